"""Retrieval metrics."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Z = 1.96


def wilson(k: Column, n: Column, z: float = Z) -> tuple[Column, Column]:
    """The bounds of the Wilson interval, (0, 0) without trials."""
    p = k / F.nullif(n, F.lit(0))
    d = 1 + z * z / n
    mid = (p + z * z / (2 * n)) / d
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4.0 * n * n)) / d
    low, high = F.greatest(F.lit(0.0), mid - half), F.least(F.lit(1.0), mid + half)
    return F.round(F.when(n > 0, low).otherwise(0.0), 6), F.round(F.when(n > 0, high).otherwise(0.0), 6)


def summarize(ranks: DataFrame, by: list[str]) -> DataFrame:
    """Hit rates at 1, 3, 5, 10 and MRR over the first ten, from a nullable `rank` per question."""
    hit = lambda k: F.sum(F.when(F.col("rank") <= k, 1).otherwise(0)).cast("long").alias(f"hit_{k}")
    mrr = F.round(F.avg(F.when(F.col("rank") <= 10, 1.0 / F.col("rank")).otherwise(0.0)), 6).alias("mrr")
    return ranks.groupBy(*by).agg(F.count("*").alias("n"), *[hit(k) for k in (1, 3, 5, 10)], mrr)


def ndcg(run: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """(qid, ndcg): linear gain over log2(pos + 1), the ideal from all judged rows; run has qid, did, pos; qrels qid, did, rel."""
    gain = F.col("rel") / F.log2(F.col("pos") + 1.0)
    got = run.where(f"pos <= {k}").join(qrels, ["qid", "did"]).groupBy("qid").agg(F.sum(gain).alias("dcg"))
    ideal = qrels.withColumn("pos", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("rel"), "did"))).where(f"pos <= {k}").groupBy("qid").agg(F.sum(gain).alias("best"))
    return ideal.join(got, "qid", "left").select("qid", F.round(F.coalesce("dcg", F.lit(0.0)) / F.col("best"), 6).alias("ndcg"))


def document_ranking(run: DataFrame) -> DataFrame:
    """(qid, did, pos): documents in the order their first chunk appears; run has qid, did, pos by chunk."""
    first = run.groupBy("qid", "did").agg(F.min("pos").alias("first"))
    return first.select("qid", "did", F.row_number().over(Window.partitionBy("qid").orderBy("first", "did")).alias("pos"))


def scores(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """(qid, recall_5, recall_10, mrr_10): shares of the relevant documents found, and the first one's reciprocal rank."""
    rel = qrels.where("rel > 0")
    found = run.join(rel, ["qid", "did"]).groupBy("qid").agg(
        *[F.count_if(F.col("pos") <= k).alias(f"f{k}") for k in (5, 10)], F.min("pos").alias("first"))
    per = rel.groupBy("qid").agg(F.count("*").alias("n")).join(found, "qid", "left")
    return per.select("qid", *[F.round(F.coalesce(f"f{k}", F.lit(0)) / F.col("n"), 6).alias(f"recall_{k}") for k in (5, 10)],
                      F.round(F.when(F.col("first") <= 10, 1.0 / F.col("first")).otherwise(0.0), 6).alias("mrr_10"))


def overlapping(chunks: DataFrame, gold: DataFrame, key: str = "doc_id") -> DataFrame:
    """Pairs of chunks and gold spans of one document that share a position; both have `start` and `end`, half open."""
    c, g = chunks.alias("c"), gold.alias("g")
    return c.join(g, (F.col(f"c.{key}") == F.col(f"g.{key}")) & (F.col("c.start") < F.col("g.end")) & (F.col("g.start") < F.col("c.end")))


def paired_differences(values: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(pair, qid, diff) for values (config, qid, value)."""
    names = values.sparkSession.createDataFrame(pairs, "a string, b string")  # a handful of rows
    a, b = values.select("qid", F.col("config").alias("a"), F.col("value").alias("x")), values.select("qid", F.col("config").alias("b"), F.col("value").alias("y"))
    return a.join(names, "a").join(b, ["qid", "b"]).select(F.concat("a", F.lit(" - "), F.col("b")).alias("pair"), "qid", (F.col("x") - F.col("y")).alias("diff"))


def bootstrap(values: DataFrame, by: str, value: str, order: str, rounds: int = 10_000, seed: int = 0) -> DataFrame:
    """(by, mean, low, high): the mean and the 2.5 and 97.5 percentiles of resampled means.

    A group is an evaluation set (one row per question); resampled in slices of rounds so that memory stays at one slice.
    """
    kind = values.schema[by].dataType.simpleString()

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        x = rows.sort_values(order)[value].to_numpy(dtype=float)
        rng, means = np.random.default_rng(seed), []
        step = max(1, 4_000_000 // max(1, len(x)))
        for i in range(0, rounds, step):
            means.append(x[rng.integers(0, len(x), (min(step, rounds - i), len(x)))].mean(axis=1))
        low, high = np.percentile(np.concatenate(means), [2.5, 97.5])
        return pd.DataFrame({by: [key[0]], "mean": [x.mean()], "low": [low], "high": [high]})

    return values.groupBy(by).applyInPandas(run, f"{by} {kind}, mean double, low double, high double")


def answers_report(answers: DataFrame, relevant: DataFrame) -> DataFrame:
    """One row over answers (qid, found, refusal, answerable, cited, invalid, seconds) and relevant (qid, n), source numbers that meet gold."""
    gold = relevant.groupBy("qid").agg(F.collect_set("n").alias("gold"))
    x = answers.join(gold, "qid", "left").withColumn("gold", F.coalesce("gold", F.array().cast("array<bigint>")))
    able = F.col("answerable")
    return x.agg(
        F.count_if(able).alias("answerable"), F.count_if(able & (F.size("gold") > 0)).alias("gold_in_sources"), F.count_if(able & F.col("found")).alias("answered"),
        F.count_if(able & F.col("found") & F.arrays_overlap("cited", "gold")).alias("cites_gold"), F.count_if(~able).alias("unanswerable"),
        F.count_if(~able & ~F.col("found")).alias("refused"), F.count_if(F.size("invalid") > 0).alias("invented"), F.round(F.avg("seconds"), 6).alias("mean_seconds"))
