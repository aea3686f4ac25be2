"""Reviewing answers and quotes: verdicts, context, constraints; and what a client shows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .metrics import wilson

# The verdicts by kind of question, and the context shown around a quote.
VERDICTS = {"answerable": ("correct", "partial", "wrong", "missed"), "unanswerable": ("refused", "wrong")}
CONTEXT = 500


def summary(ranks: DataFrame, by: str) -> DataFrame:
    """Hit rates with their intervals and MRR, over all questions (by is null) and by kind, from one pass: grouping sets."""
    hits = [F.count_if(F.col("rank") <= k).alias(f"found_{k}") for k in (1, 3, 5, 10)]
    mrr = F.round(F.avg(F.when(F.col("rank") <= 10, 1.0 / F.col("rank")).otherwise(0.0)), 6).alias("mrr")
    x = ranks.groupingSets([[by], []], by).agg(F.grouping(by).cast("long").alias("overall"), F.count("*").alias("n"), *hits, mrr)
    for k in (1, 3, 5, 10):
        low, high = wilson(F.col(f"found_{k}"), F.col("n"))
        x = x.withColumns({f"low_{k}": low, f"high_{k}": high})
    return x


def review_statistics(answers: DataFrame) -> DataFrame:
    """One row over answers (answerable, verdict, proposed): counts, shares with intervals, agreement with what was proposed."""
    able, judged = F.col("answerable"), F.col("verdict").isNotNull()
    x = answers.agg(
        F.count_if(judged).alias("judged"), F.count_if(~judged).alias("open"), F.count_if(able & judged).alias("n"),
        F.count_if(able & (F.col("verdict") == "correct")).alias("correct"), F.count_if(able & F.col("verdict").isin("correct", "partial")).alias("correct_or_partial"),
        F.count_if(~able & (F.col("verdict") == "refused")).alias("refused"), F.count_if(~able & judged).alias("unanswerable"),
        F.count_if(judged & F.col("proposed").isNotNull()).alias("proposed"), F.count_if(judged & (F.col("verdict") == F.col("proposed"))).alias("agreed"))
    low, high = wilson(F.col("correct"), F.col("n"))
    return x.withColumns({"low": low, "high": high})


def verdict_problem(answerable: Column, verdict: Column, gold: Column) -> Column:
    """Why a review can't be saved, null if it can: a verdict of the other kind, gold where there can't be any, or none where there must be."""
    domain = F.when(answerable, F.array(*map(F.lit, VERDICTS["answerable"]))).otherwise(F.array(*map(F.lit, VERDICTS["unanswerable"])))
    return (
        F.when(answerable & (gold == 0), "an answerable question needs a quote").when(~answerable & (gold > 0), "an unanswerable question has no quote")
        .when(verdict.isNotNull() & ~F.array_contains(domain, verdict), "not a verdict of this kind")
    )


def gold_view(text: Column, start: Column, end: Column, around: int = CONTEXT) -> tuple[Column, Column, Column]:
    """(context, mark start, mark end): a quote with `around` characters on each side, and where it stands in that."""
    low = F.greatest(F.lit(0), start - around)
    high = F.least(F.length(text), end + around)
    return F.substring(text, (low + 1).cast("int"), (high - low).cast("int")), start - low, end - low


def marks(spans: DataFrame) -> DataFrame:
    """Spans (doc_id, start, end) to highlight, in order; one that starts before the last shown ends is left out.

    Which is shown depends on the one shown before: a fold over a text's sorted spans, in its row.
    """
    ordered = spans.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("all"))
    empty = F.lit(None).cast(ordered.schema["all"].dataType)
    shown = F.aggregate("all", F.coalesce(empty, F.array().cast(ordered.schema["all"].dataType)), lambda a, x: F.when((F.size(a) == 0) | (F.element_at(a, -1)["end"] <= x["start"]), F.concat(a, F.array(x))).otherwise(a))
    return ordered.select("doc_id", F.inline(shown))


def slides(blocks: DataFrame) -> DataFrame:
    """Blocks (doc_id, i, level, text) with the number of their slide: a heading of level 1 begins one, what is before the first goes, notes are told apart."""
    before = Window.partitionBy("doc_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    numbered = blocks.withColumn("slide", F.sum(F.when(F.col("level") == 1, 1).otherwise(0)).over(before)).where("slide > 0")
    return numbered.withColumn("notes", F.startswith("text", F.lit("Speaker notes:")))


def page_changes(blocks: DataFrame) -> DataFrame:
    """Blocks (doc_id, i, page) with `turns`: whether the page is another than the block's before."""
    last = F.lag("page").over(Window.partitionBy("doc_id").orderBy("i"))
    return blocks.withColumn("turns", last.isNotNull() & (last != F.col("page")))


def upper_median(values: Column) -> Column:
    """The element at half the length of the sorted values, the upper one of two."""
    ordered = F.array_sort(F.collect_list(values))
    return F.get(ordered, F.floor(F.size(ordered) / 2).cast("int"))
