"""Exact cosine search for a set of query vectors, by matrix products."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOGETHER = 16_384  # questions broadcast and multiplied at a time: 64 dimensions of them take 8 MB
ROWS, COLUMNS = 4_096, 1_024  # vectors and questions in a product


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def top_k(vectors: DataFrame, questions: DataFrame, k: int, partition: list[str] | None = None) -> DataFrame:
    """(qid, vec_id, score, rank) of the k nearest for each question (qid, qvec), or for each question and partition.

    The questions are broadcast, at most TOGETHER at a time; the vectors stay where they are read.  Each batch of them is multiplied with
    the questions, and a task passes on only what may still be among its k best; the final ranking sees that.  Equal scores go to the smaller id.
    """
    spark, out = vectors.sparkSession, None
    keep = [c for c in vectors.columns if c != "embedding"]
    part = partition or []
    kinds = dict(vectors.dtypes)
    qtype = dict(questions.dtypes)["qid"]
    asked = questions.select("qid", "qvec").toPandas()  # a stated question set, in blocks below
    schema = ", ".join([f"qid {qtype}", *(f"{c} {kinds[c]}" for c in keep), "score double"])
    for lo in range(0, max(1, len(asked)), TOGETHER):
        block = asked.iloc[lo : lo + TOGETHER]
        sent = spark.sparkContext.broadcast((block["qid"].to_numpy(), np.array(block["qvec"].tolist(), dtype=np.float64).reshape(len(block), -1)))
        found = vectors.select("embedding", *keep).mapInArrow(_nearest(sent, keep, part, k), schema)
        out = found if out is None else out.unionByName(found)
    by = Window.partitionBy("qid", *part).orderBy(F.desc("score"), "vec_id")
    return out.withColumn("score", F.round("score", 6)).withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def _nearest(sent, keep: list[str], part: list[str], k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, q = sent.value
        least: dict[tuple, np.ndarray] = {}  # the k-th best so far of each partition and question
        for batch in (b.slice(lo, ROWS) for b in batches for lo in range(0, b.num_rows, ROWS)):
            if not len(qids):
                continue
            x = np.array(batch.column(0).to_pylist(), dtype=np.float64).reshape(batch.num_rows, -1)
            names = list(zip(*(batch.column(1 + keep.index(c)).to_pylist() for c in part))) if part else [()] * batch.num_rows
            rows_of: dict[tuple, list[int]] = {}
            for i, name in enumerate(names):
                rows_of.setdefault(name, []).append(i)
            for name, rows in rows_of.items():
                for left in range(0, len(qids), COLUMNS):
                    score = x[rows] @ q[left : left + COLUMNS].T
                    shown = np.round(score, 5)  # a place less than is shown, so that nothing near a tie is lost
                    kth = np.partition(shown, len(rows) - k, axis=0)[len(rows) - k] if len(rows) > k else np.full(score.shape[1], -np.inf)
                    bar = least[name, left] = np.maximum(least.get((name, left), kth), kth)
                    r, c = np.nonzero(shown >= bar[None, :])
                    if len(r):
                        at = pa.array(np.array(rows)[r])
                        yield pa.RecordBatch.from_arrays([pa.array(qids[left + c]), *(batch.column(1 + i).take(at) for i in range(len(keep))), pa.array(score[r, c])], names=["qid", *keep, "score"])

    return run
