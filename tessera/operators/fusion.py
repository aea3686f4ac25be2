"""Reciprocal rank fusion of ranked lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K = 60


def fuse(rankings: DataFrame, limit: int, k: int = K) -> DataFrame:
    """(qid, id, score, dense_rank, pos) from rows (qid, list_name, id, rank).

    Order: fused score, then the best rank among the lists whose name starts with dense, then id.
    """
    dense = F.min(F.when(F.col("list_name").startswith("dense"), F.col("rank")))
    fused = rankings.groupBy("qid", "id").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 9).alias("score"), F.coalesce(dense, F.lit(1000000)).cast("long").alias("dense_rank"))
    by = Window.partitionBy("qid").orderBy(F.desc("score"), "dense_rank", "id")
    return fused.withColumn("pos", F.row_number().over(by).cast("long")).where(F.col("pos") <= limit)
