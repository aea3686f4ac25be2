"""Fixed token windows, chunk ids and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_TOKENS, OVERLAP, MIN_TOKENS = 400, 60, 100


def chunk_fixed(docs: DataFrame, most: int = MAX_TOKENS, overlap: int = OVERLAP, least: int = MIN_TOKENS) -> DataFrame:
    """(doc_id, chunk_index, start_token, end_token, chunk_id): windows of `most` tokens, a short last one joined to the one before.

    Narrow: a document's windows come from its token count; no shuffle.
    """
    step, short = most - overlap, min(least, most // 2)
    n = F.size(F.filter(F.split(F.regexp_replace("text", r"[\x20\x09-\x0D]+", " "), " "), lambda w: w != ""))
    base = docs.select("doc_id", n.cast("long").alias("n")).where("n > 0")
    # Windows until one reaches the end; the last is dropped if short, and the one before then takes its tokens.
    last = F.greatest(F.lit(0), F.ceil((F.col("n") - most) / step)).cast("long")
    base = base.withColumn("last", last).withColumn("last", F.when((F.col("last") > 0) & (F.col("n") - F.col("last") * step < short), F.col("last") - 1).otherwise(F.col("last")))
    rows = base.select("doc_id", "n", "last", F.explode(F.expr("sequence(0L, last)")).alias("chunk_index"))
    start = F.col("chunk_index") * step
    end = F.when(F.col("chunk_index") == F.col("last"), F.col("n")).otherwise(start + most)
    rows = rows.select("doc_id", "chunk_index", start.alias("start_token"), end.alias("end_token"))
    return rows.withColumn("chunk_id", F.substring(F.sha2(F.concat_ws("|", F.col("doc_id").cast("string"), F.lit("fixed"), F.col("start_token").cast("string"), F.col("end_token").cast("string")), 256), 1, 16))


def chunk_stats(chunks: DataFrame) -> DataFrame:
    size = F.col("end_token") - F.col("start_token")
    return chunks.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.min(size).alias("min_tokens"), F.floor(F.avg(size)).cast("long").alias("avg_tokens"), F.max(size).alias("max_tokens"))
