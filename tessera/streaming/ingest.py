"""Documents that arrive over time: chunked as they come, the last version of each source kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import chunkers


def arrivals(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def ingest(docs: DataFrame, out: str, checkpoint: str, strategy: str = "structure", **options) -> StreamingQuery:
    """Chunks of every arriving (doc_id, text) appended under `out`, one folder per batch.

    A batch that runs again after a failure overwrites its own folder, so each document counts once.
    """

    def write(batch: DataFrame, number: int) -> None:
        chunkers.chunk(batch, strategy, **options).write.mode("overwrite").parquet(f"{out.rstrip('/')}/batch={number}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, out: str) -> DataFrame:
    """The chunks of each document's last batch."""
    chunks = spark.read.option("basePath", out).parquet(out)
    last = chunks.groupBy("doc_id").agg(F.max("batch").alias("batch"))
    return chunks.join(last, ["doc_id", "batch"], "left_semi")


def counts(events: DataFrame, every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, kind, n) by event time, late rows taken up to the watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", every), F.col("event_type").alias("kind")).agg(F.count("*").alias("n")).select(
        F.col("window.start").alias("start"), "kind", "n")
