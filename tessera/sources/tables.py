"""Tables of documents, chunks and judgements; every reader names its schema, so no pass infers one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT = "doc_id string, source string, text string, content_hash string, num_chars long, metadata map<string,string>"
CHUNK = "chunk_id string, doc_id string, source string, chunk_index long, strategy string, text string, heading_path string, start_char long, end_char long, page long, num_chars long, num_tokens long"


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_jsonl(frame: DataFrame, path: str) -> None:
    frame.write.mode("overwrite").json(path)


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """(qid, did, rel) of the judgements above zero in tab-separated files with a header."""
    return spark.read.schema("qid string, did string, rel int").csv(path, sep="\t", header=True).where("rel > 0")


def as_documents(corpus: DataFrame, dataset: str) -> DataFrame:
    """Benchmark rows (_id, title, text) as documents: a heading of the title, then the text."""
    titled = F.when(F.coalesce("title", F.lit("")) != "", F.concat(F.lit("# "), "title", F.lit("\n\n"), "text")).otherwise(F.col("text"))
    return corpus.select(F.concat(F.lit(f"{dataset}/"), "_id").alias("source"), titled.alias("text"))


def document_text(documents: DataFrame, source: str) -> DataFrame:
    """The text of one source; the filter reaches the Parquet scan."""
    return documents.where(F.col("source") == source).select("text")
