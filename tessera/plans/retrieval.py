"""Whole-batch retrieval plans over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..operators import bm25, fusion, vectors
from ..sources.store import written

_indexes: dict[tuple, DataFrame] = {}
_stats: dict[tuple, DataFrame] = {}


def indexed(spark: SparkSession, sf_dir: str, words=tokens) -> DataFrame:
    """The BM25 index of a folder's documents, with lang and source: tokenised and written once a session, read by every query after that."""
    key = spark.sparkContext.applicationId, sf_dir, words
    if key not in _indexes:
        docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
        most = spark.sparkContext.defaultParallelism
        if docs.rdd.getNumPartitions() < most:  # a small table in few files: all cores tokenise
            docs = docs.repartition(most)
        _indexes[key] = written(bm25.index(docs, words=words, keep=("lang", "source")), "bm25")
    return _indexes[key]


def stats(spark: SparkSession, sf_dir: str, words=tokens) -> DataFrame:
    """The index's statistics of terms, written once a session as well."""
    key = spark.sparkContext.applicationId, sf_dir, words
    if key not in _stats:
        _stats[key] = written(bm25.term_stats(indexed(spark, sf_dir, words)), "stats")
    return _stats[key]


def best(spark: SparkSession, sf_dir: str, k: int, words=tokens, **more) -> DataFrame:
    """BM25's k best documents of each question, by the stored index and statistics."""
    questions = inputs(spark, sf_dir)[2]
    return bm25.top_k(indexed(spark, sf_dir, words), questions, k, words=words, stats=stats(spark, sf_dir, words), **more)


def inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(documents, vectors, questions, question vectors)."""
    read = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    docs = read("documents").select("doc_id", "text", "lang", "source")
    vecs = read("embeddings").select("vec_id", "embedding")
    questions = read("benchmark").select(F.col("item_id").alias("qid"), "text")
    qvecs = vecs.join(questions.select("qid"), F.col("vec_id") == F.col("qid")).select("qid", F.col("embedding").alias("qvec"))
    return docs, vecs, questions, qvecs


def rankings(spark: SparkSession, sf_dir: str, k: int = 10, per_language: bool = False, source: str | None = None) -> DataFrame:
    """(qid, list_name, id, rank): one BM25 and one cosine list per question, or per question and language."""
    docs, vecs, _, qvecs = inputs(spark, sf_dir)
    allowed = docs.select("doc_id", "lang") if source is None else docs.where(F.col("source") == source).select("doc_id", "lang")
    part = ["lang"] if per_language else None
    name = lambda n: F.concat(F.lit(f"{n}:"), F.col("lang")) if per_language else F.lit(n)
    sparse = best(spark, sf_dir, k, allowed=None if source is None else F.col("source") == source, partition=part)
    near = vectors.top_k(vecs.join(allowed, F.col("vec_id") == F.col("doc_id")).select("vec_id", "embedding", "lang"), qvecs, k, part)
    return sparse.select("qid", name("sparse").alias("list_name"), F.col("doc_id").alias("id"), "rank").unionByName(
        near.select("qid", name("dense").alias("list_name"), F.col("vec_id").alias("id"), "rank"))


def hybrid(spark: SparkSession, sf_dir: str, limit: int = 5, **more) -> DataFrame:
    return fusion.fuse(rankings(spark, sf_dir, **more), limit)


def with_documents(hits: DataFrame, docs: DataFrame) -> DataFrame:
    """Hits (id ...) of the stated question set, a few each, and the columns of their documents: the hits are broadcast, the texts stay where they are read."""
    return docs.withColumnRenamed("doc_id", "id").join(F.broadcast(hits), "id")
