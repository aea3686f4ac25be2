"""A corpus pipeline of five stages; each one's result is written as Parquet and reread as the next one's documents.

All stages but the last return the columns of their documents, whatever those are named, and judge all of their input.  Null texts and
texts without words are rejected by the quality rules.  Rows that share a doc_id, or have none, are rows of their own: one goes only where its
text equals, or is linked to, that of a row that stays.  An empty table gives an empty result.  The tables are written into the shared folder
that the session names (`spark.checkpoint.dir`) and stay there; whoever names the folder clears it.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, exact_dedup, mixing, quality_rules, simhash
from tessera.llm.common import shared_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the policy rejects go."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), "text")
    marked = quality_rules.apply_policy(quality_rules.ledger(rows), "v1")
    return marked.where("kept").select("row.*")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest doc_id stays."""
    return exact_dedup.drop_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of linked fingerprints stays."""
    return simhash.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes, a row per block and epoch: a shard's rows stand together, in shuffled order."""
    return mixing.mixed_documents(docs).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded texts."""
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality_rules", quality), ("exact_dedup", exact), ("simhash_near_dedup", near), ("mixing", mix), ("bpe", tokens)]
ORACLE_SQL = None  # SimHash components, the mix's permutations and BPE are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{base}/{i}-{name}")
        docs = spark.read.schema(out.schema).parquet(f"{base}/{i}-{name}")
    return docs
