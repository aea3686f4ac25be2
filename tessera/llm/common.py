"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value of the contracts: the characters that separate words.
WS = r"\x20\x09-\x0D"
WORD = rf"[^{WS}]+"
HOT_GROUPS = 2_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def squeezed(text: Column) -> Column:
    """Null as empty, each run of white space as one space.

    Plain byte replacements first: only the texts that then hold two spaces in a row meet a regular expression.
    """
    flat = F.coalesce(text, F.lit(""))
    for c in "\t\n\x0b\x0c\r":
        flat = F.replace(flat, F.lit(c), F.lit(" "))
    return F.transform(
        F.array(flat), lambda t: F.when(F.contains(t, F.lit("  ")), F.regexp_replace(t, "  +", " ")).otherwise(t)
    )[0]


def word_list(text: Column) -> Column:
    """The words of a text in order; an empty array when there is none."""
    flat = F.btrim(squeezed(text), F.lit(" "))
    return F.when(flat == "", F.array().cast("array<string>")).otherwise(F.split(flat, " "))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`, or the context's checkpoint folder.

    Where neither is set a temporary folder is made, but in local mode only: on a cluster executors wouldn't see it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def written(df: DataFrame, label: str) -> DataFrame:
    """`df` written as a table in the shared folder and read back: cuts the lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str) -> DataFrame:
    """`rows` joined to their group's row by `key`; `size` is the group's number of rows.

    A group with more than 1 / HOT_GROUPS of all rows is hot.  There are fewer than HOT_GROUPS of these at any size, so they are
    broadcast and their rows never meet in one task; no other key brings more than that share to a task.
    """
    every = groups.agg(F.sum(size).alias("_all"))
    hot = groups.crossJoin(F.broadcast(every)).where(F.col(size) * HOT_GROUPS > F.col("_all")).drop("_all")
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rows.join(F.broadcast(hot), key).unionByName(rest.join(groups, key))


@contextmanager
def arrow_batches(spark: SparkSession, most: int) -> Iterator[None]:
    """Arrow batches of about `most` bytes for the actions inside: a task holds a batch's buffers several times over."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, most)
    try:
        yield
    finally:
        spark.conf.set(key, before)
