"""Tables in a shared folder: an index stored in versions, a version's manifest written last."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "version string, number long, model string, with_heading boolean, count long"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one in local mode only, where none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext._jsc.sc()
    if not context.getCheckpointDir().isDefined():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="shared-"))
    return context.getCheckpointDir().get().rstrip("/")


def written(frame: DataFrame, label: str) -> DataFrame:
    """The frame written as a table of the shared folder and read back."""
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def save(tables: dict[str, DataFrame | Callable[[dict[str, DataFrame]], DataFrame]], path: str, model: str, with_heading: bool, count: int | None = None) -> str:
    """A new version of an index: its tables, then one row of the manifest, which is what makes it the version read.

    A table may be a function of those before it, as they were written. Without a count the rows of chunks are counted.
    """
    spark = next(iter(tables.values())).sparkSession
    last = manifest(spark, path)
    version, done = uuid.uuid4().hex, {}
    for name, made in tables.items():
        frame = made(done) if callable(made) else made
        frame.write.parquet(f"{path}/{version}/{name}")
        done[name] = spark.read.schema(frame.schema).parquet(f"{path}/{version}/{name}")
    row = (version, 1 + (last.number if last else 0), model, with_heading, done["chunks"].count() if count is None else count)
    spark.createDataFrame([row], MANIFEST).coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    return version


def manifest(spark: SparkSession, path: str):
    """The newest row of the manifest, or None where nothing was saved."""
    try:
        return spark.read.schema(MANIFEST).parquet(f"{path}/manifest").orderBy(F.desc("number"), "version").limit(1).first()
    except AnalysisException:
        return None


def load(spark: SparkSession, path: str, model: str) -> dict[str, DataFrame]:
    """The tables chunks, bm25 and vectors of the newest version; another model's index, or one out of step, is an error."""
    row = manifest(spark, path)
    if row is None:
        raise FileNotFoundError(path)
    if row.model != model:
        raise ValueError(f"the index is made with {row.model}, not with {model}")
    tables = {name: spark.read.parquet(f"{path}/{row.version}/{name}") for name in ("chunks", "bm25", "vectors")}
    for name in ("bm25", "vectors"):
        odd = tables["chunks"].select("chunk_id").join(tables[name].select(F.col("chunk_id").alias("other")), F.col("chunk_id") == F.col("other"), "full_outer")
        if not odd.where("chunk_id IS NULL OR other IS NULL").isEmpty():
            raise ValueError(f"chunks and {name} are out of step")
    if tables["chunks"].count() != row["count"]:
        raise ValueError("the manifest counts other chunks")
    return tables
