"""The document library as a stored, versioned index: folders, documents, adding and removing."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import STOPWORDS, folder_of
from ..sources import store
from . import bm25
from .library import MOST_BYTES, file_name, file_name_ok, folder_name_ok

FOLDER_LOG = "folder string, made long, there boolean"
CHUNKS = "chunk_id string, source string, text string, page long"
CHUNK_NAMES = [c.split()[0] for c in CHUNKS.split(", ")]
KINDS = ["pdf", "docx", "pptx", "xlsx", "csv", "txt", "md", "html", "htm"]


def source_language(chunks: DataFrame) -> DataFrame:
    """(source, language): the language whose function words are more over all chunks of a source; the first one on a tie."""
    words = F.split(F.regexp_replace(F.lower("text"), r"(?U)\s+", " "), " ")
    count = lambda stop: F.sum(F.size(F.filter(words, lambda w: w.isin(*stop))))
    x = chunks.groupBy("source").agg(count(STOPWORDS["ro"]).alias("ro"), count(STOPWORDS["en"]).alias("en"))
    return x.select("source", F.when(F.col("en") > F.col("ro"), "en").otherwise("ro").alias("language"))


class Library:
    """Chunks, BM25 rows and vectors under `path`; every change is a new version, read once its manifest is written."""

    def __init__(self, spark: SparkSession, path: str, model: str = "none", embed=None):
        self.spark, self.path, self.model, self.embed = spark, path, model, embed
        self._loaded: tuple[str, dict[str, DataFrame]] | None = None
        if store.manifest(spark, path) is None:
            self._save(spark.createDataFrame([], CHUNKS))

    def tables(self) -> dict[str, DataFrame]:
        """The newest version's tables; a version never changes, so it is checked when it is first read."""
        row = store.manifest(self.spark, self.path)
        if self._loaded is None or row is None or self._loaded[0] != row.version:
            self._loaded = row and row.version, store.load(self.spark, self.path, self.model)
        return self._loaded[1]

    def chunks(self) -> DataFrame:
        return self.tables()["chunks"]

    def _save(self, added: DataFrame | None, stay: Callable[[DataFrame], DataFrame] | None = None) -> None:
        """A version of the rows that stay of the newest one (by source) and the chunks added; only these are tokenised."""
        old = self.tables() if stay else {}
        terms = [stay(old["bm25"])] if stay and "source" in old["bm25"].columns else []
        parts = [stay(old["chunks"])] if stay else []
        if added is not None:
            parts.append(store.written(added.select(*CHUNK_NAMES), "chunks"))
        # A version made before its BM25 rows had a source is tokenised anew.
        terms += [bm25.index(x, key="chunk_id", keep=("source",)) for x in parts[len(terms):]]

        def indexed(done: dict[str, DataFrame]) -> DataFrame:
            if not done["chunks"].groupBy("chunk_id").count().where("count > 1").isEmpty():
                raise ValueError("a chunk id occurs twice")
            return reduce(DataFrame.unionByName, terms)

        def vectors(done: dict[str, DataFrame]) -> DataFrame:
            return self.embed(done["chunks"]) if self.embed else done["chunks"].select("chunk_id", F.lit(None).cast("array<double>").alias("embedding"))

        chunks = reduce(DataFrame.unionByName, [x.select(*CHUNK_NAMES) for x in parts])
        store.save({"chunks": chunks, "bm25": indexed, "vectors": vectors}, self.path, self.model, True)

    def _folder_log(self) -> DataFrame:
        try:
            return self.spark.read.schema(FOLDER_LOG).parquet(f"{self.path}/folders")
        except AnalysisException:  # no folder was made yet
            return self.spark.createDataFrame([], FOLDER_LOG)

    def _names(self) -> DataFrame:
        return self._folder_log().groupBy("folder").agg(F.max_by("there", "made").alias("there")).where("there").select("folder")

    def _log(self, folder: str, there: bool) -> None:
        row = (folder, self._folder_log().count(), there)
        self.spark.createDataFrame([row], FOLDER_LOG).coalesce(1).write.mode("append").parquet(f"{self.path}/folders")

    def folders(self) -> DataFrame:
        """(folder, documents, chunks), empty folders included."""
        found = self.chunks().groupBy(folder_of(F.col("source")).alias("folder")).agg(F.count_distinct("source").alias("documents"), F.count("*").alias("chunks"))
        both = found.join(self._names(), "folder", "full_outer")
        return both.select("folder", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("chunks", F.lit(0)).alias("chunks"))

    def create_folder(self, name: str) -> str:
        name = name.strip()
        if not self.spark.range(1).select(folder_name_ok(F.lit(name))).first()[0]:
            raise ValueError(f"not a folder name: {name!r}")
        if not self.folders().where(F.lower("folder") == name.lower()).isEmpty():
            raise FileExistsError(name)
        self._log(name, True)
        return name

    def delete_folder(self, name: str, with_documents: bool = False) -> int:
        found = self.folders().where(F.col("folder") == name).first()
        if found is None:
            raise KeyError(name)
        if found.documents and not with_documents:
            raise ValueError(f"{name} holds {found.documents} documents")
        if found.documents:
            self._save(None, lambda x: x.where(folder_of(F.col("source")) != name))
        if not self._names().where(F.col("folder") == name).isEmpty():
            self._log(name, False)
        return found.documents

    def sources(self, folder: str | None = None) -> DataFrame:
        x = self.chunks().select("source").distinct()
        return x if folder is None else x.where(folder_of(F.col("source")) == folder)

    def documents(self, folder: str | None = None) -> DataFrame:
        """(source, folder, language, chunks, num_chars, pages)."""
        x = self.chunks().join(self.sources(folder), "source", "left_semi")
        sums = x.groupBy("source").agg(F.count("*").alias("chunks"), F.sum(F.length("text")).alias("num_chars"), F.max(F.coalesce("page", F.lit(0))).alias("pages"))
        return sums.join(source_language(x), "source").select("source", folder_of(F.col("source")).alias("folder"), "language", "chunks", "num_chars", "pages")

    def add(self, chunks: DataFrame, replace: bool = False) -> dict[str, int]:
        """Adds the chunks of new documents; documents that are there already are an error, or are replaced."""
        names = chunks.select("source").distinct()
        bad = names.where(~file_name_ok(file_name(F.col("source")), KINDS)).first()
        if bad:
            raise ValueError(f"not a usable file name: {bad.source!r}")
        old = self.chunks()
        there = old.select("source").distinct().join(names, "source", "left_semi").count()
        if there and not replace:
            raise FileExistsError(f"{there} documents are there already")
        self._save(chunks, lambda x: x.join(names, "source", "left_anti") if there else x)
        return {"chunks": chunks.count(), "replaced": there}

    def remove(self, sources: list[str]) -> int:
        """Removes documents; returns how many there were. Nothing is written for an empty list."""
        gone = self.spark.createDataFrame([(s,) for s in sources], "source string").distinct()
        there = self.sources().join(gone, "source", "left_semi").count() if sources else 0
        if there:
            self._save(None, lambda x: x.join(F.broadcast(gone), "source", "left_anti"))  # a list of the driver
        return there

    def scope(self, folder: str | None) -> DataFrame:
        """The sources that a search may see: all of them, or a folder's, which must be there."""
        if folder is not None and self.folders().where(F.col("folder") == folder).isEmpty():
            raise KeyError(folder)
        return self.sources(folder)

    def search(self, questions: DataFrame, k: int = 10, folder: str | None = None) -> DataFrame:
        """BM25 hits in the folder's documents, by statistics of the whole library."""
        tables = self.tables()
        allowed = tables["chunks"].join(self.scope(folder), "source", "left_semi").select("chunk_id")
        return bm25.top_k(tables["bm25"], questions, k, key="chunk_id", allowed=allowed)

    def file_size_ok(self, size: int) -> bool:
        return size <= MOST_BYTES
