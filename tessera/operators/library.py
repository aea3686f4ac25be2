"""The document library: summaries, upsert, deletion, consistency."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean_heading, usable_heading


def folders(docs: DataFrame, chunks: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """(folder, documents, chunks), folders without documents included."""
    out = docs.join(chunks.groupBy("doc_id").agg(F.count("*").alias("c")), "doc_id", "left").groupBy(F.col("source").alias("folder")).agg(
        F.count("*").alias("documents"), F.sum(F.coalesce("c", F.lit(0))).cast("long").alias("chunks"))
    if names is not None:
        out = out.join(names, "folder", "full_outer").select("folder", F.coalesce("documents", F.lit(0)).cast("long").alias("documents"), F.coalesce("chunks", F.lit(0)).cast("long").alias("chunks"))
    return out


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of `new`, and those of `old` whose key isn't among them."""
    return old.join(new, key, "left_anti").unionByName(new)


def delete(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return rows.join(gone, key, "left_anti")


def sync_problems(a: DataFrame, b: DataFrame, key: str, names: tuple[str, str]) -> DataFrame:
    """(problem, n): ids on one side only, and ids that occur twice."""
    only = lambda x, y, n: x.join(y, key, "left_anti").agg(F.lit(f"only in {n}").alias("problem"), F.count("*").alias("n"))
    twice = a.groupBy(key).agg(F.count("*").alias("c")).where("c > 1").agg(F.lit(f"twice in {names[0]}").alias("problem"), F.count("*").alias("n"))
    return only(a, b, names[0]).unionByName(only(b, a, names[1])).unionByName(twice)


def topics(headings: DataFrame, limit: int = 4) -> DataFrame:
    """(heading, doc_id, pos) of rows (doc_id, heading_path): readable headings of one document only, one per document first.

    Counts come before any window, so a heading that all documents share is one row by then.
    """
    last = clean_heading(F.element_at(F.split("heading_path", " > "), -1))
    one = headings.select("doc_id", last.alias("heading")).where(usable_heading(F.col("heading"))).groupBy("doc_id", "heading").agg(F.lit(1).alias("one"))
    alone = one.groupBy(F.lower("heading").alias("low")).agg(F.countDistinct("doc_id").alias("docs"), F.min("doc_id").alias("doc_id"), F.min("heading").alias("heading")).where("docs = 1")
    turn = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.md5("heading"), "heading"))
    ranked = alone.select("heading", "doc_id", turn.alias("turn")).orderBy("turn", F.md5("heading"), "doc_id").limit(limit)
    return ranked.select("heading", "doc_id", F.row_number().over(Window.orderBy("turn", F.md5("heading"), "doc_id")).cast("long").alias("pos"))


# Folder names allowed, device names refused, the largest file.
FOLDER = r"^[\p{L}\p{N}_][\p{L}\p{N}_ .-]{0,63}$"
RESERVED = r"(?i)^(con|prn|aux|nul|com[0-9]|lpt[0-9])(\..*)?$"
MOST_BYTES = 50 * 1024 * 1024


def folder_name_ok(name: F.Column) -> F.Column:
    """Whether a name, white space around it aside, may name a folder."""
    bare = F.regexp_replace(name, r"(?U)^\s+|\s+$", "")
    return F.regexp_like(bare, F.lit(FOLDER)) & ~F.regexp_like(bare, F.lit(RESERVED)) & ~F.endswith(bare, F.lit("."))


def file_name(name: F.Column) -> F.Column:
    """The last component of an uploaded file's name."""
    return F.regexp_extract(F.regexp_replace(name, r"(?U)^\s+|\s+$", ""), r"[^\\/]*$", 0)


def file_name_ok(name: F.Column, kinds: list[str]) -> F.Column:
    """Whether the last component may name a file of a known kind (extensions without the dot)."""
    bare = file_name(name)
    kind = F.lower(F.regexp_extract(bare, r"^.+\.([^.]+)$", 1))
    return (bare != "") & ~F.startswith(bare, F.lit(".")) & (F.length(bare) <= 160) & ~F.regexp_like(bare, F.lit(RESERVED)) & kind.isin(*kinds)


def repeated_lines(lines: DataFrame, share: float = 0.6) -> DataFrame:
    """(source, key, pages) of the lines (source, page, key) on at least `share` of a document's pages, two at the least, of three pages or more."""
    pages = lines.select("source", "page").distinct().groupBy("source").agg(F.count("*").alias("all"))
    found = lines.select("source", "page", "key").distinct().groupBy("source", "key").agg(F.count("*").alias("pages"))
    enough = F.greatest(F.lit(2), F.bround(share * F.col("all"), 0))
    return found.join(pages, "source").where((F.col("all") >= 3) & (F.col("pages") >= enough)).select("source", "key", "pages")
