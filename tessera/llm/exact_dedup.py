"""Exact deduplication by content-defined chunk recipes, in DataFrame operations only.

A text, its white space squeezed, is cut where its own characters say so, so that a passage gives the same chunks wherever it
stands, but for the one it begins in and the one it ends in.  Each distinct chunk gets a verified identifier: a 64-bit hash, and the rank
of the chunk among the chunks of that hash.  A document becomes its recipe, the ordered list of its
identifiers, and two texts are equal exactly when their recipes are.  The chunks of the whole table are
shuffled once, after a map-side combine, to verify the hashes; grouping and joining move recipes of eight
bytes a chunk and never the texts.  Groups that hold many of all rows join by broadcast (`join_groups`).

Nulls: a null text counts as empty, and all empty texts are equal.  A null doc_id sorts after the others
as a candidate to stay (it stays only in a group without any other).  Repeated rows of one doc_id are
kept as rows: each one that shares the smallest doc_id is marked as staying.  Very long texts give long recipes and nothing else.
An empty table gives an empty result.  Extra columns are ignored by `exact_duplicates`, whatever their names, and kept by
`drop_duplicates`, which keeps one row of each group, whatever ids others share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_groups, squeezed, written

MIN_CHARS, MAX_CHARS = 64, 4096


def _residue_class(modulus: int, residue: int) -> str:
    """A character class of the Latin-1 letters whose code leaves that residue (one bitmap for the regex engine)."""
    return "[" + "".join(f"\\x{c:02x}" for c in range(0x21, 0x100) if c % modulus == residue) + "]"


def chunk_array(text: Column, least: int = MIN_CHARS, most: int = MAX_CHARS) -> Column:
    """The chunks of a squeezed text in order: to the first cut beyond `least` characters, or `most` of them.

    A cut stands after three letters of fixed residues, about one place in some hundreds, so it depends on content only.  Where none
    comes, as in scripts beyond Latin, chunks have `most` characters; equality of recipes holds all the same.
    """
    cut = _residue_class(8, 5) + _residue_class(8, 4) + _residue_class(8, 1)
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{{least},{most}}}?(?<={cut})|.{{1,{most}}}"), 0)


def chunk_hash(chunk: Column) -> Column:
    return F.xxhash64(chunk)


def recipes(docs: DataFrame, least: int = MIN_CHARS, most: int = MAX_CHARS, hashed=chunk_hash) -> DataFrame:
    """(doc_id, recipe, text_sha256): recipe is the ordered list of verified identifiers of the chunks."""
    base = docs.select("doc_id", squeezed(F.col("text")).alias("flat"))
    chunks = base.select(F.explode(chunk_array(F.col("flat"), least, most)).alias("chunk"))
    # Distinct contents; map-side combine moves a chunk that a task sees often only once.
    distinct = chunks.select(hashed(F.col("chunk")).alias("h"), "chunk").groupBy("h", "chunk").agg(F.lit(1).alias("one"))
    clashes = distinct.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    plain = base.select(
        "doc_id",
        F.transform(chunk_array(F.col("flat"), least, most), hashed).alias("recipe"),
        F.sha2(F.col("flat"), 256).alias("text_sha256"),
    )
    if clashes.isEmpty():
        return plain
    # Different chunks share a hash: rank them by content and put the ranks into the recipes concerned.
    from pyspark.sql import Window

    ranks = (
        distinct.join(clashes, "h", "left_semi")
        .select("h", "chunk", (F.row_number().over(Window.partitionBy("h").orderBy("chunk")) - 1).cast("int").alias("r"))
    )
    # The row number comes before the chunks do: in one projection the explosion would come first.
    numbered = base.withColumn("row", F.monotonically_increasing_id())
    rows = numbered.select("doc_id", F.sha2(F.col("flat"), 256).alias("text_sha256"), "row", F.posexplode_outer(chunk_array(F.col("flat"), least, most)).alias("pos", "chunk"))
    fixed = rows.withColumn("h", hashed(F.col("chunk"))).join(ranks, ["h", "chunk"], "left")
    pair = F.struct("pos", "h", F.coalesce("r", F.lit(0)).cast("long").alias("r"))
    return (
        fixed.groupBy("row", "doc_id", "text_sha256")
        .agg(F.sort_array(F.collect_list(F.when(F.col("pos").isNotNull(), pair))).alias("parts"))
        .select("doc_id", F.flatten(F.transform("parts", lambda x: F.array(x["h"], x["r"]))).alias("recipe"), "text_sha256")
    )


def exact_duplicates(docs: DataFrame, least: int = MIN_CHARS, most: int = MAX_CHARS, hashed=chunk_hash) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    # Written once: both the grouping and the join read recipes, and texts are not cut again.
    r = written(recipes(docs.select("doc_id", "text"), least, most, hashed), "recipes")
    groups = r.groupBy("recipe").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    return join_groups(r, groups, "recipe", "group_size").select(
        "doc_id", "keep_id", "group_size", F.expr("doc_id <=> keep_id").alias("kept"), "text_sha256"
    )


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that stay, with all their columns: one row of each group of equal texts.

    Rows are found again by doc_id and text, so rows that share a doc_id (or have none) but not a text don't meet.
    """
    marked = exact_duplicates(docs).where("kept").select(F.col("doc_id").alias("kept_id"), F.col("text_sha256").alias("kept_sha")).distinct()
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.sha2(squeezed(F.col("text")), 256).alias("sha"))
    on = F.col("row.doc_id").eqNullSafe(F.col("kept_id")) & (F.col("sha") == F.col("kept_sha"))
    found = rows.join(marked, on, "left_semi").withColumn("id", F.col("row.doc_id"))
    return found.dropDuplicates(["id", "sha"]).select("row.*")
