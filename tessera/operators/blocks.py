"""Extracted text as a client shows it: blocks with their places; stand-alone division lines; tables as lines."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import DIVISIONS, pattern_rank, roman_number

ANNEX = len(DIVISIONS) - 1
# A division's word and number alone on a line; a cell that is a number; how a table's rows must end to be grouped.
ALONE = rf"(?iu)^({'|'.join(DIVISIONS)})\s*[:.]?\s*([IVXLCDM]+|[0-9]+)$"
NUMBER = re.compile(r"[\d.,]+\s*%?")
GROUPED_SHARE = 0.6


def parse_blocks(docs: DataFrame) -> DataFrame:
    """(doc_id, block, kind, level, text, rows, start, end) of rows (doc_id, text): headings, list items, paragraphs, tables.

    A line's kind, and whether it goes on with the line before, are columns; blocks are the runs.  Separator rows of tables have no cells.
    """
    line = F.regexp_replace("line", r"(?U)^\s+|\s+$", "")
    like = lambda p: F.regexp_like("t", F.lit(p))
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    by = Window.partitionBy("doc_id").orderBy("i")
    behind = by.rowsBetween(Window.unboundedPreceding, -1)
    x = lines.withColumn("start", F.coalesce(F.sum(F.length("line") + 1).over(behind), F.lit(0))).withColumn("end", F.col("start") + F.length("line")).withColumn("t", line)
    kind = F.when(F.col("t") == "", "").when(like(r"^#{1,6}\s+"), "h").when(like(r"^\|[\s|:-]+\|$") & F.contains("t", F.lit("-")), "rule").when(F.startswith("t", F.lit("|")), "row").when(like(r"^([-*+]|[0-9]+[.)])\s+"), "li").otherwise("p")
    x = x.withColumn("k", kind).withColumn("kind", F.when(F.col("k").isin("row", "rule"), "table").otherwise(F.col("k")))
    begins = F.col("kind").isin("h", "li") | ~F.lag("kind").over(by).eqNullSafe(F.col("kind"))
    x = x.withColumn("g", F.sum(begins.cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0))).where("kind <> ''")
    # What stands before a table's first row is no part of it.
    rows_so_far = F.count_if(F.col("k") == "row").over(Window.partitionBy("doc_id", "g").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    x = x.withColumn("rows_so_far", rows_so_far).where("kind <> 'table' OR rows_so_far > 0")
    cells = F.transform(F.split(F.regexp_replace("t", r"^\||\|$", ""), r"\|"), lambda c: F.btrim(c))
    said = F.when(F.col("kind") == "h", F.regexp_replace("t", r"^#{1,6}\s+", "")).when(F.col("kind") == "li", F.regexp_replace("t", r"^([-*+]|[0-9]+[.)])\s+", "")).when(F.col("kind") == "p", F.col("t")).otherwise("")
    in_order = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("i", c.alias("v")))), lambda s: s["v"])
    out = x.withColumn("said", said).withColumn("cells", F.when(F.col("k") == "row", cells)).groupBy("doc_id", "g", "kind").agg(
        F.when(F.col("kind") == "h", F.length(F.regexp_extract(F.first("t"), "^#+", 0))).alias("level"), F.array_join(in_order(F.col("said")), " ").alias("text"),
        F.filter(in_order(F.col("cells")), lambda c: c.isNotNull()).alias("rows"), F.min("start").alias("start"), F.max("end").alias("end"))
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("g")) - 1
    return out.select("doc_id", number.alias("block"), "kind", "level", F.when(F.col("kind") == "table", "").otherwise(F.col("text")).alias("text"), "rows", "start", "end")


def keyword_levels(lines: Column) -> Column:
    """Array of (i, level) of the lines that are a capitalised division and its number, in their order.

    A number must be above the last one of its division; a wider division sets the narrower ones back, an annex doesn't.  The divisions in use
    are numbered from 1; annexes stand beside the widest.  A fold over the few candidate lines, in the document's row.
    """
    found = F.filter(
        F.transform(lines, lambda x, i: F.struct(i.alias("i"), F.btrim(x).alias("t"))),
        lambda s: F.regexp_like(s["t"], F.lit(ALONE)) & F.regexp_like(s["t"], F.lit(r"^\p{Lu}")))
    ranked = F.transform(found, lambda s: F.struct(s["i"].alias("i"), pattern_rank(s["t"]).cast("int").alias("rank"), roman_number(F.regexp_extract(s["t"], ALONE, 2)).cast("int").alias("number")))
    begin = F.struct(F.array(*[F.lit(0)] * (ANNEX + 1)).alias("last"), F.array().cast("array<struct<i:int,rank:int>>").alias("kept"))

    def step(state: Column, s: Column) -> Column:
        ok = s["number"] > F.get(state["last"], s["rank"])
        last = F.transform(state["last"], lambda v, r: F.when(r == s["rank"], s["number"]).when((s["rank"] != ANNEX) & (r > s["rank"]) & (r < ANNEX), 0).otherwise(v))
        kept = F.concat(state["kept"], F.array(F.struct(s["i"].alias("i"), s["rank"].alias("rank"))))
        return F.struct(F.when(ok, last).otherwise(state["last"]).alias("last"), F.when(ok, kept).otherwise(state["kept"]).alias("kept"))

    kept = F.aggregate(ranked, begin, step, lambda state: state["kept"])
    return F.transform(F.array(kept), lambda k: F.transform(
        F.array(F.array_sort(F.array_distinct(F.filter(F.transform(k, lambda x: x["rank"]), lambda r: r != ANNEX)))),
        lambda used: F.transform(k, lambda x: F.struct(x["i"].alias("i"), F.when(x["rank"] == ANNEX, 1).otherwise(F.array_position(used, x["rank"]).cast("int")).alias("level"))))[0])[0]


def _is_number(cell: str) -> bool:
    return NUMBER.fullmatch(cell) is not None


def _header(rows: list[list[str]]) -> tuple[list[str], int]:
    """(a name for each column, how many rows they take): no names where the first row isn't a header."""
    named = [c for c in rows[0] if c] if rows else []
    if len(rows) < 3 or len(named) < 3 or any(map(_is_number, named)):
        return [], 0
    names: list[str] = []
    for c in rows[0]:
        names.append(c or (names[-1] if names else ""))  # a merged cell names the columns to its right
    second = rows[1]
    if second[0] or any(_is_number(c) for c in second if c):
        return names, 1
    return [f"{n} – {c}" if c else n for n, c in zip(names, second)], 2


def table_lines(grid: list[list[str]]) -> list[str]:
    """A table as lines that can be read alone: cells under a header say their column, rows of a scoring grid say their category."""
    rows = [r for r in grid if any(r)]
    names, taken = _header(rows)
    shown = lambda cells: f"| {' | '.join(cells)} |"
    if names:
        told = [[c if not n or n == c else f"{n}: {c}" for n, c in zip(names, r) if c] for r in rows[taken:]]
        return [shown([*dict.fromkeys(n for n in names if n)]), *map(shown, told)]
    filled = [[c for c in r if c] for r in rows]
    ends = [_is_number(cells[-1]) for cells in filled if len(cells) > 1]
    grid_of_scores = ends and sum(ends) >= GROUPED_SHARE * len(ends)
    out, category = [], []
    for r, cells in zip(rows, filled):
        alone = len(cells) == 1
        if grid_of_scores and alone and r[0]:
            category = [] if cells[0].rstrip()[-1:] in (":", ".") else cells
            out.append(shown(cells))
        else:
            out.append(shown(cells if alone else category * bool(grid_of_scores) + cells))
    return out
