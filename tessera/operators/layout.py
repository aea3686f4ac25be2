"""Page layout from a table of text spans, and grids of cells: what is body, heading, furniture, table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import repeat_key
from .library import repeated_lines

# How much larger a heading's letters are, how long one may be, how much of a page is margin, what makes a table.
LARGER, HEADING_CHARS, MARGIN = 1.15, (2, 120), 0.12
EMPTY_SHARE, CELL_CHARS = 0.7, 40
WIDTH_ROWS, WIDTH = 200, (6, 40)


def body_size(spans: DataFrame, key: str = "source") -> DataFrame:
    """(key, body): the size, to a tenth, with the most letters; the smaller one on a tie."""
    sums = spans.groupBy(key, F.round("size", 1).alias("size")).agg(F.sum(F.length(F.trim("text"))).alias("chars"))
    return sums.groupBy(key).agg(F.max_by("size", F.struct("chars", -F.col("size"))).alias("body"))


def looks_like_heading(text: Column, size: Column, body: Column, emphasised: Column) -> Column:
    """A short line that ends like no sentence, in larger letters than the body or in emphasised ones no smaller."""
    t = F.trim(text)
    return (
        F.length(t).between(*HEADING_CHARS) & ~F.regexp_like(t, F.lit("^[0-9]+$")) & ~F.right(t, F.lit(1)).isin(*".,;:")
        & ((size >= body * LARGER) | (emphasised & (size >= body)))
    )


def level_map(sizes: DataFrame, key: str = "source") -> DataFrame:
    """(key, size, level): a document's distinct sizes from the largest down, six levels at most."""
    rank = F.dense_rank().over(Window.partitionBy(key).orderBy(F.desc("size")))
    return sizes.select(key, "size").distinct().select(key, "size", F.least(rank, F.lit(6)).cast("long").alias("level"))


def page_lines(spans: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """(source, page, block, line, text, size, bold, x, y) of spans put together, without lines whose middle lies in a table.

    Spans have source, page, block, line, span, text, size, bold, x and y (of the middle, as shares of the page); tables source, page, x0, y0, x1, y1.
    """
    parts = F.transform(F.array_sort(F.collect_list(F.struct("span", "text"))), lambda s: s["text"])
    lines = spans.groupBy("source", "page", "block", "line").agg(
        F.array_join(parts, "").alias("text"), F.max("size").alias("size"), F.bool_and("bold").alias("bold"), F.avg("x").alias("x"), F.avg("y").alias("y"))
    if tables is None:
        return lines
    a, t = lines.alias("a"), tables.alias("t")
    inside = (F.col("a.source") == F.col("t.source")) & (F.col("a.page") == F.col("t.page")) & F.col("a.x").between(F.col("t.x0"), F.col("t.x1")) & F.col("a.y").between(F.col("t.y0"), F.col("t.y1"))
    return a.join(t, inside, "left_anti")


def in_margin(y: Column) -> Column:
    return (y < MARGIN) | (y > 1 - MARGIN)


def without_furniture(lines: DataFrame, share: float = 0.6) -> DataFrame:
    """Page lines but those in a margin that recur over a document's pages (running heads and feet, page numbers)."""
    keyed = lines.withColumn("key", repeat_key(F.col("text")))
    running = repeated_lines(keyed.where(in_margin(F.col("y"))).select("source", "page", "key"), share).select("source", "key")
    marked = keyed.withColumn("_m", in_margin(F.col("y")))
    gone = running.withColumn("_m", F.lit(True))
    return marked.join(gone, ["source", "key", "_m"], "left_anti").drop("key", "_m")


def real_tables(cells: DataFrame) -> DataFrame:
    """(table_id, rows, cols) of grids that are tables: two rows and columns at least, not mostly empty, no long texts.

    Rows and columns (whole numbers) are marked as bits of blocks of 64 x 64 cells, so that an aggregation holds a row for each block.
    """
    full = F.length(F.trim(F.coalesce("text", F.lit(""))))
    row, col, one = F.col("row").cast("long"), F.col("col").cast("long"), F.lit(1).cast("long")
    bit = lambda n: F.call_function("shiftleft", one, n.bitwiseAND(63).cast("int"))
    blocks = cells.groupBy("table_id", F.shiftright(row, 6).alias("r"), F.shiftright(col, 6).alias("c")).agg(
        F.bit_or(bit(row)).alias("r_bits"), F.bit_or(bit(col)).alias("c_bits"), F.count("*").alias("n"), F.count_if(full == 0).alias("empty"), F.sum(full).alias("chars"))
    sides = blocks.select("table_id", F.inline(F.array(
        F.struct(F.lit(True).alias("is_row"), F.col("r").alias("block"), F.col("r_bits").alias("bits"), "n", "empty", "chars"),
        F.struct(F.lit(False).alias("is_row"), F.col("c").alias("block"), F.col("c_bits").alias("bits"), *[F.lit(0).cast("long").alias(x) for x in ("n", "empty", "chars")]))))
    sums = [F.sum(x).alias(x) for x in ("n", "empty", "chars")]
    merged = sides.groupBy("table_id", "is_row", "block").agg(F.bit_or("bits").alias("bits"), *sums)
    count = lambda side: F.coalesce(F.sum(F.when(side, F.bit_count("bits"))), F.lit(0))
    x = merged.groupBy("table_id").agg(count(F.col("is_row")).alias("rows"), count(~F.col("is_row")).alias("cols"), *sums)
    mean = F.when(F.col("n") > F.col("empty"), F.col("chars") / (F.col("n") - F.col("empty"))).otherwise(0.0)
    return x.where((F.col("rows") >= 2) & (F.col("cols") >= 2) & (F.col("empty") / F.col("n") <= EMPTY_SHARE) & (mean <= CELL_CHARS)).select("table_id", "rows", "cols")


def cell_text(value: Column) -> Column:
    """A number as a sheet shows it: whole ones without a point, others with ten digits at most."""
    whole = (value == F.floor(value)) & (F.abs(value) < 1e15)
    tens = F.pow(F.lit(10.0), 9 - F.floor(F.log10(F.abs(value))))
    short = F.regexp_replace((F.round(value * tens) / tens).cast("decimal(38,12)").cast("string"), r"\.?0+$", "")
    return F.when(value.isNull(), "").when(whole, value.cast("long").cast("string")).otherwise(short)


def column_widths(cells: DataFrame) -> DataFrame:
    """(sheet, col, width): two more than the longest of the first rows, within bounds; cells have sheet, row (from 0), col, text."""
    longest = F.max(F.when(F.col("row") < WIDTH_ROWS, F.length("text")).otherwise(0))
    return cells.groupBy("sheet", "col").agg(F.least(F.greatest(longest + 2, F.lit(WIDTH[0])), F.lit(WIDTH[1])).cast("long").alias("width"))


def hidden_cells(merges: DataFrame) -> DataFrame:
    """(sheet, row, col) of the cells that merged ones hide: merges have sheet, row, col and the spans rows, cols."""
    inside = merges.withColumn("r", F.explode(F.sequence(F.lit(0), F.col("rows") - 1))).withColumn("c", F.explode(F.sequence(F.lit(0), F.col("cols") - 1)))
    return inside.where("r > 0 OR c > 0").select("sheet", (F.col("row") + F.col("r")).alias("row"), (F.col("col") + F.col("c")).alias("col"))


def column_letters(col: Column) -> Column:
    """A, B ... Z, AA ... of columns numbered from 0 (three letters at most)."""
    letter = lambda n: F.char(65 + n)
    left = F.floor(col / 26) - 1
    return F.when(col < 26, letter(col)).when(col < 702, F.concat(letter(left), letter(col % 26))).otherwise(
        F.concat(letter(F.floor(left / 26) - 1), letter(left % 26), letter(col % 26)))
