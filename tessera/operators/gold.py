"""Gold quotes: where they stand, what is wrong with them, and what covers them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

GAP = r"(?:\s+#{1,6})?\s+"  # fixed value: what may stand between two words of a quote
KEY_WORDS = 3


def pattern(quote: str) -> re.Pattern:
    return re.compile(GAP.join(map(re.escape, quote.split())))


def _inner(words):
    """The words that a match must hold whole: all but the first and the last."""
    return F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0)))


def find_spans(docs: DataFrame, quotes: DataFrame) -> DataFrame:
    """(item_id, doc_id, start_char, end_char): all matches of each quote (item_id, quote), left to right, that don't overlap.

    Candidates share the first KEY_WORDS inner words of a quote, an equal key; Spark broadcasts the quotes' keys by their size, and only documents
    that hold one go on to the match.  Quotes with fewer inner words are looked for in every document: such a set should be small.
    """
    split = lambda c: F.filter(F.split(c, r"(?U)\s+"), lambda w: ~F.regexp_like(w, F.lit("^#{0,6}$")))
    asked = quotes.where(F.regexp_like("quote", F.lit(r"(?U)\S"))).withColumn("_inner", _inner(split(F.col("quote"))))
    long = asked.where(F.size("_inner") >= KEY_WORDS).select("item_id", "quote", F.xxhash64(*[F.get("_inner", i) for i in range(KEY_WORDS)]).alias("_key"))
    keys = F.transform(F.array(split(F.col("text"))), lambda w: F.array_distinct(F.transform(
        F.slice(w, 1, F.greatest(F.size(w) - (KEY_WORDS - 1), F.lit(0))), lambda x, i: F.xxhash64(*[F.get(w, i + j) for j in range(KEY_WORDS)]))))[0]
    met = docs.select("doc_id", F.explode(keys).alias("_key")).join(long, "_key").select("doc_id", "item_id", "quote").distinct()
    short = asked.where(F.size("_inner") < KEY_WORDS).select("item_id", "quote")
    some = docs.select("doc_id", "text").join(met, "doc_id").unionByName(docs.select("doc_id", "text").crossJoin(short))
    kinds = dict(docs.dtypes)["doc_id"], dict(quotes.dtypes)["item_id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, d, m.start(), m.end()) for i, d, t, q in zip(batch["item_id"], batch["doc_id"], batch["text"], batch["quote"]) for m in pattern(q).finditer(t or "")]
            yield pd.DataFrame(rows, columns=["item_id", "doc_id", "start_char", "end_char"])

    return some.select("item_id", "doc_id", "text", "quote").mapInPandas(run, f"item_id {kinds[1]}, doc_id {kinds[0]}, start_char long, end_char long")


def attach_spans(gold: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(spans, problems) of gold rows (item_id, doc_id, quote): the quote's spans in its document, and the rows without one and why."""
    found = find_spans(docs, gold.select("item_id", "quote").distinct()).join(gold.select("item_id", "doc_id"), ["item_id", "doc_id"], "left_semi")
    known = gold.join(docs.select("doc_id", F.lit(True).alias("known")), "doc_id", "left")
    lost = known.join(found.select("item_id", "doc_id").distinct(), ["item_id", "doc_id"], "left_anti")
    return found, lost.select("item_id", "doc_id", F.when(F.col("known"), "quote not found").otherwise("unknown source").alias("problem"))


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, start: str, value: str) -> DataFrame:
    """`left` with the `value` of the last row of `right` whose start is at or before `at`, null without one.

    One sort over both sides by key and place, and the last value seen: no pair of rows is ever made.
    """
    cols = [c for c in left.columns if c != key]
    a = left.select(key, F.col(at).cast("long").alias("_at"), F.lit(1).alias("_side"), F.struct(*cols).alias("_row"), F.lit(None).cast(dict(right.dtypes)[value]).alias(value))
    b = right.select(key, F.col(start).cast("long").alias("_at"), F.lit(0).alias("_side"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), value)
    by = Window.partitionBy(key).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b).withColumn(value, F.last(value, ignorenulls=True).over(by)).where("_side = 1")
    return both.select(key, "_row.*", value)
