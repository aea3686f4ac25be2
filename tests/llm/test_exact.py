"""Cuts that follow content, hot groups, clashing columns."""

from collections import Counter

from pyspark.sql import functions as F

from tessera.llm import common, exact_dedup

SF = "/root/testdata/sf0.01"


def test_chunks_recur_behind_an_insertion(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) > 3000")
    moved = F.concat(F.lit("An inserted line of forty characters...\n"), F.col("text"))
    both = docs.select(*[exact_dedup.chunk_array(common.squeezed(c)).alias(n) for c, n in ((F.col("text"), "a"), (moved, "b"))]).collect()
    same = sum((Counter(r.a) & Counter(r.b)).total() for r in both)
    assert same >= 0.9 * sum(len(r.a) for r in both)
    assert sum(not Counter(r.a) & Counter(r.b) for r in both) <= 0.02 * len(both)
    assert all("".join(r.a) == "".join(r.b)[40:] for r in both)


def test_hot_groups_join_by_broadcast(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), "id")
    groups = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    got = common.join_groups(rows, groups, "k", "n").collect()
    assert len(got) == 5000 and all((r.n, r.first) == ((1667, 0) if r.id % 3 == 0 else (1, r.id)) for r in got)
    assert common.join_groups(rows.limit(0), groups.limit(0), "k", "n").count() == 0


def test_clashing_columns(spark):
    names = "doc_id", "text", "keep_id", "sha", "row", "kept_sha", "kept_id", "recipe", "id", "group_size"
    docs = spark.createDataFrame([(i, t, *range(len(names) - 2)) for i, t in ((2, "a  b"), (1, "a b"), (1, "c"), (None, "a\tb"), (None, None), (3, ""))], ", ".join(f"{n} {'string' if n == 'text' else 'long'}" for n in names))
    got = exact_dedup.drop_duplicates(docs)
    assert got.columns == list(names)
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(1, "a b"), (1, "c"), (3, "")], key=str)
    marked = exact_dedup.exact_duplicates(docs)
    assert marked.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"] and marked.count() == 6


def test_very_long_texts(spark):
    long = "The quick brown fox, number {}. ".join(map(str, range(60_000)))
    docs = spark.createDataFrame([(1, long), (2, long + "x"), (3, long), (4, "日本" * 50_000), (5, "日本" * 50_000)], "doc_id long, text string")
    assert {r.doc_id: r.keep_id for r in exact_dedup.exact_duplicates(docs).collect()} == {1: 1, 2: 2, 3: 1, 4: 4, 5: 4}
