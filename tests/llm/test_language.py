"""Learning and predicting languages: expected counts by enumeration, long words, groups of languages, held-out accuracy."""

from itertools import product

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tessera.llm import language_id as L
from tessera.llm import queries

PATH = public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.01"


def enumerated(word: str, known: dict[str, int]) -> dict[str, float]:
    p, out, total = 1e4 / len(known), {}, 0.0
    for cuts in product((0, 1), repeat=len(word) - 1):
        at = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(word)]
        parts = [word[a:b] for a, b in zip(at, at[1:])]
        if all(len(x) == 1 or x in known for x in parts):
            w = p ** len(parts)
            total += w
            for x in parts:
                if x in known:
                    out[x] = out.get(x, 0.0) + w
    return {k: v / total for k, v in out.items()}


@pytest.mark.parametrize("word", ["▁abab", "▁ba", "a", "▁aabbccab"])
def test_expected_counts(word):
    known = {x: i for i, x in enumerate(["▁", "a", "b", "ab", "▁a", "bab", "aabb", "c"])}
    got, want = L.expected_counts(word, known), enumerated(word, known)
    assert got.keys() == want.keys() and np.allclose([got[k] for k in want], [want[k] for k in want])


@pytest.mark.parametrize("size", [32_000, 8])  # sums that vanish, and sums that grow beyond all bounds
def test_long_words_teach(size):
    known = {x: i for i, x in enumerate(["a", "b", "ab", "ba", *(f"z{i}" for i in range(size - 4))])}
    short, long = L.expected_counts("ab" * 100, known), L.expected_counts("ab" * 5_000, known)
    assert abs(sum(len(k) * v for k, v in long.items()) - 10_000) < 1e-3
    assert all(abs(long[k] / 50 - short[k]) < 0.1 * short[k] + 1 for k in short)


def test_groups_of_languages(spark):
    rows = [(i, f"{w} " * 30, lang) for i, (w, lang) in enumerate([("aber nicht", "de"), ("avec nous", "fr"), ("with them", "en"), ("para nada", "es"), ("日本語です" * 300, "ja")] * 4)]
    docs = spark.createDataFrame([*rows, (90, None, "de"), (91, "12 !", None), (92, "aber nicht", None), (92, "aber nicht", None), (None, "日本語", None)], "doc_id long, text string, lang string").selectExpr("*", "1 AS held_out", "'x' AS rows")
    totals = L.learn(docs, PATH)
    one = sorted(map(tuple, L.predicted(docs, PATH, totals).collect()), key=str)
    assert one == sorted(map(tuple, L.predicted(docs, PATH, totals, together=2).collect()), key=str)
    got = {r[0]: r[2] for r in one}
    assert (got[0], got[1], got[90], got[91], got[92], got[None]) == ("de", "fr", "und", "und", "de", "ja")
    none = docs.limit(0)
    assert L.predicted(none, PATH).count() == 0 and {r.lang_pred for r in L.predicted(docs, PATH, L.learn(none, PATH)).collect()} == {"und"}


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = queries.op8_language_id(spark, SF).where("held_out").join(docs.where("lang is not null").select("doc_id", "lang"), "doc_id")
    assert got.where("lang = lang_pred").count() >= 0.98 * got.count() > 0
    few = L.predicted(docs, PATH, L.learn(docs.where(~L.held_out(F.col("doc_id"))), PATH, most=20)).where("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    assert few.where("lang = lang_pred").count() >= 0.9 * few.count()
