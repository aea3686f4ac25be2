"""The operators against brute force, the libraries and round trips, on small hostile tables."""

import hashlib
import os
import re
import sys
import zlib

import numpy as np
import public_tokenizers
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from compare import differs, duck  # noqa: E402

from pyspark.sql import functions as F  # noqa: E402
from tessera.llm import bpe, exact_dedup, html_extract, language_id, mixing, quality_classifier, quality_rules, queries, simhash, sql, suffix_dedup, token_files  # noqa: E402

SF = "/root/testdata/sf0.001"
LONG = "lorem ipsum dolor " * 4000
ROWS = [(1, "a b\tc", "s1", "en"), (2, "a  b c", "s1", "en"), (3, None, None, None), (4, "", "s2", "fr"), (5, LONG, "s2", "fr"), (6, LONG, None, "en"), (7, "日本語 <|endoftext|> d's\n\n x  y", "s1", None), (7, "日本語 <|endoftext|> d's\n\n x  y", "s1", None), (None, "no id", "s1", "en"), (8, "x" * 3000, "s3", "de")]
SCHEMA = "doc_id long, text string, source string, lang string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).withColumn("n_words", F.lit("clash")).withColumn("recipe", F.lit(1))


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", list(sql.ORACLES))
def test_sql(spark, name):
    assert differs(spark, duck(SF), queries.QUERIES[name], sql.ORACLES[name], SF) is None


def test_exact_duplicates(docs, none):
    got = {r.doc_id: r for r in exact_dedup.exact_duplicates(docs).collect()}
    assert (got[2].keep_id, got[2].group_size, got[2].kept) == (1, 2, False) and got[4].keep_id == 3 and got[6].keep_id == 5
    weak = exact_dedup.exact_duplicates(docs, 8, 64, hashed=lambda c: F.xxhash64(c) % 2)
    assert sorted(map(str, weak.collect())) == sorted(map(str, exact_dedup.exact_duplicates(docs).collect()))
    assert exact_dedup.exact_duplicates(none).count() == 0
    assert sorted(r.doc_id or 0 for r in exact_dedup.drop_duplicates(docs).collect()) == [0, 1, 3, 5, 7, 8]


def test_ledger(docs, none):
    marked = quality_rules.apply_policy(quality_rules.ledger(docs), "v1")
    got = {r.doc_id: r for r in marked.collect()}
    assert got[3].n_words == 0 and got[3].failed_bits == 1 and got[5].n_repeat_words == 12000 and got[5].base_failed
    assert {r.rule: r.failed for r in quality_rules.ablations(marked).collect()}["few_words"] == 8
    assert quality_rules.ledger(none).count() == 0


def test_bpe_agrees_with_the_library(docs, none):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    for r in bpe.encode(docs, path).collect():
        ids = lib.encode(r.text or "", add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == ids
        assert bpe.tokenizer(path).decode(bytes(r.ids)) == lib.decode(ids, skip_special_tokens=False)
    assert bpe.digests(none, path).count() == 0


def test_token_files(docs, none):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    at = 0
    rows = sorted(((r.doc_id if r.doc_id is not None else -1, r.text) for r in docs.collect()), key=lambda x: x[0])
    got = sorted(token_files.write_and_read(docs, path).collect(), key=lambda r: r.start)
    for (doc, text), r in zip(rows, got, strict=True):
        ids = [*lib.encode(text or "", add_special_tokens=False).ids, 1]
        assert (r.doc_id if r.doc_id is not None else -1, r.start, r.n_tokens) == (doc, at, len(ids))
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    assert token_files.write_and_read(none, path).count() == 0


def test_html(spark):
    page = '<html><body><nav><ul><li><a href=x>Menu</a></ul></nav><article><h1>T &amp; U</h1><p><b>One<br>two<p>Three.</p><div class="comments"><p>Nice!</p></div></article><footer>f</footer>'
    assert html_extract.extract(page) == "T & U\n\nOne two\n\nThree."
    assert html_extract.extract(None) == html_extract.extract("") == html_extract.extract("<script>x</script>") == ""
    rows = html_extract.extracted(spark.createDataFrame([(1, "u", page), (2, None, None)], "page_id long, url string, html string")).collect()
    assert rows[1].n_chars == 0


def test_simhash_links(spark, docs, none):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = [int(b) for b in base]
    for b in base.tolist():
        for _ in range(12):
            x = b
            for bit in rng.choice(64, rng.integers(1, 6), replace=False).tolist():
                x ^= 1 << bit
            fps.append(x)
    fps = sorted(set(fps))
    want, got = simhash.Forest(), simhash.Forest()
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 3:
                want.link(a, b)
    frame = spark.createDataFrame([(int(np.uint64(x).view(np.int64)),) for x in fps], "fp long")
    for r in simhash.links(frame).collect():
        a, b = r.a % (1 << 64), r.b % (1 << 64)
        assert (a ^ b).bit_count() <= 3
        got.link(a, b)
    assert [want.root(x) for x in fps] == [got.root(x) for x in fps]
    rows = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    assert rows[3].fingerprint == "0" * 16 and rows[4].component_id == 3 and rows[6].component_id == 5
    assert simhash.near_duplicates(none).count() == 0


def test_suffix_dedup(spark, none):
    import random

    r = random.Random(1)
    base = ["".join(r.choice("abc é") for _ in range(300)) for _ in range(4)]
    rows = [(i, r.choice(base)[r.randrange(150) :] + r.choice(["", "x" * r.randrange(300), "ab" * r.randrange(200)]) + r.choice(base)) for i in range(40)] + [(200, None), (201, ""), (202, "a" * 99)]
    seen: set[bytes] = set()
    for d, text in rows:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(b[p : p + 100])
        rows[d if d < 40 else d - 160] = (d, text, len(b), sum(gone), hashlib.sha256(bytes(c for c, x in zip(b, gone) if not x)).hexdigest())
    got = {x.doc_id: x for x in suffix_dedup.removed(spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string")).collect()}
    for d, _, n, gone, sha in rows:
        assert (got[d].n_bytes, got[d].n_removed, got[d].kept_sha256) == (n, gone, sha)
    assert suffix_dedup.removed(none).count() == 0


def test_mixing(docs, none):
    rows = mixing.mixture(docs, block=64).collect()
    assert len(rows) == len(ROWS) and all(r.taken <= 2 * r.size for r in rows)
    by: dict = {}
    for r in rows:
        by.setdefault((r.source_size, r.target), []).append(r.taken)
    assert all(abs(sum(t) - k[1]) <= 1 for k, t in by.items())
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mixture(docs, block=64).collect()))
    words = sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in mixing.mixed_documents(docs, block=64).collect())
    assert words == sum(r.taken for r in rows)
    assert mixing.mixture(none).count() == 0


def test_models(spark, docs, none):
    larger = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{larger}/labels.parquet")
    got = queries.op1_quality_classifier(spark, larger).join(labels, "doc_id").where("held_out")
    assert got.where("predicted = quality").count() >= 0.95 * got.count()
    assert quality_classifier.scored(docs, labels.limit(0)).count() == len(ROWS)
    path = public_tokenizers.path("piece_bpe_32k.model")
    rows = {r.doc_id: r for r in language_id.predicted(docs, path).collect()}
    assert rows[3].lang_pred == rows[4].lang_pred == "und" and rows[2].lang_pred != "und"
    assert language_id.predicted(none, path).count() == 0


def test_forward_sums_all_segmentations():
    vocabulary = ["▁a", "b", "▁ab", "c", "bc"]
    m = language_id.Model({"x": {p: 0.1 * (i + 1) for i, p in enumerate(vocabulary)} | {"": 1e-3}}, vocabulary)
    p = lambda s: m.rows[s][0] if s in m.rows else m.other[0]
    w = "▁abc"

    def total(i: int) -> float:
        return 1.0 if i == len(w) else sum(p(w[i:j]) * total(j) for j in range(i + 1, len(w) + 1) if w[i:j] in m.rows or j == i + 1)

    assert abs(np.exp(m.word(w)[0]) - total(0)) < 1e-12
    many = [w, "▁ab", "▁zz", "▁" + "abc" * 20, "▁", "▁bc日", ""]
    assert np.allclose(m.words(many), [m.word(x) for x in many], rtol=0, atol=1e-12)
    again = language_id.Model({"x": dict(zip(m.rows, (r[0] for r in m.rows.values()))) | {"": 1e-3}, "y": {"": 1e-3}}, vocabulary)
    texts = ["abc ab", None, "1 2", "c " * 5, "abc" * 50, "ab"]
    assert again.predict(texts) == [again.predict([t])[0] for t in texts]


def test_rows_with_shared_ids_stay(spark):
    r = np.random.default_rng(5)
    other = [" ".join(f"w{x}" for x in r.integers(0, 10**6, 60)) for _ in range(6)]
    rows = [(None, other[0]), (None, other[1]), (None, other[1]), (None, None), (7, other[2]), (7, other[3]), (7, other[4]), (1, other[4]), (None, other[2]), (7, other[5])]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("extra", F.lit(1))
    want = sorted([(None, other[0]), (None, other[1]), (None, None), (7, other[2]), (7, other[3]), (1, other[4]), (7, other[5])], key=str)
    for drop in (exact_dedup.drop_duplicates, simhash.one_of_each):
        got = drop(frame)
        assert got.columns == frame.columns and sorted(((x.doc_id, x.text) for x in got.collect()), key=str) == want
    linked = spark.createDataFrame([(None, "a b c"), (None, "A  b c"), (None, "x y z"), (2, "u v"), (2, "U v"), (3, "u V")], "doc_id long, text string")
    assert sorted((x.doc_id or 0, x.text.lower()[0]) for x in simhash.one_of_each(linked).collect()) == [(0, "a"), (0, "x"), (2, "u")]
