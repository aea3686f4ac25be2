"""Token files and BPE against the tokenizers library, id by id over whole tables and hostile texts."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tessera.llm import queries, token_files

SF = "/root/testdata/sf0.01"
WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def test_bpe_query_is_the_library(spark):
    lib = Tokenizer.from_file(BYTES)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op3_bpe_round_trip(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = lib.encode(texts[r.doc_id], add_special_tokens=False).ids
        back = lib.decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())


def test_token_query_is_the_library(spark):
    lib, at = Tokenizer.from_file(WORDS), 0
    rows = {r.doc_id: r for r in queries.op5_token_files(spark, SF).collect()}
    for doc in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect():
        ids = [*lib.encode(doc.text or "", add_special_tokens=False).ids, 1]
        r = rows.pop(doc.doc_id)
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert not rows


def test_ranges_keep_the_order_and_split_hot_ids():
    rng = np.random.default_rng(2)
    docs = np.sort(np.where(rng.random(4_000) < 0.4, -(1 << 63), rng.integers(0, 999, 4_000)))
    ties = rng.integers(0, 1 << 32, 4_000)
    order = np.lexsort((ties, docs))
    docs, ties = docs[order], ties[order]
    bounds = docs[np.linspace(0, 3_999, 41).astype(int)[1:-1]]
    part = token_files.part_of(docs, ties, bounds)
    assert (np.diff(part) >= 0).all() and part.min() == 0 and part.max() <= 39
    assert np.bincount(part).max() < 400
    assert token_files.part_of(docs, ties, docs[:0]).max() == 0


def test_hot_and_hostile_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "ROWS_PER_RANGE", 16)
    monkeypatch.setattr(token_files, "CONTAINER_BYTES", 64)
    texts = [None, "", "a b", "日本語 <|endoftext|>", "Ünḯ 'S", "word " * 30_000, "x" * 5_000]
    rows = [(None if i % 3 == 0 else i // 2, texts[i % len(texts)]) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS part", "'x' AS frame", "2 AS n", "3 AS tie")
    out = str(tmp_path / "files")
    token_files.write(docs, WORDS, out)
    got = sorted(token_files.read(spark, out, with_ids=True).collect(), key=lambda r: r.start)
    lib = Tokenizer.from_file(WORDS)
    key = lambda d: -1 if d is None else d
    want = sorted((key(d), [*lib.encode(t or "", add_special_tokens=False).ids, 1]) for d, t in rows)
    assert sorted((key(r.doc_id), list(r.ids)) for r in got) == want and [key(r.doc_id) for r in got] == [d for d, _ in want]
    assert [r.start for r in got] == np.cumsum([0, *(len(r.ids) for r in got[:-1])]).tolist()
    parts = spark.read.parquet(f"{out}/containers").groupBy("part").count().collect()
    assert len(parts) >= 4  # a third of the rows shares an id, and still no range has them all


def test_spaced_pieces():
    assert token_files.spaced(b"") == [] and token_files.spaced(b"abc", 4, 2) == [b"ab", b"c"]
    assert token_files.spaced(bytes(range(100)), 4, 5) == [bytes(range(i, i + 5)) for i in (0, 25, 50, 75)]
