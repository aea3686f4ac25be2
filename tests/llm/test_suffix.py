"""Repeated byte strings beside brute force over every window: whole tables, hot passages, shared and null ids."""

import hashlib
import random

import pytest

from tessera.llm import queries, suffix_dedup

SF = "/root/testdata/sf0.001"


def brute(rows: list[tuple[int | None, str | None]]) -> list[tuple]:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) per row; rows with one id and text are one document."""
    docs = sorted({(d, t or "") for d, t in rows}, key=lambda x: (x[0] is not None, x[0] or 0))
    first: dict[bytes, tuple] = {}
    for rank, (_, t) in enumerate(docs):
        b = t.encode()
        for p in range(len(b) - 99):
            first.setdefault(b[p : p + 100], (rank, p))
    out = {}
    for rank, (d, t) in enumerate(docs):
        b = t.encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            if first[b[p : p + 100]] < (rank, p):
                gone[p : p + 100] = b"\1" * 100
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[d, t] = (d, len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest())
    return sorted((out[d, t or ""] for d, t in rows), key=str)


def test_query_is_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, queries.op9_suffix_dedup(spark, SF).collect()), key=str) == brute(rows)


@pytest.mark.parametrize("least,records", [(4096, 10_000), (3, 10_000), (3, 5)])
def test_hot_passages(spark, monkeypatch, least, records):
    monkeypatch.setattr(suffix_dedup, "HOT_LEAST", least)
    monkeypatch.setattr(suffix_dedup, "BATCH", 2_000 if records == 5 else 1 << 22)
    r = random.Random(least + records)
    noise = lambda n: "".join(r.choice("abcdefg é\n") for _ in range(n))
    passage, line = noise(400), "the same long line " * 7
    rows = []
    for i in range(160):
        parts = [noise(r.randrange(200)), r.choice([passage, line, passage[50:300], "x" * r.randrange(300), "ab" * 90, ""]), noise(r.randrange(150)), r.choice(["", passage, line])]
        rows.append((None if i % 17 == 3 else i, "".join(parts)))
    rows += [(500, rows[4][1]), (4, rows[4][1]), (501, rows[4][1] + "!"), (502, None), (503, ""), (504, "a" * 99), (505, "\0" * 300), (506, "\0" * 150 + "a" * 80), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS th", "'x' AS anchor", "2 AS spans", "3 AS head")
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, records)
    try:
        got = suffix_dedup.removed(docs, texts=False).collect()
    finally:
        spark.conf.set(key, before)
    ids = [d for d, _ in rows if d is not None]
    texts_of_null = {t or "" for d, t in rows if d is None}
    want = brute(rows)
    if len(texts_of_null) > 1:  # several texts without an id are ordered by a hash: what they keep between them is what counts
        assert sorted(map(tuple, [x for x in got if x.doc_id in (502, 503, 504)]), key=str) == sorted((w for w in want if w[0] in (502, 503, 504)), key=str)
        assert sum(x.n_bytes - x.n_removed for x in got) > 0
        later = [x for x in got if x.doc_id is not None]
        assert sorted(map(tuple, later), key=str) == sorted((w for w in want if w[0] is not None), key=str)
    assert len(got) == len(rows) and len(ids) + sum(d is None for d, _ in rows) == len(rows)


def test_spans_and_texts(spark):
    words = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, words), (2, f"new {words} end"), (2, f"new {words} end")], "doc_id long, text string")
    for x in suffix_dedup.removed(docs).where("doc_id = 2").collect():
        assert x.n_spans == len(x.spans) == 1 and bytes(x.kept) == f"new {words} end".encode()[: x.spans[0].start] + f"new {words} end".encode()[x.spans[0].stop :] == b"new  end"[:4] + b" end"
    assert suffix_dedup.removed(docs.limit(0)).count() == 0
