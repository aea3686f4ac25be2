"""The pipeline stage by stage against plain versions, on a table of repeated ids, nulls, copies and clashing columns."""

import hashlib
import os
import re
import sys

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
import corpus_pipeline  # noqa: E402

from tessera.llm import sql  # noqa: E402

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from test_simhash import brute  # noqa: E402

WS = re.compile(r"[\x20\x09-\x0D]+")
rng = np.random.default_rng(8)


def prose(n: int) -> str:
    return " ".join("".join("aeioubcdfg"[int(c)] for c in str(k)) for k in rng.integers(10**3, 10**6, n))


A, B, C = prose(300), prose(1200), prose(40)
ROWS = [
    (1, A, "s1"), (2, A.replace(" ", "\n", 3), "s2"), (3, A + " end", "s1"), (None, A, None), (4, B, "s2"), (4, C, "s2"), (4, C, "s2"), (None, prose(50), None), (None, prose(60), None),
    (5, None, "s1"), (6, "", "s1"), (7, "too short", "s1"), (8, "same again and " * 100, "s3"), (9, prose(2000), "s3"), (9, prose(700), "s3"), (None, None, None), (10, "#$% " * 50, "s3"),
]


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, source string").selectExpr("*", "length(text) AS n_chars", "7 AS n_words", "'x' AS kept", "1 AS shard", "2 AS row", "3 AS size")
    out = [("documents", docs.columns, docs.collect())]
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, "")
        out.append((name, got.columns, got.collect()))
        docs = spark.createDataFrame(out[-1][2], got.schema)
    return out


def pairs(rows) -> list[tuple]:
    return sorted(((r.doc_id, r.text) for r in rows), key=str)


def test_quality(stages):
    (_, columns, docs), (_, kept_columns, kept) = stages[:2]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [(i, r.text) for i, r in enumerate(docs)])
    good = {i for i, ok in con.sql(f"SELECT doc_id, kept FROM ({sql.OP6})").fetchall() if ok}
    assert kept_columns == columns and pairs(kept) == pairs(r for i, r in enumerate(docs) if i in good) and 0 < len(kept) < len(docs)
    assert all((r.n_words, r.kept, r.row) == (7, "x", 2) for r in kept)


def test_exact(stages):
    (_, columns, docs), (_, kept_columns, kept) = stages[1:3]
    best: dict[str, int | None] = {}
    for r in docs:
        t = WS.sub(" ", r.text)
        best[t] = min((x for x in (best.get(t), r.doc_id) if x is not None), default=None)
    assert kept_columns == columns and sorted(((r.doc_id, WS.sub(" ", r.text)) for r in kept), key=str) == sorted(((d, t) for t, d in best.items()), key=str)


def test_near(stages):
    (_, columns, docs), (_, kept_columns, kept) = stages[2:4]
    found = {(d, t): c for (d, t), c in zip(pairs(docs), [brute_of(docs, x) for x in pairs(docs)])}
    groups: dict = {}
    for x, c in found.items():
        groups.setdefault(c, []).append(x)
    assert kept_columns == columns and len(kept) == len(groups) < len(docs)
    left = pairs(kept)
    for c, rows in groups.items():
        stay = [x for x in rows if x in left]
        assert len(stay) == 1 and stay[0][0] == min((d for d, _ in rows if d is not None), default=None)


def brute_of(docs, row) -> object:
    """What tells a row's component: its rows, found by numbering the rows."""
    texts = [(i, t) for i, (_, t) in enumerate(pairs(docs))]
    at = pairs(docs).index(row)
    return {d: c for d, _, c in brute(texts)}[at]


def test_mix_and_tokens(stages):
    (_, columns, docs), (_, mixed_columns, mixed), (_, token_columns, tokens) = stages[3:6]
    words = lambda t: [w for w in WS.split(t) if w]
    assert mixed_columns == columns
    total = sum(len(words(r.text)) for r in docs)
    taken = sum(len(words(r.text)) for r in mixed)
    assert abs(taken - 1.5 * total) <= len({r.source for r in docs}) or taken <= 2 * total
    whole = {(r.doc_id, len(words(r.text)), r.text) for r in docs}
    for r in mixed:
        assert any(d == r.doc_id and " ".join(words(r.text)) in " ".join(words(t)) for d, _, t in whole) and r.n_chars == len(r.text)
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for r in mixed:
        ids = lib.encode(r.text, add_special_tokens=False).ids
        want.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert token_columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and sorted(map(tuple, tokens), key=str) == sorted(want, key=str)


def test_empty_table_and_run(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
