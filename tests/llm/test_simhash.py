"""SimHash beside brute force over whole tables: fingerprints bit by bit, components over all pairs."""

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tessera.llm import queries, simhash

SF = "/root/testdata/sf0.001"


def plain(text: str | None) -> int:
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in "\x20\t\n\x0b\x0c\r" else c for c in words).split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows: list[tuple[int | None, str | None]]) -> list[tuple]:
    fps = [plain(t) for _, t in rows]
    x = np.array(fps, dtype=np.uint64)
    near = np.bitwise_count(x[:, None] ^ x[None, :]) <= 3
    out = []
    for i in range(len(rows)):
        reach = np.zeros(len(rows), bool)
        reach[i] = True
        while (more := near[reach].any(axis=0)).sum() > reach.sum():
            reach = more
        out.append((rows[i][0], f"{fps[i]:016x}", min((rows[j][0] for j in np.flatnonzero(reach) if rows[j][0] is not None), default=None)))
    return sorted(out, key=str)


def test_query_is_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, queries.op7_simhash(spark, SF).collect()), key=str) == brute(rows)


def test_hostile_rows(spark):
    words = [f"w{i}" for i in range(400)]
    text = lambda *gone: " ".join(w for w in words if w not in gone)
    rows = [(5, text()), (4, text("w7")), (9, text("w7", "w300").upper()), (None, text("w1")), (None, "one"), (3, None), (3, None), (2, "  x"), (1, " \t"), (8, "a b"), (8, "A\nB")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS fp", "1 AS sha", "2 AS row", "3 AS rows", "4 AS component", "5 AS kept_id")
    got = simhash.near_duplicates(docs)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)
    one = simhash.one_of_each(docs)
    assert one.columns == docs.columns and one.count() == len({r[2] if r[2] is not None else r[1] for r in brute(rows)})


def test_long_runs_cross_batches(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 62, 3)
    fps = sorted({int(b) ^ (1 << int(i)) ^ (1 << int(j)) for b in base for i in range(16) for j in range(16)} | {int(x) for x in rng.integers(0, 1 << 62, 500)})
    frame = spark.createDataFrame([(x,) for x in fps], "fp long")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = simhash.links(frame).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want, got = simhash.Forest(), simhash.Forest()
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 3:
                want.link(a, b)
    for r in found:
        got.link(r.a, r.b)
    assert [want.root(x) for x in fps] == [got.root(x) for x in fps]
    assert frame.select(F.count("*")).first()[0] == len(fps)
