"""Mixing: exact targets, exact draws, the tree's margins, and the whole query against its contract."""

import math
import re
from fractions import Fraction

import numpy as np

from tessera.llm import common, mixing, queries

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_targets(sizes: list[int]) -> list[Fraction]:
    w = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
    stopped: set[int] = set()
    while True:
        left = Fraction(3, 2) * sum(sizes) - sum(2 * sizes[i] for i in stopped)
        total = sum(w[i] for i in range(len(sizes)) if i not in stopped)
        out = [Fraction(2 * n) if i in stopped else left * w[i] / total for i, n in enumerate(sizes)]
        over = {i for i, n in enumerate(sizes) if out[i] > 2 * n}
        if not over:
            return out
        stopped |= over


def test_targets(spark):
    rng = np.random.default_rng(4)
    for sizes in ([10, 10, 10], [0, 0], [1], [5, 0, 1000], [1, 1, 2, 9, 100, 3, 0, 8], rng.integers(0, 10**12, 300).tolist(), rng.integers(0, 9, 50).tolist()):
        names = sorted(f"s{i}" for i in range(len(sizes) - 1)) + [None]
        per = spark.createDataFrame([*zip(names, sizes)], "source string, source_size long")
        got = mixing.targets(per).orderBy("sid").collect()
        want = plain_targets(sizes)
        assert [r.source for r in got] == names and [r.sid for r in got] == [*range(len(sizes))]
        assert [r.target for r in got] == [float(t) for t in want] and [r.words for r in got] == [round(t) for t in want]


def test_tree_keeps_its_margins():
    tree = mixing.splitting_tree([1000, 300, 0, 7], 8)
    assert tree.sum(axis=1).tolist() == [1000, 300, 0, 7] and np.ptp(tree.sum(axis=0)) <= 1
    totals = [3, 0, 9, 1]
    cells = {(s, int(w)): int(k) for s, who, n in mixing.dealt([6, 0, 7], totals, 2) for w, k in zip(who, n)}
    assert [sum(k for (s, _), k in cells.items() if s == i) for i in range(4)] == totals and sum(k for (_, w), k in cells.items() if w == 2) == 7


def test_draws_by_inversion_are_exact():
    for good, bad, take in ((5, 7, 4), (40, 3, 30), (1, 9, 10), (300, 500, 99)):
        pmf = [math.comb(good, k) * math.comb(bad, take - k) / math.comb(good + bad, take) if 0 <= take - k <= bad else 0.0 for k in range(min(good, take) + 1)]
        edges = np.cumsum(pmf)
        us = np.linspace(1e-9, 1 - 1e-9, 1001)
        assert [mixing.inverted(u, good, bad, take) for u in us] == np.searchsorted(edges, us * edges[-1]).tolist()
    rng, n = np.random.default_rng(1), 20_000_000_000
    x = [mixing.hypergeometric(rng, n, 3 * n, n) for _ in range(50)]
    sigma = math.sqrt(n * 0.25 * 0.75 * 0.75)
    assert abs(np.mean(x) - n / 4) < 4 * sigma / math.sqrt(50) and 0.6 * sigma < np.std(x) < 1.5 * sigma


def test_query_keeps_the_contract(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    size = {r.doc_id: len(WORD.findall(r.text or "")) for r in docs}
    sources = sorted({r.source for r in docs if r.source is not None}) + [None] * any(r.source is None for r in docs)
    sums = {s: sum(size[r.doc_id] for r in docs if r.source == s) for s in sources}
    goal = dict(zip(sources, plain_targets([sums[s] for s in sources])))
    source = {r.doc_id: r.source for r in docs}
    rows = queries.op10_mixing(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(size)
    for r in rows:
        assert (r.size, r.source_size, r.target) == (size[r.doc_id], sums[source[r.doc_id]], float(goal[source[r.doc_id]])) and 0 <= r.taken <= 2 * r.size
        assert (r.first_position is None) == (r.taken == 0) == (r.shards == 0)
    for s in sources:
        assert sum(r.taken for r in rows if source[r.doc_id] == s) == round(goal[s])
    assert sorted(map(str, queries.op10_mixing(spark, SF).collect())) == sorted(map(str, rows))


def test_clashing_columns_and_many_sources(spark):
    rows = [(None if i % 3 else i, f"{'a b ' * (i % 7)}{i % 11}", f"src{i % 200}" if i % 5 else None) for i in range(600)] + [(0, None, "x"), (0, None, "x"), (0, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS size", "2 AS mark", "3 AS copy", "4 AS runs", "5 AS row", "6 AS parts", "'p' AS position", "length(text) AS n_chars")
    got = mixing.mixture(docs, block=2).collect()
    assert len(got) == len(rows) and all(r.taken <= 2 * r.size for r in got)
    out = mixing.mixed_documents(docs, block=2)
    assert out.columns == [c for c in docs.columns if c != "position"] + ["shard", "position"]
    out = out.collect()
    assert sum(len(WORD.findall(r.text)) for r in out) == sum(r.taken for r in got) and all(r.n_chars == len(r.text) and (r.size, r.mark, r.row) == (1, 2, 5) for r in out)
    assert mixing.mixed_documents(docs.limit(0)).count() == 0


def test_mixed_documents_are_dealt(spark):
    rows = [(i, f" {i} " + "\n".join(f"w{i}  {j}" for j in range(n)), "ab"[i % 2]) for i, n in enumerate([3, 500, 1200, 64, 32, 700, 0, 9])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mixed_documents(docs, shards=4, block=64).collect()
    _, blocks = mixing.plan(mixing.sized(docs), 4, 0, 64)
    want = mixing.sharded(common.written(blocks, "blocks"), 4, 0).collect()
    words = lambda t: len(t.split())
    assert sorted((r.shard, r.position, r.doc_id, words(r.text)) for r in got) == sorted((r.shard, r.position, r.doc_id, r.words) for r in want)
    by = {s: [r.position for r in got if r.shard == s] for s in range(4)}
    assert all(p == [*range(1, len(p) + 1)] for p in by.values()) and np.ptp([len(p) for p in by.values()]) <= 1
    first = {(r.doc_id, r.block): (r.shard, r.position) for r in want if r.epoch == 0}
    text = {(r.shard, r.position): r.text for r in got}
    for i, t, _ in rows:
        n = -(-words(t) // 64)
        if n and all((i, b) in first for b in range(n)) and sum(r.words for r in want if r.doc_id == i and r.epoch == 0) == words(t):
            assert "".join(text[first[i, b]] for b in range(n)) == t
    assert any(r.doc_id == 2 and r.epoch == 0 and r.block == 18 for r in want)
    long = mixing.mixed_documents(spark.createDataFrame([(1, "word \n" * 30_000, "s")], "doc_id long, text string, source string"))
    assert long.selectExpr("sum(size(regexp_extract_all(text, '[^ \\n]+', 0)))").first()[0] == 45_000
