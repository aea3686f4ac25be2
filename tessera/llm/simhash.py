"""SimHash near-duplicates by meeting in the middle of Hamming balls.

Two fingerprints at most R = 3 bits apart meet half-way: each moves by at most half the radius, 1.5 bits.
The half bit is taken by a free group: the 64 bits fall into four groups of 16, and every distinct
fingerprint emits, for each group, its other 48 bits as they are and with each one bit flipped (49 variants a group,
196 in all, instead of the 2,081 of the full ball of radius 2).  If three differing bits fall on several groups, one of
them holds exactly one bit or two: freeing it leaves at most two bits, and both sides meet after one flip each; if all
fall on one group, freeing that leaves none.  One or two differing bits meet likewise.  So every pair within R shares a variant.

Variants are shuffled by value and sorted; fingerprints that share one are compared, in blocks, and only
verified links go on, and of those only the ones that connect: each task keeps a forest of what it has linked.
Copies never meet: fingerprints are made distinct first, and a document joins its fingerprint at the end; fingerprints that
many of all rows have join by broadcast (`join_groups`).  The fingerprints of one variant differ in 18 bits at most, so a
run has a bound that doesn't grow with the data.  Components of the linked fingerprints are found by star contraction.

Nulls and texts without words have fingerprint zero, linked like any other.  A null doc_id takes part and gets
its component's smallest non-null id (null if there is none).  Repeated rows get the same result each.  Very long texts are read
whole, 4,096 shingles' bits at a time.  An empty table gives an empty result.  Extra columns are ignored by `near_duplicates`, whatever
their names, and kept by `one_of_each`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_groups, written
from .components import components

SHINGLE, RADIUS, SEED = 3, 3, 42
GROUPS, BITS = 4, 16
BLOCK = 512
EMITTED = 1 << 15  # fingerprints a task that emits variants: about 90 MB of them
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Bit i is 1 if it is 1 in over half the shingles' hashes; no words: zero."""
    import xxhash

    words = (text or "").encode().translate(_LOWER).split()  # bytes.split: exactly the six ASCII white space bytes
    if not words:
        return 0
    h = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return h(b" ".join(words), SEED)
    hashes = np.array([h(b"%b %b %b" % x, SEED) for x in zip(words, words[1:], words[2:])] if shingle == 3 else [h(b" ".join(words[i : i + shingle]), SEED) for i in range(len(words) - shingle + 1)], dtype=np.uint64)
    ones = np.zeros(64, dtype=np.int64)
    for lo in range(0, len(hashes), 4096):
        part = hashes[lo : lo + 4096]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, *others: str) -> DataFrame:
    """(doc_id, fp) with the fingerprint as a signed long, and the columns named in `others`."""
    kinds = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64)), *batch.columns[2:]], names=["doc_id", "fp", *others])

    return docs.select("doc_id", "text", *others).mapInArrow(run, ", ".join([f"doc_id {kinds['doc_id']}", "fp long", *(f"{c} {kinds[c]}" for c in others)]))


def _variants(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, fingerprints): the group's number stands where the freed group's low bits were."""
    keys = []
    for g in range(GROUPS):
        free = np.uint64(((1 << BITS) - 1) << (BITS * g))
        base = (fps & ~free) | (np.uint64(g) << np.uint64(BITS * g))
        keys.append(base)
        keys += [base ^ (np.uint64(1) << np.uint64(b)) for b in range(64) if b // BITS != g]
    # The group must be part of the key: mix it in, one to one within a group.
    per = 64 - BITS + 1
    mixed = [k * np.uint64(0x9E3779B97F4A7C15) + np.uint64(g * 0xC2B2AE3D27D4EB4F % (1 << 64)) for g in range(GROUPS) for k in keys[per * g : per * (g + 1)]]
    return np.concatenate(mixed), np.tile(fps, per * GROUPS)


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


class Forest:
    """Union-find over fingerprints; `link` is true when it joins two trees."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        path = []
        while (y := up.get(x, x)) != x:
            path.append(x)
            x = y
        for p in path:
            up[p] = x
        return x

    def link(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _links(keys: np.ndarray, fps: np.ndarray, forest: Forest) -> Iterator[tuple[int, int]]:
    """Verified links of rows sorted by key, within runs of one key."""
    n = len(keys)
    # Runs of two or three, nearly all of them: compare neighbours at distance 1 and 2 in one go.
    start = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    size = np.diff(np.r_[start, n])
    small = size <= 3
    for step in (1, 2):
        if n > step:
            in_run = np.repeat(small, size)[:-step]
            i = np.flatnonzero(in_run & (keys[step:] == keys[:-step]))
            a, b = fps[i], fps[i + step]
            ok = (a != b) & (_popcount(a ^ b) <= RADIUS)
            if ok.any():
                pairs = np.unique(np.stack([a[ok], b[ok]], axis=1), axis=0)
                for x, y in pairs.tolist():
                    if forest.link(x, y):
                        yield x, y
    for s, k in zip(start[~small].tolist(), size[~small].tolist()):
        run = np.unique(fps[s : s + k])
        yield from _run_links(run, forest)


def _run_links(run: np.ndarray, forest: Forest) -> Iterator[tuple[int, int]]:
    """A spanning forest of one run: a fingerprint is compared with the ones not yet in its tree, in blocks."""
    left = run
    while len(left):
        frontier, left = left[:1], left[1:]
        while len(frontier) and len(left):  # grow the tree by whoever is within R of its newest part
            found = np.zeros(len(left), dtype=bool)
            for f in range(0, len(frontier), BLOCK):
                part = frontier[f : f + BLOCK]
                for lo in range(0, len(left), BLOCK):
                    near = _popcount(left[lo : lo + BLOCK, None] ^ part[None, :]) <= RADIUS
                    hit = near.any(axis=1) & ~found[lo : lo + BLOCK]
                    for j in np.flatnonzero(hit).tolist():
                        x, y = int(left[lo + j]), int(part[int(near[j].argmax())])
                        if forest.link(x, y):
                            yield x, y
                    found[lo : lo + BLOCK] |= hit
            frontier, left = left[found], left[~found]


def links(fps: DataFrame) -> DataFrame:
    """(a, b): links that connect all distinct fingerprints within RADIUS of one another; `fps` has fp, distinct."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for lo in range(0, len(x), 256):
                k, f = _variants(x[lo : lo + 256])
                yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(f.view(np.int64))], names=["variant", "fp"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()

        def out(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
            x = np.array(pairs, dtype=np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], names=["a", "b"])

        wait: list[tuple[np.ndarray, np.ndarray]] = []  # the last run so far, which may go on in the next batch
        for batch in batches:
            k, f = (batch.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in (0, 1))
            if not len(k):
                continue
            first = int(np.searchsorted(k.view(np.int64), k.view(np.int64)[0], side="right"))
            if wait and wait[0][0][0] == k[0]:
                wait.append((k[:first], f[:first]))
                if first == len(k):
                    continue
                k, f = k[first:], f[first:]
            last = int(np.searchsorted(k.view(np.int64), k.view(np.int64)[-1], side="left"))
            yield out([*_links(*(np.concatenate(x) for x in zip(*wait, (k[:last], f[:last]))), forest)])
            wait = [(k[last:], f[last:])]
        if wait:
            yield out([*_links(*(np.concatenate(x) for x in zip(*wait)), forest)])

    tasks = fps.count() // EMITTED + 1  # 196 rows for one: a split as large as a scan's would be far too much for one task
    return (
        fps.select("fp").repartition(tasks, "fp").mapInArrow(emit, "variant long, fp long")
        .repartition("variant").sortWithinPartitions("variant")
        .mapInArrow(meet, "a long, b long")
    )


def _named(fps: DataFrame) -> DataFrame:
    """(fp, rows, component, component_id) of each distinct fingerprint: its rows, the component's smallest fingerprint and doc_id."""
    distinct = fps.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("rows"))
    distinct = written(distinct, "distinct")
    parts = components(links(distinct))
    named = distinct.join(parts, F.col("fp") == F.col("node"), "left").select("fp", "rows", "first", F.coalesce("component", "fp").alias("component"))
    ids = named.groupBy("component").agg(F.min("first").alias("component_id"))
    return named.join(ids, "component").select("fp", "rows", "component", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id."""
    fps = written(fingerprints(docs), "fingerprints")
    named = _named(fps).select("fp", "rows", "component_id")
    return join_groups(fps, named, "fp", "rows").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each component, with all columns: one whose id is the component's smallest.

    It is found again by doc_id and text: components that share an id (or have none) keep a row each.
    """
    text, sha = F.col("text"), F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))
    fps = written(fingerprints(docs.select("doc_id", text, sha.alias("sha")), "sha"), "fingerprints")
    first = join_groups(fps, _named(fps), "fp", "rows").where(F.expr("doc_id <=> component_id"))
    kept = first.groupBy("component").agg(F.min("component_id").alias("kept_id"), F.min("sha").alias("kept_sha")).drop("component")
    rows = docs.select(F.struct(*docs.columns).alias("row"), sha.alias("sha"))
    on = F.col("row.doc_id").eqNullSafe(F.col("kept_id")) & (F.col("sha") == F.col("kept_sha"))
    found = rows.join(kept, on, "left_semi").withColumn("id", F.col("row.doc_id"))
    return found.dropDuplicates(["id", "sha"]).select("row.*")
