"""Removing repeated byte strings of length L = 100 with longest-previous-factor arrays.

A byte goes when it lies in an L-byte string that also starts earlier (smaller doc_id, or earlier in the
document).  The longest-previous-factor value of a start is the longest string there that also starts earlier,
so the question at each start is whether that value reaches L.  Suffixes are put in order by their first L bytes, equal ones by
position.  The previous smaller position of a start that shares L bytes is then its neighbour before, and no next one can share
them: the value reaches L exactly where the neighbour before has the same L bytes.

Suffixes are brought together without a global sort.  Each L-byte window has an anchor, its smallest hash of 32
bytes, so equal windows have equal anchors at equal offsets.  (1) Copies of a whole text are resolved by its SHA-256
and take no part further.  (2) Anchors are shuffled as numbers; those that occur once are dropped, for their
windows are unique.  (3) For the others, the bytes of their windows (contexts) are shuffled by anchor, put in suffix order
and compared byte by byte.  (4) Spans go back to the documents.  The texts themselves are
shuffled once, by doc_id, and that exchange is reused.

Hot anchors.  Before either shuffle a batch's own repetitions are taken out: of an anchor two places go on, and of equal contexts the first,
the others being known as repeated already.  Anchors that occur at over `HOT_LEAST` places, or over 1 / `HOT_MOST` of all where that is more, are
split: their windows go on one by one, keyed by 128-bit hashes (compared by these, and by bytes within a batch), so that one
passage in very many documents doesn't meet in one task.  Their list, all that reaches the driver, has fewer than `HOT_MOST` numbers.
So a task holds the contexts of one anchor below that bound, of 168 bytes at most each, and of hot ones one row at a time.

Nulls count as empty; a null doc_id stands before all others.  Repeated rows of one doc_id with one text are the same
document and get the same result; with different texts they are ordered by a hash of the text.  Texts shorter than L lose nothing.
Very long texts are hashed `PIECE` bytes at a time.  An empty table gives an empty result.  Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_groups, written

LENGTH, GRAM = 100, 32
SPAN = LENGTH - GRAM + 1  # grams in a window
PIECE = 1 << 18  # bytes hashed at a time
TOGETHER = 3 << 20  # bytes of contexts resolved at a time, and more only where one anchor has more
BATCH = 4 << 20  # bytes of contexts gathered before a batch's own repetitions are taken out
HOT_LEAST, HOT_MOST = 4_096, 4_000_000
NULL_ID = -(1 << 63)
TOP = np.uint64(0xFFFFFFFFFFFFFFFF)
_rng = np.random.default_rng(20240229)
LETTERS = _rng.integers(1, 1 << 63, size=(2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
FACTORS = _rng.integers(1, 1 << 63, size=(2, 8), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def _doubled(b: np.ndarray, which: int, upto: int, keep: tuple[int, ...] = ()) -> list[np.ndarray]:
    """Hashes of 1, 2, 4 ... bytes from each position (positions near the end are left out);
    those shorter than `upto` are emptied after use, but for `keep`."""
    hs = [LETTERS[which][b]]
    step = 1
    while step < upto:
        h = hs[-1]
        if step not in keep:
            hs[-1] = h[:0]
        if len(h) <= step:
            hs.append(h[:0])
        else:
            hs.append(h[:-step] * FACTORS[which][len(hs) - 1] + h[step:])
        step *= 2
    return hs


def _sliding(x: np.ndarray, width: int, op) -> np.ndarray:
    """op over each `width` neighbours, by doubling."""
    out, have = x, 1
    while have * 2 <= width:
        out = op(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return op(out[: len(out) - rest], out[rest:]) if rest else out


def anchors(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(position, hash, first window, last window) of each anchor of a document; windows by their start."""
    n = len(text)
    if n < LENGTH:
        e = np.empty(0, np.int64)
        return e, e.astype(np.uint64), e, e
    parts = []
    windows = n - LENGTH + 1
    b = np.frombuffer(text, dtype=np.uint8)
    for lo in range(0, windows, PIECE):
        hi = min(windows, lo + PIECE)  # window starts lo..hi-1
        grams = np.minimum(_mix(_doubled(b[lo : hi + LENGTH - 1], 0, GRAM)[-1]), TOP - np.uint64(1))
        low = _sliding(grams, SPAN, np.minimum)  # by window
        pad = np.zeros(SPAN - 1, dtype=np.uint64)
        best = _sliding(np.concatenate([pad, low, pad]), SPAN, np.maximum)  # by gram: the best window it lies in
        at = np.flatnonzero(best == grams)
        # The windows of an anchor are a run that ends or starts where a smaller gram comes in.
        h = grams[at]
        first, last = _window_runs(low, at, h)
        parts.append((at + lo, h, first + lo, last + lo))
    return tuple(np.concatenate(x) for x in zip(*parts))  # type: ignore[return-value]


def _window_runs(low: np.ndarray, at: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last window start around each anchor whose smallest gram is the anchor's hash."""
    edge = np.flatnonzero(low[1:] != low[:-1]) + 1
    starts, ends = np.r_[0, edge], np.r_[edge, len(low)] - 1  # runs of windows with one smallest gram
    lo_, hi_ = np.maximum(at - SPAN + 1, 0), np.minimum(at, len(low) - 1)
    i = np.searchsorted(ends, lo_)  # the run that holds the first window around the anchor
    while True:
        miss = (low[starts[i]] != h) & (starts[i] <= hi_)
        if not miss.any():
            break
        i = np.where(miss, np.minimum(i + 1, len(starts) - 1), i)
    return np.maximum(starts[i], lo_), np.minimum(ends[i], hi_)


def _pack_batch(names: list[str], *cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(cols), names=names)


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(anchor, doc_id, at, n): of an anchor's places in a batch the first two, which stand for n; the others with n = 0 and a key of their own."""
    for batch in batches:
        hs, ds, ats = [], [], []
        for doc, th, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            pos, h, _, _ = anchors(text.encode())
            if len(pos):
                hs.append(h.view(np.int64))
                ds.append(np.full(len(pos), doc, dtype=np.int64))
                ats.append((np.int64(th) << np.int64(32)) | pos)
        if not hs:
            continue
        h, d, at = (np.concatenate(x) for x in (hs, ds, ats))
        order = np.lexsort((at, d, h))
        h, d, at = h[order], d[order], at[order]
        new = np.r_[True, (h[1:] != h[:-1]) | (d[1:] != d[:-1]) | (at[1:] != at[:-1])]  # copies of a row aren't places of their own
        h, d, at = h[new], d[new], at[new]
        start = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        size = np.diff(np.r_[start, len(h)])
        rank = np.arange(len(h)) - np.repeat(start, size)
        n = np.where(rank == 0, np.repeat(np.maximum(size - 1, 1), size), np.where(rank == 1, 1, 0))
        key = np.where(n > 0, h, _mix((d + at).view(np.uint64)).view(np.int64))
        yield _pack_batch(["anchor", "doc_id", "at", "n"], *(pa.array(x.astype(np.int64)) for x in (key, d, at, n)))


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, at, n) of rows (sorted by anchor) whose anchor occurs at two places or more, and for each anchor
    of over HOT_LEAST places a row without doc_id: the anchor and the number of its places."""

    def out(d, t) -> pa.RecordBatch:
        return _pack_batch(["doc_id", "at", "n"], pa.array(d), pa.array(t), pa.nulls(len(d), pa.int64()))

    def hot(a, n) -> pa.RecordBatch:
        return _pack_batch(["doc_id", "at", "n"], pa.nulls(len(a), pa.int64()), pa.array(a), pa.array(n))

    run = None  # of the last anchor so far: the anchor, its first place, how many places, and whether it is known to be repeated
    for batch in batches:
        a, d, t, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        known = n == 0
        if known.any():
            yield out(d[known], t[known])
            a, d, t, n = a[~known], d[~known], t[~known], n[~known]
        if not len(a):
            continue
        start = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
        size = np.diff(np.r_[start, len(a)])
        fd, ft, total = d[start].copy(), t[start].copy(), np.add.reduceat(n, start)
        goes_on = run is not None and run[0] == a[0]
        if goes_on:
            fd[0], ft[0] = run[1]
            total[0] += run[2]
        elif run is not None and run[2] > HOT_LEAST:
            yield hot(np.array([run[0]]), np.array([run[2]]))
        hit = np.add.reduceat(((d != np.repeat(fd, size)) | (t != np.repeat(ft, size))).astype(np.int64), start) > 0
        if goes_on and run[3]:
            hit[0] = True
        elif goes_on and hit[0]:
            yield out(fd[:1], ft[:1])
        flag = np.repeat(hit, size)
        if flag.any():
            yield out(d[flag], t[flag])
        much = np.flatnonzero(total[:-1] > HOT_LEAST)
        if len(much):
            yield hot(a[start][much], total[much])
        # A run that goes on and isn't known to be repeated waits as one place.
        run = (a[-1], (fd[-1], ft[-1]), int(total[-1]), bool(hit[-1]))
    if run is not None and run[2] > HOT_LEAST:
        yield hot(np.array([run[0]]), np.array([run[2]]))


def _again(contexts: list[bytes], places: np.ndarray) -> tuple[np.ndarray, ...]:
    """(again, owner, within, first hash, second hash) of the windows of distinct contexts, by `places` of their first windows.

    A window is there again if the one before it in suffix order, ties by position, has the same bytes.
    """
    length = np.array([len(c) for c in contexts], dtype=np.int64)
    data = np.frombuffer(b"".join(contexts), dtype=np.uint8)
    count = length - LENGTH + 1
    owner = np.repeat(np.arange(len(contexts)), count)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    at = (np.cumsum(length) - length)[owner] + within
    place = places[owner] + within
    keys = [_window_hash(data, at, which) for which in (0, 1)]
    # Only windows whose hash recurs can be equal to others: these are put in order.
    by = np.argsort(keys[0], kind="stable")
    k = keys[0][by]
    same = k[1:] == k[:-1]
    some = by[np.r_[False, same] | np.r_[same, False]]
    again = np.zeros(len(owner), dtype=bool)
    if len(some):
        some = some[np.argsort(place[some], kind="stable")]
        suffix = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, LENGTH)[at[some]]).view(f"S{LENGTH}").ravel()
        order = np.argsort(suffix, kind="stable")
        suffix, some = suffix[order], some[order]
        start = np.flatnonzero(np.r_[True, suffix[1:] != suffix[:-1]])
        # A window may stand in two contexts (of one anchor met twice in it): it isn't there again at its own place.
        again[some] = place[some] > np.repeat(place[some[start]], np.diff(np.r_[start, len(some)]))
    return again, owner, within, keys[0], keys[1]


def _window_hash(data: np.ndarray, at: np.ndarray, which: int) -> np.ndarray:
    h = _doubled(data, which, 64, (4, 32))
    return _mix((h[6][at] * FACTORS[which][6] + h[5][at + 64]) * FACTORS[which][7] + h[2][at + 96])


def _ranks(doc: np.ndarray, th: np.ndarray) -> np.ndarray:
    """The rank of each row's document, for rows in order of (doc_id, th)."""
    return np.cumsum(np.r_[False, (doc[1:] != doc[:-1]) | (th[1:] != th[:-1])][: len(doc)]).astype(np.int64)


def _runs(again: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of the runs of marked windows within a context."""
    on = np.flatnonzero(again & ~(np.r_[False, again[:-1]] & np.r_[False, owner[1:] == owner[:-1]]))
    off = np.flatnonzero(again & ~(np.r_[again[1:], False] & np.r_[owner[:-1] == owner[1:], False]))
    return on, off


CONTEXT_NAMES = ["key", "also", "doc_id", "th", "first", "stop", "context"]
CONTEXT_ROWS = "key long, also long, doc_id long, th int, first long, stop long, context binary"


def _heads(doc: np.ndarray, th: np.ndarray, first: np.ndarray, context: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, heads, copies) for rows in order of place: rows with the first of each distinct context, and those
    with a later one (the same place met again is neither)."""
    place = (_ranks(doc, th) << np.int64(33)) + first
    code = context.dictionary_encode().indices.to_numpy()
    head = np.full(int(code.max()) + 1, len(code), dtype=np.int64)
    np.minimum.at(head, code, np.arange(len(code)))
    return place, np.sort(head), np.flatnonzero(place > place[head[code]])


def _sent(hs: list, ds: list, ts: list, fs: list, cs: list, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of CONTEXT_ROWS: contexts (stop 0), windows of hot anchors by their hashes (stop -1), and spans known already (stop above)."""
    key, doc, th, first = (np.concatenate(x) for x in (hs, ds, ts, fs))
    order = np.lexsort((first, th, doc))
    key, doc, th, first = key[order], doc[order], th[order], first[order]
    context = pa.array(cs, pa.binary()).take(pa.array(order))
    length = pa.compute.binary_length(context).to_numpy().astype(np.int64)
    place, heads, copies = _heads(doc, th, first, context)
    spans = [(copies, first[copies], first[copies] + length[copies])]
    is_hot = np.isin(key[heads], hot)

    def rows(i, also, start, stop, bodies, keys=None) -> pa.RecordBatch:
        return _pack_batch(CONTEXT_NAMES, pa.array(key[i] if keys is None else keys), pa.array(also), pa.array(doc[i]), pa.array(th[i].astype(np.int32)), pa.array(start), pa.array(stop), bodies)

    cold = heads[~is_hot]
    if len(cold):
        yield rows(cold, np.zeros(len(cold), np.int64), first[cold], np.zeros(len(cold), np.int64), context.take(pa.array(cold)))
    much = heads[is_hot]
    if len(much):
        again, owner, within, k0, k1 = _again(context.take(pa.array(much)).to_pylist(), place[much])
        on, off = _runs(again, owner)
        i = much[owner[on]]
        spans.append((i, first[i] + within[on], first[i] + within[off] + LENGTH))
        one = np.flatnonzero(~again)
        i = much[owner[one]]
        yield rows(i, k1[one].view(np.int64), first[i] + within[one], np.full(len(i), -1, np.int64), pa.nulls(len(i), pa.binary()), k0[one].view(np.int64))
    i, start, stop = (np.concatenate(x) for x in zip(*spans))
    if len(i):
        # Spans of a document that touch go on as one.
        base = _ranks(doc, th)[i] << np.int64(40)
        whole = np.array(merged(base + start, base + stop), dtype=np.int64)
        low = (1 << 40) - 1
        i = np.searchsorted(_ranks(doc, th), whole[:, 0] >> 40)
        start, stop = whole[:, 0] & low, whole[:, 1] - ((whole[:, 0] >> 40) << 40)
        yield rows(i, np.zeros(len(i), np.int64), start, stop, pa.nulls(len(i), pa.binary()), _mix((doc[i] + start).view(np.uint64)).view(np.int64))


def _contexts(hot) -> Iterator[pa.RecordBatch]:
    """The windows of each repeated anchor, `hot` a broadcast sorted array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        much = hot.value
        held: list[list] = [[], [], [], [], []]
        size = 0
        for batch in batches:
            docs, ths, texts, places = (batch.column(i) for i in range(4))
            for k in range(batch.num_rows):
                text = texts[k].as_py().encode()
                want = np.unique(np.asarray(places[k].values.to_numpy(zero_copy_only=False)))
                pos, h, first, last = anchors(text)
                i = np.flatnonzero(np.isin(pos, want))
                own = [text[x : y + LENGTH] for x, y in zip(first[i].tolist(), last[i].tolist())]
                for column, value in zip(held, (h[i].view(np.int64), np.full(len(i), docs[k].as_py(), dtype=np.int64), np.full(len(i), ths[k].as_py(), dtype=np.int32), first[i].astype(np.int64))):
                    column.append(value)
                held[4] += own
                size += sum(map(len, own))
                if size > BATCH:
                    yield from _sent(*held, much)
                    held, size = [[], [], [], [], []], 0
        if held[4]:
            yield from _sent(*held, much)

    return run


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans to remove, from CONTEXT_ROWS sorted by (key, also, doc_id, th, first).

    Contexts of one anchor are taken together, hot windows as they pass: the first place of equal hashes is the smallest.
    """
    wait: list[pa.RecordBatch] = []
    size, last = 0, None

    def out(doc, th, start, stop) -> pa.RecordBatch:
        return _pack_batch(["doc_id", "th", "start", "stop"], pa.array(doc), pa.array(th.astype(np.int32)), pa.array(start), pa.array(stop))

    for batch in batches:
        stop = batch.column(5).to_numpy(zero_copy_only=False)
        known = np.flatnonzero(stop > 0)
        if len(known):
            d, t, f = (batch.column(i).to_numpy(zero_copy_only=False)[known] for i in (2, 3, 4))
            yield out(d, t, f, stop[known])
        windows = np.flatnonzero(stop < 0)
        if len(windows):
            k, a, d, t, f = (batch.column(i).to_numpy(zero_copy_only=False)[windows] for i in range(5))
            rows = [np.r_[x0, x] for x0, x in zip(last or [x[:0] for x in (k, a, d, t, f)], (k, a, d, t, f))]
            k, a, d, t, f = rows
            start = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (a[1:] != a[:-1])])
            n = np.diff(np.r_[start, len(k)])
            later = (d != np.repeat(d[start], n)) | (t != np.repeat(t[start], n)) | (f != np.repeat(f[start], n))
            if later.any():
                yield out(d[later], t[later], f[later], f[later] + LENGTH)
            last = [x[start[-1] : start[-1] + 1] for x in rows]  # the last run may go on
        cold = np.flatnonzero(stop == 0)
        if not len(cold):
            continue
        part = batch if len(cold) == batch.num_rows else batch.take(pa.array(cold))
        wait.append(part)
        size += part.nbytes
        if size < TOGETHER:
            continue
        table = pa.Table.from_batches(wait).combine_chunks()
        a = table.column(0).to_numpy()
        if a[0] == a[-1]:
            continue  # one anchor so far
        cut = int(np.flatnonzero(a != a[-1])[-1]) + 1
        yield out(*_resolve(table.slice(0, cut)))
        rest = table.slice(cut).combine_chunks()
        wait, size = rest.to_batches(), rest.nbytes
    if wait:
        yield out(*_resolve(pa.Table.from_batches(wait).combine_chunks()))


def _resolve(table: pa.Table) -> tuple[np.ndarray, ...]:
    """(doc_id, th, start, stop) of what goes of whole anchors' contexts."""
    doc, th, first = (table.column(i).to_numpy() for i in (2, 3, 4))
    order = np.lexsort((first, th, doc))
    doc, th, first, context = doc[order], th[order], first[order], table.column(6).combine_chunks().take(pa.array(order))
    length = pa.compute.binary_length(context).to_numpy().astype(np.int64)
    place, heads, copies = _heads(doc, th, first, context)
    again, owner, within, _, _ = _again(context.take(pa.array(heads)).to_pylist(), place[heads])
    on, off = _runs(again, owner)
    i = heads[owner[on]]
    rows = np.r_[i, copies]
    return doc[rows], th[rows], np.r_[first[i] + within[on], first[copies]], np.r_[first[i] + within[off] + LENGTH, first[copies] + length[copies]]


def merged(starts: np.ndarray, stops: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of the union of spans."""
    if not len(starts):
        return []
    i = np.argsort(starts, kind="stable")
    s, e = starts[i], np.maximum.accumulate(stops[i])
    new = np.flatnonzero(np.r_[True, s[1:] > e[:-1]])
    return list(zip(s[new].tolist(), e[np.r_[new[1:] - 1, len(e) - 1]].tolist()))


def removed_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, text, head, spans) for each row: head is null where an earlier document has the whole text."""
    base = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")
    ).withColumn("th", F.hash("text"))
    spark = docs.sparkSession
    ids = base.select("doc_id", "th", F.sha2("text", 256).alias("sha"))
    heads = ids.groupBy("sha").agg(F.min("doc_id").alias("head"), F.count("*").alias("rows"))
    unique = join_groups(ids, heads, "sha", "rows").where("doc_id = head").select("doc_id", "th").distinct()
    # The texts are shuffled once by doc_id; the small sides are hashed, so that texts aren't sorted.
    # Every join has the same keys, or the exchange of the texts would not be shared.
    on = ["doc_id", "th"]
    texts = base.select("doc_id", "th", "text")
    small = lambda df: df.hint("shuffle_hash")
    own = texts.join(small(unique), on).select("doc_id", "th", "text")
    found = written(
        own.mapInArrow(_anchor_rows, "anchor long, doc_id long, at long, n long")
        .repartition("anchor").sortWithinPartitions("anchor", "doc_id", "at")
        .mapInArrow(_repeated, "doc_id long, at long, n long"),
        "places",
    )
    bound = max(HOT_LEAST, found.where("doc_id is not null").count() // HOT_MOST)
    much = found.where(F.col("doc_id").isNull() & (F.col("n") > bound)).select("at").toPandas()["at"]  # fewer than HOT_MOST numbers
    hot = spark.sparkContext.broadcast(np.sort(much.to_numpy(dtype=np.int64)))
    places = (
        found.where("doc_id is not null").groupBy("doc_id", F.shiftright("at", 32).cast("int").alias("th"))
        .agg(F.collect_list(F.col("at").bitwiseAND(F.lit((1 << 32) - 1))).alias("places"))
    )
    spans = (
        texts.join(small(places), on).select("doc_id", "th", "text", "places")
        .mapInArrow(_contexts(hot), CONTEXT_ROWS)
        .repartition("key").sortWithinPartitions("key", "also", "doc_id", "th", "first")
        .mapInArrow(_spans, "doc_id long, th int, start long, stop long")
        .groupBy("doc_id", "th").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    )
    marks = unique.withColumn("head", F.lit(True)).join(spans, on, "left")
    return texts.join(small(marks), on, "left").select("doc_id", "text", "head", "spans")


def removed(docs: DataFrame, texts: bool = True) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with `texts` the spans and the kept bytes."""
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    more = ", spans array<struct<start:long,stop:long>>, kept binary" if texts else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs_, n, gone, parts, sha, every, kept = [], [], [], [], [], [], []
            for doc, text, head, found in zip(*(batch.column(i).to_pylist() for i in range(4))):
                b = text.encode()
                if not head:  # a copy of an earlier document
                    spans = [(0, len(b))] if len(b) >= LENGTH else []
                else:
                    x = found or []
                    spans = merged(np.array([s["start"] for s in x], dtype=np.int64), np.array([s["stop"] for s in x], dtype=np.int64))
                at, keep = 0, []
                for s, e in spans:
                    keep.append(b[at:s])
                    at = e
                keep.append(b[at:])
                rest = b"".join(keep)
                docs_.append(None if doc == NULL_ID else doc)
                n.append(len(b))
                gone.append(len(b) - len(rest))
                parts.append(len(spans))
                sha.append(hashlib.sha256(rest).hexdigest())
                if texts:
                    every.append([{"start": s, "stop": e} for s, e in spans])
                    kept.append(rest)
            cols = [*(pa.array(x, pa.int64()) for x in (docs_, n, gone, parts)), pa.array(sha, pa.string())]
            if texts:
                cols += [pa.array(every, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), pa.array(kept, pa.binary())]
            yield _pack_batch(names + ["spans", "kept"] * texts, *cols)

    return removed_spans(docs).mapInArrow(run, f"doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string{more}")
