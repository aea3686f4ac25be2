"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Documents are cut into blocks of `BLOCK` words.  A source with target t takes its words floor(t / size) times over and then the
beginning of one more permutation of its blocks, the last block cut to the word, so that what is taken
equals the rounded target.  Each pass (epoch) has its own permutation: blocks are ordered by a keyed hash, ranked inside
hash buckets of bounded size and offset by the sums of the buckets before.  The number of blocks so wanted is the source's quota.

The splitting tree divides the quotas among the output shards: at each node the quotas of the left half are a multivariate
hypergeometric draw, exact at any size (`hypergeometric`).  What a shard gets of a source is a run of its permuted sequence,
disjoint from every other shard's; a block is taken exactly when the tree dealt it to a shard, and is shuffled
within the shard by another hash.  Shards have about `SHARD_BLOCKS` blocks, and there are `SHARDS` at least.

Nothing per source reaches the driver: targets come from a few rounds of sums, and the tree has two levels, quotas of
`GROUPS` groups of sources and then each group's sources against the group's shard totals, a task per group.  A window's bucket
holds about `BUCKET_ROWS` blocks, a shard's window its own blocks only: neither grows with the data.

Nulls: a null text has size 0 and is not drawn; the null source is a source and comes last; a null doc_id is an id.  Repeated
rows (equal doc_id, source and text) are separate rows, each with blocks of its own.  Very long texts have many blocks, dealt
like any others.  An empty table gives an empty result.  Extra columns, whatever their names, are ignored by the plan and
kept by `mixed_documents`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, WS, join_groups, word_list, written

BLOCK = 512
WEIGHTS = (5, 2, 1)
SHARDS, SHARD_BLOCKS = 64, 65_536
BUCKET_ROWS = 8192
GROUPS = 64
SHARE = Fraction(3, 2)
MOST_REPEATS = 2
NUMPY_MOST = 1_000_000_000  # numpy draws up to here
DEVIATIONS = 12  # the probability beyond is below 1e-30, less than a double's last bit


def hypergeometric(rng: np.random.Generator, good: int, bad: int, take: int) -> int:
    """How many of `take` drawn from good + bad are good; exact at any size.

    Beyond numpy's range by inversion: the probabilities around the mode follow from their exact ratios.
    """
    if not take or not good:
        return 0
    if good + bad < NUMPY_MOST:
        return int(rng.hypergeometric(good, bad, take))
    return inverted(rng.random(), good, bad, take)


def inverted(u: float, good: int, bad: int, take: int) -> int:
    """The smallest k whose cumulated probability reaches `u`."""
    n = good + bad
    low, high = max(0, take - bad), min(good, take)
    mode = min(high, max(low, (take + 1) * (good + 1) // (n + 2)))
    reach = int(DEVIATIONS * math.sqrt(take / n * good * (bad / n) * (n - take) / max(1, n - 1))) + 64
    low, high = max(low, mode - reach), min(high, mode + reach)
    up, down = np.arange(mode, high, dtype=np.float64), np.arange(mode, low, -1, dtype=np.float64)
    rise = np.cumsum(np.log(good - up) + np.log(take - up) - np.log(up + 1) - np.log((bad - take) + up + 1))
    fall = np.cumsum(np.log(down) + np.log((bad - take) + down) - np.log(good - down + 1) - np.log(take - down + 1))
    p = np.cumsum(np.exp(np.concatenate([fall[::-1], [0.0], rise])))
    return low + min(len(p) - 1, int(np.searchsorted(p, u * p[-1])))


def dealt(quotas: list[int], totals: list[int], seed: int = 0) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, sources, blocks) for each shard in turn: how many blocks of which sources it gets, zeros left out.

    Rows sum to the quotas, columns to the totals (both have one sum); at each node of the tree the left half's part of the quotas
    is a multivariate hypergeometric draw, made as a chain of univariate ones.
    """
    ends = [0, *np.cumsum(np.array(totals, dtype=np.int64)).tolist()]
    q = np.array(quotas, dtype=np.int64)
    stack = [(0, len(totals), np.flatnonzero(q), q[q > 0])]
    while stack:
        lo, hi, who, n = stack.pop()
        if not len(who):
            continue
        if hi - lo == 1:
            yield lo, who, n
            continue
        mid = (lo + hi) // 2
        take, rest = ends[mid] - ends[lo], ends[hi] - ends[lo]
        rng = np.random.default_rng([seed, lo, hi])
        left = np.zeros_like(n)
        for i, good in enumerate(n.tolist()):
            rest -= good
            left[i] = hypergeometric(rng, good, rest, take)
            take -= int(left[i])
        right = n - left
        stack += [(mid, hi, who[right > 0], right[right > 0]), (lo, mid, who[left > 0], left[left > 0])]


def even(total: int, shards: int) -> list[int]:
    """`total` blocks over the shards, one more or less each."""
    return [total * (i + 1) // shards - total * i // shards for i in range(shards)]


def splitting_tree(quotas: list[int], shards: int, seed: int = 0) -> np.ndarray:
    """[source, shard] block counts: rows sum to the quotas, columns differ by one at most."""
    out = np.zeros((len(quotas), shards), dtype=np.int64)
    for shard, who, n in dealt(quotas, even(sum(quotas), shards), seed):
        out[who, shard] = n
    return out


def _key(source) -> F.Column:
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("-"))


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, mark): mark tells texts of one id and size apart."""
    return docs.select("doc_id", "source", F.size(word_list(F.col("text"))).cast("long").alias("size"), F.xxhash64("text").alias("mark"))


def targets(per: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: Fraction = SHARE, most: int = MOST_REPEATS) -> DataFrame:
    """`per` (source, source_size, ...) with sid, target and words (the target rounded, halves to even).

    Targets are proportional to the repeating weights and stop at `most` x size; the excess is reshared by weight.  A source stops
    where its size for its weight is below a water level, which rises from round to round: each is one sum over the sources.
    """
    spark = per.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = F.col("source").asc_nulls_last()
    dealt_ = written(per.repartitionByRange(parts, order).withColumn("_part", F.spark_partition_id()), "sources")
    counts = dict(dealt_.groupBy("_part").agg(F.count("*")).collect())  # a number per partition
    offsets, at = [], 0
    for p in sorted(counts):
        offsets.append((p, at))
        at += counts[p]
    starts = spark.createDataFrame(offsets, "_part int, _start long")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("sid") % len(weights) + 1).cast("int"))
    per = dealt_.join(F.broadcast(starts), "_part").withColumn("sid", F.col("_start") + F.row_number().over(Window.partitionBy("_part").orderBy(order)) - 1).drop("_part", "_start").withColumn("_w", weight)
    per = written(per, "sources")
    a, b = share.numerator, share.denominator
    everything, level_w = per.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("_w"), F.lit(0))).first()
    left, stopped = a * everything, 0  # b times the words not yet given out
    while True:
        over = F.expr(f"cast({left} AS decimal(38,0)) * _w > cast({b * most} AS decimal(38,0)) * source_size * {max(1, level_w)}")
        s, w = per.agg(F.coalesce(F.sum(F.when(over, F.col("source_size"))), F.lit(0)), F.coalesce(F.sum(F.when(~over, F.col("_w"))), F.lit(0))).first()
        if s == stopped and w == level_w or not w:
            break
        left, level_w, stopped = a * everything - b * most * s, w, s
    open_ = F.expr(f"cast({left} AS decimal(38,0)) * _w")
    low = F.expr(f"(cast({left} AS decimal(38,0)) * _w) div cast({b * max(1, level_w)} AS decimal(38,0))")
    twice = 2 * (open_ - low.cast("decimal(38,0)") * (b * max(1, level_w)))
    up = (twice > b * max(1, level_w)) | ((twice == b * max(1, level_w)) & (low % 2 == 1))
    stop = F.col("source_size") * most
    return per.select(
        *[c for c in per.columns if c != "_w"],
        F.when(over, stop.cast("double")).otherwise(open_.cast("double") / F.lit(float(b * max(1, level_w)))).alias("target"),
        F.when(over, stop).otherwise(low + up.cast("long")).alias("words"),
    )


def plan(docs_sized: DataFrame, shards: int | None = None, seed: int = 0, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(per_source, blocks) for rows (doc_id, source, size, mark).

    per_source: key, source_size, target.  blocks: every source's permuted sequence, its quota and the blocks behind it in the last pass:
    doc_id, source, size, mark, copy, epoch, block, words (0 behind the quota), sid, at (the place in the sequence).
    """
    rows = docs_sized.groupBy("doc_id", "source", "size", "mark").agg(F.count("*").alias("copies"))
    per = rows.groupBy("source").agg(
        F.sum(F.col("size") * F.col("copies")).alias("source_size"), F.sum(F.ceil(F.col("size") / block) * F.col("copies")).alias("blocks"), F.count("*").alias("rows")
    )
    goal = targets(per).withColumn("key", _key(F.col("source")))
    goal = goal.withColumn("whole", F.expr("if(source_size > 0, words div source_size, 0L)")).withColumn("rest", F.col("words") - F.col("whole") * F.col("source_size"))
    goal = goal.withColumn("buckets", F.greatest(F.lit(1), F.ceil(F.col("blocks") / BUCKET_ROWS)).cast("long"))
    goal = written(goal, "targets")
    meta = goal.where("whole > 0 or rest > 0").select("key", "rows", "sid", "blocks", "whole", "rest", "buckets")
    b = (
        join_groups(rows.where("size > 0").withColumn("key", _key(F.col("source"))), meta, "key", "rows")
        .withColumn("copy", F.explode(F.expr("sequence(1L, copies)")))
        .withColumn("epoch", F.explode(F.expr("sequence(0L, if(rest > 0, whole, whole - 1))")))
        .withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / block))))
        .withColumn("words", F.least(F.lit(block).cast("long"), F.col("size") - F.col("block") * block))
        .withColumn("hash", F.xxhash64(F.lit(seed), "epoch", "doc_id", "mark", "copy", "block"))
        .withColumn("bucket", F.pmod(F.shiftrightunsigned("hash", 16), F.col("buckets")))
        .select("sid", "epoch", "bucket", "hash", "doc_id", "source", "size", "mark", "copy", "block", "words", "rest", "whole", "blocks")
    )
    order = Window.partitionBy("sid", "epoch", "bucket").orderBy("hash", "doc_id", "size", "mark", "copy", "block")
    sums = b.groupBy("sid", "epoch", "bucket").agg(F.count("*").alias("n"), F.sum("words").alias("w"))
    before = Window.partitionBy("sid", "epoch").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("sid", "epoch", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("w").over(before), F.lit(0)).alias("w0"))
    ranked = (
        b.withColumn("i", F.row_number().over(order))
        .withColumn("c", F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .join(offsets, ["sid", "epoch", "bucket"])
        .withColumn("at", F.col("epoch") * F.col("blocks") + F.col("n0") + F.col("i") - 1)
        .withColumn("words", F.when(F.col("epoch") < F.col("whole"), F.col("words")).otherwise(F.greatest(F.lit(0).cast("long"), F.least("words", F.col("rest") - (F.col("w0") + F.col("c") - F.col("words"))))))
        .select("sid", "doc_id", "source", "size", "mark", "copy", "epoch", "block", "words", "at")
    )
    return goal.select("key", "rows", "source_size", "target"), ranked


def sharded(blocks: DataFrame, shards: int | None = None, seed: int = 0) -> DataFrame:
    """The blocks that the splitting tree deals to a shard, with the shard and the position there (a local shuffle)."""
    quotas = written(blocks.where("words > 0").groupBy("sid").agg(F.count("*").alias("quota")).withColumn("g", (F.col("sid") % GROUPS).cast("int")), "quotas")
    group = {r.g: int(r.n) for r in quotas.groupBy("g").agg(F.sum("quota").alias("n")).collect()}  # GROUPS rows at most
    own = [group.get(g, 0) for g in range(GROUPS)]
    total = sum(own)
    n = shards or max(SHARDS, -(-total // SHARD_BLOCKS))

    def deal(part: pd.DataFrame) -> pd.DataFrame:
        g, part = int(part["g"].iloc[0]), part.sort_values("sid")
        mine = [0] * n
        for shard, who, k in dealt(own, even(total, n), seed):
            i = int(np.searchsorted(who, g))
            if i < len(who) and who[i] == g:
                mine[shard] = int(k[i])
        sid, at = part["sid"].to_numpy(), np.zeros(len(part), dtype=np.int64)
        step = np.maximum(1, part["quota"].to_numpy() // n)
        out = []
        for shard, who, k in dealt(part["quota"].tolist(), mine, seed + 1 + g):
            start = at[who].copy()
            at[who] += k
            out.append(pd.DataFrame({"sid": sid[who], "shard": shard, "start": start, "stop": at[who], "step": step[who]}))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({c: pd.Series(dtype="int64") for c in ("sid", "shard", "start", "stop", "step")})

    # A run of a source is found by a slot of places about as long as a run: an equal key, and few runs in each.
    runs = quotas.groupBy("g").applyInPandas(deal, "sid long, shard long, start long, stop long, step long")
    slots = runs.withColumn("slot", F.explode(F.expr("sequence(start div step, (stop - 1) div step)"))).drop("step")
    steps = quotas.select("sid", "quota", F.greatest(F.lit(1).cast("long"), F.expr(f"quota div {n}")).alias("step"))
    placed = join_groups(blocks, steps, "sid", "quota").withColumn("slot", F.expr("at div step")).drop("step", "quota")
    taken = placed.join(slots, ["sid", "slot"]).where("at >= start AND at < stop").drop("slot", "start", "stop")
    mixed = F.xxhash64(F.lit(seed + 1), "sid", "at")
    return taken.withColumn("position", F.row_number().over(Window.partitionBy("shard").orderBy(mixed, "sid", "at")).cast("long"))


IDENTITY = ("doc_id", "source", "size", "mark", "copy")


def mixture(docs: DataFrame, shards: int | None = None, seed: int = 0, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, shards (how many it reaches), first_shard and first_position (its first place)."""
    # Sizes and draws are small and read several times: each is computed once and written.
    rows = written(sized(docs), "sizes")
    per_source, blocks = plan(rows, shards, seed, block)
    blocks = written(blocks, "blocks")
    taken = sharded(blocks, shards, seed).groupBy(*IDENTITY).agg(F.sum("words").alias("taken"), F.count_distinct("shard").alias("shards"), F.min(F.struct("shard", "position")).alias("first"))
    every = rows.groupBy(*IDENTITY[:-1]).agg(F.count("*").alias("copies")).withColumn("copy", F.explode(F.expr("sequence(1L, copies)"))).drop("copies")
    on = [every[c].eqNullSafe(taken[c]) for c in IDENTITY]
    some = lambda c: F.coalesce(taken[c], F.lit(0)).cast("long").alias(c)
    out = every.join(taken, on, "left").select(every["doc_id"], every["size"], _key(every["source"]).alias("key"), some("taken"), some("shards"), taken["first"]["shard"].alias("first_shard"), taken["first"]["position"].alias("first_position"))
    return join_groups(out, per_source, "key", "rows").select("doc_id", "size", "source_size", "target", "taken", "shards", "first_shard", "first_position")


def mixed_documents(docs: DataFrame, shards: int | None = None, seed: int = 0, block: int = BLOCK) -> DataFrame:
    """The mix as texts, dealt to shards: one row per draw (a block of a document in an epoch), in order of position.

    The columns of `docs`, then shard and position.  A block taken whole keeps its text and white space, so that
    a document's blocks joined in order are its text; of one cut to the word the words are joined by one
    space.  `n_chars`, where there is one, follows the text.  A shard is in one partition, sorted by position.
    """
    own = [c for c in docs.columns if c not in ("shard", "position")]
    _, blocks = plan(written(sized(docs), "sizes"), shards, seed, block)
    draws = sharded(written(blocks, "blocks"), shards, seed)
    # A document's draws come together before its text joins them, so that texts are moved and cut once.
    place = F.struct("block", F.col("words").cast("int").alias("words"), "shard", "position")
    runs = draws.groupBy(*[F.col(c).alias(f"draw_{c}") for c in IDENTITY]).agg(F.collect_list(place).alias("runs"))
    base = docs.select(F.struct(*own).alias("row"), F.col("doc_id"), F.col("source"), F.col("text"), F.size(word_list(F.col("text"))).cast("long").alias("size"), F.xxhash64("text").alias("mark"))
    numbered = base.withColumn("copy", F.row_number().over(Window.partitionBy(*IDENTITY[:-1]).orderBy(F.lit(0))).cast("long"))
    on = [F.col(c).eqNullSafe(F.col(f"draw_{c}")) for c in IDENTITY]
    cut = F.when(F.col("size") <= block, F.array("text")).otherwise(F.regexp_extract_all("text", F.lit(rf"[{WS}]*+(?>{WORD}+[{WS}]*+){{1,{block}}}"), 0))

    def taken(r):
        part = F.get("parts", r["block"].cast("int"))
        whole = r["words"] == F.least(F.lit(block).cast("long"), F.col("size") - r["block"] * block)
        return F.struct(F.when(whole, part).otherwise(F.array_join(F.slice(word_list(part), 1, r["words"]), " ")).alias("text"), r["shard"].alias("shard"), r["position"].alias("position"))

    joined = numbered.join(runs, on).select("row", "size", "runs", cut.alias("parts"))
    out = joined.select("row", F.explode(F.transform("runs", taken)).alias("draw"))
    cols = [F.col("draw.text").alias(c) if c == "text" else F.length("draw.text").cast("long").alias(c) if c == "n_chars" else F.col("row")[c].alias(c) for c in own]
    out = out.select(*cols, "draw.shard", "draw.position")
    return (out.repartition(shards, "shard") if shards else out.repartition("shard")).sortWithinPartitions("shard", "position")
