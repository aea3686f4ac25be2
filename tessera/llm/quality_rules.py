"""Quality rules as a bitmask ledger, in DataFrame operations only.

Every rule is evaluated once per document: the ledger holds the measurements and one long whose bit i says
that rule i failed.  A policy is a version of a mask (and of how many failures of it reject); policies and
ablations read the ledger only, so changing one never touches the texts again.

Nulls and empty texts have no words; they fail `few_words` and, having nothing else to measure, no other
rule.  Repeated rows are judged row by row.  Extra columns are kept by `ledger` unless they carry one of
its names, in which case the ledger's own column takes the place.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import squeezed

SYMBOLS = "#*$%&|<>"  # fixed value of the contract
WINDOW = 8  # words; a power of two, see `repeat_words`

#: (name, SQL condition that fails).  A rule's bit is its position; new rules are only ever appended.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 20"),
    ("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    ("many_symbols", "10 * n_symbols > 3 * n_words"),
    ("shouting", "10 * n_upper > 5 * word_chars"),
    ("exclamations", "10 * n_exclaims > 3 * n_words"),
    ("repeated_lines", "10 * n_dup_lines > 5 * n_lines"),
    ("long_words", "word_chars > 20 * n_words"),
    ("short_words", "word_chars < 2 * n_words"),
    ("digits", "10 * n_digits > 4 * word_chars"),
)
BIT = {name: i for i, (name, _) in enumerate(RULES)}


def mask_of(*names: str) -> int:
    return sum(1 << BIT[n] for n in names)


#: version -> mask of the rules that reject.
POLICIES = {"base": mask_of("few_words", "repeated_windows"), "v1": (1 << len(RULES)) - 1}


def repeat_words(words: Column, n: Column) -> Column:
    """Words that lie in a window of WINDOW words which the text holds twice or more.

    Window hashes are sorted with their positions, so the work grows as n log n with the text; texts whose
    hashes are all different, nearly all of them, stop after one pass.
    """
    def paired(hs: Column, step: int) -> Column:
        return F.transform(hs, lambda h, i: F.xxhash64(h, F.get(hs, i + step)))

    def windows(hs: Column) -> Column:
        """Hashes of two, four, then eight words from each position that has as many."""
        eight = _let(paired(hs, 1), lambda two: _let(paired(two, 2), lambda four: paired(four, 4)))
        return F.slice(eight, F.lit(1), n - (WINDOW - 1))

    hashes = F.when(n < WINDOW, F.array().cast("array<bigint>")).otherwise(
        _let(F.transform(words, lambda w: F.xxhash64(w)), windows)
    )

    def covered(hs: Column) -> Column:
        pairs = F.sort_array(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def among(s: Column) -> Column:
            same = F.filter(s, lambda x, k: (x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"]))
            at = F.sort_array(F.transform(same, lambda x: x["i"]))
            return _let(at, lambda p: F.aggregate(
                F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW)))),
                F.lit(0), lambda a, x: a + x,
            ))

        return _let(pairs, among)

    return _let(hashes, lambda hs: F.when(F.size(F.array_distinct(hs)) == F.size(hs), F.lit(0)).otherwise(covered(hs)))


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once: lambda variables are never evaluated anew."""
    return F.transform(F.array(value), body)[0]


def measurements(text: Column) -> dict[str, Column]:
    """What the rules look at, but for what is derived from the column `_words`."""
    n = F.size("_words")
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]")))
    kept = lambda pattern: F.length(F.regexp_replace(F.col("_flat"), pattern, ""))
    return {
        "n_words": n.cast("long"),
        "word_chars": (F.length("_flat") - F.greatest(n - 1, F.lit(0))).cast("long"),
        "n_symbols": kept(f"[^{SYMBOLS}]+").cast("long"),
        "n_upper": kept(r"[^\p{Lu}]+").cast("long"),
        "n_exclaims": kept("[^!]+").cast("long"),
        "n_digits": kept("[^0-9]+").cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_dup_lines": _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeat_words(F.col("_words"), n).cast("long"),
    }


def ledger(docs: DataFrame, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """`docs` with the measurements and `failed_bits`."""
    names = [*measurements(F.col("text")), "failed_bits"]
    base = docs.drop(*[c for c in docs.columns if c.lower() in {*names, "_flat", "_words"}])
    flat = base.withColumn("_flat", F.btrim(squeezed(F.col("text")), F.lit(" ")))
    words = flat.withColumn("_words", F.when(F.col("_flat") == "", F.array().cast("array<string>")).otherwise(F.split("_flat", " ")))
    measured = words.withColumns(measurements(F.col("text"))).drop("_flat", "_words")
    bits = [F.when(F.expr(f"n_words > 0 or {i} = 0") & F.expr(cond), F.lit(1 << i)).otherwise(F.lit(0)) for i, (_, cond) in enumerate(rules)]
    return measured.withColumn("failed_bits", reduce(lambda a, b: a.bitwiseOR(b), bits).cast("long"))


def apply_policy(marked: DataFrame, version: str, policies: dict[str, int] = POLICIES) -> DataFrame:
    """A ledger with `base_failed` and `kept` under that version of the policy."""
    hit = lambda mask: F.col("failed_bits").bitwiseAND(F.lit(mask)) != 0
    return marked.withColumn("base_failed", hit(policies["base"])).withColumn("kept", ~hit(policies["base"] | policies[version]))


def ablations(marked: DataFrame, version: str = "v1", policies: dict[str, int] = POLICIES) -> DataFrame:
    """One row per rule of the policy: how many rows fail it, fail it alone, and pass without it.

    Works on counts of distinct bitmasks, so the shuffle has a row per mask and task at most.
    """
    mask = policies[version]
    by_mask = marked.groupBy(F.col("failed_bits").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << i).cast("long").alias("bit")) for i, (r, _) in enumerate(RULES) if mask >> i & 1]))
    x = by_mask.select("bits", "n", rules.alias("x")).select("bits", "n", "x.*")
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).cast("long")
    return x.groupBy("rule").agg(
        total(F.col("bits").bitwiseAND(F.col("bit")) != 0).alias("failed"),
        total(F.col("bits") == F.col("bit")).alias("failed_alone"),
        total(F.col("bits").bitwiseAND(F.bitwise_not("bit")) == 0).alias("kept_without_rule"),
    )
