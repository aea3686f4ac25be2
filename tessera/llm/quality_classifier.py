"""Quality classifier: a sparse rule ensemble compiled into column expressions.

Small gradient-boosted trees are grown over text statistics; each path from a root to a node is a rule, a
conjunction of comparisons.  Lasso logistic regression weighs the rules, most weights become zero, and what is left
is compiled into one Spark expression, so scoring runs in generated code and never leaves the JVM.

The model is fitted on a bounded sample of labelled rows (`MAX_LABELLED` in expectation, drawn by a hash of
doc_id; only their statistics reach the driver); every document is scored.  Inputs are statistics of the text alone.

Nulls and empty texts have zero for every statistic and are scored like any other.  Labelled rows without a quality
are left out; several labels of one doc_id count by their mean.  With labels of one kind, or none, the score is their
smoothed share.  Repeated rows get the same score each.  Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .quality_rules import ledger

MAX_LABELLED = 20_000
TREES, DEPTH, BINS, LEAST_ROWS = 40, 2, 32, 10
RATE, LASSO, STEPS = 0.3, 0.002, 400
SEED = 7

#: name -> SQL over the measurements of a text; divisions by zero are zero.
STATISTICS: dict[str, str] = {
    "log_words": "ln(1 + n_words)",
    "word_length": "word_chars / n_words",
    "symbols": "n_symbols / n_words",
    "upper": "n_upper / word_chars",
    "exclaims": "n_exclaims / n_words",
    "digits": "n_digits / word_chars",
    "repeated": "n_repeat_words / n_words",
    "dup_lines": "n_dup_lines / n_lines",
    "words_a_line": "n_words / n_lines",
}


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, one double per statistic)."""
    marked = ledger(docs.select("doc_id", "text"))
    safe = lambda sql: F.coalesce(F.expr(_guarded(sql)), F.lit(0.0)).cast("double")
    return marked.select("doc_id", *[F.round(safe(sql), 9).alias(name) for name, sql in STATISTICS.items()])


def _guarded(sql: str) -> str:
    a, slash, b = sql.partition(" / ")
    return f"try_divide({a}, {b})" if slash else sql


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, above, threshold): value > threshold if above, else value <= threshold."""

    terms: tuple[tuple[int, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), dtype=bool)
        for f, above, t in self.terms:
            out &= (x[:, f] > t) if above else (x[:, f] <= t)
        return out

    def sql(self, names: list[str]) -> str:
        return " AND ".join(f"{names[f]} {'>' if above else '<='} {t!r}D" for f, above, t in self.terms)


@dataclass(frozen=True)
class Ensemble:
    names: tuple[str, ...]
    bias: float
    rules: tuple[tuple[Rule, float], ...]

    def score(self) -> Column:
        """The compiled expression over the statistics' columns."""
        total = F.lit(self.bias)
        for rule, w in self.rules:
            total = total + F.when(F.expr(rule.sql(list(self.names))), F.lit(w)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _tree(bins: np.ndarray, grad: np.ndarray, hess: np.ndarray, edges: list[np.ndarray]) -> tuple[list[tuple], np.ndarray]:
    """(paths of all nodes but the root, fitted step for each row)."""
    paths, step = [], np.zeros(len(grad))

    def grow(rows: np.ndarray, path: tuple, depth: int) -> None:
        g, h = grad[rows], hess[rows]
        step[rows] = g.sum() / (h.sum() + 1.0)
        if depth == DEPTH or len(rows) < 2 * LEAST_ROWS:
            return
        best = (1e-6, None, None)
        base = g.sum() ** 2 / (h.sum() + 1.0)
        for f, edge in enumerate(edges):
            if not len(edge):
                continue
            b = bins[rows, f]
            gl, hl, nl = (np.cumsum(np.bincount(b, v, len(edge) + 1))[:-1] for v in (g, h, np.ones(len(rows))))
            gain = gl**2 / (hl + 1.0) + (g.sum() - gl) ** 2 / (h.sum() - hl + 1.0) - base
            gain[(nl < LEAST_ROWS) | (len(rows) - nl < LEAST_ROWS)] = 0
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], f, k)
        if best[1] is None:
            return
        f, k = best[1], best[2]
        low = bins[rows, f] <= k
        for above, part in ((False, rows[low]), (True, rows[~low])):
            p = (*path, (f, above, float(edges[f][k])))
            paths.append(p)
            grow(part, p, depth + 1)

    grow(np.arange(len(grad)), (), 0)
    return paths, step


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, names: list[str]) -> Ensemble:
    """Rules from boosted trees, weighed by lasso logistic regression (accelerated proximal gradient)."""
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return Ensemble(tuple(names), float(np.log(share / (1 - share))), ())
    order = np.lexsort((*x.T, y))
    x, y = x[order], y[order]
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for f in range(x.shape[1])]
    bins = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    z, found = np.full(len(y), np.log(y.mean() / (1 - y.mean()))), {}
    rng = np.random.default_rng(SEED)
    for _ in range(TREES):
        p = _sigmoid(z)
        use = rng.random(len(y)) < 0.7
        paths, step = _tree(bins, np.where(use, y - p, 0.0), np.where(use, p * (1 - p), 0.0), edges)
        z = z + RATE * np.clip(step, -4, 4)
        for path in paths:
            found.setdefault(tuple(sorted(path)), None)
    rules = [Rule(p) for p in found]
    m = np.stack([r.holds(x) for r in rules], axis=1)
    _, first = np.unique(m, axis=1, return_index=True)  # equal columns count once
    rules, m = [rules[i] for i in sorted(first)], m[:, sorted(first)].astype(float)
    mean, dev = m.mean(axis=0), m.std(axis=0)
    ok = dev > 1e-9
    rules, a = [r for r, k in zip(rules, ok) if k], (m[:, ok] - mean[ok]) / dev[ok]
    w, v, b, t = np.zeros(a.shape[1]), np.zeros(a.shape[1]), float(np.log(y.mean() / (1 - y.mean()))), 1.0
    rate = 4 * len(y) / max(1e-9, np.linalg.norm(a, 2) ** 2)
    for _ in range(STEPS):
        r = _sigmoid(a @ v + b) - y
        new = v - rate * (a.T @ r) / len(y)
        new = np.sign(new) * np.maximum(np.abs(new) - rate * LASSO, 0)
        t1 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, w, t = new + (t - 1) / t1 * (new - w), new, t1
        b -= 2.0 * float(r.mean())
    raw = w / dev[ok]
    kept = [(r, round(float(k), 6)) for r, k in zip(rules, raw) if abs(k) > 1e-6]
    return Ensemble(tuple(names), round(float(b - (raw * mean[ok]).sum()), 6), tuple(kept))


def held_out(doc_id: Column, folds: int = 5, rest: int = 0) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == rest, F.lit(False))


def train(stats: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> Ensemble:
    """Fits on the labelled rows that aren't held out, a bounded sample of them."""
    one = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.avg("quality").alias("_y")).where(~held_out(F.col("doc_id")))
    n = one.count()
    if n > most:
        one = one.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 24)) < int(most / n * (1 << 24)))
    rows = stats.join(one, "doc_id").select(*STATISTICS, "_y").toPandas()
    y = (rows.pop("_y").to_numpy(float) >= 0.5).astype(float)
    return fit(rows.to_numpy(float).reshape(len(y), len(STATISTICS)), y, list(STATISTICS))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of each row."""
    stats = written(statistics(docs), "statistics")
    model = train(stats, labels)
    out = stats.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), model.score().alias("score"))
    return out.withColumn("predicted", F.when(F.col("score") >= 0.3, 1).otherwise(0))
