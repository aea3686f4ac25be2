"""Where models plug in: embedding, reranking, and retrieval put together."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# What an embedding model is told about a text.
PASSAGE, QUERY = "passage: ", "query: "
TEXTS = 32
MODES = ("hybrid", "dense", "bm25")
_loaded: dict[str, object] = {}


def once(name: str, make: Callable[[], object]) -> object:
    """A model made once per Python worker."""
    if name not in _loaded:
        _loaded[name] = make()
    return _loaded[name]


def _embedded(rows: DataFrame, prefix: str, make: Callable[[], Callable[[list[str]], np.ndarray]], name: str) -> DataFrame:
    """`rows` (with text) and the embedding, of length one, of each prefixed text, TEXTS at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = once(name, make)
        for batch in batches:
            parts = []
            for lo in range(0, len(batch), TEXTS):
                v = np.asarray(encode([prefix + (t or "") for t in batch["text"].iloc[lo : lo + TEXTS]]), dtype=float)
                parts += list(v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12))
            yield batch.assign(embedding=parts)

    names = ", ".join(f"{c} {t}" for c, t in rows.dtypes)
    return rows.mapInPandas(run, f"{names}, embedding array<double>")


def embed_passages(rows: DataFrame, make, name: str = "embedder") -> DataFrame:
    return _embedded(rows, PASSAGE, make, name)


def embed_queries(rows: DataFrame, make, name: str = "embedder") -> DataFrame:
    return _embedded(rows, QUERY, make, name)


def rerank(hits: DataFrame, make: Callable[[], Callable[[list[tuple[str, str]]], list[float]]], top_n: int, name: str = "reranker") -> DataFrame:
    """The `top_n` best of each question's hits (qid, id, pos, question, text ...) by the scorer, ties in fused order: pos becomes the new place, fused the old."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = once(name, make)
        for batch in batches:
            yield batch.assign(rerank=[float(x) for x in score(list(zip(batch["question"], batch["text"])))] if len(batch) else [])

    names = ", ".join(f"{c} {t}" for c, t in hits.dtypes)
    scored = hits.mapInPandas(run, f"{names}, rerank double").withColumnRenamed("pos", "fused")
    by = Window.partitionBy("qid").orderBy(F.desc("rerank"), "fused")
    return scored.withColumn("pos", F.row_number().over(by).cast("long")).where(F.col("pos") <= top_n)


def check_mode(mode: str) -> str:
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}, not {mode!r}")
    return mode
