"""Language identification with segmentation-marginalised unigrams.

A language is a probability for each piece of a fixed public vocabulary.  A word's probability sums, by the forward
algorithm, over all its segmentations into pieces; a text's is the product over its words.  Piece probabilities come
from one round of expectation-maximisation that starts from equal probabilities, over the words of a bounded
sample of labelled rows: `LANG_DOCS` of each language in expectation, by a hash of doc_id, and all of a language that has
fewer.  What reaches the driver at once is at most one count per piece for `LANGS_TOGETHER` languages; so much is broadcast at a time
as well, and more languages are scored group by group, with the same result.

A null text, or one without a letter, is `und` with score 0, as is every text if there was nothing to learn from (an empty
table, no labels).  Words of any length count, in learning and in scoring: long ones are rescaled on the way; a long text is scored whole.
Repeated rows get the same result each; equal likelihoods go to the first language in code-point order.  Extra columns are ignored,
whatever their names.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_groups, written

LANG_DOCS, LANGS_TOGETHER = 2_000, 16
STEP = 1e60  # by which sums are rescaled
MEMO_MOST = 600_000
LONGEST = 16
SHORT = 24  # words up to here need no rescaling and go forward together
CELLS = 1 << 20
TOGETHER = 1 << 20  # characters of texts whose new words are scored together
SMOOTH = 0.1
EDGE = "▁"  # fixed value: the vocabulary's mark of a word's start


def pieces(path: str) -> list[str]:
    """The vocabulary's pieces, in order of their ids."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]


def core(word: str) -> str:
    """The letters of a word (signs at its ends and inside are not language), with the mark of its start; '' without letters."""
    letters = word if word.isalpha() else "".join(c for c in word if c.isalpha())
    return EDGE + letters if letters else ""


def expected_counts(word: str, known: dict[str, int]) -> dict[str, float]:
    """Expected uses of each piece in a word when all segmentations of equal length are equally likely; of any length of word."""
    n, p = len(word), 1e4 / max(1, len(known))
    ends = [[j for j in range(i + 1, min(n, i + LONGEST) + 1) if j == i + 1 or word[i:j] in known] for i in range(n)]
    ahead, back = [0.0] * (n + 1), [0.0] * (n + 1)
    up, down = [0] * (n + 1), [0] * (n + 1)  # how often each sum was made larger by STEP
    ahead[0] = back[n] = 1.0
    for i in range(n):
        for j in ends[i]:
            ahead[j] += ahead[i] * p
        near = range(i + 1, min(n, i + LONGEST) + 1)
        k = _steps(max(ahead[j] for j in near))
        for j in near:
            ahead[j] *= STEP**k
        up[i + 1] = up[i] + k
    starts: list[list[int]] = [[] for _ in range(n + 1)]
    for i, js in enumerate(ends):
        for j in js:
            starts[j].append(i)
    for j in range(n, 0, -1):
        for i in starts[j]:
            back[i] += back[j] * p
        near = range(max(0, j - LONGEST), j)
        k = _steps(max(back[i] for i in near))
        for i in near:
            back[i] *= STEP**k
        down[j - 1] = down[j] + k
    out: dict[str, float] = {}
    for i, js in enumerate(ends):
        for j in js:
            if word[i:j] in known:
                share = ahead[i] / ahead[n] * p * back[j]
                for _ in range(abs(k := up[n] - up[i] - down[j])):
                    share = share * STEP if k > 0 else share / STEP
                out[word[i:j]] = out.get(word[i:j], 0.0) + share
    return out


def _steps(top: float) -> int:
    return 1 if top < 1 / STEP else -1 if top > STEP else 0


def learn(docs: DataFrame, path: str, most: int = LANG_DOCS) -> DataFrame:
    """(lang, piece, n): expected uses of each piece, from rows (doc_id, text, lang) with a language; written."""
    rows = docs.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    counts = rows.groupBy("lang").agg(F.count("*").alias("rows"))
    share = F.pmod(F.xxhash64("doc_id", F.lit("languages")), F.lit(1 << 24)) * F.col("rows") < F.lit(most << 24)
    rows = join_groups(rows, written(counts, "languages"), "lang", "rows").where(share).drop("rows")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[str, Counter] = {}
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen.setdefault(lang, Counter()).update(text.lower().split())
            for lang, c in seen.items():
                by_core: Counter = Counter()
                for w, k in c.items():
                    if w := core(w):
                        by_core[w] += k
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(by_core), pa.string()), pa.array([*by_core], pa.string()), pa.array([*by_core.values()], pa.int64())], names=["lang", "word", "n"])

    def uses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {p: i for i, p in enumerate(pieces(path))}
        sums: dict[tuple[str, str], float] = {}

        def out() -> pa.RecordBatch:
            keys = [*sums]
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in keys], pa.string()), pa.array([b for _, b in keys], pa.string()), pa.array([*sums.values()], pa.float64())], names=["lang", "piece", "n"])

        for batch in batches:
            for lang, word, k in zip(*(batch.column(i).to_pylist() for i in range(3))):
                for piece, x in expected_counts(word, known).items():
                    sums[lang, piece] = sums.get((lang, piece), 0.0) + x * k
            if len(sums) > MEMO_MOST:
                yield out()
                sums = {}
        yield out()

    counted = rows.select("text", "lang").mapInArrow(words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    uses_ = counted.mapInArrow(uses, "lang string, piece string, n double").groupBy("lang", "piece").agg(F.round(F.sum("n"), 4).alias("n"))
    return written(uses_, "pieces")


def probabilities(totals: DataFrame, langs: list[str], size: int) -> dict[str, dict[str, float]]:
    """language -> piece -> probability, and "" for a piece never met; of the languages asked for, whose counts are collected."""
    out: dict[str, dict[str, float]] = {lang: {} for lang in langs}
    for lang, piece, x in totals.where(F.col("lang").isin(*langs)).collect():
        out[lang][piece] = x
    for lang, c in out.items():
        whole = sum(c[p] for p in sorted(c)) + SMOOTH * size
        out[lang] = {p: (c[p] + SMOOTH) / whole for p in sorted(c)} | {"": SMOOTH / whole}
    return out


class Model:
    """Per piece a row of probabilities over the languages; words' log-likelihoods in a bounded memory."""

    def __init__(self, learned: dict[str, dict[str, float]], vocabulary: list[str]):
        self.langs = sorted(learned)
        rest = [learned[k][""] for k in self.langs]
        self.rows = {p: tuple(learned[k].get(p, r) for k, r in zip(self.langs, rest)) for p in vocabulary}
        self.other = tuple(r * 1e-2 for r in rest)  # a letter that is no piece
        # Pieces, and None for what only begins pieces; what is absent begins none.
        self.found = {p[:j]: None for p in vocabulary for j in range(1, min(len(p), LONGEST))} | self.rows
        # The same pieces as arrays: letters numbered from 1, a sorted key for each step from a beginning to a longer one.
        short = [p for p in vocabulary if 0 < len(p) <= LONGEST]
        letters = sorted(set("".join(short)))
        number = {c: i + 1 for i, c in enumerate(letters)}
        self.code = np.zeros(0x110000, dtype=np.int32)
        self.code[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        node = {b: i for i, b in enumerate(sorted({p[:j] for p in short for j in range(1, len(p) + 1)}))}
        row = {p: i for i, p in enumerate(short)}
        self.prob = np.array([self.rows[p] for p in short]).reshape(len(short), len(self.langs))
        self.first = np.array([-1] + [node.get(c, -1) for c in letters], dtype=np.int64)
        self.single = np.array([self.other] + [self.rows.get(c, self.other) for c in letters]).reshape(len(letters) + 1, len(self.langs))
        self.radix = len(letters) + 1
        steps = sorted((node[b[:-1]] * self.radix + number[b[-1]], node[b], row.get(b, -1)) for b in node if len(b) > 1)
        self.keys = np.array([k for k, _, _ in steps] + [np.iinfo(np.int64).max], dtype=np.int64)
        self.child = np.array([c for _, c, _ in steps] + [-1], dtype=np.int64)
        self.piece = np.array([r for _, _, r in steps] + [-1], dtype=np.int64)
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {"": 0}
        self.table = np.zeros((1 << 12, len(self.langs)))
        self.size = 1

    def word(self, word: str) -> list[float]:
        """The log of the sum over all segmentations, for each language."""
        n, k = len(word), len(self.langs)
        alpha = [None] * (n + 1)
        alpha[0] = [1.0] * k
        logs, found = [0.0] * k, self.found.get
        for i in range(n):
            a = alpha[i]
            for j in range(i + 1, min(n, i + LONGEST) + 1):
                p = found(word[i:j], ())
                if not p:
                    if j > i + 1:
                        if p is None:
                            continue
                        break
                    p = self.other
                b = alpha[j]
                if b is None:
                    alpha[j] = [x * y for x, y in zip(a, p)]
                else:
                    alpha[j] = [z + x * y for x, y, z in zip(a, p, b)]
            alpha[i] = None
            if i % LONGEST == LONGEST - 1:  # keep long words from underflowing
                for q in range(k):
                    top = max(x[q] for x in alpha[i + 1 : i + 1 + LONGEST] if x is not None)
                    if 0 < top:
                        logs[q] += math.log(top)
                        for x in alpha[i + 1 : i + 1 + LONGEST]:
                            if x is not None:
                                x[q] /= top
        return [x + math.log(y) if y > 0 else -1e9 for x, y in zip(logs, alpha[n])]

    def words(self, words: list[str]) -> np.ndarray:
        """`word` for each of many: those of one length go forward together."""
        k = len(self.langs)
        out, by_length = np.empty((len(words), k)), {}
        for at, w in enumerate(words):
            by_length.setdefault(len(w), []).append(at)
        for n, where in by_length.items():
            if not 0 < n <= SHORT:
                for at in where:
                    out[at] = self.word(words[at])
                continue
            most = max(1, CELLS // ((n + 1) * max(1, k)))
            for part in (where[x : x + most] for x in range(0, len(where), most)):
                out[part] = self._forward([words[at] for at in part], n)
        return out

    def _forward(self, words: list[str], n: int) -> np.ndarray:
        codes = self.code[np.frombuffer("".join(words).encode("utf-32-le"), "<u4")].reshape(-1, n)
        alpha = np.zeros((n + 1, len(words), len(self.langs)))
        alpha[0] = 1.0
        for i in range(n):
            a = alpha[i]
            alpha[i + 1] += a * self.single[codes[:, i]]
            node = self.first[codes[:, i]]
            alive = np.flatnonzero(node >= 0)
            node = node[alive]
            for j in range(i + 1, min(n, i + LONGEST)):
                key = node * self.radix + codes[alive, j]
                at = np.searchsorted(self.keys, key)
                same = self.keys[at] == key
                alive, at = alive[same], at[same]
                if not len(alive):
                    break
                node, piece = self.child[at], self.piece[at]
                whole = piece >= 0
                r = alive[whole]
                alpha[j + 1][r] += a[r] * self.prob[piece[whole]]
        return np.where(alpha[n] > 0, np.log(np.maximum(alpha[n], 1e-320)), -1e9)

    def _remember(self, raws: set[str]) -> None:
        cores = {raw: core(raw) for raw in raws}
        new = sorted({c for c in cores.values() if c not in self.at})
        if new:
            while self.size + len(new) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[self.size : self.size + len(new)] = self.words(new)
            self.at.update(zip(new, range(self.size, self.size + len(new))))
            self.size += len(new)
        at = self.at
        at.update({raw: at[c] for raw, c in cores.items()})

    def totals(self, texts: Iterable[str | None]) -> list[np.ndarray | None]:
        """The log-likelihood of each text in each language, None without a letter; `TOGETHER` characters (or one text) at a time."""
        out, held, size = [], [], 0
        for t in texts:
            held.append(t)
            size += len(t or "")
            if size >= TOGETHER:
                out += self._totals(held)
                held, size = [], 0
        return out + self._totals(held)

    def predict(self, texts: Iterable[str | None]) -> list[tuple[str, float]]:
        return [decided(self.langs, x) for x in self.totals(texts)]

    def _totals(self, texts: list[str | None]) -> list[np.ndarray | None]:
        if max(len(self.at), self.size) > MEMO_MOST:
            self.clear()
        split = [(t or "").lower().split() for t in texts]
        new = set().union(*split).difference(self.at)
        self._remember(new)
        out, at = [], self.at
        for words in split:
            where = [at[w] for w in words]
            out.append(self.table[where].sum(axis=0) if any(where) else None)
        for raw in new:
            if len(raw) > 64:  # long words aren't kept
                at.pop(raw, None)
                at.pop(core(raw), None)
        at[""] = 0
        return out


def decided(langs: list[str], total: np.ndarray | None) -> tuple[str, float]:
    """The likeliest language and its share."""
    if total is None or not len(total):
        return "und", 0.0
    best = int(total.argmax())
    return langs[best], float(1 / np.exp(total - total[best]).sum())


_models: dict[tuple[str, int], Model] = {}


def model_of(key: str, group: int, sent, path: str) -> Model:
    """One model per Python worker: the last one asked for, with the words it remembers."""
    if (key, group) not in _models:
        _models.clear()
        _models[key, group] = Model(sent.value, pieces(path))
    return _models[key, group]


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def predicted(docs: DataFrame, path: str, totals: DataFrame | None = None, together: int = LANGS_TOGETHER) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row; learns from the rows that aren't held out unless counts are given."""
    if totals is None:
        totals = learn(docs.where(~held_out(F.col("doc_id"))), path)
    context = docs.sparkSession.sparkContext
    langs = sorted(r[0] for r in totals.select("lang").distinct().collect())  # a name per language
    size = len(pieces(path))
    sent = [context.broadcast(probabilities(totals, langs[lo : lo + together], size)) for lo in range(0, len(langs), together)]
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model_of(key, g, x, path).totals(v.as_py() for v in batch.column(2)) for g, x in enumerate(sent)]
            rows = zip(*found) if found else [()] * batch.num_rows
            got = [decided(langs, None if not x or x[0] is None else np.concatenate(x)) for x in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([a for a, _ in got], pa.string()), pa.array([b for _, b in got], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, held_out boolean, lang_pred string, score double")
