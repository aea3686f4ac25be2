"""Byte-level BPE encoding and decoding with forced boundaries.

A byte pair that occurs inside no token of the vocabulary can be joined by no merge: a cut between its two
bytes is certain.  Each piece of the pre-tokenizer is cut at all its certain cuts, the fragments are encoded
independently, and their ids are concatenated.  They recur, so their ids are kept in a
bounded memory (by the word around them); a document without any white space is cut like any other.

Nulls count as the empty text, which has no ids.  Rows, repeated ones included, are encoded one by one; extra columns
are dropped by `digests` and kept by `encode`, where an `ids` column is replaced.
"""

from __future__ import annotations

import hashlib
import json
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, StructField, StructType

MEMO_MOST = 800_000
#: Fixed value: how the byte-level pre-tokenizer splits a text (contractions, words, numbers, signs, white space).
PRETOKENS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

class _Spaced(Exception):
    """A word that ends in white space, or an empty one: the space after it is no place to cut."""


def byte_letters() -> dict[str, int]:
    """Letter -> byte of byte-level vocabularies: printable bytes stand for themselves, the rest follow from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _packed(ids: list[int]) -> bytes:
    a = array("I", ids)
    if sys.byteorder != "little":
        a.byteswap()
    return a.tobytes()


class ForcedBoundaryBPE:
    """A byte-level BPE vocabulary from a tokenizer file."""

    def __init__(self, path: str):
        import regex
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letter = byte_letters()
        raw = lambda token: bytes(letter[c] for c in token)
        model = spec["model"]
        self.id_of = {raw(t): i for t, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = [b""] * (1 + max([*self.id_of.values(), *self.special.values()]))
        for b, i in self.id_of.items():
            self.token[i] = b
        for t, i in self.special.items():
            self.token[i] = t.encode()
        # Merges are applied by rank, and a rank is the id of what the merge makes: true of vocabularies
        # whose ids follow their merges, which is checked here.
        made = [self.id_of[b"".join(raw(x) for x in (m if isinstance(m, list) else m.split(" ")))] for m in model["merges"]]
        if any(x >= y for x, y in zip(made, made[1:])):
            raise ValueError("ids do not follow the merges")
        self.core = tiktoken.Encoding("fragments", pat_str=PRETOKENS, mergeable_ranks=self.id_of, special_tokens={})._core_bpe
        self.inside = bytearray(65536)  # byte pairs that some token holds
        for b in self.id_of:
            for x, y in zip(b, b[1:]):
                self.inside[x << 8 | y] = 1
        self.split = regex.compile(PRETOKENS).findall
        names = "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True))
        self.specials = regex.compile(f"({names})").split if names else None
        self.memo: dict[str, bytes] = {}

    def fragments(self, piece: bytes) -> list[bytes]:
        """`piece` cut at every certain cut."""
        inside, out, start, last = self.inside, [], 0, -1
        for i, c in enumerate(piece):
            if last >= 0 and not inside[last << 8 | c]:
                out.append(piece[start:i])
                start = i
            last = c
        if piece:
            out.append(piece[start:])
        return out

    def _merge(self, fragment: bytes) -> list[int]:
        """The ids of a fragment by the vocabulary's merges, lowest rank first."""
        return self.core.encode_single_piece(fragment)

    def _part(self, part: str) -> bytes:
        """The ids of a stretch of text that starts a pre-token and ends one."""
        ids = []
        for k, x in enumerate(self.specials(part) if self.specials else [part]):
            if k % 2:
                ids.append(self.special[x])
                continue
            for p in self.split(x):
                for f in self.fragments(p.encode()):
                    ids += self._merge(f)
        return _packed(ids)

    def _word(self, word: str) -> bytes:
        if not word or word[-1].isspace():
            raise _Spaced
        out = self._part(" " + word)
        if len(word) <= 64:
            if len(self.memo) >= MEMO_MOST:
                self.memo.clear()
            self.memo[word] = out
        return out

    def encode(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit integers.

        A pre-token holds white space at its start only, so the text may be cut before any space that does
        not follow white space; each such part is a space and a word, and words recur.
        """
        if not text:
            return b""
        first, *rest = text.split(" ")
        if not first or first[-1].isspace():
            return self._part(text)
        memo, word = self.memo.get, self._word
        try:
            return b"".join([self._part(first), *[word(w) if (ids := memo(w)) is None else ids for w in rest]])
        except _Spaced:
            return self._part(text)

    def decode(self, ids: bytes) -> str:
        token = self.token
        return b"".join([token[i] for i in np.frombuffer(ids, dtype="<u4").tolist()]).decode("utf-8", errors="replace")


_loaded: dict[str, ForcedBoundaryBPE] = {}


def tokenizer(path: str) -> ForcedBoundaryBPE:
    """One per path and Python worker."""
    if path not in _loaded:
        _loaded[path] = ForcedBoundaryBPE(path)
    return _loaded[path]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """`docs` with `ids`, binary: little-endian unsigned 32-bit integers."""
    docs = docs.drop(*[c for c in docs.columns if c.lower() == "ids"])
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for batch in batches:
            ids = pa.array([bpe.encode(t) for t in batch.column(at).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], names=[*batch.schema.names, "ids"])

    return docs.mapInArrow(run, StructType([*docs.schema, StructField("ids", BinaryType())]))


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for batch in batches:
            n, a, b = [], [], []
            for text in batch.column(1).to_pylist():
                ids = bpe.encode(text)
                n.append(len(ids) // 4)
                a.append(hashlib.sha256(ids).hexdigest())
                b.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
