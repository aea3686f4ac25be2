"""Token-id files with a shared zstandard dictionary, each document compressed separately.

A file is a sequence of containers.  A container (all integers little-endian):

    4 bytes  magic b"TOK1"
    8 bytes  first 8 bytes of the SHA-256 of the dictionary
    4 bytes  number of documents n
    n x 24   index: doc_id (int64), end of the frame within the body (uint64), ids with the end id (uint64)
    body     n zstandard frames, one a document: its ids as uint16 (or uint32 where the vocabulary needs it)

so one document is read by its index entry and one frame.  The dictionary is trained on the ids of a documented sample: about
`DICT_DOCS` documents drawn by a hash of doc_id, twice as many at most, and of each at most `DICT_PIECES` pieces of
`DICT_PIECE` bytes, evenly spaced over the whole document.  Where that is too little to train on, the pieces
themselves are the dictionary; an empty table has an empty one.  It is stored once beside the containers.  Containers travel as binary
values of Parquet rows (part, seq, n_docs, n_ids, blob), because Spark's writers are what reaches every store and commits whole files only.

Documents are encoded where they are read, whole; only compressed frames are shuffled, by ranges of doc_id whose
bounds come from a quantile sketch of the ids: `RANGES_MOST` at most, so that the sketch and what is summed over the ranges have a bound.
A doc_id that takes several ranges (one that many rows share) is split among them by its rows' tie numbers.
A range is sorted externally and its containers are built as its rows pass; one holds at most `CONTAINER_BYTES` of frames, or one document.

Nulls: a null text has the end id only; a null doc_id comes first and is stored with the smallest int64.
Repeated rows are separate documents, in order of their tie numbers, the CRC-32 of their frames, then of the frames' bytes.
An empty table gives no container.  Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import struct
import sys
import unicodedata
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import byte_letters
from .common import arrow_batches, shared_dir

MAGIC = b"TOK1"
DICT_BYTES, DICT_DOCS, DICT_PIECES, DICT_PIECE = 65_536, 1_000, 4, 2_048
CONTAINER_BYTES = 4 << 20
ROWS_PER_RANGE, RANGES_MOST = 8_192, 4_096
MEMO_MOST = 600_000
ROWS = 500
BATCH_BYTES = 4 << 20
LEVEL = 3
NULL_ID = -(1 << 63)


class WordEncoder:
    """The tokenizer of a word-level BPE file: NFC, lower case, pieces by pattern, merges up to a word's end.

    White space only separates pieces, so a text's ids are those of its words in a row; words recur, and
    their packed ids are kept in a bounded memory.  Agreement with the library is tested id by id.

    The merges run in the byte-pair core of another tokenizer library: byte 0xFF, which UTF-8 never holds, stands for the
    end of a word, and joining it to the letter before it comes before every merge.
    """

    def __init__(self, path: str):
        import regex
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letter = spec["model"], byte_letters()
        suffix = model["end_of_word_suffix"]

        def raw(token: str) -> bytes:
            whole = suffix and token.endswith(suffix)
            return bytes(letter[c] for c in (token[: -len(suffix)] if whole else token)) + (b"\xff" if whole else b"")

        ranks: dict[bytes, int] = {}
        for b in (*(bytes([x, 255]) for x in range(256)), *(bytes([x]) for x in range(256))):
            ranks.setdefault(b, len(ranks))
        for m in model["merges"]:
            x, y = m if isinstance(m, list) else m.split(" ")
            ranks.setdefault(raw(x + y), len(ranks))
        self.core = tiktoken.Encoding("pieces", pat_str=pattern_of(spec), mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ids = {raw(t): i for t, i in model["vocab"].items()}
        self.id_of = [ids.get(b, -1) for b in ranks]
        self.split = regex.compile(pattern_of(spec)).findall
        names = "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True))
        self.specials = regex.compile(f"({names})").split if names else None
        most = max([*ids.values(), *self.special.values()])
        self.dtype, self.code = ("<u2", "H") if most < 65_536 else ("<u4", "I")
        self.memo: dict[str, bytes] = {}

    def pack(self, ids: list[int]) -> bytes:
        a = array(self.code, ids)
        if sys.byteorder != "little":
            a.byteswap()
        return a.tobytes()

    def _word(self, word: str) -> bytes:
        out, id_of = [], self.id_of
        for k, part in enumerate(self.specials(word) if self.specials else [word]):
            if k % 2:
                out.append(self.special[part])
                continue
            # Letter by letter, as the file's normalizer does: no final sigma.
            for p in self.split(unicodedata.normalize("NFC", part).replace("\u03a3", "\u03c3").lower()):
                out += [i for x in self.core.encode_single_piece(p.encode() + b"\xff") if (i := id_of[x]) >= 0]
        packed = self.pack(out)
        if len(word) <= 64:
            if len(self.memo) >= MEMO_MOST:
                self.memo.clear()
            self.memo[word] = packed
        return packed

    def encode(self, text: str | None) -> bytes:
        """The packed ids of a text."""
        memo, word = self.memo.get, self._word
        return b"".join([word(w) if (ids := memo(w)) is None else ids for w in (text or "").replace("\n", " ").split(" ")])


def pattern_of(spec: dict) -> str:
    return next(x["pattern"]["Regex"] for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def train_dictionary(docs: DataFrame, path: str, end_id: int, most: int = DICT_BYTES, sample: int = DICT_DOCS) -> tuple[bytes, int]:
    """(dictionary, number of rows): the sample is a share of all rows by hash, `sample` rows in expectation."""
    import zstandard

    n = docs.count()
    share = min(1.0, sample / max(1, n))
    picked = docs.where(F.pmod(F.xxhash64("doc_id", F.lit("dictionary")), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    parts = [x for r in _encoded(picked, path, end_id).select("ids").limit(2 * sample).collect() for x in spaced(bytes(r[0]))]
    if not parts:
        return b"", n
    try:
        return zstandard.train_dictionary(most, parts, k=256, d=8).as_bytes(), n
    except zstandard.ZstdError:  # too little to train on
        return b"".join(parts)[-most:], n


def spaced(ids: bytes, pieces: int = DICT_PIECES, size: int = DICT_PIECE) -> list[bytes]:
    """Pieces of `size` bytes at even distances over the whole, all of it if it is short."""
    n = -(-len(ids) // size)
    return [ids[i * size : (i + 1) * size] for i in sorted({k * n // pieces for k in range(pieces)} if n > pieces else range(n))]


def part_of(docs: np.ndarray, ties: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The range of each (doc_id, tie): in their order; ids that are bounds are split by tie, those several times over into several."""
    low, high = np.searchsorted(bounds, docs, side="left"), np.searchsorted(bounds, docs, side="right")
    return (low + (ties.astype(np.uint64) * (high - low + 1).astype(np.uint64) >> np.uint64(32)).astype(np.int64)).astype(np.int32)


def _encoded(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """(doc_id, ids) with the packed ids, the end id appended."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        end = np.array([end_id], dtype=enc.dtype).tobytes()
        for batch in batches:
            ids = pa.array([enc.encode(t) + end for t in batch.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["doc_id", "ids"])

    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids binary")


def write(docs: DataFrame, path: str, out: str, end_id: int = 1, level: int = LEVEL) -> None:
    """Writes the token files of `docs` under `out` (containers/ and dictionary/)."""
    import zstandard

    spark = docs.sparkSession
    dictionary, n = train_dictionary(docs, path, end_id)
    spark.createDataFrame([(bytearray(dictionary),)], "dictionary binary").coalesce(1).write.parquet(f"{out}/dictionary")
    size = np.dtype(encoder(path).dtype).itemsize
    ranges = min(RANGES_MOST, max(1, -(-n // ROWS_PER_RANGE)))
    ids = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"))
    # A sketch of the ids; its bounds have n / ranges rows between them.
    bounds = [] if ranges == 1 else sorted(ids.select(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], 20 * ranges)).first()[0] or [])

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        if kept:
            kept.precompute_compress(level=level)
        zip_ = zstandard.ZstdCompressor(level=level, dict_data=kept, write_checksum=False)
        edges = np.array(bounds, dtype=np.int64)
        enc = encoder(path)
        end = enc.pack([end_id])
        # Encoded and compressed in one worker, in short slices.
        for batch in (b.slice(lo, ROWS) for b in batches for lo in range(0, b.num_rows, ROWS)):
            raw = [enc.encode(t) + end for t in batch.column(1).to_pylist()]
            packed = [zip_.compress(x) for x in raw]
            tie = np.array([zlib.crc32(x) for x in packed], dtype=np.int64)
            part = part_of(batch.column(0).to_numpy(zero_copy_only=False), tie, edges)
            yield pa.RecordBatch.from_arrays(
                [pa.array(part), batch.column(0), pa.array(tie), pa.array([len(x) // size for x in raw], pa.int64()), pa.array(packed, pa.binary())],
                names=["part", "doc_id", "tie", "n", "frame"],
            )

    def containers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark = hashlib.sha256(dictionary).digest()[:8]
        now, seq, index, body, end = None, 0, [], [], 0

        def row() -> pa.RecordBatch:
            blob = b"".join([MAGIC, mark, struct.pack("<I", len(index)), *(struct.pack("<qQQ", *x) for x in index), *body])
            return pa.RecordBatch.from_arrays(
                [pa.array([now], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(index)], pa.int64()), pa.array([sum(x[2] for x in index)], pa.int64()), pa.array([blob], pa.binary())],
                names=["part", "seq", "n_docs", "n_ids", "blob"],
            )

        for batch in batches:
            for part, doc, _, n_, frame in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if index and (part != now or end + len(frame) > CONTAINER_BYTES):
                    yield row()
                    seq, index, body, end = (seq + 1 if part == now else 0), [], [], 0
                if part != now:
                    now, seq = part, 0
                end += len(frame)
                index.append((doc, end, n_))
                body.append(frame)
        if index:
            yield row()

    (
        docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), "text")
        .mapInArrow(frames, "part int, doc_id long, tie long, n long, frame binary")
        .repartitionById(ranges, "part")
        .sortWithinPartitions("part", "doc_id", "tie", "frame")
        .mapInArrow(containers, "part int, seq int, n_docs long, n_ids long, blob binary")
        .write.parquet(f"{out}/containers")
    )


def open_container(blob: bytes, dictionary: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(doc_id, number of ids, compressed frame) of each document; checks the dictionary's hash."""
    if blob[:4] != MAGIC or blob[4:12] != hashlib.sha256(dictionary).digest()[:8]:
        raise ValueError("not a container of this dictionary")
    n = struct.unpack_from("<I", blob, 12)[0]
    body, at = 16 + 24 * n, 0
    for doc, end, count in struct.iter_unpack("<qQQ", blob[16:body]):
        yield doc, count, blob[body + at : body + end]
        at = end


def frame_ids(frame: bytes, count: int, dictionary: bytes, opener: dict | None = None) -> np.ndarray:
    """The ids of one frame as uint32."""
    import zstandard

    opener = {} if opener is None else opener
    if "z" not in opener:
        opener["z"] = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    raw = opener["z"].decompress(frame)
    return np.frombuffer(raw, dtype="<u4" if len(raw) == 4 * count else "<u2").astype("<u4")


def read(spark: SparkSession, out: str, with_ids: bool = False) -> DataFrame:
    """One row per document, from the files: doc_id, start, n_tokens, ids_crc32 (and ids)."""
    dictionary = bytes(spark.read.schema("dictionary binary").parquet(f"{out}/dictionary").first()[0])
    rows = spark.read.schema("part int, seq int, n_docs long, n_ids long, blob binary").parquet(f"{out}/containers")
    # A row per container: the sums before a part (RANGES_MOST at most), then those before a container in its part.
    parts = rows.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    before = parts.select("part", (F.sum("ids").over(Window.orderBy("part")) - F.col("ids")).alias("part_start"))
    heads = rows.select("part", "seq", (F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_ids")).alias("seq_start"))
    starts = heads.join(before, "part").select("part", "seq", (F.col("part_start") + F.col("seq_start")).alias("start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opener: dict = {}
        for batch in batches:
            for part, seq, blob in zip(*(batch.column(i).to_pylist() for i in range(3))):
                at, docs, first, counts, sums, lists = 0, [], [], [], [], []
                for doc, count, frame in open_container(blob, dictionary):
                    ids = frame_ids(frame, count, dictionary, opener)
                    docs.append(None if doc == NULL_ID else doc)
                    first.append(at)
                    counts.append(count)
                    sums.append(zlib.crc32(ids.tobytes()))
                    if with_ids:
                        lists.append(ids)
                    at += count
                k = len(docs)
                cols = [pa.array([part] * k, pa.int32()), pa.array([seq] * k, pa.int32()), pa.array(docs, pa.int64()), pa.array(first, pa.int64()), pa.array(counts, pa.int64()), pa.array(sums, pa.int64())]
                names = ["part", "seq", "doc_id", "at", "n_tokens", "ids_crc32"]
                if with_ids:
                    cols.append(pa.array(lists, pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    more = ", ids array<long>" if with_ids else ""
    docs = rows.select("part", "seq", "blob").mapInArrow(run, f"part int, seq int, doc_id long, at long, n_tokens long, ids_crc32 long{more}")
    return docs.join(starts, ["part", "seq"]).select("doc_id", (F.col("start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def write_and_read(docs: DataFrame, path: str, end_id: int = 1) -> DataFrame:
    """Writes the files into the shared folder and reads them back."""
    spark = docs.sparkSession
    out = f"{shared_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    with arrow_batches(spark, BATCH_BYTES):
        write(docs, path, out, end_id)
    return read(spark, out)
