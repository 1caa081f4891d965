"""Packing along a space-filling curve.

Each document's token ids are hashed into a vector of fixed size, the vector is
projected to three dimensions, and the point's place on a Hilbert curve is the
document's key.  Spark range-sorts the documents by key, so that each task holds one
stretch of the curve and packs neighbours one after another into sequences of
``length`` tokens, cutting freely.  Only a stretch's last sequence stays short; it is
cut into sequences whose lengths are powers of two, which need no padding.

Token ids travel as 16-bit numbers and are written once before the range sort, so its
sampling pass does not tokenise again.

Defined cases: null and empty texts are the end id alone; copies have equal keys and
lie side by side in doc_id order; a null doc_id is carried like any other; repeated rows
are packed one by one; a long document (tested at 1 MB) fills sequences of its own and
shares its first and last; other columns of the input are left behind, whatever their
names; an empty table gives an empty table."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pingworks.llm.bytescan import mix
from pingworks.llm.encode import Encoder
from pingworks.llm.shared import new_path, parts_for, tidy

LENGTH = 2048
END_ID = 1
VECTOR = 256
DIMENSIONS = 3
BITS = 16


def _slots() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slot and sign of each token id, and the projection of the slots."""
    h = mix(np.arange(1 << 16, dtype=np.uint64) + np.uint64(0x51ED270B))
    directions = np.random.default_rng(5).standard_normal((VECTOR, DIMENSIONS))
    return (h % np.uint64(VECTOR)).astype(np.int64), np.where(h >> np.uint64(63), 1.0, -1.0), directions


def points(flat: np.ndarray, at: np.ndarray, slots, signs, directions) -> np.ndarray:
    """A point in [-1, 1]^3 for each row of ids."""
    n = len(at) - 1
    row = np.repeat(np.arange(n), np.diff(at))
    v = np.bincount(row * VECTOR + slots[flat], signs[flat], n * VECTOR).reshape(n, VECTOR)
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    return np.tanh(v @ directions)


def hilbert(p: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place of points in [-1, 1]^d on the Hilbert curve with ``bits`` a dimension, by
    the transpose form: undo the excess of each level, then Gray-decode."""
    x = np.clip(((p + 1) / 2 * (1 << bits)).astype(np.int64), 0, (1 << bits) - 1).T.copy()
    d = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(d):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= np.where(high, q - 1, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    t = np.zeros(x.shape[1], np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where(x[d - 1] & q, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = key << 1 | (x[i] >> b & 1)
    return key


def place(docs: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """(doc_id, curve_key, ids, n_ids): ids as little-endian 16-bit numbers, end id included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, tables = Encoder.of(tokenizer), _slots()
        for b in batches:
            for i, j, flat, at in encoder.ids(b.column(1), END_ID):
                keys = hilbert(points(flat, at, *tables))
                blob = pa.py_buffer(np.ascontiguousarray(flat, "<u2"))
                ids = pa.Array.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer((2 * at).astype(np.int64)), blob])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(keys), ids.cast(pa.binary()), pa.array(np.diff(at))], names=["doc_id", "curve_key", "ids", "n_ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col(text)).mapInArrow(tidy(run), "doc_id long, curve_key long, ids binary, n_ids long")


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary, curve_key long"


class _Packer:
    """Cuts a stretch of the curve into sequences; holds at most one open sequence."""

    def __init__(self, length: int, first: int):
        self.length, self.sequence, self.used = length, first, 0
        self.open: list[tuple] = []  # pieces of the open sequence

    def _piece(self, doc, start, length, tokens, sequence, offset, ids, key):
        wide = ids[start : start + length]
        return (doc, start, length, zlib.crc32(wide.astype("<u4").tobytes()), tokens, sequence, offset, wide.tobytes(), key)

    def add(self, doc, key, raw: bytes) -> list[tuple]:
        ids, at, out = np.frombuffer(raw, "<u2"), 0, []
        while at < len(ids):
            n = min(self.length - self.used, len(ids) - at)
            self.open.append((doc, at, n, len(ids), ids, key))
            self.used, at = self.used + n, at + n
            if self.used == self.length:
                out += self._close([self.length])
        return out

    def _close(self, lengths: list[int]) -> list[tuple]:
        """The open pieces, cut again at the ends of sequences of these lengths."""
        out, offset, left = [], 0, list(lengths)
        for doc, at, n, tokens, ids, key in self.open:
            while n:
                k = min(n, left[0] - offset)
                out.append(self._piece(doc, at, k, tokens, self.sequence, offset, ids, key))
                at, n, offset = at + k, n - k, offset + k
                if offset == left[0]:
                    left.pop(0)
                    self.sequence, offset = self.sequence + 1, 0
        self.open, self.used = [], 0
        return out

    def finish(self) -> list[tuple]:
        return self._close([1 << b for b in range(self.length.bit_length() - 1, -1, -1) if self.used >> b & 1])


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, text: str = "text") -> DataFrame:
    """Pieces of all documents: where each lies in its document and in its sequence,
    with its ids (little-endian 16-bit)."""
    spark = docs.sparkSession
    path = new_path(spark, "placed")
    placed = place(docs, tokenizer, text)
    placed.write.option("compression", "zstd").parquet(path)
    placed = spark.read.schema(placed.schema).parquet(path)
    parts = parts_for(placed.agg(F.sum("n_ids") * 2))
    line = placed.drop("n_ids").repartitionByRange(parts, "curve_key", "doc_id").sortWithinPartitions("curve_key", "doc_id")
    kinds = [pa.int64()] * 7 + [pa.binary(), pa.int64()]
    names = [x.split()[0] for x in PIECES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = _Packer(length, TaskContext.get().partitionId() << 40)

        def out(pieces: list[tuple]) -> Iterator[pa.RecordBatch]:
            for i in range(0, len(pieces), 4096):
                cols = zip(*pieces[i : i + 4096])
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

        for b in batches:
            pieces: list[tuple] = []
            for doc, key, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                pieces += packer.add(doc, key, raw.as_py())
                if len(pieces) >= 4096:
                    yield from out(pieces)
                    pieces = []
            yield from out(pieces)
        yield from out(packer.finish())

    return line.mapInArrow(tidy(run), PIECES)


RESULT = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def _tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack(docs, _tokenizer()).select(*RESULT)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last pipeline stage: the pieces of the sequences, with their ids."""
    return pack(docs, _tokenizer())
