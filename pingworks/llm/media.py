"""Media columns: payloads kept as progressive JPEG, read back into RGB tensors.

A payload's bytes are the quantised coefficients of an image (less OFFSET, in zig-zag
order, quantisers of one), so the file holds it without loss; the file's comment holds
its length.  Reading accumulates the scans into coefficients, from which both the
payload and, by inverse transform and chroma upsampling, the tensor come.

Defined cases: a null text is the empty one; it is padded to the least payload; equal
texts have equal files, tensors and features whatever rows stand beside them; a null
doc_id is carried like any other; repeated rows are images of their own; very long texts are wider images (a tensor has twice the
bytes of its text and must fit in a Spark value, so 1 GB of text is the most); other
columns are left behind; an empty table gives an empty result."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pingworks.llm import progressive as J
from pingworks.llm.shared import new_path, slices, text_buffer

UNIT = 192
#: Images decoded together; more lanes make a step cheaper, and memory grows with them.
BATCH_BYTES = 4 << 20
MCU_BYTES = 384
#: Taken from each byte; near the middle of the letters, so that most numbers are small.
OFFSET = 110


def to_jpeg(payloads: list[bytes]) -> list[bytes]:
    """One progressive file a payload; the last MCUs are filled up with zeros."""
    frames = []
    for p in payloads:
        n = -(-len(p) // MCU_BYTES)
        width, height = J.grid(n)
        c = np.zeros(width * height * MCU_BYTES, np.int16)
        c[: len(p)] = np.frombuffer(p, np.uint8).astype(np.int16) - OFFSET
        frames.append((c.reshape(-1, 6, 64), width, height))
    return J.write(frames, [b"payload=%d" % len(p) for p in payloads])


def _payload(img: J.Image, coef: np.ndarray) -> bytes:
    (_, cols, _, _), (rows, width, _, _) = img.shape(0), img.shape(1)
    y = coef[img.base[0] : img.base[0] + 4 * rows * width].reshape(rows, 2, width, 2, 64).transpose(0, 2, 1, 3, 4).reshape(-1, 4, 64)
    chroma = [coef[img.base[c] : img.base[c] + rows * width][:, None] for c in (1, 2)]
    size = int(img.comment.removeprefix(b"payload="))
    return (np.concatenate([y, *chroma], 1).ravel()[:size] + OFFSET).astype(np.uint8).tobytes()


def from_jpeg(files: list[bytes]) -> list[tuple[bytes, np.ndarray]]:
    """Payload and RGB tensor of each file."""
    images, coef = J.read(files)
    payloads = [_payload(i, coef) for i in images]
    pixels = J.all_samples(images, coef)
    return [(p, J.tensor(i, pixels)) for p, i in zip(payloads, images)]


def store(docs: DataFrame, path: str, text: str = "text") -> None:
    """Writes (doc_id, n_bytes, media): padded texts as image files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, offs = text_buffer(b.column(1))
            raw = buf.tobytes()
            for i, j in slices(offs, BATCH_BYTES):
                texts = [raw[x:y] for x, y in zip(offs[i:j].tolist(), offs[i + 1 : j + 1].tolist())]
                padded = [t.ljust(max(UNIT, -(-len(t) // UNIT) * UNIT), b" ") for t in texts]
                cols = [b.column(0).slice(i, j - i), pa.array([len(t) for t in texts], pa.int64()), pa.array(to_jpeg(padded), pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_bytes", "media"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text)
    rows.mapInArrow(run, "doc_id long, n_bytes long, media binary").write.option("compression", "zstd").parquet(path)


DIGESTS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def load(spark: SparkSession, path: str, tensors: bool = False) -> DataFrame:
    """Digests and features of stored media; if asked, also height, width and tensor
    (height x width x 3 bytes)."""
    schema = DIGESTS + (", height int, width int, tensor binary" if tensors else "")
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()] + [pa.int32(), pa.int32(), pa.binary()] * tensors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = np.append(0, np.cumsum([len(x.as_buffer()) if x.is_valid else 0 for x in b.column(2)]))
            for i, j in slices(sizes, BATCH_BYTES):
                files = b.column(2).slice(i, j - i).to_pylist()
                rows = []
                for doc, n, raw, (payload, rgb) in zip(b.column(0).slice(i, j - i).to_pylist(), b.column(1).slice(i, j - i).to_pylist(), files, from_jpeg(files)):
                    body = rgb.tobytes()
                    mean = rgb.reshape(-1, 3).sum(0, dtype=np.int64) * 1000 // (rgb.size // 3)
                    feature = f"{rgb.shape[1]}x{rgb.shape[0]};mean={','.join(map(str, mean.tolist()))};crc={zlib.crc32(body)}"
                    row = (doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(raw), hashlib.sha256(raw).hexdigest(), feature)
                    rows.append(row + ((rgb.shape[0], rgb.shape[1], body) if tensors else ()))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[x.split()[0] for x in schema.split(", ")])

    return spark.read.schema("doc_id long, n_bytes long, media binary").parquet(path).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "media")
    store(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), path)
    return load(spark, path, tensors=True)
