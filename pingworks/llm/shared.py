"""Where intermediate tables live, and how Arrow batches are read as bytes."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
BATCH_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see.

    The session's ``spark.checkpoint.dir``; where a session on one machine (tests) has
    none, a fresh folder that is then set for the session.  A cluster must name one."""
    found = spark.conf.get(CHECKPOINT_KEY, None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError(f"{CHECKPOINT_KEY} must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="pingworks-")
        spark.conf.set(CHECKPOINT_KEY, found)
    return found.rstrip("/")


def bound_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of at most ``rows`` rows, unless the session sets a number of its
    own: with whole texts in the rows, Spark's ten thousand take too much memory."""
    if spark.conf.get(BATCH_KEY) == "10000":
        spark.conf.set(BATCH_KEY, str(rows))


def new_path(spark: SparkSession, name: str) -> str:
    bound_batches(spark)
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends there,
    and a lost executor costs a reread instead of a recomputation."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, whose worker gives freed memory back to the system at the
    task's end.  Workers outlive their stage, and the C library keeps what is freed: the
    later stages of a session, those without Python too, would find it taken."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def give_back() -> None:
    """Freed memory goes back to the system, where the C library has a call for that."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def parts_for(total: DataFrame, each: int = 64 << 20) -> int:
    """Partitions for so many bytes (the one number of ``total``): the session's number,
    or more where that would put over ``each`` bytes into one."""
    n = total.first()[0] or 0
    return max(int(total.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // each))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and its n + 1 offsets, without copying
    where Arrow allows; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    return np.frombuffer(data, np.uint8)[offs[0] : offs[-1]], offs - offs[0]


def slices(offs: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes each (one longer row stands alone)."""
    out, n, i = [], len(offs) - 1, 0
    while i < n:
        j = int(np.searchsorted(offs, offs[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n)
        out.append((i, j))
        i = j
    return out
