"""Token-id output: documents to files of range-coded blocks, and back.

Documents are range-sorted by doc_id; each task encodes its stretch and writes rows of
(shard, row, n_ids, file): whole documents, about ROW_IDS ids a row, as a file in the
format of `idfile`, which holds doc_ids and lengths beside the ids and can be read alone.
Shards and rows ascend with doc_id.  The place of a document's first id among all ids
comes from one number a row.

Defined cases: null and empty texts are the end id alone; null doc_ids come first and
are read back as null; rows of one doc_id go by their text; repeated rows are documents of
their own, side by side; a long
document (tested at 1 MB) fills a row of its own; other columns are left behind, whatever
their names; an empty table gives files without rows and an empty result."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pingworks.llm.encode import Encoder
from pingworks.llm.idfile import read_file, write_file
from pingworks.llm.shared import new_path, parts_for

END_ID = 1
ROW_IDS = 4 << 20
#: What a document is taken to hold when tasks are dealt out; it decides nothing else.
MEAN_BYTES = 4096
ROWS = "shard long, row long, n_ids long, file binary"


def write(docs: DataFrame, path: str, tokenizer: str, text: str = "text") -> None:
    # from the number of rows alone, which costs no reading; tasks stream, so they may be large
    parts = parts_for(docs.agg(F.count(F.lit(1)) * MEAN_BYTES), 1 << 30)
    line = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")).repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard, row = Encoder.of(tokenizer), TaskContext.get().partitionId(), 0
        ids, docs_, lens, total = [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal ids, docs_, lens, total, row
            one = [[shard], [row], [total], [write_file(docs_, np.concatenate(lens), np.concatenate(ids))]]
            row, ids, docs_, lens, total = row + 1, [], [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(one, (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=[x.split()[0] for x in ROWS.split(", ")])

        for b in batches:
            for i, j, flat, at in encoder.ids(b.column(1), END_ID):
                if total and total + len(flat) > ROW_IDS:
                    yield flush()
                ids.append(flat)
                docs_ += b.column(0).slice(i, j - i).to_pylist()
                lens.append(np.diff(at))
                total += len(flat)
        if total:
            yield flush()

    line.mapInArrow(run, ROWS).write.parquet(path)


def read(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32), and ids (little-endian 16-bit) if asked."""
    rows = spark.read.schema(ROWS).parquet(path)
    shards = rows.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    shards = shards.select("shard", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("shard_start"))
    before = Window.partitionBy("shard").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.select("shard", "row", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("row_start")).join(shards, "shard")
    starts = starts.select("shard", "row", (F.col("shard_start") + F.col("row_start")).alias("base"))
    schema = "shard long, row long, doc_id long, at long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                docs_, lens, ids = read_file(b.column(2)[k].as_py())
                at = np.append(0, np.cumsum(lens))
                wide = ids.astype("<u4")
                crcs = [zlib.crc32(wide[x:y].data) for x, y in zip(at[:-1].tolist(), at[1:].tolist())]
                n = len(lens)
                cols = [pa.array([b.column(0)[k].as_py()] * n, pa.int64()), pa.array([b.column(1)[k].as_py()] * n, pa.int64()), pa.array(docs_, pa.int64()), pa.array(at[:-1]), pa.array(lens), pa.array(crcs, pa.int64())]
                if with_ids:
                    cols.append(pa.array([ids[x:y].astype("<u2").tobytes() for x, y in zip(at[:-1], at[1:])], pa.binary()))
                yield pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in schema.split(", ")])

    found = rows.select("shard", "row", "file").mapInArrow(run, schema)
    out = found.join(starts, ["shard", "row"]).withColumn("start", F.col("base") + F.col("at"))
    return out.select("doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids)


RESULT = ["doc_id", "start", "n_tokens", "ids_crc32"]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = new_path(spark, "token-ids")
    write(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), path, public_tokenizers.path("word_bpe_49k.json"))
    return read(spark, path).select(*RESULT)
