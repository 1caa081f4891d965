"""Token counts through a digest cache.

The cache is a Parquet table (tokenizer_digest, text_digest, n_tokens) in a folder.
A run digests every text, encodes each distinct text that the cache lacks once,
appends those counts, and joins the counts back by digest.

Normalisation is what leaves every count as the library's: null becomes the empty
text, nothing else changes.  Defined cases: null and empty texts have no tokens; a null
doc_id passes through, since counts go by digest; very long texts are encoded whole
(tested at 1 MB); copies and repeated rows share one encoding and each gets its row;
other columns of the input pass through (a column named like a result is replaced); an empty table
gives an empty table; counts appended twice by concurrent runs are read once."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pingworks.llm.encode import Encoder, file_digest
from pingworks.llm.shared import cut, new_path

CACHE_SCHEMA = "tokenizer_digest string, text_digest binary, n_tokens long"


def normalised(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def read_cache(spark: SparkSession, path: str, tokenizer_digest: str) -> DataFrame:
    """One row a text digest; an absent cache is an empty one."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
    rows = spark.read.schema(CACHE_SCHEMA).parquet(path) if there else spark.createDataFrame([], CACHE_SCHEMA)
    return rows.filter(F.col("tokenizer_digest") == tokenizer_digest).groupBy("text_digest").agg(F.max("n_tokens").alias("n_tokens"))


def fill_cache(docs: DataFrame, cache: str, tokenizer: str, text: str = "text") -> str:
    """Encodes the distinct texts that ``cache`` lacks and appends their counts;
    returns the tokenizer's digest."""
    spark, version = docs.sparkSession, file_digest(tokenizer)
    texts = docs.select(normalised(text).alias("__body")).select(digest(F.col("__body")).alias("text_digest"), "__body")
    # map-side first: a hot copy reaches the shuffle once a task
    misses = texts.dropDuplicates(["text_digest"]).join(read_cache(spark, cache, version).select("text_digest"), "text_digest", "left_anti")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(tokenizer)
        for b in batches:
            counts = encoder.counts(b.column("__body"))
            yield pa.RecordBatch.from_arrays(
                [pa.array([version] * len(counts), pa.string()), b.column("text_digest"), pa.array(counts, pa.int64())],
                names=["tokenizer_digest", "text_digest", "n_tokens"],
            )

    misses.mapInArrow(encode, CACHE_SCHEMA).write.mode("append").parquet(cache)
    return version


def count_tokens(docs: DataFrame, cache: str, tokenizer: str, text: str = "text", limit: int = 4096) -> DataFrame:
    """``docs`` with n_bytes, n_tokens and over_limit (n_tokens > ``limit``)."""
    version = fill_cache(docs, cache, tokenizer, text)
    # one row a digest, read back from a table, so that Spark may split a hot digest in the join
    counts = cut(read_cache(docs.sparkSession, cache, version), "counts").withColumnRenamed("n_tokens", "__n").withColumnRenamed("text_digest", "__digest")
    body = normalised(text)
    rows = docs.withColumns({"n_bytes": F.octet_length(body).cast("long"), "__digest": digest(body)})
    return rows.join(counts, "__digest", "left").withColumns({"n_tokens": F.col("__n"), "over_limit": F.col("__n") > limit}).drop("__n", "__digest")


RESULT = ["doc_id", "n_bytes", "n_tokens", "over_limit"]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache of its own for each run, so that each run does the whole work."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return count_tokens(docs, new_path(spark, "token-counts"), public_tokenizers.path("piece_bpe_32k.model")).select(*RESULT)
