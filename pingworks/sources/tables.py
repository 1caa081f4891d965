"""The ping table: creation, additive migration, append, backfill, gold tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pingworks.schemas import LATE_COLUMNS, PINGS

PARTITION = "event_date"

#: Paths that `scratch` gave, by application.
_given: dict[str, list[str]] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share; without a setting, one
    machine may use a folder of its own, a cluster may not."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="pingworks-")
        spark.conf.set("spark.checkpoint.dir", found)
    path = f"{found.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _given.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def release(spark: SparkSession) -> int:
    """Deletes what is at the paths that `scratch` gave this application, and nothing else;
    frames that read from there can be read no more.  Says how many paths held something."""
    gone = 0
    for name in _given.pop(spark.sparkContext.applicationId, []):
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        gone += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return gone


def with_date(pings: DataFrame) -> DataFrame:
    return pings.withColumn(PARTITION, F.to_date("timestamp"))


def create(spark: SparkSession, table: str) -> None:
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in PINGS.fields)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({fields}, {PARTITION} date) USING parquet PARTITIONED BY ({PARTITION})")


def migrate(spark: SparkSession, table: str) -> list[str]:
    """Adds the late columns that a table lacks; says which."""
    have = set(spark.table(table).columns)
    missing = [f for f in PINGS.fields if f.name in LATE_COLUMNS and f.name not in have]
    if missing:
        spark.sql(f"ALTER TABLE {table} ADD COLUMNS ({', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in missing)})")
    return [f.name for f in missing]


def laid_out(pings: DataFrame) -> DataFrame:
    """Rows dealt by day, but in pieces of one size: Spark splits a large day and joins
    small ones.  Sorted, so that row groups can be skipped by route."""
    return pings.hint("rebalance", PARTITION).sortWithinPartitions(PARTITION, "route", "vid")


def append(pings: DataFrame, table: str) -> None:
    """Adds rows to a catalog table, by column name."""
    rows = with_date(pings).select(*pings.sparkSession.table(table).columns)
    laid_out(rows).write.insertInto(table)


def append_path(pings: DataFrame, path: str) -> None:
    """Adds rows to the table of day folders at ``path``."""
    laid_out(with_date(widen(pings))).write.mode("append").partitionBy(PARTITION).parquet(path)


def read_path(spark: SparkSession, path: str) -> DataFrame:
    """The table of day folders at ``path``, with event_date to prune by; columns that
    older files lack are null."""
    return spark.read.schema(T.StructType([*PINGS.fields, T.StructField(PARTITION, T.DateType())])).parquet(path)


def backfill_files(spark: SparkSession, files: str, path: str) -> None:
    """Adds history files (a glob) to the table at ``path``, under its full schema: the
    pings (by vehicle and time) that the table does not have.  Only the days that the files
    hold are read, so a second run, or one over the live boundary, changes nothing."""
    history = with_date(widen(spark.read.option("mergeSchema", "true").parquet(files)))
    days = [r[0] for r in history.select(PARTITION).distinct().collect()]  # one row a day
    own, have = ["vid", "timestamp", PARTITION], read_path(spark, path)
    fits = F.lit(False)
    if None in days:
        fits = fits | F.col(PARTITION).isNull()
    if set(days) - {None}:
        fits = fits | F.col(PARTITION).isin([d for d in days if d is not None])
    have = have.filter(fits).select(*[F.col(c).alias(f"h_{c}") for c in own])
    same = F.lit(True)
    for c in own:
        same = same & F.col(c).eqNullSafe(F.col(f"h_{c}"))
    append_path(history.join(have, same, "left_anti"), path)


def widen(old: DataFrame) -> DataFrame:
    """Rows of an older table under the full schema."""
    have = set(old.columns)
    return old.select(*[F.col(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in PINGS.fields])


def read_recursive(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(PINGS).option("recursiveFileLookup", "true").parquet(root)


def refresh_gold(reports: dict[str, DataFrame], root: str) -> None:
    """Each report, computed once, to a table of its own."""
    for name, df in reports.items():
        df.write.mode("overwrite").parquet(f"{root}/{name}")


def json_rows(df: DataFrame) -> DataFrame:
    """Rows as JSON objects: every field, nulls too, and times with microseconds."""
    options = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "ignoreNullFields": "false"}
    return df.select(F.to_json(F.struct(*df.columns), options).alias("row"))
