"""The ping table of a running stream, in folders that a manifest names.

Each batch writes a folder of its own, and merging replaces many small folders by one with
few files a day.  A manifest lists the folders that are the table, and a new one is made by
renaming a file to the next number, which succeeds for one writer only (on file systems
where a rename is atomic).  So a reader sees
a batch or a merge whole or not at all, and goes on with the folders of the manifest it
began with; what a broken writer leaves behind is in no manifest."""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass, replace

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pingworks.schemas import PINGS
from pingworks.sources.tables import PARTITION, laid_out, widen, with_date

RUN = "run"


@dataclass(frozen=True)
class Manifest:
    version: int = 0
    folders: tuple[str, ...] = ()
    batch: int = -1  # the newest batch of the stream


def _fs(spark: SparkSession, root: str):
    path = spark._jvm.org.apache.hadoop.fs.Path
    return path(root).getFileSystem(spark._jsc.hadoopConfiguration()), path


def _text(spark: SparkSession, fs, file) -> str:
    stream = fs.open(file)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def current(spark: SparkSession, root: str) -> Manifest:
    fs, path = _fs(spark, root)
    home = path(f"{root}/_manifest")
    names = [s.getPath().getName() for s in fs.listStatus(home)] if fs.exists(home) else []
    version = max((int(n) for n in names if n.isdigit()), default=0)
    if not version:
        return Manifest()
    found = json.loads(_text(spark, fs, path(f"{root}/_manifest/{version:010d}")))
    return Manifest(version, tuple(found["folders"]), found["batch"])


def commit(spark: SparkSession, root: str, next_: Manifest) -> bool:
    """Makes ``next_`` the table; False if another writer has taken its number.  The file
    is written beside and then renamed, which fails where the name is taken."""
    fs, path = _fs(spark, root)
    draft, final = path(f"{root}/_manifest/_{uuid.uuid4().hex}"), path(f"{root}/_manifest/{next_.version:010d}")
    fs.mkdirs(draft.getParent())
    stream = fs.create(draft, False)
    try:
        stream.write(bytearray(json.dumps({"folders": next_.folders, "batch": next_.batch}).encode()))
    finally:
        stream.close()
    jvm = spark._jvm
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), spark._jsc.hadoopConfiguration())
    none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        files.rename(fs.makeQualified(draft), fs.makeQualified(final), none)
    except Py4JJavaError as e:
        fs.delete(draft, False)
        if "FileAlreadyExistsException" in str(e.java_exception.getClass().getName()):
            return False
        raise
    return True


def read(spark: SparkSession, root: str, at: Manifest | None = None) -> DataFrame:
    """The table as its newest manifest, or that of ``at``, has it."""
    at = at or current(spark, root)
    schema = T.StructType([*PINGS.fields, T.StructField(PARTITION, T.DateType())])
    if not at.folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", root).parquet(*[f"{root}/{f}" for f in at.folders]).drop(RUN)


def append_batch(rows: DataFrame, root: str, batch: int) -> bool:
    """Adds a batch of the stream; False if it is in the table already (a replay)."""
    spark = rows.sparkSession
    if batch <= current(spark, root).batch:
        return False
    folder = f"{RUN}=batch-{batch}"
    with_date(widen(rows)).write.mode("overwrite").partitionBy(PARTITION).parquet(f"{root}/{folder}")
    while True:
        old = current(spark, root)
        if batch <= old.batch:
            return False
        if commit(spark, root, Manifest(old.version + 1, (*old.folders, folder), batch)):
            return True


def merge(spark: SparkSession, root: str, least: int = 8) -> bool:
    """Puts all folders of the table together, once there are ``least`` of them: few files
    a day, sorted, whatever the batches were.  Batches that come meanwhile stay beside."""
    old = current(spark, root)
    if len(old.folders) < least:
        return False
    folder = f"{RUN}=merged-{uuid.uuid4().hex}"
    laid_out(read(spark, root, old)).write.partitionBy(PARTITION).parquet(f"{root}/{folder}")
    while True:
        now = current(spark, root)
        if not set(old.folders) <= set(now.folders):
            return False  # another merge was first; this folder is in no manifest
        if commit(spark, root, replace(now, version=now.version + 1, folders=(folder, *[f for f in now.folders if f not in old.folders]))):
            return True


def sweep(spark: SparkSession, root: str, older_s: float = 86_400) -> list[str]:
    """Deletes folders that no manifest of the last ``older_s`` seconds names and that are
    themselves older; readers have so long to finish."""
    fs, path = _fs(spark, root)
    limit = (time.time() - older_s) * 1000
    new = [s for s in fs.listStatus(path(f"{root}/_manifest")) if s.getPath().getName().isdigit()]
    new.sort(key=lambda s: s.getPath().getName())
    # the newest one, those of the time, and the one that was valid when it began
    first = next((i for i, s in enumerate(new) if s.getModificationTime() >= limit), len(new))
    keep = set(current(spark, root).folders)
    for s in new[max(0, first - 1) :]:
        keep |= set(json.loads(_text(spark, fs, s.getPath()))["folders"])
    gone = []
    for s in fs.listStatus(path(root)):
        name = s.getPath().getName()
        if name.startswith(f"{RUN}=") and name not in keep and s.getModificationTime() < limit:
            fs.delete(s.getPath(), True)
            gone.append(name)
    return gone


def files_a_day(t: DataFrame) -> DataFrame:
    return t.groupBy(PARTITION).agg(F.count_distinct(F.col("_metadata.file_path")).alias("files"))
