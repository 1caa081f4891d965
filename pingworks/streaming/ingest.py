"""Continuous ingest: landing zone of feed texts, keyed dedup, tagging, append.

The only state is one timestamp text a vehicle; the only shuffle is on the vehicle."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from pingworks.operators.clean import clean, explode_vehicles, parse_messages, rejected
from pingworks.operators.segments import tag
from pingworks.schemas import PINGS
from pingworks.sources import versions

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_landing(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """One message a line, as JSON with message_no, received_at and value."""
    schema = "message_no long, received_at timestamp_ntz, value string"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(path)


class _Monotonic(StatefulProcessor):
    """Flags a vehicle's pings: kept are valid ones newer than the last one kept."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.mark = handle.getValueState("mark", T.StructType([T.StructField("mark", T.StringType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["message_no", "pos"], kind="stable")
        keys, valid = batch["order_key"].to_numpy(object), (batch["outcome"] == "ok").to_numpy()
        old = self.mark.get()[0] if self.mark.exists() else ""
        marks = np.maximum.accumulate(np.append(np.array([old], object), np.where(valid, keys, "")))
        newer = (keys > marks[:-1]).astype(bool)
        if marks[-1] != old:
            self.mark.update((marks[-1],))
        batch["outcome"] = np.where(~newer, "deduped", np.where(valid, "kept", "invalid"))
        yield batch

    def close(self) -> None:
        pass


def flag(pings: DataFrame) -> DataFrame:
    """Streaming form of `dedup.flagged`, over rows with outcome (ok or invalid),
    order_key, message_no and pos."""
    return pings.groupBy("vid").transformWithStateInPandas(_Monotonic(), outputStructType=pings.schema, outputMode="Append", timeMode="None")


def outcomes(messages: DataFrame) -> DataFrame:
    """Messages to flagged pings; malformed texts and unreadable rows are `start_quarantine`'s."""
    rows = clean(explode_vehicles(parse_messages(messages)), ("message_no", "pos")).filter("status <> 'bad'").withColumnRenamed("status", "outcome")
    return flag(rows)


def _counts(column: str, *values: str) -> list[Column]:
    return [F.count_if(F.col(column) == x).alias(x) for x in values]


def _note(spark: SparkSession, path: str, stream: str, batch: int, counts: dict) -> None:
    """One row of counters a batch, in a folder of its own: a replay writes it again."""
    row = spark.createDataFrame([(k, v) for k, v in counts.items()], "outcome string, pings long")
    row.coalesce(1).write.mode("overwrite").parquet(f"{path}/stream={stream}/batch={batch}")


def counters(spark: SparkSession, path: str) -> DataFrame:
    """(stream, batch, outcome, pings) of the streams that note their counts at ``path``."""
    return spark.read.schema("outcome string, pings long, stream string, batch long").parquet(path).select("stream", "batch", "outcome", "pings")


def _run(out: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, every: str | None) -> StreamingQuery:
    w = out.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()


def start(messages: DataFrame, segs: DataFrame, table_path: str, checkpoint: str, every: str | None = None, metrics: str | None = None, merge_at: int = 50) -> StreamingQuery:
    """Appends to the table of `versions`, a folder a batch; once it has ``merge_at``
    folders they are merged.  ``every`` is the flush interval; without one the query drains
    what is there and stops.  A failed batch is replayed from the checkpoint and enters the
    table once.  With ``metrics``, each batch notes how many pings it kept and dropped."""

    def each(batch: DataFrame, number: int) -> None:
        spark, seen = batch.sparkSession, Observation()
        rows = batch.observe(seen, *_counts("outcome", "kept", "deduped", "invalid")).filter("outcome = 'kept'")
        written = versions.append_batch(tag(rows, segs).select(*PINGS.names), table_path, number)
        if metrics:
            # of a batch that is in the table already, counts come from its rows anew
            counts = seen.get if written else batch.agg(*_counts("outcome", "kept", "deduped", "invalid")).first().asDict()
            _note(spark, metrics, "ingest", number, counts)
        versions.merge(spark, table_path, merge_at)

    return _run(outcomes(messages), each, checkpoint, every)


def start_quarantine(messages: DataFrame, path: str, checkpoint: str, every: str | None = None, metrics: str | None = None) -> StreamingQuery:
    """Writes what ingest cannot use to Parquet by batch and reason, beside the ingest query
    on the same landing zone; with ``metrics``, each batch notes its counts."""

    def each(batch: DataFrame, number: int) -> None:
        seen = Observation()
        batch.observe(seen, *_counts("reason", "malformed", "bad")).write.mode("overwrite").partitionBy("reason").parquet(f"{path}/batch={number}")
        if metrics:
            _note(batch.sparkSession, metrics, "quarantine", number, seen.get)

    return _run(rejected(messages), each, checkpoint, every)


def dry_run(messages: DataFrame, segs: DataFrame, checkpoint: str) -> StreamingQuery:
    """The same work without a table; counts come from the observed metrics."""
    out = outcomes(messages).observe("ingest", *_counts("outcome", "kept", "deduped", "invalid"))
    out = tag(out.filter("outcome = 'kept'"), segs).select(*PINGS.names)
    return out.writeStream.format("noop").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
