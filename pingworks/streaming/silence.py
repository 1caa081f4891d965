"""Alarm of a live feed: raised by a timer, since what is missing makes no row.

Each task first brings its messages down to one row, so the state of the feed, one time,
is kept by a task that sees a few rows a batch however many messages come."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ALARM = "feed string, last_received timestamp, silent_s long"


class _Silence(StatefulProcessor):
    def __init__(self, least_s: int) -> None:
        self.least_ms = least_s * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", T.StructType([T.StructField("received", T.TimestampType()), T.StructField("seen_ms", T.LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        newest = max(f["received_at"].max() for f in rows)
        if self.last.exists():
            newest = max(newest, pd.Timestamp(self.last.get()[0]))
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        now = timerValues.getCurrentProcessingTimeInMs()
        self.handle.registerTimer(now + self.least_ms)
        self.last.update((newest.to_pydatetime(), now))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        received, seen_ms = self.last.get()
        silent = (timerValues.getCurrentProcessingTimeInMs() - seen_ms) // 1000
        yield pd.DataFrame({"feed": [key[0]], "last_received": [pd.Timestamp(received)], "silent_s": [silent]})

    def close(self) -> None:
        pass


def alarms(messages: DataFrame, feed: str = "vehicles", least_s: int = 300) -> DataFrame:
    """(feed, last_received, silent_s): one row each time that no message has come for
    ``least_s`` seconds of the clock; the next message ends the silence.  ``messages`` is a
    stream with received_at."""

    def newest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = max((f["received_at"].max() for f in frames if len(f)), default=None)
        if last is not None and not pd.isna(last):
            yield pd.DataFrame({"feed": [feed], "received_at": [last]})

    rows = messages.select(F.col("received_at").cast("timestamp").alias("received_at")).mapInPandas(newest, "feed string, received_at timestamp")
    return rows.groupBy("feed").transformWithStateInPandas(_Silence(least_s), outputStructType=T._parse_datatype_string(ALARM), outputMode="Append", timeMode="ProcessingTime")
