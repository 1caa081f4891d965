"""Aggregates that the reports share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pingworks.functions.parsing import round_to


def readings() -> Column:
    return F.count(F.lit(1))


def delayed() -> Column:
    return F.sum(F.when(F.col("is_delayed"), 1).otherwise(0))


def delay_pct(digits: int = 2) -> Column:
    return round_to(F.lit(100.0) * delayed() / readings(), digits)


def on_time_pct(digits: int = 2) -> Column:
    return round_to(F.lit(100.0) - F.lit(100.0) * delayed() / readings(), digits)


def avg_speed(digits: int) -> Column:
    return round_to(F.avg("speed"), digits)


def day(ts: str = "timestamp") -> Column:
    return F.date_trunc("day", F.col(ts)).cast("timestamp_ntz")


def hour(ts: str = "timestamp") -> Column:
    return F.hour(ts).cast("long")
