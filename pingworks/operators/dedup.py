"""Monotonic dedup in batch: per vehicle, in arrival order, a ping is kept if it is
valid and newer than every earlier valid ping of its vehicle.

A valid ping that is dropped is not newer than the mark, so the mark is the running
maximum over all earlier valid pings.  It is found at two levels: arrivals are cut into
blocks of so many numbers; one row a vehicle and block holds the block's maximum, a scan
over those few rows gives what came before each block, and only the rest is a window, of
one vehicle and block.  So no task holds more of a vehicle than a block, even where one
vehicle sends most pings.  Marks can be stored, and a later run goes on from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Arrival numbers of a block; a number stands for a ping, or for a message of some dozens.
BLOCK = 1_000_000


def _block(arrival: tuple[str, ...], size: int) -> Column:
    return F.floor(F.col(arrival[0]) / size)


def block_marks(pings: DataFrame, valid: Column, order_key: str, arrival: tuple[str, ...], size: int) -> DataFrame:
    """(m_vid, m_block, before): the newest valid key of each vehicle before each block."""
    best = pings.groupBy(F.col("vid").alias("m_vid"), _block(arrival, size).alias("m_block")).agg(F.max(F.when(valid, F.col(order_key))).alias("newest"))
    earlier = Window.partitionBy("m_vid").orderBy("m_block").rowsBetween(Window.unboundedPreceding, -1)
    return best.select("m_vid", "m_block", F.max("newest").over(earlier).alias("before"))


def marks(pings: DataFrame, valid: Column, order_key: str = "timestamp", stored: DataFrame | None = None) -> DataFrame:
    """(vid, mark): the newest valid key of each vehicle, to go on from; with ``stored``,
    those marks brought forward."""
    now = pings.groupBy("vid").agg(F.max(F.when(valid, F.col(order_key))).alias("mark")).filter("mark is not null")
    return now if stored is None else now.unionByName(stored.select("vid", "mark")).groupBy("vid").agg(F.max("mark").alias("mark"))


def flagged(
    pings: DataFrame, valid: Column, order_key: str = "timestamp", arrival: tuple[str, ...] = ("arrival_seq",), stored: DataFrame | None = None, size: int = BLOCK
) -> DataFrame:
    """``pings`` with outcome: kept, deduped or invalid.  ``arrival`` names what orders
    them, numbers first; ``stored`` holds the `marks` of what came before them."""
    own = pings.columns
    before = block_marks(pings, valid, order_key, arrival, size)
    if stored is not None:
        old = stored.select(F.col("vid").alias("o_vid"), F.col("mark").alias("old"))
        before = before.join(old, F.col("m_vid").eqNullSafe(F.col("o_vid")), "left").select("m_vid", "m_block", F.greatest("before", "old").alias("before"))
    within = Window.partitionBy("vid", "__block").orderBy(*arrival).rowsBetween(Window.unboundedPreceding, -1)
    rows = pings.withColumn("__block", _block(arrival, size)).withColumn("__mark", F.max(F.when(valid, F.col(order_key))).over(within))
    rows = rows.join(before.filter("before is not null"), F.col("vid").eqNullSafe(F.col("m_vid")) & (F.col("__block") == F.col("m_block")), "left")
    stale = F.coalesce(F.col(order_key) <= F.greatest("__mark", "before"), F.lit(False))
    return rows.select(*own, F.when(stale, "deduped").when(~valid, "invalid").otherwise("kept").alias("outcome"))


def dedup(
    pings: DataFrame, valid: Column, order_key: str = "timestamp", arrival: tuple[str, ...] = ("arrival_seq",), stored: DataFrame | None = None, size: int = BLOCK
) -> DataFrame:
    return flagged(pings, valid, order_key, arrival, stored, size).filter("outcome = 'kept'").drop("outcome")
