"""Data-quality audits of the ping table and the feed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pingworks.functions import metrics as M
from pingworks.functions.parsing import round_to
from pingworks.operators import quantiles
from pingworks.operators.reports import MAIN_ROUTE


def trailing_days(t: DataFrame, days: int = 7, as_of: Column | None = None) -> DataFrame:
    """Rows of the last ``days`` before ``as_of``, the bound included; by default the
    table's newest timestamp, as a scalar subquery.  Where the table is
    partitioned by event_date, whole older days are pruned as well."""
    if as_of is None:
        newest = t
        if "event_date" in t.columns:
            # the newest day alone holds it; which that is, the folders' names say
            newest = t.filter(F.col("event_date") == t.agg(F.max("event_date")).scalar())
        as_of = newest.agg(F.max("timestamp")).scalar()
    since = as_of - F.expr(f"INTERVAL {days} DAYS")
    rows = t.filter(F.col("timestamp") >= since)
    if "event_date" in t.columns:
        rows = rows.filter(F.col("event_date") >= F.to_date(since))
    return rows


def _pct(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, round_to(F.lit(100.0) * part / whole, 2)).otherwise(F.lit(0.0))


def duplicate_rate(raw: DataFrame, as_of: Column | None = None) -> DataFrame:
    pair = F.count_distinct(F.struct("vid", "timestamp"))
    c = trailing_days(raw, as_of=as_of).agg(F.count(F.lit(1)).alias("total"), pair.alias("distinct_pings"))
    dup = F.col("total") - F.col("distinct_pings")
    return c.select("total", "distinct_pings", dup.alias("duplicates"), _pct(dup, F.col("total")).alias("duplicate_pct"))


def _recent_main(t: DataFrame, as_of: Column | None = None) -> DataFrame:
    return trailing_days(t, as_of=as_of).filter(F.col("route") == MAIN_ROUTE)


def pings_per_segment(t: DataFrame, as_of: Column | None = None) -> DataFrame:
    return _recent_main(t, as_of).groupBy("segment_id", "segment_name").agg(F.count(F.lit(1)).alias("pings")).orderBy(F.asc_nulls_last("segment_id"))


def pings_per_segment_type(t: DataFrame, as_of: Column | None = None) -> DataFrame:
    return _recent_main(t, as_of).groupBy("segment_type").agg(F.count(F.lit(1)).alias("pings")).orderBy(F.desc("pings"), F.asc_nulls_last("segment_type"))


def in_service(t: DataFrame, as_of: Column | None = None) -> DataFrame:
    return _recent_main(t, as_of).filter((F.col("route") != "U") & F.col("trip_id").isNotNull() & (F.col("trip_id") != "N/A"))


def null_segment_coverage(t: DataFrame, as_of: Column | None = None) -> DataFrame:
    c = in_service(t, as_of).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("segment_id").isNull()).alias("null_segments"))
    return c.withColumn("null_pct", _pct(F.col("null_segments"), F.col("total")))


def null_segment_clusters(t: DataFrame, top: int = 25, as_of: Column | None = None) -> DataFrame:
    g = in_service(t, as_of).filter(F.col("segment_id").isNull()).groupBy(round_to(F.col("lat"), 3).alias("lat"), round_to(F.col("lon"), 3).alias("lon"))
    return g.agg(F.count(F.lit(1)).alias("pings")).orderBy(F.desc("pings"), "lat", "lon").limit(top)


def feed_gaps(feed: DataFrame, at: str = "ts", least_s: int = 300) -> DataFrame:
    """Silences of ``least_s`` seconds or more.  Time is cut into stretches of that length:
    no such silence lies within one, so the first and last message of each are enough, and
    what is ordered in one task is one row a stretch, not the messages."""
    since = F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(at))
    ends = feed.filter(F.col(at).isNotNull()).groupBy(F.floor(since / least_s).alias("stretch")).agg(F.min(at).alias("gap_end"), F.max(at).alias("last"))
    rows = ends.withColumn("gap_start", F.lag("last").over(Window.orderBy("stretch")))
    rows = rows.withColumn("gap_seconds", F.timestamp_diff("SECOND", F.col("gap_start"), F.col("gap_end")))
    return rows.filter(F.col("gap_seconds") >= least_s).select("gap_start", "gap_end", "gap_seconds")


def unassigned(t: DataFrame) -> DataFrame:
    """By hour of day: pings of vehicles without a route ("U") or without a trip."""
    none = F.col("route") == "U"
    no_trip = F.col("trip_id").isNull() | (F.col("trip_id") == "N/A")
    c = t.groupBy(M.hour().alias("hour")).agg(F.count(F.lit(1)).alias("pings"), F.count_if(none).alias("unassigned"), F.count_if(no_trip).alias("without_trip"))
    return c.withColumn("unassigned_pct", _pct(F.col("unassigned"), F.col("pings"))).orderBy("hour")


def staleness(t: DataFrame, least_s: int = 300, store: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """By route: how far the server's time is behind the vehicle's, in seconds, over the
    pings that have both.  Only whole seconds and how often each occurs leave the pings'
    tasks; the quantiles are selected from these.  ``store`` writes and rereads them."""
    rows = t.select("route", F.timestamp_diff("SECOND", F.col("timestamp"), F.col("srvtmstmp").try_cast("timestamp_ntz")).alias("s"))
    counts = store(quantiles.counted(rows, ["route"], "s"))
    stale = F.sum(F.when(F.col("s") >= least_s, F.col("n")).otherwise(F.lit(0)))
    mean = F.sum(F.col("s") * F.col("n")).cast("double") / F.sum("n")
    c = counts.groupBy("route").agg(F.sum("n").alias("pings"), stale.alias("stale"), round_to(mean, 2).alias("avg_s"))
    picked = quantiles.select_many(counts, ["route"], "s", {"median_s": 0.5, "p90_s": 0.9})
    picked = picked.select(F.col("route").alias("p_route"), *[round_to(F.col(x), 2).alias(x) for x in ("median_s", "p90_s")])
    c = c.join(picked, F.col("route").eqNullSafe(F.col("p_route"))).drop("p_route")
    return c.orderBy("route")


def ingest_stats(flagged: DataFrame) -> DataFrame:
    of = lambda x: F.count_if(F.col("outcome") == x).alias(x)
    return flagged.agg(F.count(F.lit(1)).alias("received"), of("kept"), of("deduped"), of("invalid"))


def ingest_counters(parsed: DataFrame, pings: DataFrame, flagged: DataFrame) -> DataFrame:
    """One row: messages and malformed ones, pings and those that cannot be read (bad) of
    the cleaned rows, and what became of the readable ones."""
    m = parsed.agg(F.count(F.lit(1)).alias("messages"), F.count_if("malformed").alias("malformed"))
    p = pings.agg(F.count(F.lit(1)).alias("pings"), F.count_if(F.col("status") == "bad").alias("bad"))
    return m.join(p).join(ingest_stats(flagged).drop("received"))  # one row each
