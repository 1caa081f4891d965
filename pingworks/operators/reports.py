"""The dashboard's reports, each a function of the ping table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pingworks.functions import metrics as M
from pingworks.functions.parsing import round_to

MAIN_ROUTE = "12"


def on_main_route(t: DataFrame, having: str) -> DataFrame:
    return t.filter((F.col("route") == MAIN_ROUTE) & F.col(having).isNotNull())


def summary(t: DataFrame) -> DataFrame:
    return t.agg(
        M.readings().alias("total_records"), F.count_distinct("route").alias("total_routes"), F.count_distinct("vid").alias("total_vehicles"),
        F.min("timestamp").alias("first_record"), F.max("timestamp").alias("last_record"),
    )


def segment_types(t: DataFrame) -> DataFrame:
    g = on_main_route(t, "segment_type").groupBy("segment_type")
    return g.agg(M.readings().alias("readings"), M.delayed().alias("delayed"), M.delay_pct().alias("delay_pct"), M.avg_speed(1).alias("avg_speed")).orderBy("segment_type")


def segments(t: DataFrame) -> DataFrame:
    g = on_main_route(t, "segment_name").groupBy("segment_name", "segment_type")
    out = g.agg(M.readings().alias("readings"), M.delay_pct().alias("delay_pct"), M.avg_speed(1).alias("avg_speed"))
    return out.orderBy(F.desc_nulls_last("avg_speed"), "segment_name", F.asc_nulls_last("segment_type"))


def routes(t: DataFrame, more_than: int = 100) -> DataFrame:
    g = t.filter(F.col("route") != "U").groupBy("route")
    out = g.agg(M.readings().alias("readings"), M.delayed().alias("delayed"), M.delay_pct().alias("delay_pct"), M.on_time_pct().alias("on_time_pct"), M.avg_speed(1).alias("avg_speed"))
    return out.filter(F.col("readings") > more_than).orderBy(F.desc_nulls_last("on_time_pct"), "route")


def hourly(t: DataFrame) -> DataFrame:
    g = on_main_route(t, "segment_type").groupBy(M.hour().alias("hour"), "segment_type")
    return g.agg(M.delay_pct().alias("delay_pct"), M.avg_speed(1).alias("avg_speed")).orderBy("hour", "segment_type")


def daily(t: DataFrame) -> DataFrame:
    g = t.groupBy(M.day().alias("date"))
    out = g.agg(
        M.readings().alias("readings"), F.count_distinct("vid").alias("vehicles"), M.delayed().alias("delayed"),
        M.on_time_pct().alias("on_time_pct"), M.avg_speed(2).alias("avg_speed"),
    )
    return out.orderBy("date")


def daily_routes(t: DataFrame, route: str | None = None, more_than: int = 50) -> DataFrame:
    rows = t.filter(F.col("route") == route) if route else t.filter(F.col("route") != "U")
    out = rows.groupBy(M.day().alias("date"), "route").agg(M.readings().alias("readings"), M.on_time_pct().alias("on_time_pct"), M.avg_speed(2).alias("avg_speed"))
    return out.filter(F.col("readings") > more_than).orderBy("date", "route")


def daily_segments(t: DataFrame) -> DataFrame:
    g = on_main_route(t, "segment_type").groupBy(M.day().alias("date"), "segment_type")
    return g.agg(M.readings().alias("readings"), M.on_time_pct().alias("on_time_pct"), M.avg_speed(2).alias("avg_speed")).orderBy("date", "segment_type")


def mixed_vs_dedicated(t: DataFrame) -> DataFrame:
    g = on_main_route(t, "segment_type").groupBy("segment_type")
    return g.agg(M.readings().alias("readings"), M.delay_pct().alias("delay_pct"), M.avg_speed(1).alias("avg_speed"))


def headline_kpis(t: DataFrame) -> DataFrame:
    pick = lambda kind, c: F.max(F.when(F.col("segment_type") == kind, F.col(c)))
    k = segment_types(t).agg(
        pick("dedicated_row", "avg_speed").alias("dedicated_speed"), pick("mixed_traffic", "avg_speed").alias("mixed_speed"), pick("mixed_traffic", "delay_pct").alias("mixed_delay_pct")
    )
    over = F.when(F.coalesce("mixed_speed", F.lit(0.0)) == 0.0, 1.0).otherwise(F.col("mixed_speed"))
    return k.withColumn("speed_ratio", round_to(F.coalesce("dedicated_speed", F.lit(0.0)) / over, 1))


def data_range(t: DataFrame) -> DataFrame:
    span = t.agg(F.timestamp_diff("SECOND", F.min("timestamp"), F.max("timestamp")).alias("s"))
    hours = F.floor(F.col("s") / 3600 + 0.5)
    days = F.floor(F.col("hours") / 24 + 0.5)
    label = F.when(F.col("hours") >= 48, F.concat(days.cast("string"), F.lit(" days"))).otherwise(F.concat(F.col("hours").cast("string"), F.lit("h")))
    return span.select(hours.cast("long").alias("hours")).withColumn("label", label)


def segment_speed_pivot(t: DataFrame) -> DataFrame:
    pick = lambda kind: F.max(F.when(F.col("segment_type") == kind, F.col("avg_speed")))
    return daily_segments(t).groupBy("date").agg(pick("dedicated_row").alias("dedicated_speed"), pick("mixed_traffic").alias("mixed_speed")).orderBy("date")


def route_bands(t: DataFrame) -> DataFrame:
    band = F.when(F.col("on_time_pct") >= 90, "green").when(F.col("on_time_pct") >= 80, "yellow").otherwise("red")
    return routes(t).select("route", "on_time_pct", band.alias("band"))


def segment_labels(t: DataFrame) -> DataFrame:
    label = F.when(F.col("segment_type") == "dedicated_row", "Dedicated ROW").otherwise("Mixed Traffic")
    return segment_types(t).select("segment_type", label.alias("label"), "readings")


ALL = {
    "summary": summary, "segment_types": segment_types, "segments": segments, "routes": routes, "hourly": hourly, "daily": daily,
    "daily_routes": daily_routes, "daily_segments": daily_segments,
}
