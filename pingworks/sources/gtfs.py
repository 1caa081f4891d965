"""Static GTFS schedules: CSV files under fixed schemas, kept by version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The columns of GTFS files that are read, by file.
FILES = {
    "routes": "route_id string, route_short_name string, route_long_name string, route_type int",
    "trips": "route_id string, service_id string, trip_id string, shape_id string",
    "stops": "stop_id string, stop_name string, stop_lat double, stop_lon double",
    "stop_times": "trip_id string, arrival_time string, departure_time string, stop_id string, stop_sequence int, shape_dist_traveled double",
    "shapes": "shape_id string, shape_pt_lat double, shape_pt_lon double, shape_pt_sequence int, shape_dist_traveled double",
    "calendar": "service_id string, monday int, tuesday int, wednesday int, thursday int, friday int, saturday int, sunday int, start_date string, end_date string",
}


def service_seconds(clock: Column) -> Column:
    """HH:MM:SS as seconds of the service day; hours go on beyond 24.  Null if unreadable."""
    part = lambda k: F.nullif(F.regexp_extract(clock, r"^\s*(\d+):(\d\d):(\d\d)\s*$", k), F.lit("")).try_cast("int")
    return part(1) * 3600 + part(2) * 60 + part(3)


def read(spark: SparkSession, folder: str, file: str) -> DataFrame:
    """One file of a feed, by column name in any order; clock times also as seconds."""
    kinds = dict(x.split() for x in FILES[file].split(", "))
    raw = spark.read.option("header", True).csv(f"{folder}/{file}.txt")
    out = raw.select(*[(F.col(c) if c in raw.columns else F.lit(None)).try_cast(t).alias(c) for c, t in kinds.items()])
    return out.withColumns({c.replace("_time", "_s"): service_seconds(F.col(c)) for c in kinds if c.endswith("_time")})


def load(spark: SparkSession, folder: str, root: str, version: str, files: tuple[str, ...] = tuple(FILES)) -> None:
    """Files of a feed to Parquet under ``root``, beside its earlier versions."""
    for file in files:
        read(spark, folder, file).write.mode("overwrite").parquet(f"{root}/{file}/version={version}")


def table(spark: SparkSession, root: str, file: str, version: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{file}").filter(F.col("version").cast("string") == version).drop("version")


DAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")


def _day(text: Column) -> Column:
    return F.to_date(F.try_to_timestamp(text, F.lit("yyyyMMdd")))


def services(trips: DataFrame, calendar: DataFrame) -> DataFrame:
    """(trip_id, service_id, first_day, last_day, weekdays): when each trip runs; bit k of
    weekdays is the day k after Monday.  Trips whose service has no calendar have nulls."""
    bits = sum((F.coalesce(F.col(d), F.lit(0)) * (1 << k) for k, d in enumerate(DAYS)), F.lit(0))
    c = calendar.select(F.col("service_id").alias("c_service"), _day(F.col("start_date")).alias("first_day"), _day(F.col("end_date")).alias("last_day"), bits.alias("weekdays"))
    return trips.join(c, F.col("service_id") == F.col("c_service"), "left").select("trip_id", "service_id", "first_day", "last_day", "weekdays")


def service_days(calendar: DataFrame) -> DataFrame:
    """(service_id, day): every day on which a service runs."""
    first, last = _day(F.col("start_date")), _day(F.col("end_date"))
    rows = calendar.filter(first <= last).select("service_id", *DAYS, F.explode(F.sequence(first, last)).alias("day"))
    runs = F.element_at(F.array(*DAYS), F.weekday("day") + 1) == 1
    return rows.filter(runs).select("service_id", "day")


def changes(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """(key, change): rows added, removed or changed between two versions of a file."""
    rest = [c for c in old.columns if c not in key]
    mark = lambda df, v: df.select(*key, F.struct(*[F.col(c) for c in rest]).alias("row") if rest else F.lit(0).alias("row"), F.lit(v).alias("v"))
    both = mark(old, 0).unionByName(mark(new, 1)).groupBy(*key).agg(F.max(F.when(F.col("v") == 0, F.col("row"))).alias("a"), F.max(F.when(F.col("v") == 1, F.col("row"))).alias("b"))
    what = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "changed")
    return both.select(*key, what.alias("change")).filter("change is not null")
