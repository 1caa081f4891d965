"""Reports kept up to date by day: partial results that merge, and reports made of them.

A cell holds counts and sums of one day, hour, route and segment; beside the cells, each
day has its vehicles, since exact distinct counts need the keys.  A day's partials depend
on that day's rows alone, so after an append only the days it touched are read again.  Both
tables are small: their size goes with days and vehicles, not with pings."""

from __future__ import annotations

import hashlib
import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pingworks.functions import metrics as M
from pingworks.functions.parsing import round_to
from pingworks.operators.reports import on_main_route
from pingworks.sources.tables import PARTITION, read_path


#: Folder of the rows without a day.
NO_DAY = "__HIVE_DEFAULT_PARTITION__"


def cells(t: DataFrame) -> DataFrame:
    g = t.groupBy(PARTITION, M.hour().alias("hour"), "route", "segment_name", "segment_type")
    return g.agg(
        M.readings().alias("n"), M.delayed().alias("late"), F.sum(F.col("speed").cast("long")).alias("speed_sum"), F.count("speed").alias("speed_n"),
        F.min("timestamp").alias("first"), F.max("timestamp").alias("last"),
    )


def vehicles(t: DataFrame) -> DataFrame:
    return t.select(PARTITION, "vid").distinct()


def _n() -> Column:
    return F.sum("n")


def _late(digits: int = 2) -> Column:
    return round_to(F.lit(100.0) * F.sum("late") / _n(), digits)


def _on_time(digits: int = 2) -> Column:
    return round_to(F.lit(100.0) - F.lit(100.0) * F.sum("late") / _n(), digits)


def _speed(digits: int) -> Column:
    return round_to(F.sum("speed_sum") / F.sum("speed_n"), digits)


def _date() -> Column:
    return F.col(PARTITION).cast("timestamp_ntz").alias("date")


def summary(c: DataFrame, v: DataFrame) -> DataFrame:
    whole = c.agg(_n().alias("total_records"), F.count_distinct("route").alias("total_routes"), F.min("first").alias("first_record"), F.max("last").alias("last_record"))
    whole = whole.withColumn("total_records", F.coalesce("total_records", F.lit(0).cast("long"))).crossJoin(v.agg(F.count_distinct("vid").alias("total_vehicles")))  # one row each
    return whole.select("total_records", "total_routes", "total_vehicles", "first_record", "last_record")


def segment_types(c: DataFrame, v: DataFrame) -> DataFrame:
    g = on_main_route(c, "segment_type").groupBy("segment_type")
    return g.agg(_n().alias("readings"), F.sum("late").alias("delayed"), _late().alias("delay_pct"), _speed(1).alias("avg_speed")).orderBy("segment_type")


def segments(c: DataFrame, v: DataFrame) -> DataFrame:
    g = on_main_route(c, "segment_name").groupBy("segment_name", "segment_type")
    out = g.agg(_n().alias("readings"), _late().alias("delay_pct"), _speed(1).alias("avg_speed"))
    return out.orderBy(F.desc_nulls_last("avg_speed"), "segment_name", F.asc_nulls_last("segment_type"))


def routes(c: DataFrame, v: DataFrame, more_than: int = 100) -> DataFrame:
    g = c.filter(F.col("route") != "U").groupBy("route")
    out = g.agg(_n().alias("readings"), F.sum("late").alias("delayed"), _late().alias("delay_pct"), _on_time().alias("on_time_pct"), _speed(1).alias("avg_speed"))
    return out.filter(F.col("readings") > more_than).orderBy(F.desc_nulls_last("on_time_pct"), "route")


def hourly(c: DataFrame, v: DataFrame) -> DataFrame:
    g = on_main_route(c, "segment_type").groupBy("hour", "segment_type")
    return g.agg(_late().alias("delay_pct"), _speed(1).alias("avg_speed")).orderBy("hour", "segment_type")


def daily(c: DataFrame, v: DataFrame) -> DataFrame:
    out = c.groupBy(PARTITION).agg(_n().alias("readings"), F.sum("late").alias("delayed"), _on_time().alias("on_time_pct"), _speed(2).alias("avg_speed"))
    seen = v.groupBy(F.col(PARTITION).alias("__day")).agg(F.count("vid").alias("vehicles"))
    out = out.join(seen, F.col(PARTITION).eqNullSafe(F.col("__day")), "left")
    return out.select(_date(), "readings", "vehicles", "delayed", "on_time_pct", "avg_speed").orderBy("date")


def daily_routes(c: DataFrame, v: DataFrame, more_than: int = 50) -> DataFrame:
    g = c.filter(F.col("route") != "U").groupBy(_date(), "route")
    return g.agg(_n().alias("readings"), _on_time().alias("on_time_pct"), _speed(2).alias("avg_speed")).filter(F.col("readings") > more_than).orderBy("date", "route")


def daily_segments(c: DataFrame, v: DataFrame) -> DataFrame:
    g = on_main_route(c, "segment_type").groupBy(_date(), "segment_type")
    return g.agg(_n().alias("readings"), _on_time().alias("on_time_pct"), _speed(2).alias("avg_speed")).orderBy("date", "segment_type")


ALL = {
    "summary": summary, "segment_types": segment_types, "segments": segments, "routes": routes, "hourly": hourly, "daily": daily,
    "daily_routes": daily_routes, "daily_segments": daily_segments,
}


def _stamps(t: DataFrame) -> dict[str, str]:
    """A digest of each day's files, by name; a file is never changed in place."""
    days: dict[str, list[str]] = {}
    for f in t.inputFiles():
        days.setdefault(re.search(rf"/{PARTITION}=([^/]+)/", f)[1], []).append(f)
    return {d: hashlib.sha256("\n".join(sorted(f)).encode()).hexdigest() for d, f in days.items()}


def _in_days(days: list[str]) -> Column:
    """Rows of the days of these folder names."""
    named = [F.lit(d).cast("date") for d in days if d != NO_DAY]
    fits = F.col(PARTITION).isin(named) if named else F.lit(False)
    return fits | F.col(PARTITION).isNull() if NO_DAY in days else fits


def _held(spark: SparkSession, root: str) -> dict[str, str]:
    try:
        return {r.day: r.stamp for r in spark.read.schema("day string, stamp string").parquet(f"{root}/days").collect()}  # one row a day
    except AnalysisException:
        return {}


def refresh(spark: SparkSession, table: DataFrame | str, root: str) -> list[str]:
    """Brings the partials at ``root`` up to ``table`` and returns the days that differ:
    those whose files are not those of the last refresh are computed again, those that
    have no files any more leave the list of days that `read` goes by.  The list is
    written last: a refresh that breaks off is done again."""
    t = read_path(spark, table) if isinstance(table, str) else table
    now, old = _stamps(t), _held(spark, root)
    changed, gone = sorted(d for d, s in now.items() if old.get(d) != s), sorted(old.keys() - now.keys())
    if changed:
        rows = t.filter(_in_days(changed))
        for name, partial in (("cells", cells), ("vehicles", vehicles)):
            out = partial(rows).repartition(PARTITION)
            out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PARTITION).parquet(f"{root}/{name}")
    if changed or gone:
        spark.createDataFrame(sorted(now.items()), "day string, stamp string").coalesce(1).write.mode("overwrite").parquet(f"{root}/days")
    return sorted(changed + gone)


def read(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The eight reports, from the partials at ``root`` of the days it lists."""
    days = _in_days(sorted(_held(spark, root)))
    c, v = (spark.read.parquet(f"{root}/{name}").filter(days) for name in ("cells", "vehicles"))
    return {name: report(c, v) for name, report in ALL.items()}
