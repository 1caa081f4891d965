"""Registered queries: each reads its tables, builds the ping table and reports on it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pingworks import fixtures as events
from pingworks.operators import audits, clean, dedup, gold, reports, schedule, segments, shapes
from pingworks.schemas import LATE_COLUMNS, PINGS
from pingworks.sources import gtfs, tables


def valid() -> Column:
    return (F.col("lat") != 0.0) | (F.col("lon") != 0.0)


def kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.dedup(events.raw_pings(spark, sf_dir), valid())


def tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.tag(kept(spark, sf_dir), segments.segments(spark))


def transit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tagged(spark, sf_dir).select(*PINGS.names)


def parse_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = clean.explode_vehicles(clean.parse_messages(events.messages(spark, sf_dir)))
    return rows.select("message_no", F.col("pos").cast("long").alias("pos"), "vid", F.col("tmstmp").cast("timestamp_ntz").alias("tmstmp"), "rt", "dly", "spd")


def clean_pings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = clean.clean(clean.explode_vehicles(clean.parse_messages(events.messages(spark, sf_dir))), ("message_no", F.col("pos").cast("long").alias("pos")))
    return rows.filter("status = 'ok'").drop("status", "order_key")


#: Pings before this day are history, in files without the late columns.
LIVE_SINCE = "2024-01-16"

PING_COLUMNS = ["arrival_seq", "vid", "timestamp", "lat", "lon", "route", "trip_id", "speed", "is_delayed"]


def dedup_pings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept(spark, sf_dir).select(*PING_COLUMNS)


def dedup_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same pings in two runs: what arrived before LIVE_SINCE, whose marks are stored,
    and what came after, which goes on from them."""
    raw, path = events.raw_pings(spark, sf_dir), tables.scratch(spark, "marks")
    # arrivals in order of time: of an event and its replay, the event's own time decides
    first_live = raw.filter(F.col("timestamp") >= F.lit(LIVE_SINCE).cast("timestamp_ntz")).agg(F.min("arrival_seq")).scalar()
    history, live = raw.filter(F.col("arrival_seq") < first_live), raw.filter(F.col("arrival_seq") >= first_live)
    dedup.marks(history, valid()).write.parquet(path)
    return dedup.dedup(history, valid()).unionByName(dedup.dedup(live, valid(), stored=spark.read.parquet(path))).select(*PING_COLUMNS)


def tag_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tagged(spark, sf_dir).select(*PING_COLUMNS, "segment_id", "segment_name", "segment_type")


def tag_segments_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.tag_by_cells(kept(spark, sf_dir).select(*PING_COLUMNS), segments.segments(spark))


def tag_segments_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.tag_by_join(kept(spark, sf_dir).select(*PING_COLUMNS), segments.segments(spark))


_stored: dict[tuple, str] = {}


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ping table of ``sf_dir`` as ingest leaves it, in day folders.  The first report
    of a session that asks for it runs the ingest; all read the stored table, until the
    input's files change."""
    key = _input(spark, sf_dir)
    if key not in _stored:
        path = tables.scratch(spark, "transit")
        tables.append_path(transit(spark, sf_dir), path)
        _stored[key] = path
    return tables.read_path(spark, _stored[key])


def release(spark: SparkSession) -> int:
    """Deletes the tables that this application's queries have written, once their results
    are no longer read; the next query that needs one writes it anew."""
    for key in [k for k in _stored if k[0] == spark.sparkContext.applicationId]:
        del _stored[key]
    return tables.release(spark)


def _input(spark: SparkSession, sf_dir: str, *more: str) -> tuple:
    """What a stored table depends on: the session and the input's files as they are."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/events.parquet")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path)
    at = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).getModificationTime()
    return (spark.sparkContext.applicationId, sf_dir, found.getLength(), found.getFileCount(), at, *more)


def on_table(report: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: report(stored(spark, sf_dir))


def ingest_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole ingest into a new table, read back: rows and vehicles a day folder."""
    path = tables.scratch(spark, "ingest")
    tables.append_path(transit(spark, sf_dir), path)
    return tables.read_path(spark, path).groupBy(tables.PARTITION).agg(F.count(F.lit(1)).alias("pings"), F.count_distinct("vid").alias("vehicles"))


def mixed_vs_dedicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over raw files: every file below the table's folder, scanned recursively."""
    stored(spark, sf_dir)
    return reports.mixed_vs_dedicated(tables.read_recursive(spark, _stored[_input(spark, sf_dir)]))


def _filled(t: DataFrame) -> DataFrame:
    return t.groupBy("route").agg(F.count(F.lit(1)).alias("pings"), *[F.count(c).alias(f"with_{c}") for c in LATE_COLUMNS])


OLD_COLUMNS = [c for c in PINGS.names if c not in LATE_COLUMNS]
def backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History files, one folder a day, appended to the live table through a glob."""
    t, files, live = stored(spark, sf_dir), tables.scratch(spark, "daily"), tables.scratch(spark, "live")
    old = F.col(tables.PARTITION) < F.lit(LIVE_SINCE).cast("date")
    t.filter(old).select(*OLD_COLUMNS, F.col(tables.PARTITION).alias("day")).write.partitionBy("day").parquet(files)
    tables.append_path(t.filter(~old).select(*PINGS.names), live)
    tables.backfill_files(spark, f"{files}/day=*/*.parquet", live)
    return _filled(tables.read_path(spark, live))


def schema_evolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pings in files of the older form, read under the full schema."""
    path = tables.scratch(spark, "old-form")
    stored(spark, sf_dir).select(*OLD_COLUMNS, tables.PARTITION).write.partitionBy(tables.PARTITION).parquet(path)
    return _filled(tables.read_path(spark, path))


def adhoc_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored(spark, sf_dir).createOrReplaceTempView("transit_data")
    return spark.sql(ADHOC)


ADHOC = "SELECT route, is_off_route, count(*) AS pings, max(speed) AS top_speed FROM transit_data WHERE heading >= 180 GROUP BY route, is_off_route"


def ingest_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audits.ingest_stats(dedup.flagged(events.raw_pings(spark, sf_dir), valid()))


def feed_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audits.feed_gaps(spark.read.parquet(f"{sf_dir}/events.parquet").select("ts"))


def duplicate_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audits.duplicate_rate(events.raw_pings(spark, sf_dir))


def reports_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, out = stored(spark, sf_dir), None
    for name, report in reports.ALL.items():
        rows = tables.json_rows(report(t)).select(F.lit(name).alias("report"), "row")
        out = rows if out is None else out.unionByName(rows)
    return out


def gold_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reports as JSON from partials by day: a table of all days before LIVE_SINCE is
    refreshed, the other days are appended, and only they are read again."""
    t, path, root, out = stored(spark, sf_dir), tables.scratch(spark, "growing"), tables.scratch(spark, "gold"), None
    old = F.col(tables.PARTITION) < F.lit(LIVE_SINCE).cast("date")
    for part in (old, ~old):
        tables.append_path(t.filter(part).select(*PINGS.names), path)
        gold.refresh(spark, path, root)
    for name, report in gold.read(spark, root).items():
        rows = tables.json_rows(report).select(F.lit(name).alias("report"), "row")
        out = rows if out is None else out.unionByName(rows)
    return out


def backfill_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History files that overlap the live table, added twice: the same pings as once."""
    t, files, live = stored(spark, sf_dir), tables.scratch(spark, "daily"), tables.scratch(spark, "live")
    day = F.col(tables.PARTITION)
    t.filter(day < F.lit(LIVE_SINCE).cast("date")).select(*PINGS.names, day.alias("day")).write.partitionBy("day").parquet(files)
    tables.append_path(t.filter(day >= F.date_sub(F.lit(LIVE_SINCE).cast("date"), 3)).select(*PINGS.names), live)
    for _ in range(2):
        tables.backfill_files(spark, f"{files}/day=*/*.parquet", live)
    return tables.read_path(spark, live).groupBy(tables.PARTITION).agg(F.count(F.lit(1)).alias("pings"), F.count_distinct("vid").alias("vehicles"))


def quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.rejected(events.messages(spark, sf_dir, damaged=True)).select("message_no", F.col("pos").cast("long").alias("pos"), "reason")


def ingest_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = clean.parse_messages(events.messages(spark, sf_dir, damaged=True))
    rows = clean.clean(clean.explode_vehicles(parsed), ("message_no", "pos"))
    read = rows.filter("status <> 'bad'")
    return audits.ingest_counters(parsed, rows, dedup.flagged(read, F.col("status") == "ok", arrival=("message_no", "pos"), size=dedup.BLOCK // 50))


def staleness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audits.staleness(events.stale_pings(spark, sf_dir), store=lambda df: _cut(df, "staleness"))


def schedule_files(spark: SparkSession, sf_dir: str, distances: bool = True) -> Callable[[str], DataFrame]:
    """The files of the schedule of ``sf_dir`` by name: written as GTFS once a session,
    loaded as a version and read back."""
    key = _input(spark, sf_dir, f"schedule-{distances}")
    if key not in _stored:
        feed, root = tables.scratch(spark, "gtfs"), tables.scratch(spark, "schedule")
        events.write_schedule(spark, sf_dir, feed, distances=distances)
        gtfs.load(spark, feed, root, "v1")
        _stored[key] = root
    return lambda file: gtfs.table(spark, _stored[key], file, "v1")


def _stop_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = schedule_files(spark, sf_dir)
    return of("stop_times").join(of("trips").select("trip_id", "route_id"), "trip_id")


def gtfs_stop_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["trip_id", "route_id", "stop_id", F.col("stop_sequence").cast("long").alias("stop_sequence"), F.col("arrival_s").cast("long").alias("arrival_s")]
    return _stop_times(spark, sf_dir).select(*cols)


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule.place(stored(spark, sf_dir), _stop_times(spark, sf_dir))


def trip_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _placed(spark, sf_dir).select("vid", "timestamp", "trip_id", "pdist", "from_stop", "to_stop")


def schedule_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = schedule.deviation(_placed(spark, sf_dir))
    return rows.select("vid", "timestamp", "trip_id", F.round("scheduled_s", 3).alias("scheduled_s"), F.round("deviation_s", 3).alias("deviation_s"))


def _cut(df: DataFrame, name: str) -> DataFrame:
    path = tables.scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def deviation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule.deviation_report(schedule.deviation(_placed(spark, sf_dir)), lambda df: _cut(df, "deviations"))


def service_day_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pings on trips by the calendar: the day whose service they ran, and how late."""
    of = schedule_files(spark, sf_dir)
    rows = schedule.on_service_day(_placed(spark, sf_dir), gtfs.services(of("trips"), of("calendar")))
    return rows.select("vid", "timestamp", "trip_id", "service_day", F.round("deviation_s", 3).alias("deviation_s"))


def service_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By day, how many trips run, with their routes and shapes: all six files."""
    of = schedule_files(spark, sf_dir)
    trips = of("trips").join(of("routes").select("route_id"), "route_id").join(of("shapes").groupBy("shape_id").agg(F.max("shape_dist_traveled").alias("length")), "shape_id")
    stops = of("stop_times").join(of("stops").select("stop_id"), "stop_id").groupBy("trip_id").agg(F.count(F.lit(1)).alias("stops"))
    per_service = trips.join(stops, "trip_id").groupBy("service_id").agg(F.count(F.lit(1)).alias("trips"), F.sum("stops").alias("stops"), F.sum("length").alias("length"))
    rows = gtfs.service_days(of("calendar")).join(per_service, "service_id")
    return rows.groupBy("day").agg(F.sum("trips").alias("trips"), F.sum("stops").alias("stops"), F.sum("length").alias("length"))


def stop_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A schedule without distances: stops placed on their trips' shapes."""
    of = schedule_files(spark, sf_dir, distances=False)
    rows = shapes.fill_distances(of("stop_times"), of("trips"), of("stops"), of("shapes"))
    return rows.select("trip_id", "stop_id", F.round("shape_dist_traveled", 2).alias("dist"))


#: Distances along a pattern between which run times are taken.
MARKS = list(range(50, 5000, 50))


def segment_run_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule.segment_run_times(stored(spark, sf_dir), MARKS)


def run_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule.run_times(stored(spark, sf_dir))
