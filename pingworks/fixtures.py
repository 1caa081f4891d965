"""Test input, not part of the library: pings, feed texts and a schedule derived from the
``events`` table by integer arithmetic, so that any engine computes the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def raw_pings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value")
    i, u, kind = F.col("event_id"), F.col("user_id"), F.col("event_type")
    # each event, and a replay of every tenth one right behind it
    e = e.withColumn("again", F.explode(F.when(i % 10 == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    zero, m = i % 97 == 0, u % 10
    grid = lambda base, a, b, n: (F.lit(base) + (i * a + u * b) % n * 5).cast("double") / F.lit(10000.0)
    route = F.when(kind == "signup", "U").when(u % 150 == 149, "99").when(m < 4, "12").when(m < 6, "47").when(m < 8, "91").when(m == 8, "39").otherwise("9")
    late = (kind == "error") & ((m < 4) | ((m < 6) & (i % 2 == 0)) | ((m >= 6) & (i % 4 == 0)))
    return e.select(
        "event_id", (2 * i + F.col("again")).alias("arrival_seq"), u.cast("string").alias("vid"),
        F.when(i % 17 == 5, F.col("ts") - F.expr("INTERVAL 2 DAYS")).otherwise(F.col("ts")).alias("timestamp"),
        F.when(zero, 0.0).otherwise(grid(299050, 37, 11, 160)).alias("lat"), F.when(zero, 0.0).otherwise(grid(-901450, 53, 29, 180)).alias("lon"),
        (i * 13 % 360).cast("int").alias("heading"), route.alias("route"),
        F.when(i % 11 == 0, "N/A").when(i % 13 == 0, F.lit(None)).otherwise(F.concat(F.lit("T"), u.cast("string"))).alias("trip_id"),
        kind.alias("destination"), (F.floor("value").cast("int") % 45).alias("speed"), late.alias("is_delayed"), (kind == "purchase").alias("is_off_route"),
        F.when(i % 7 == 0, F.lit(None)).otherwise((i % 5000).cast("int")).alias("pdist"), (u % 12).cast("int").alias("pid"), route.alias("rid"),
        F.concat(F.lit("B"), (u % 20).cast("string")).alias("tablockid"), F.lit(None).cast("string").alias("srvtmstmp"),
    )


def messages(spark: SparkSession, sf_dir: str, per_message: int = 50, damaged: bool = False) -> DataFrame:
    """The same pings as feed texts: (message_no, received_at, value).  ``damaged``: every
    40th text breaks off and some latitudes cannot be read."""
    r = raw_pings(spark, sf_dir)
    text = lambda c: F.col(c).cast("string")
    coord = lambda c: F.when(F.col(c) == 0.0, "0").otherwise(text(c))
    lat = F.when(F.col("event_id") % 89 == 1, "n/a").otherwise(coord("lat")) if damaged else coord("lat")
    v = F.struct(
        "arrival_seq", F.col("vid"), text("timestamp").alias("tmstmp"), lat.alias("lat"), coord("lon").alias("lon"), text("heading").alias("hdg"),
        F.col("route").alias("rt"), F.col("trip_id").alias("tatripid"), F.col("destination").alias("des"), text("speed").alias("spd"),
        F.col("is_delayed").alias("dly"), F.col("is_off_route").alias("or"), text("pdist").alias("pdist"), text("pid").alias("pid"), "rid", "tablockid", "srvtmstmp",
    )
    no = F.floor(F.col("arrival_seq") / per_message).cast("long")
    value = F.to_json(F.sort_array(F.collect_list(v)))
    out = r.groupBy(no.alias("message_no")).agg(F.max("timestamp").alias("received_at"), value.alias("value"))
    return out.withColumn("value", F.when(F.col("message_no") % 40 == 7, F.substring("value", 1, 100)).otherwise(F.col("value"))) if damaged else out


def stale_pings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw pings with a server time behind the vehicle's."""
    r = raw_pings(spark, sf_dir)
    later = F.col("timestamp") + F.make_dt_interval(secs=(F.col("event_id") % 400).cast("decimal(18,6)"))
    return r.withColumn("srvtmstmp", F.when(F.col("event_id") % 23 == 0, F.lit(None)).otherwise(later.cast("string")))


def write_schedule(spark: SparkSession, sf_dir: str, folder: str, stops: int = 11, distances: bool = True) -> None:
    """GTFS files: a trip a vehicle, a stop every 500 feet of its pattern, some of them
    after midnight of the service day.  Every fifth trip runs from Monday to Friday.
    Without ``distances`` the stops' places must come from their coordinates."""
    users = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id").distinct()
    u, k = F.col("user_id"), F.col("k")
    at = (u * 600) % 86400 + k * (120 + u % 7)
    two = lambda c: F.lpad(F.floor(c).cast("string"), 2, "0")
    clock = F.concat(two(F.col("at") / 3600), F.lit(":"), two(F.col("at") % 3600 / 60), F.lit(":"), two(F.col("at") % 60))
    put = lambda df, file: df.write.option("header", True).csv(f"{folder}/{file}.txt")
    trip = F.concat(F.lit("T"), u.cast("string")).alias("trip_id")
    rows = users.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(stops - 1)))).withColumn("at", at)
    dist = (k * 500 if distances else F.lit(None).cast("int")).alias("shape_dist_traveled")
    put(rows.select(trip, clock.alias("arrival_time"), clock.alias("departure_time"), F.concat(F.lit("S"), k.cast("string")).alias("stop_id"), k.alias("stop_sequence"), dist), "stop_times")
    service = F.when(u % 5 == 0, "weekdays").otherwise("daily").alias("service_id")
    put(users.select((u % 12).cast("string").alias("route_id"), service, trip, (u % 12).cast("string").alias("shape_id")), "trips")
    lines, places = spark.range(12).select(F.col("id").alias("s")), spark.range(stops).select(F.col("id").alias("k"))
    name = F.col("s").cast("string")
    put(lines.select(name.alias("route_id"), name.alias("route_short_name"), F.concat(F.lit("Route "), name).alias("route_long_name"), F.lit(3).alias("route_type")), "routes")
    points = lines.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(stops - 1))))
    put(points.select(name.alias("shape_id"), (29.9 + k * 0.002).alias("shape_pt_lat"), (-90.1 + F.col("s") * 0.00001).alias("shape_pt_lon"), k.alias("shape_pt_sequence"), (k * 500).alias("shape_dist_traveled")), "shapes")
    # a quarter of the way past its point, and some metres beside the line
    north = F.when(k < stops - 1, 0.0005).otherwise(0.0)
    put(places.select(F.concat(F.lit("S"), k.cast("string")).alias("stop_id"), F.concat(F.lit("Stop "), k.cast("string")).alias("stop_name"), (29.9 + k * 0.002 + north).alias("stop_lat"), F.lit(-90.0999).alias("stop_lon")), "stops")
    week = lambda sid, end: F.struct(F.lit(sid).alias("service_id"), *[F.lit(1 if d < 5 else end).alias(x) for d, x in enumerate("monday tuesday wednesday thursday friday saturday sunday".split())], F.lit("20240101").alias("start_date"), F.lit("20241231").alias("end_date"))
    put(spark.range(1).select(F.explode(F.array(week("weekdays", 0), week("daily", 1))).alias("c")).select("c.*"), "calendar")
