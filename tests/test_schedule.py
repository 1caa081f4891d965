from __future__ import annotations

import random

import numpy as np
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from pingworks.operators import quantiles, schedule, shapes
from pingworks.plans import queries
from pingworks.sources import gtfs


@pytest.mark.parametrize("bits", [0, 3, 12])
def test_selected_quantiles_are_the_percentiles(spark, bits):
    rng = random.Random(bits)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, rng.randrange(-9000, 9000), 7])) for _ in range(2000)] + [("one", -5), ("two", 1), ("two", 4)]
    df = spark.createDataFrame(rows, "k string, v long")
    counts = quantiles.counted(df, ["k"], "v")
    for p in (0.0, 0.5, 0.9, 1.0):
        want = {r.k: r.q for r in df.filter("v is not null").groupBy("k").agg(F.percentile("v", F.lit(p)).alias("q")).collect()}
        got = {r.k: r.quantile for r in quantiles.select(counts, ["k"], "v", p, bits).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)
    many = {"a": 0.1, "b": 0.5, "c": 0.5, "d": 1.0}
    want = {r.k: r[1:] for r in df.filter("v is not null").groupBy("k").agg(*[F.percentile("v", F.lit(p)).alias(n) for n, p in many.items()]).collect()}
    got = {r.k: r[1:] for r in quantiles.select_many(counts, ["k"], "v", many, bits).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], atol=1e-6) for k in want)


def test_stops_on_a_line_that_crosses_itself():
    # east, north, back west over the start's meridian: the crossing is passed twice
    lat, lon = [0.0, 0.0, 0.01, 0.01, -0.01], [0.0, 0.02, 0.02, 0.01, 0.01]
    unit = 0.01 * shapes.METRES
    got = shapes.along([0.0, 0.0, 0.0005, 0.0], [0.001, 0.01, 0.02, 0.01], lat, lon, [np.nan] * 5, 200)
    assert np.allclose(got / unit, [0.1, 1.0, 2.05, 5.0], atol=1e-3)
    # in the other order the first stop at the crossing is the second pass, and none may follow before it
    got = shapes.along([0.0, 0.0], [0.01, 0.0102], lat, lon, [np.nan] * 5, 200)
    assert got[0] / unit == pytest.approx(1.0, abs=1e-3) and got[1] > got[0]
    far = shapes.along([0.0, 5.0], [0.0, 5.0], lat, lon, [0, 1, 2, 3, 4], 200)
    assert far[0] == 0 and np.isnan(far[1])
    assert np.isnan(shapes.along([0.0], [0.0], [0.0], [0.0], [1.0], 200)).all()


def test_distances_are_filled_and_the_rest_counted(spark):
    of = queries.schedule_files(spark, SMALL)
    bare = of("stop_times").withColumn("shape_dist_traveled", F.when(F.col("trip_id") != "T3", F.col("shape_dist_traveled")))
    bare = bare.unionByName(bare.filter("trip_id = 'T3'").limit(1).withColumn("trip_id", F.lit("nowhere")))
    filled = shapes.fill_distances(bare, of("trips"), of("stops"), of("shapes"))
    got = {(r.trip_id, r.stop_sequence): r.shape_dist_traveled for r in filled.collect()}
    assert len(got) == bare.count() and got["T3", 0] == pytest.approx(125, abs=0.1) and got["T3", 10] == pytest.approx(5000, abs=0.1) and got["T4", 3] == 1500
    assert {r.trip_id: (r.stops, r.left_out) for r in schedule.unplaceable(filled).collect()} == {"nowhere": (1, 1)}


def test_service_days_over_midnight(spark):
    calendar = spark.createDataFrame([("wk", 1, 1, 1, 1, 1, 0, 0, "20240101", "20240112"), ("bad", 1, 1, 1, 1, 1, 1, 1, "x", None)], "service_id string, monday int, tuesday int, wednesday int, thursday int, friday int, saturday int, sunday int, start_date string, end_date string")
    assert gtfs.service_days(calendar).count() == 10
    trips = spark.createDataFrame([("t", "wk"), ("u", "none"), ("v", "bad")], "trip_id string, service_id string")
    times = spark.createDataFrame([(t, k, f"s{k}", 100.0 * k, 86000 + 600 * k) for t in ("t", "u", "v") for k in range(3)], "trip_id string, stop_sequence int, stop_id string, shape_dist_traveled double, arrival_s int")
    # Saturday 00:05 is Friday's service; Friday 00:05 is Thursday's; Monday 00:05 would be Sunday's, which does not run
    pings = spark.sql("SELECT trip_id, 50 AS pdist, timestamp FROM VALUES ('t', timestamp_ntz'2024-01-06 00:05:00'), ('t', timestamp_ntz'2024-01-05 00:05:00'), ('t', timestamp_ntz'2024-01-08 00:05:00'), ('u', timestamp_ntz'2024-01-05 00:05:00'), ('v', timestamp_ntz'2024-01-05 00:05:00') p(trip_id, timestamp)")
    rows = schedule.on_service_day(schedule.place(pings, times), gtfs.services(trips, calendar)).collect()
    got = {(r.trip_id, str(r.timestamp)[:10]): (str(r.service_day), r.deviation_s) for r in rows}
    late = 86400 + 300 - 86300.0
    assert got["t", "2024-01-06"] == ("2024-01-05", late) and got["t", "2024-01-05"] == ("2024-01-04", late)
    assert got["t", "2024-01-08"] == ("2024-01-08", late - 86400) and got["u", "2024-01-05"] == ("None", None) == got["v", "2024-01-05"]


def test_versions_of_a_file(spark):
    old = spark.createDataFrame([("a", "x", None), ("b", "y", 1), ("c", "z", 2)], "route_id string, name string, kind int")
    new = spark.createDataFrame([("a", "x", None), ("b", "y", 2), ("d", "z", 2)], "route_id string, name string, kind int")
    assert {r.route_id: r.change for r in gtfs.changes(old, new, ["route_id"]).collect()} == {"b": "changed", "c": "removed", "d": "added"}


def test_crossings_between_pings_and_days(spark):
    rows = [("v", "t", "12", 0, "2024-01-01 10:00:00"), ("v", "t", "12", 300, "2024-01-01 10:03:00"), ("v", "t", "12", 250, "2024-01-01 10:04:00"), ("v", "t", "12", 450, "2024-01-01 10:06:00"),
            ("v", "t", "12", 900, "2024-01-02 10:00:00"), ("v", "t", "12", None, "2024-01-02 10:01:00")]
    df = spark.createDataFrame(rows, "vid string, trip_id string, route string, pdist int, at string").withColumn("timestamp", F.col("at").cast("timestamp_ntz")).withColumn("event_date", F.to_date("timestamp"))
    got = {(r.from_mark, r.to_mark): r.seconds for r in schedule.segment_run_times(df, [100, 200, 400, 800]).collect()}
    # 100 and 200 lie on the first hop, 400 on the hop from 250 (10:04) to 450; none on the night
    assert got == {(100, 200): 60.0, (200, 400): 210.0}
    assert {(r.from_pdist, r.to_pdist) for r in schedule.run_times(df).collect()} == {(0, 300), (250, 450)}


def test_a_mark_passed_twice_names_the_smallest_route(spark):
    rows = [("v", "t", r, d, f"2024-01-01 10:0{m}:00") for m, (r, d) in enumerate([("U", 0), ("U", 300), ("12", 50), ("12", 250)])]
    df = spark.createDataFrame(rows, "vid string, trip_id string, route string, pdist int, at string").withColumn("timestamp", F.col("at").cast("timestamp_ntz")).withColumn("event_date", F.to_date("timestamp"))
    # first passed at 10:00:20 and 10:00:40 as U, again on the third hop as 12
    got = [(r.route, r.from_mark, r.to_mark, r.seconds) for r in schedule.segment_run_times(df, [100, 200]).collect()]
    assert got == [("12", 100, 200, 20.0)]
