from __future__ import annotations

import json
import random
import re
import shutil
from collections import defaultdict
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from pingworks.operators import audits, clean, dedup, segments
from pingworks.sources import tables


def _messages(spark, texts):
    rows = [(i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "message_no long, value string")


def _ping(**kw):
    return {"vid": "v", "tmstmp": "2024-01-01 00:00:00", "lat": "29.95", "lon": "-90.07", "rt": "12"} | kw


def _clean(spark, *pings):
    parsed = clean.parse_messages(_messages(spark, [json.dumps(list(pings))]))
    return clean.clean(clean.explode_vehicles(parsed), ("pos",)).orderBy("pos").collect()


def test_malformed_messages_stay_alone(spark):
    parsed = clean.parse_messages(_messages(spark, ["no json", '{"vid": "a"}', json.dumps([_ping(vid="1"), None, _ping(vid="3")]), None]))
    assert [r.malformed for r in parsed.orderBy("message_no").collect()] == [True, True, False, True]
    assert [r.vid for r in clean.explode_vehicles(parsed).orderBy("pos").collect()] == ["1", "3"]


def test_scalar_rules(spark):
    rows = _clean(
        spark,
        _ping(lat="0", lon="0"), _ping(lat="0", lon="-90.1"), _ping(lat=""), _ping(lat="abc"), _ping(tmstmp="x"),
        _ping(hdg="12.7", spd="12abc", pdist=" 12", pid="x", des="", tatripid="", rid="", dly="true"),
        _ping(pdist="0", pid="-1", dly=True),
    )
    assert [r.status for r in rows] == ["invalid", "ok", "bad", "bad", "bad", "ok", "ok"]
    r = rows[5]
    assert (r.heading, r.speed, r.pdist, r.pid, r.destination, r.trip_id, r.rid, r.is_delayed) == (12, 12, 12, None, None, "", None, False)
    assert (rows[0].heading, rows[0].pdist, rows[6].pdist, rows[6].pid, rows[6].is_delayed) == (0, None, 0, -1, True)


@pytest.mark.parametrize("size", [1, 7, 50, 1000])
def test_dedup_is_the_sequential_algorithm(spark, size):
    """Whatever the blocks, in one run and in two with stored marks; a null vehicle is one."""
    rng = random.Random(4)
    rows = [(i, rng.choice(["v0", "v1", None]), rng.choice([None, *range(40)]), rng.random() < 0.8) for i in range(300)]
    marks, want = {}, {}
    for seq, vid, at, ok in rows:
        stale = at is not None and vid in marks and at <= marks[vid]
        want[seq] = "deduped" if stale else "kept" if ok else "invalid"
        if ok and not stale and at is not None:
            marks[vid] = at
    df = spark.createDataFrame(rows, "arrival_seq long, vid string, timestamp int, ok boolean")
    ok = F.col("ok")
    assert {r.arrival_seq: r.outcome for r in dedup.flagged(df, ok, size=size).collect()} == want
    old, new = df.filter("arrival_seq < 171"), df.filter("arrival_seq >= 171")
    stored = dedup.marks(old, ok)
    assert {r.arrival_seq: r.outcome for d in (dedup.flagged(old, ok, size=size), dedup.flagged(new, ok, stored=stored, size=size)) for r in d.collect()} == want
    assert {r.vid: r.mark for r in dedup.marks(new, ok, stored=stored).collect()} == marks


def test_one_vehicle_of_most_pings_is_split(spark):
    df = spark.range(20_000).selectExpr("id AS arrival_seq", "if(id % 100 = 7, 'cold', 'hot') AS vid", "cast(id % 1000 as int) AS timestamp")
    out = dedup.flagged(df, F.lit(True), size=500)
    plan = out._jdf.queryExecution().executedPlan().toString()
    windows = re.findall(r"Window \[.*?\], \[([^\]]*)\], \[[^\]]*\]", plan)
    assert len(windows) == 2 and all("__block" in w or "m_vid" in w for w in windows), windows
    kept = out.filter("outcome = 'kept'").groupBy("vid").count().collect()
    assert {r.vid: r["count"] for r in kept} == {"hot": 990, "cold": 10}


def test_first_box_wins_on_shared_edges(spark):
    rows = [(1, "12", 29.9495, -90.0750), (2, "47", 29.9495, -90.0750), (3, "12", 29.93, -90.10), (4, "12", 29.9150, -90.1050), (5, None, 29.95, -90.07)]
    df = spark.createDataFrame(rows, "arrival_seq long, route string, lat double, lon double")
    segs = segments.segments(spark)
    a = {r.arrival_seq: r.segment_id for r in segments.tag(df, segs).collect()}
    b = {r.arrival_seq: r.segment_id for r in segments.tag_by_join(df, segs).collect()}
    c = {r.arrival_seq: r.segment_id for r in segments.tag_by_cells(df, segs).collect()}
    assert a == b == c == {1: 1, 2: None, 3: None, 4: 4, 5: None}
    twice = df.unionByName(df).drop("arrival_seq")
    assert segments.tag_by_join(twice, segs).count() == 10  # equal pings stay apart


def test_many_boxes_go_by_cells(spark):
    rng = random.Random(6)
    boxes = []
    for i in range(30_000):
        y, x = rng.uniform(-1, 1), rng.uniform(-1, 1)
        boxes.append((i, rng.choice("AB"), f"n{i}", "t", y, y + rng.uniform(0, 0.03), x, x + rng.uniform(0, 0.03), 30_000 - i))
    segs = spark.createDataFrame(boxes, segments.SEGMENTS)
    pings = [(k, rng.choice(["A", "B", "C", None]), rng.uniform(-1.1, 1.1), rng.uniform(-1.1, 1.1)) for k in range(300)]
    pings += [(1000 + k, boxes[k][1], boxes[k][4], boxes[k][7]) for k in range(50)]  # on borders
    df = spark.createDataFrame(pings, "k long, route string, lat double, lon double")
    want = {k: min(((b[8], b[0]) for b in boxes if b[1] == r and b[4] <= y <= b[5] and b[6] <= x <= b[7]), default=(0, None))[1] for k, r, y, x in pings}
    out = segments.tag(df, segs)
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()
    assert {r.k: r.segment_id for r in out.collect()} == want


def test_gaps_against_every_pair(spark):
    rng = random.Random(9)
    at = sorted(1_700_000_000 + rng.choice([rng.randrange(3_000), 3_000 + rng.randrange(40) * 300]) for _ in range(80))
    df = spark.createDataFrame([(x,) for x in at] + [(None,)], "s long").select(F.timestamp_seconds("s").cast("timestamp_ntz").alias("ts"))
    got = sorted(r.gap_seconds for r in audits.feed_gaps(df).collect())
    assert got == sorted(b - a for a, b in zip(at, at[1:]) if b - a >= 300)


def test_distinct_pings_count_nulls(spark):
    df = spark.sql("SELECT * FROM VALUES ('a', timestamp_ntz'2024-01-01'), ('a', timestamp_ntz'2024-01-01'), (NULL, timestamp_ntz'2024-01-01') t(vid, timestamp)")
    r = audits.duplicate_rate(df).first()
    assert (r.total, r.distinct_pings, r.duplicates, r.duplicate_pct) == (3, 2, 1, 33.33)


def test_table_is_created_migrated_and_appended(spark):
    spark.sql("DROP TABLE IF EXISTS old_pings")
    spark.sql("CREATE TABLE old_pings (vid string, timestamp timestamp_ntz, event_date date) USING parquet PARTITIONED BY (event_date)")
    spark.sql("INSERT INTO old_pings VALUES ('a', timestamp_ntz'2024-01-01 00:00:00', date'2024-01-01')")
    assert tables.migrate(spark, "old_pings") == ["pdist", "pid", "rid", "tablockid", "srvtmstmp"]
    assert tables.migrate(spark, "old_pings") == []
    assert spark.table("old_pings").first().pdist is None
    spark.sql("DROP TABLE IF EXISTS pings")
    tables.create(spark, "pings")
    tables.create(spark, "pings")
    tables.append(tables.widen(spark.table("old_pings").drop("event_date")), "pings")
    assert [(r.vid, str(r.event_date)) for r in spark.table("pings").collect()] == [("a", "2024-01-01")]


def test_gold_tables(spark, tmp_path):
    tables.refresh_gold({"x": spark.range(3).toDF("n")}, str(tmp_path))
    tables.refresh_gold({"x": spark.range(4).toDF("n")}, str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/x").count() == 4


def test_partials_of_changed_days_only(spark, tmp_path):
    from conftest import SMALL

    from pingworks.operators import gold, reports
    from pingworks.plans import queries

    t, path, root = queries.stored(spark, SMALL), f"{tmp_path}/t", f"{tmp_path}/g"
    own = [c for c in t.columns if c != "event_date"]
    tables.append_path(t.filter("event_date < date'2024-01-28'").select(*own), path)
    first = gold.refresh(spark, path, root)
    assert len(first) > 20 and gold.refresh(spark, path, root) == []
    tables.append_path(t.filter("event_date = date'2024-01-28'").select(*own), path)
    tables.append_path(t.filter("event_date = date'2024-01-05'").limit(3).select(*own), path)  # late rows of an old day
    assert gold.refresh(spark, path, root) == ["2024-01-05", "2024-01-28"]
    whole = tables.read_path(spark, path)
    for name, got in gold.read(spark, root).items():
        want = reports.ALL[name](whole)
        assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect())), name
    # a day that loses all its files leaves the reports; rows without a time are a day of their own
    shutil.rmtree(f"{path}/event_date=2024-01-05")
    tables.append_path(t.filter("event_date = date'2024-01-06'").limit(40).withColumn("timestamp", F.lit(None).cast("timestamp_ntz")).select(*own), path)
    assert gold.refresh(spark, path, root) == ["2024-01-05", gold.NO_DAY]
    whole = tables.read_path(spark, path)
    assert whole.filter("event_date is null").count() == 40 and whole.filter("event_date = date'2024-01-05'").isEmpty()
    for name, got in gold.read(spark, root).items():
        want = reports.ALL[name](whole)
        assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect())), name
    assert gold.refresh(spark, path, root) == []


def test_audits_take_a_time_and_prune_days(spark):
    from conftest import SMALL

    from pingworks.plans import queries

    t = queries.stored(spark, SMALL)
    now = F.current_timestamp().cast("timestamp_ntz")
    for audit in (audits.pings_per_segment, audits.pings_per_segment_type, audits.null_segment_clusters):
        assert audit(t, as_of=now).count() == 0  # the table is of the past
    assert audits.null_segment_coverage(t, as_of=now).first().total == 0
    at = F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")
    found = audits.pings_per_segment(t, as_of=at)
    assert re.search(r"PartitionFilters: \[[^\]]*event_date", found._jdf.queryExecution().executedPlan().toString())
    assert sum(r.pings for r in found.collect()) == t.filter("route = '12' and timestamp >= timestamp_ntz'2024-01-13 00:00:00'").count()


def test_a_large_day_is_written_by_several_tasks(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "20000")
    try:
        rows = spark.range(60_000).selectExpr("cast(id % 500 as string) AS vid", "timestamp_ntz'2024-01-01 00:00:00' AS timestamp", "cast(id as double) AS lat", "'12' AS route", "cast(id as int) AS heading")
        tables.append_path(rows, f"{tmp_path}/t")
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    back = tables.read_path(spark, f"{tmp_path}/t")
    assert back.count() == 60_000 and len(back.inputFiles()) > 1


def test_schedule_edges(spark, tmp_path):
    from pingworks.operators import schedule
    from pingworks.sources import gtfs

    clocks = spark.createDataFrame([("25:10:05",), ("07:00:00",), ("x",), (None,), ("",)], "c string")
    assert [r.s for r in clocks.select(gtfs.service_seconds(F.col("c")).alias("s")).collect()] == [90605, 25200, None, None, None]
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "stop_times.txt").write_text("stop_id,trip_id,arrival_time,stop_sequence,shape_dist_traveled\nA,t,23:59:00,1,0\nB,t,24:01:00,2,100\nC,t,,3,200\n")
    gtfs.load(spark, str(tmp_path / "f"), str(tmp_path / "g"), "1", ("stop_times",))
    gtfs.load(spark, str(tmp_path / "f"), str(tmp_path / "g"), "2", ("stop_times",))
    times = gtfs.table(spark, str(tmp_path / "g"), "stop_times", "2")
    assert times.count() == 3
    pings = spark.sql("SELECT * FROM VALUES ('t', 50, timestamp_ntz'2024-01-02 00:00:30'), ('t', 100, timestamp_ntz'2024-01-02 00:01:00'), ('t', -1, timestamp_ntz'2024-01-02 00:00:00'), ('N/A', 5, timestamp_ntz'2024-01-02 00:00:00'), (NULL, 5, NULL), ('t', NULL, NULL) p(trip_id, pdist, timestamp)")
    got = schedule.deviation(schedule.place(pings, times)).collect()
    assert [(r.from_stop, r.to_stop, r.scheduled_s, r.deviation_s) for r in got] == [("A", "B", 86400.0, 30.0)]


@pytest.mark.parametrize("size", [0, 4000])
def test_staleness_selects_what_percentiles_give(spark, size):
    rng = random.Random(size)
    rows = []
    for _ in range(size):
        at = datetime(2024, 1, 1) + timedelta(seconds=rng.randrange(90_000))
        behind = timedelta(seconds=rng.choice([rng.randrange(-50, 100_000), 7, 300]))
        # half of all pings are of one route
        rows.append((rng.choice(["hot", "hot", "b", None]), at, rng.choice([str(at + behind)] * 9 + [None, "no time"])))
    rows.append(("one", datetime(2024, 1, 1), "2024-01-01 00:05:00"))
    t = spark.createDataFrame(rows, "route string, timestamp timestamp_ntz, srvtmstmp string")
    seen = defaultdict(list)
    for route, at, server in rows:
        if server not in (None, "no time"):
            seen[route].append(int((datetime.fromisoformat(server) - at).total_seconds()))
    got = {r.route: r for r in audits.staleness(t).collect()}
    assert got.keys() == seen.keys()
    for route, s in seen.items():
        r = got[route]
        assert (r.pings, r.stale) == (len(s), sum(x >= 300 for x in s))
        for value, want in ((r.avg_s, np.mean(s)), (r.median_s, np.quantile(s, 0.5)), (r.p90_s, np.quantile(s, 0.9))):
            assert value == pytest.approx(want, abs=0.0051)
