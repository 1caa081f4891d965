from __future__ import annotations

import json
import os

from pingworks.operators import dedup, segments
from pingworks.plans.queries import valid
from pingworks.plans.registry import QUERIES
from pingworks import fixtures as events
from pingworks.sources import versions
from pingworks.streaming import ingest

from conftest import SMALL


def _land(rows, path, name, at):
    os.makedirs(path, exist_ok=True)
    file = f"{path}/{name}"
    with open(file, "w") as f:
        for r in rows:
            f.write(json.dumps({"message_no": r.message_no, "received_at": str(r.received_at), "value": r.value}) + "\n")
    os.utime(file, (at, at))


def test_stream_equals_batch_over_a_restart(spark, tmp_path):
    rows = events.messages(spark, SMALL).orderBy("message_no").collect()
    landing, table, check = f"{tmp_path}/landing", f"{tmp_path}/table", f"{tmp_path}/check"
    segs = segments.segments(spark)
    n = len(rows) // 3
    for k, part in enumerate((rows[:n], rows[n : 2 * n], rows[2 * n :])):  # three runs, one checkpoint
        _land(part, landing, f"{k}.json", 1_700_000_000 + k)
        q = ingest.start(ingest.read_landing(spark, landing, 1), segs, table, check, merge_at=2)
        q.awaitTermination(120)
        assert q.exception() is None
    got = versions.read(spark, table)
    assert versions.current(spark, table).batch == 2 and len(versions.current(spark, table).folders) == 1
    want = segments.tag(dedup.dedup(events.raw_pings(spark, SMALL), valid()), segs)
    cols = ["vid", "timestamp", "lat", "lon", "route", "speed", "segment_id"]
    key = lambda df: sorted(tuple(map(str, r)) for r in df.select(*cols).collect())
    assert key(got) == key(want) and got.count() == 933


def test_dry_run_writes_nothing(spark, tmp_path):
    _land(events.messages(spark, SMALL).limit(3).collect(), f"{tmp_path}/l", "a.json", 1_700_000_000)
    q = ingest.dry_run(ingest.read_landing(spark, f"{tmp_path}/l"), segments.segments(spark), f"{tmp_path}/c")
    q.awaitTermination(60)
    assert q.exception() is None
    kept = [p.observedMetrics["ingest"].kept for p in q.recentProgress if "ingest" in p.observedMetrics]
    want = dedup.dedup(events.raw_pings(spark, SMALL).filter("arrival_seq < 150"), valid()).count()
    assert sum(kept) == want


def test_quarantine_keeps_what_ingest_cannot_use(spark, tmp_path):
    rows = events.messages(spark, SMALL, damaged=True).orderBy("message_no").collect()
    for k, part in enumerate((rows[:9], rows[9:])):  # two runs, one checkpoint
        _land(part, f"{tmp_path}/l", f"{k}.json", 1_700_000_000 + k)
        for start, name in ((ingest.start_quarantine, "q"), (lambda m, *x, **k: ingest.start(m, segments.segments(spark), *x, **k), "t")):
            q = start(ingest.read_landing(spark, f"{tmp_path}/l", 1), f"{tmp_path}/{name}", f"{tmp_path}/c{name}", metrics=f"{tmp_path}/m")
            q.awaitTermination(120)
            assert q.exception() is None
    counted = {r.outcome: r["sum(pings)"] for r in ingest.counters(spark, f"{tmp_path}/m").groupBy("outcome").sum("pings").collect()}
    whole = QUERIES["ingest_counters"](spark, SMALL).first()
    assert counted == {k: whole[k] for k in ("kept", "deduped", "invalid", "malformed", "bad")}
    got = spark.read.parquet(f"{tmp_path}/q").collect()
    want = QUERIES["quarantine"](spark, SMALL).collect()
    assert sorted((r.message_no, -1 if r.pos is None else r.pos, r.reason) for r in got) == sorted((r.message_no, -1 if r.pos is None else r.pos, r.reason) for r in want)
    texts = {r.message_no: r.value for r in rows}
    assert {r.reason for r in got} == {"malformed", "bad"} and all(r.payload == texts[r.message_no] for r in got if r.reason == "malformed")


def test_flush_interval_runs_until_stopped(spark, tmp_path):
    _land(events.messages(spark, SMALL).limit(3).collect(), f"{tmp_path}/l", "a.json", 1_700_000_000)
    q = ingest.start(ingest.read_landing(spark, f"{tmp_path}/l"), segments.segments(spark), f"{tmp_path}/t", f"{tmp_path}/c", every="1 second")
    q.processAllAvailable()
    assert q.isActive and versions.read(spark, f"{tmp_path}/t").count() > 0
    q.stop()


def _folder(spark, n, day):
    return spark.range(n).selectExpr("cast(id as string) AS vid", f"timestamp_ntz'2024-01-{day:02d} 00:00:00' AS timestamp", "'12' AS route", "cast(id as int) AS heading")


def test_batches_enter_once_and_merge_safely(spark, tmp_path):
    root = f"{tmp_path}/t"
    assert versions.read(spark, root).count() == 0
    for k in range(6):
        assert versions.append_batch(_folder(spark, 10 + k, 1 + k % 2), root, k)
    assert not versions.append_batch(_folder(spark, 99, 1), root, 3)  # a replay
    rows = lambda: sorted(map(str, versions.read(spark, root).collect()))
    before, reader = rows(), versions.read(spark, root)
    assert len(before) == 75
    # a merge that breaks off before its manifest leaves the table as it is
    real = versions.commit
    versions.commit = lambda *a: (_ for _ in ()).throw(RuntimeError("lost"))
    try:
        versions.merge(spark, root, 2)
    except RuntimeError:
        pass
    finally:
        versions.commit = real
    assert rows() == before and len(versions.current(spark, root).folders) == 6
    # two merges of the same folders: one wins, the other changes nothing
    old = versions.current(spark, root)
    assert versions.merge(spark, root, 2) and rows() == before
    assert not versions.commit(spark, root, versions.Manifest(old.version + 1, (), 9)) and rows() == before
    files = versions.files_a_day(versions.read(spark, root)).collect()
    assert {r.files for r in files} == {1} and len(files) == 2
    assert versions.append_batch(_folder(spark, 5, 3), root, 6) and len(rows()) == 80
    assert sorted(map(str, reader.collect())) == before  # a reader that began before the merge
    assert versions.sweep(spark, root) == []
    gone = versions.sweep(spark, root, older_s=-60)  # 6 batches and the merge that broke off
    assert len(gone) == 7 and len(rows()) == 80


def test_silence_raises_an_alarm_and_ends(spark, tmp_path):
    import time

    from pingworks.streaming import silence

    rows = events.messages(spark, SMALL).orderBy("message_no").limit(6).collect()
    _land(rows[:3], f"{tmp_path}/l", "a.json", 1_700_000_000)
    out = silence.alarms(ingest.read_landing(spark, f"{tmp_path}/l"), least_s=3)
    q = out.writeStream.format("memory").queryName("alarms").option("checkpointLocation", f"{tmp_path}/c").trigger(processingTime="500 milliseconds").start()
    try:
        def wait(n):
            end = time.time() + 60
            while spark.table("alarms").count() < n and time.time() < end:
                assert q.exception() is None
                time.sleep(0.5)
            return spark.table("alarms").collect()

        assert [r.feed for r in wait(1)] == ["vehicles"]
        _land(rows[3:], f"{tmp_path}/l", "b.json", 1_700_000_001)
        got = wait(2)
        assert len(got) == 2 and all(r.silent_s >= 3 for r in got)
        assert str(max(r.last_received for r in got)) == str(max(r.received_at for r in rows))
    finally:
        q.stop()
