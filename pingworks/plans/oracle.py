"""The same results in an independent engine's SQL."""

from __future__ import annotations

from pingworks.schemas import SEGMENT_ROWS

_SEGMENTS = ",\n    ".join(
    f"({i}, '{r}', '{n}', '{t}', " + ", ".join(f"CAST({x} AS DOUBLE)" for x in box) + ")" for i, r, n, t, *box in (row[:8] for row in SEGMENT_ROWS)
)

_RAW = """raw AS (
  SELECT event_id, 2 * event_id + again AS arrival_seq, CAST(user_id AS VARCHAR) AS vid,
    CASE WHEN event_id % 17 = 5 THEN ts - INTERVAL 2 DAY ELSE ts END AS timestamp,
    CASE WHEN event_id % 97 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(299050 + ((event_id * 37 + user_id * 11) % 160) * 5 AS DOUBLE) / CAST(10000 AS DOUBLE) END AS lat,
    CASE WHEN event_id % 97 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(-901450 + ((event_id * 53 + user_id * 29) % 180) * 5 AS DOUBLE) / CAST(10000 AS DOUBLE) END AS lon,
    CAST((event_id * 13) % 360 AS INTEGER) AS heading,
    CASE WHEN event_type = 'signup' THEN 'U' WHEN user_id % 150 = 149 THEN '99' WHEN user_id % 10 < 4 THEN '12'
      WHEN user_id % 10 < 6 THEN '47' WHEN user_id % 10 < 8 THEN '91' WHEN user_id % 10 = 8 THEN '39' ELSE '9' END AS route,
    CASE WHEN event_id % 11 = 0 THEN 'N/A' WHEN event_id % 13 = 0 THEN NULL ELSE 'T' || user_id END AS trip_id,
    event_type AS destination, CAST(floor(value) AS INTEGER) % 45 AS speed,
    event_type = 'error' AND (user_id % 10 < 4 OR (user_id % 10 < 6 AND event_id % 2 = 0) OR (user_id % 10 >= 6 AND event_id % 4 = 0)) AS is_delayed,
    event_type = 'purchase' AS is_off_route,
    CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(event_id % 5000 AS INTEGER) END AS pdist,
    CAST(user_id % 12 AS INTEGER) AS pid, 'B' || (user_id % 20) AS tablockid
  FROM events CROSS JOIN (VALUES (0), (1)) AS r(again)
  WHERE again = 0 OR event_id % 10 = 3
)"""
_KEPT = """marked AS (
  SELECT *, NOT (lat = 0 AND lon = 0) AS valid,
    max(CASE WHEN NOT (lat = 0 AND lon = 0) THEN timestamp END)
      OVER (PARTITION BY vid ORDER BY arrival_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mark
  FROM raw
), kept AS (
  SELECT * EXCLUDE (valid, mark) FROM marked WHERE valid AND (mark IS NULL OR timestamp > mark)
)"""
_TAGGED = f"""segs(id, route, name, type, min_lat, max_lat, min_lon, max_lon) AS (
  VALUES {_SEGMENTS}
), t AS (
  SELECT k.*, s.id AS segment_id, s.name AS segment_name, s.type AS segment_type
  FROM kept k LEFT JOIN segs s ON k.route = s.route AND k.lat BETWEEN s.min_lat AND s.max_lat AND k.lon BETWEEN s.min_lon AND s.max_lon
  QUALIFY row_number() OVER (PARTITION BY k.arrival_seq ORDER BY s.id) = 1
)"""
_T = f"WITH {_RAW}, {_KEPT}, {_TAGGED}"
_DELAYED = "CAST(sum(CASE WHEN is_delayed THEN 1 ELSE 0 END) AS BIGINT)"
_LATE = f"CAST(100 AS DOUBLE) * {_DELAYED} / count(*)"
_ON_TIME = f"round(CAST(100 AS DOUBLE) - {_LATE}, 2) AS on_time_pct"
_PCT = f"round({_LATE}, 2) AS delay_pct"
_MAIN = "route = '12' AND segment_type IS NOT NULL"
_DAY = "CAST(date_trunc('day', timestamp) AS TIMESTAMP)"
_RECENT = "timestamp >= (SELECT max(timestamp) FROM t) - INTERVAL 7 DAY AND route = '12'"
_SERVICE = f"{_RECENT} AND route <> 'U' AND trip_id IS NOT NULL AND trip_id <> 'N/A'"
_COLS = "arrival_seq, vid, timestamp, lat, lon, route, trip_id, speed, is_delayed"
_SEGTYPES = f"SELECT segment_type, count(*) AS readings, {_DELAYED} AS delayed, {_PCT}, round(avg(speed), 1) AS avg_speed FROM t WHERE {_MAIN} GROUP BY segment_type"
_DAYSEGS = f"SELECT {_DAY} AS date, segment_type, count(*) AS readings, {_ON_TIME}, round(avg(speed), 2) AS avg_speed FROM t WHERE {_MAIN} GROUP BY ALL"
_ROUTES = f"SELECT route, count(*) AS readings, {_DELAYED} AS delayed, {_PCT}, {_ON_TIME}, round(avg(speed), 1) AS avg_speed FROM t WHERE route <> 'U' GROUP BY route HAVING count(*) > 100"
_PLACE = "arrival_seq // 50 AS message_no, row_number() OVER (PARTITION BY arrival_seq // 50 ORDER BY arrival_seq) - 1 AS pos"


def _daily_routes(where: str) -> str:
    return f"{_T} SELECT {_DAY} AS date, route, count(*) AS readings, {_ON_TIME}, round(avg(speed), 2) AS avg_speed FROM t WHERE {where} GROUP BY ALL HAVING count(*) > 50"


def _filled(where: str, late: str) -> str:
    cols = {"pdist": "pdist", "pid": "pid", "rid": "route", "tablockid": "tablockid"}
    counts = ", ".join(f"count(CASE WHEN {late} THEN {v} END) AS with_{k}" for k, v in cols.items())
    return f"{_T} SELECT route, count(*) AS pings, {counts}, CAST(0 AS BIGINT) AS with_srvtmstmp FROM t WHERE {where} GROUP BY route"


_STOPS = """stops AS (
  SELECT 'T' || user_id AS trip_id, CAST(user_id % 12 AS VARCHAR) AS route_id, 'S' || k AS stop_id, k AS stop_sequence, 500 * k AS dist,
    (user_id * 600) % 86400 + k * (120 + user_id % 7) AS arrival_s
  FROM (SELECT DISTINCT user_id FROM events) CROSS JOIN range(0, 11) AS r(k)
)"""
_PLACED = f"""{_STOPS}, placed AS (
  SELECT t.*, a.stop_id AS from_stop, b.stop_id AS to_stop, a.arrival_s + CAST(t.pdist - a.dist AS DOUBLE) / 500 * (b.arrival_s - a.arrival_s) AS scheduled_s
  FROM t JOIN stops a ON t.trip_id = a.trip_id AND t.pdist >= a.dist AND t.pdist < a.dist + 500 JOIN stops b ON b.trip_id = a.trip_id AND b.stop_sequence = a.stop_sequence + 1
), late AS (
  SELECT *, extract(hour FROM timestamp) * 3600 + extract(minute FROM timestamp) * 60 + floor(extract(second FROM timestamp)) - scheduled_s AS d FROM placed
), dev AS (
  SELECT *, d - 86400 * floor((d + 43200) / 86400) AS deviation_s FROM late
)"""
_DAMAGED = f"""WITH {_RAW}, placed AS (SELECT *, {_PLACE} FROM raw), whole AS (SELECT * FROM placed WHERE message_no % 40 <> 7),
  fine AS (SELECT *, NOT (lat = 0 AND lon = 0) AS valid FROM whole WHERE event_id % 89 <> 1),
  marked AS (SELECT *, max(CASE WHEN valid THEN timestamp END) OVER (PARTITION BY vid ORDER BY arrival_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mark FROM fine)"""

ORACLES = {
    "parse_payload": f"WITH {_RAW} SELECT {_PLACE}, vid, timestamp AS tmstmp, route AS rt, is_delayed AS dly, CAST(speed AS VARCHAR) AS spd FROM raw",
    "clean_pings": f"""WITH {_RAW}, placed AS (SELECT *, {_PLACE} FROM raw)
      SELECT message_no, pos, vid, timestamp, lat, lon, heading, route, trip_id, destination, speed, is_delayed, is_off_route, pdist, pid, route AS rid, tablockid,
        CAST(NULL AS VARCHAR) AS srvtmstmp FROM placed WHERE NOT (lat = 0 AND lon = 0)""",
    "dedup_pings": f"WITH {_RAW}, {_KEPT} SELECT {_COLS} FROM kept",
    "dedup_incremental": f"WITH {_RAW}, {_KEPT} SELECT {_COLS} FROM kept",
    "tag_segments": f"{_T} SELECT {_COLS}, segment_id, segment_name, segment_type FROM t",
    "tag_segments_join": f"{_T} SELECT {_COLS}, segment_id, segment_name, segment_type FROM t",
    "summary": f"{_T} SELECT count(*) AS total_records, count(DISTINCT route) AS total_routes, count(DISTINCT vid) AS total_vehicles, min(timestamp) AS first_record, max(timestamp) AS last_record FROM t",
    "segment_types": f"{_T} {_SEGTYPES}",
    "segments": f"{_T} SELECT segment_name, segment_type, count(*) AS readings, {_PCT}, round(avg(speed), 1) AS avg_speed FROM t WHERE route = '12' AND segment_name IS NOT NULL GROUP BY ALL",
    "routes": f"{_T} {_ROUTES}",
    "hourly": f"{_T} SELECT CAST(extract(hour FROM timestamp) AS BIGINT) AS hour, segment_type, {_PCT}, round(avg(speed), 1) AS avg_speed FROM t WHERE {_MAIN} GROUP BY ALL",
    "daily": f"{_T} SELECT {_DAY} AS date, count(*) AS readings, count(DISTINCT vid) AS vehicles, {_DELAYED} AS delayed, {_ON_TIME}, round(avg(speed), 2) AS avg_speed FROM t GROUP BY ALL",
    "daily_routes": _daily_routes("route <> 'U'"),
    "daily_routes_one": _daily_routes("route = '12'"),
    "daily_segments": f"{_T} {_DAYSEGS}",
    "mixed_vs_dedicated": f"{_T} SELECT segment_type, count(*) AS readings, {_PCT}, round(avg(speed), 1) AS avg_speed FROM t WHERE {_MAIN} GROUP BY ALL",
    "duplicate_rate": f"""WITH {_RAW}, r AS (SELECT vid, timestamp FROM raw WHERE timestamp >= (SELECT max(timestamp) FROM raw) - INTERVAL 7 DAY),
      c AS (SELECT (SELECT count(*) FROM r) AS total, (SELECT count(*) FROM (SELECT DISTINCT vid, timestamp FROM r)) AS distinct_pings)
      SELECT total, distinct_pings, total - distinct_pings AS duplicates,
        CASE WHEN total > 0 THEN round(CAST(100 AS DOUBLE) * (total - distinct_pings) / total, 2) ELSE CAST(0 AS DOUBLE) END AS duplicate_pct FROM c""",
    "pings_per_segment": f"{_T} SELECT segment_id, segment_name, count(*) AS pings FROM t WHERE {_RECENT} GROUP BY ALL",
    "pings_per_segment_type": f"{_T} SELECT segment_type, count(*) AS pings FROM t WHERE {_RECENT} GROUP BY ALL",
    "null_segment_coverage": f"""{_T} SELECT count(*) AS total, count(*) FILTER (WHERE segment_id IS NULL) AS null_segments,
      CASE WHEN count(*) > 0 THEN round(CAST(100 AS DOUBLE) * count(*) FILTER (WHERE segment_id IS NULL) / count(*), 2) ELSE CAST(0 AS DOUBLE) END AS null_pct FROM t WHERE {_SERVICE}""",
    "null_segment_clusters": f"{_T} SELECT round(lat, 3) AS lat, round(lon, 3) AS lon, count(*) AS pings FROM t WHERE {_SERVICE} AND segment_id IS NULL GROUP BY 1, 2 ORDER BY pings DESC, 1, 2 LIMIT 25",
    "headline_kpis": f"""{_T}, s AS ({_SEGTYPES}), k AS (
      SELECT max(CASE WHEN segment_type = 'dedicated_row' THEN avg_speed END) AS dedicated_speed, max(CASE WHEN segment_type = 'mixed_traffic' THEN avg_speed END) AS mixed_speed,
        max(CASE WHEN segment_type = 'mixed_traffic' THEN delay_pct END) AS mixed_delay_pct FROM s)
      SELECT *, round(coalesce(dedicated_speed, 0) / CASE WHEN coalesce(mixed_speed, 0) = 0 THEN CAST(1 AS DOUBLE) ELSE mixed_speed END, 1) AS speed_ratio FROM k""",
    "data_range": f"""{_T}, h AS (SELECT CAST(floor(CAST(date_diff('microsecond', min(timestamp), max(timestamp)) // 1000000 AS DOUBLE) / 3600 + CAST(0.5 AS DOUBLE)) AS BIGINT) AS hours FROM t)
      SELECT hours, CASE WHEN hours >= 48 THEN CAST(CAST(floor(CAST(hours AS DOUBLE) / 24 + CAST(0.5 AS DOUBLE)) AS BIGINT) AS VARCHAR) || ' days' ELSE CAST(hours AS VARCHAR) || 'h' END AS label FROM h""",
    "segment_speed_pivot": f"""{_T}, d AS ({_DAYSEGS}) SELECT date, max(CASE WHEN segment_type = 'dedicated_row' THEN avg_speed END) AS dedicated_speed,
      max(CASE WHEN segment_type = 'mixed_traffic' THEN avg_speed END) AS mixed_speed FROM d GROUP BY date""",
    "route_bands": f"{_T}, r AS ({_ROUTES}) SELECT route, on_time_pct, CASE WHEN on_time_pct >= 90 THEN 'green' WHEN on_time_pct >= 80 THEN 'yellow' ELSE 'red' END AS band FROM r",
    "segment_labels": f"{_T}, s AS ({_SEGTYPES}) SELECT segment_type, CASE WHEN segment_type = 'dedicated_row' THEN 'Dedicated ROW' ELSE 'Mixed Traffic' END AS label, readings FROM s",
    "feed_gaps": """WITH g AS (SELECT lag(ts) OVER (ORDER BY ts) AS gap_start, ts AS gap_end FROM events)
      SELECT gap_start, gap_end, CAST(date_diff('microsecond', gap_start, gap_end) // 1000000 AS BIGINT) AS gap_seconds FROM g WHERE date_diff('microsecond', gap_start, gap_end) // 1000000 >= 300""",
    "ingest_stats": f"""WITH {_RAW}, {_KEPT} SELECT count(*) AS received, count(*) FILTER (WHERE valid AND (mark IS NULL OR timestamp > mark)) AS kept,
      count(*) FILTER (WHERE timestamp <= mark) AS deduped, count(*) FILTER (WHERE NOT valid AND (mark IS NULL OR timestamp > mark)) AS invalid FROM marked""",
    "backfill": _filled("true", "timestamp >= TIMESTAMP '2024-01-16'"),
    "schema_evolution": _filled("true", "false"),
    "adhoc_sql": f"{_T} SELECT route, is_off_route, count(*) AS pings, max(speed) AS top_speed FROM t WHERE heading >= 180 GROUP BY route, is_off_route",
    "ingest_table": f"{_T} SELECT CAST(timestamp AS DATE) AS event_date, count(*) AS pings, count(DISTINCT vid) AS vehicles FROM t GROUP BY 1",
    "quarantine": f"""{_DAMAGED} SELECT DISTINCT message_no, CAST(NULL AS BIGINT) AS pos, 'malformed' AS reason FROM placed WHERE message_no % 40 = 7
      UNION ALL SELECT message_no, pos, 'bad' FROM whole WHERE event_id % 89 = 1""",
    "ingest_counters": f"""{_DAMAGED} SELECT (SELECT count(DISTINCT message_no) FROM placed) AS messages, (SELECT count(DISTINCT message_no) FROM placed WHERE message_no % 40 = 7) AS malformed,
      (SELECT count(*) FROM whole) AS pings, (SELECT count(*) FROM whole WHERE event_id % 89 = 1) AS bad,
      count(*) FILTER (WHERE valid AND (mark IS NULL OR timestamp > mark)) AS kept, count(*) FILTER (WHERE timestamp <= mark) AS deduped,
      count(*) FILTER (WHERE NOT valid AND (mark IS NULL OR timestamp > mark)) AS invalid FROM marked""",
    "unassigned": f"""{_T}, c AS (SELECT CAST(extract(hour FROM timestamp) AS BIGINT) AS hour, count(*) AS pings, count(*) FILTER (WHERE route = 'U') AS unassigned,
      count(*) FILTER (WHERE trip_id IS NULL OR trip_id = 'N/A') AS without_trip FROM t GROUP BY 1)
      SELECT *, round(CAST(100 AS DOUBLE) * unassigned / pings, 2) AS unassigned_pct FROM c""",
    "staleness": f"""WITH {_RAW}, s AS (SELECT route, event_id % 400 AS s FROM raw WHERE event_id % 23 <> 0)
      SELECT route, count(*) AS pings, count(*) FILTER (WHERE s >= 300) AS stale, round(avg(s), 2) AS avg_s, round(quantile_cont(s, 0.5), 2) AS median_s, round(quantile_cont(s, 0.9), 2) AS p90_s
      FROM s GROUP BY route""",
    "gtfs_stop_times": f"WITH {_STOPS} SELECT trip_id, route_id, stop_id, stop_sequence, arrival_s FROM stops",
    "trip_positions": f"{_T}, {_PLACED} SELECT vid, timestamp, trip_id, pdist, from_stop, to_stop FROM placed",
    "schedule_deviation": f"{_T}, {_PLACED} SELECT vid, timestamp, trip_id, round(scheduled_s, 3) AS scheduled_s, round(deviation_s, 3) AS deviation_s FROM dev",
    "deviation_report": f"""{_T}, {_PLACED} SELECT route, segment_type, CAST(extract(hour FROM timestamp) AS BIGINT) AS hour, count(*) AS pings, round(avg(ms) / 1000, 1) AS avg_deviation_s,
      round(quantile_cont(ms, 0.5) / 1000, 1) AS median_deviation_s FROM (SELECT *, CAST(round(deviation_s * 1000) AS BIGINT) AS ms FROM dev) GROUP BY ALL""",
    "run_times": f"""{_T}, h AS (SELECT *, lag(pdist) OVER w AS from_pdist, lag(timestamp) OVER w AS from_time FROM t WHERE trip_id IS NOT NULL AND trip_id <> 'N/A' AND pdist IS NOT NULL
      WINDOW w AS (PARTITION BY vid, trip_id, CAST(timestamp AS DATE) ORDER BY timestamp, pdist))
      SELECT vid, trip_id, route, from_pdist, pdist AS to_pdist, CAST(date_diff('microsecond', from_time, timestamp) // 1000000 AS BIGINT) AS seconds FROM h WHERE pdist > from_pdist""",
}

ORACLES["segment_run_times"] = f"""{_T}, h AS (SELECT *, CAST(timestamp AS DATE) AS day, lag(pdist) OVER w AS p0, lag(timestamp) OVER w AS t0 FROM t WHERE trip_id IS NOT NULL AND trip_id <> 'N/A' AND pdist IS NOT NULL
  WINDOW w AS (PARTITION BY vid, trip_id, CAST(timestamp AS DATE) ORDER BY timestamp, pdist)),
  c AS (SELECT vid, trip_id, day, mark, min(epoch_us(t0) + CAST(round(CAST(mark - p0 AS DOUBLE) / (pdist - p0) * (epoch_us(timestamp) - epoch_us(t0))) AS BIGINT)) AS at, min(route) AS route
    FROM h JOIN (SELECT 50 * k AS mark FROM range(1, 100) AS r(k)) ON p0 < mark AND mark <= pdist WHERE pdist > p0 GROUP BY ALL)
  SELECT a.vid, a.trip_id, a.day, a.route, CAST(a.mark AS INTEGER) AS from_mark, CAST(b.mark AS INTEGER) AS to_mark, round(CAST(b.at - a.at AS DOUBLE) / 1000000, 3) AS seconds
  FROM c a JOIN c b ON a.vid = b.vid AND a.trip_id = b.trip_id AND a.day = b.day AND b.mark = a.mark + 50 AND b.at > a.at"""
ORACLES["service_day_deviation"] = f"""{_T}, {_PLACED}, tries AS (
    SELECT late.*, k, CAST(timestamp AS DATE) + CAST(k AS INTEGER) AS day, d - 86400 * k AS off FROM late CROSS JOIN (VALUES (-1), (0), (1)) AS r(k)
  ), best AS (
    SELECT *, row_number() OVER (PARTITION BY arrival_seq ORDER BY abs(off), k) AS rank FROM tries
    WHERE day BETWEEN DATE '2024-01-01' AND DATE '2024-12-31' AND (CAST(trip_id[2:] AS BIGINT) % 5 <> 0 OR isodow(day) <= 5)
  )
  SELECT l.vid, l.timestamp, l.trip_id, b.day AS service_day, round(b.off, 3) AS deviation_s FROM late l LEFT JOIN best b ON l.arrival_seq = b.arrival_seq AND b.rank = 1"""
ORACLES["service_days"] = """WITH n AS (SELECT count(DISTINCT user_id) AS trips, count(DISTINCT CASE WHEN user_id % 5 <> 0 THEN user_id END) AS daily FROM events),
  d AS (SELECT CAST(unnest(range(DATE '2024-01-01', DATE '2025-01-01', INTERVAL 1 DAY)) AS DATE) AS day)
  SELECT day, CASE WHEN isodow(day) <= 5 THEN trips ELSE daily END AS trips, 11 * CASE WHEN isodow(day) <= 5 THEN trips ELSE daily END AS stops, CAST(5000 * CASE WHEN isodow(day) <= 5 THEN trips ELSE daily END AS DOUBLE) AS length FROM d, n"""
ORACLES["stop_distances"] = f"WITH {_STOPS} SELECT trip_id, stop_id, CAST(dist + CASE WHEN stop_sequence < 10 THEN 125 ELSE 0 END AS DOUBLE) AS dist FROM stops"


def _as_json(name: str) -> str:
    clock = ", ".join(f"strftime({c}, '%Y-%m-%dT%H:%M:%S.%f') AS {c}" for c in {"summary": ("first_record", "last_record"), "daily": ("date",), "daily_routes": ("date",), "daily_segments": ("date",)}.get(name, ()))
    return f"""SELECT '{name}' AS report, CAST(to_json(x) AS VARCHAR) AS "row" FROM (SELECT *{f" REPLACE ({clock})" if clock else ""} FROM ({ORACLES[name]})) AS x"""


ORACLES["reports_json"] = " UNION ALL ".join(_as_json(n) for n in ("summary", "segment_types", "segments", "routes", "hourly", "daily", "daily_routes", "daily_segments"))
ORACLES["gold_reports"] = ORACLES["reports_json"]
ORACLES["backfill_twice"] = ORACLES["ingest_table"]
ORACLES["tag_segments_cells"] = ORACLES["tag_segments"]
