"""Queries by name, and their SQL."""

from __future__ import annotations

from pingworks.operators import audits, reports
from pingworks.plans import queries as Q
from pingworks.plans.oracle import ORACLES

QUERIES = {
    "parse_payload": Q.parse_payload,
    "clean_pings": Q.clean_pings,
    "dedup_pings": Q.dedup_pings,
    "dedup_incremental": Q.dedup_incremental,
    "tag_segments": Q.tag_segments,
    "tag_segments_join": Q.tag_segments_join,
    "tag_segments_cells": Q.tag_segments_cells,
    **{name: Q.on_table(report) for name, report in reports.ALL.items()},
    "daily_routes_one": Q.on_table(lambda t: reports.daily_routes(t, "12")),
    "mixed_vs_dedicated": Q.mixed_vs_dedicated,
    "duplicate_rate": Q.duplicate_rate,
    "pings_per_segment": Q.on_table(audits.pings_per_segment),
    "pings_per_segment_type": Q.on_table(audits.pings_per_segment_type),
    "null_segment_coverage": Q.on_table(audits.null_segment_coverage),
    "null_segment_clusters": Q.on_table(audits.null_segment_clusters),
    "headline_kpis": Q.on_table(reports.headline_kpis),
    "data_range": Q.on_table(reports.data_range),
    "segment_speed_pivot": Q.on_table(reports.segment_speed_pivot),
    "route_bands": Q.on_table(reports.route_bands),
    "segment_labels": Q.on_table(reports.segment_labels),
    "feed_gaps": Q.feed_gaps,
    "ingest_stats": Q.ingest_stats,
    "backfill": Q.backfill,
    "schema_evolution": Q.schema_evolution,
    "adhoc_sql": Q.adhoc_sql,
    "reports_json": Q.reports_json,
    "gold_reports": Q.gold_reports,
    "backfill_twice": Q.backfill_twice,
    "ingest_table": Q.ingest_table,
    "quarantine": Q.quarantine,
    "ingest_counters": Q.ingest_counters,
    "unassigned": Q.on_table(audits.unassigned),
    "staleness": Q.staleness,
    "gtfs_stop_times": Q.gtfs_stop_times,
    "trip_positions": Q.trip_positions,
    "schedule_deviation": Q.schedule_deviation,
    "deviation_report": Q.deviation_report,
    "run_times": Q.run_times,
    "segment_run_times": Q.segment_run_times,
    "service_day_deviation": Q.service_day_deviation,
    "service_days": Q.service_days,
    "stop_distances": Q.stop_distances,
}
