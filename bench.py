"""Headline queries at one scale, warm, as one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) say where and on
how many threads.  Each query runs once to warm up and then BENCH_RUNS times (default
3); its figure is the median.  Reports read the stored ping table, which the first one
writes while it warms up; what writing it takes is the figure of ``ingest_table``."""

from __future__ import annotations

import json
import os
import statistics
import tempfile
import time

from pyspark.sql import SparkSession

from pingworks.plans.registry import QUERIES

HEADLINE = [
    "summary", "segment_types", "segments", "routes", "hourly", "daily", "daily_routes", "daily_segments", "mixed_vs_dedicated", "duplicate_rate",
    "pings_per_segment", "pings_per_segment_type", "null_segment_coverage", "null_segment_clusters", "headline_kpis", "data_range",
    "segment_speed_pivot", "tag_segments", "dedup_pings", "ingest_table", "feed_gaps", "deviation_report", "run_times",
]


def main() -> None:
    sf_dir, cpus, runs = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8"), int(os.environ.get("BENCH_RUNS", "3"))
    scratch = tempfile.mkdtemp(prefix="spark-")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "12g").config("spark.checkpoint.dir", f"file://{scratch}/shared")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in HEADLINE:
        took = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - start)
        times[name] = round(statistics.median(took[1:]), 3)
    print(json.dumps({"metric": "total_headline_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
