"""Distances of stops along their trip's shape, where a schedule does not give them.

A stop may lie near several parts of a line that crosses or turns back on itself, so the
stops of a trip are placed together: of all ways to put them on the line in order, that
with the least sum of squared offsets.  It is found once a pattern (a shape and its stops),
however many trips run it; a pattern has some dozens of stops and hundreds of points."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

METRES = 111_320.0  # a degree of latitude


def along(stop_lat, stop_lon, lat, lon, dist, off: float) -> np.ndarray:
    """Distance of each stop along the line; all NaN where the stops cannot be put on it in
    order, NaN for a stop more than ``off`` metres from it."""
    n = len(stop_lat)
    if len(lat) < 2 or n == 0:
        return np.full(n, np.nan)
    wide = np.cos(np.radians(np.mean(lat)))
    line = np.column_stack([np.asarray(lon, float) * wide, np.asarray(lat, float)]) * METRES
    stops = np.column_stack([np.asarray(stop_lon, float) * wide, np.asarray(stop_lat, float)]) * METRES
    a, step = line[:-1], np.diff(line, axis=0)
    size = (step**2).sum(1)
    way = np.clip(((stops[:, None] - a) * step).sum(2) / np.where(size > 0, size, 1), 0, 1)
    cost = ((stops[:, None] - (a + way[..., None] * step)) ** 2).sum(2)
    best, back = cost[0].copy(), np.zeros((n, len(a)), np.int64)
    for j in range(1, n):
        # the best earlier segment, or the same one further on
        low = np.minimum.accumulate(best)
        at = np.maximum.accumulate(np.where(best == low, np.arange(len(a)), 0))
        before, came = np.append(np.inf, low[:-1]), np.append(0, at[:-1])
        same = np.where(way[j] >= way[j - 1], best, np.inf)
        back[j] = np.where(same <= before, np.arange(len(a)), came)
        best = cost[j] + np.minimum(same, before)
    if not np.isfinite(best.min()):
        return np.full(n, np.nan)
    seg = np.empty(n, np.int64)
    seg[-1] = best.argmin()
    for j in range(n - 1, 0, -1):
        seg[j - 1] = back[j][seg[j]]
    marks = np.asarray(dist, float)
    if np.isnan(marks).any():
        marks = np.append(0.0, np.cumsum(np.sqrt(size)))
    each = np.arange(n)
    out = marks[seg] + way[each, seg] * (marks[seg + 1] - marks[seg])
    return np.where(cost[each, seg] <= off * off, out, np.nan)


def fill_distances(stop_times: DataFrame, trips: DataFrame, stops: DataFrame, shapes: DataFrame, off: float = 200.0) -> DataFrame:
    """``stop_times`` with shape_dist_traveled for trips that lack any of them; what cannot
    be placed stays null (see `schedule.unplaceable`).  Distances are in the shape's own
    unit, or in metres where it has none."""
    own = stop_times.columns
    bare = stop_times.groupBy("trip_id").agg(F.count_if(F.col("shape_dist_traveled").isNull()).alias("n")).filter("n > 0").select(F.col("trip_id").alias("b_trip"))
    rows = stop_times.join(bare, F.col("trip_id") == F.col("b_trip"), "left_semi").join(stops.select("stop_id", "stop_lat", "stop_lon"), "stop_id", "left")
    stop = F.struct("stop_sequence", "stop_id", "stop_lat", "stop_lon")
    per_trip = rows.groupBy("trip_id").agg(F.sort_array(F.collect_list(stop)).alias("stops")).join(trips.select("trip_id", "shape_id"), "trip_id")
    per_trip = per_trip.withColumn("pattern", F.sha2(F.to_json(F.struct("shape_id", "stops")), 256))
    point = F.struct("shape_pt_sequence", "shape_pt_lat", "shape_pt_lon", "shape_dist_traveled")
    lines = shapes.groupBy("shape_id").agg(F.sort_array(F.collect_list(point)).alias("line"))
    patterns = per_trip.groupBy("pattern").agg(F.first("shape_id").alias("shape_id"), F.first("stops").alias("stops")).join(lines, "shape_id")

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for slat, slon, lat, lon, dist in zip(f["slat"], f["slon"], f["lat"], f["lon"], f["dist"]):
                number = lambda x: np.array([np.nan if v is None else v for v in x], float)
                s, known = number(slat), number(slon)
                fine = ~(np.isnan(s) | np.isnan(known))
                got = np.full(len(s), np.nan)
                got[fine] = along(s[fine], known[fine], number(lat), number(lon), number(dist), off)
                out.append([None if np.isnan(v) else float(v) for v in got])
            yield pd.DataFrame({"pattern": f["pattern"], "dists": out})

    flat = patterns.select("pattern", *[F.col(f"{a}.{b}").alias(c) for a, b, c in (("stops", "stop_lat", "slat"), ("stops", "stop_lon", "slon"), ("line", "shape_pt_lat", "lat"), ("line", "shape_pt_lon", "lon"), ("line", "shape_dist_traveled", "dist"))])
    placed = flat.mapInPandas(place, "pattern string, dists array<double>")
    found = per_trip.join(placed, "pattern").select(F.col("trip_id").alias("f_trip"), F.explode(F.arrays_zip(F.col("stops.stop_sequence").alias("seq"), F.col("dists").alias("dist"))).alias("x"))
    found = found.select("f_trip", F.col("x.seq").alias("f_seq"), F.col("x.dist").alias("f_dist"))
    out = stop_times.join(found, (F.col("trip_id") == F.col("f_trip")) & (F.col("stop_sequence") == F.col("f_seq")), "left")
    return out.select(*[F.coalesce("f_dist", c).alias(c) if c == "shape_dist_traveled" else F.col(c) for c in own])
