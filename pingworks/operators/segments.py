"""Track segments: the first box of a ping's route that holds it, borders included."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pingworks.schemas import SEGMENT_ROWS, SEGMENTS

#: At most so many boxes (some 100 bytes each) are broadcast.
BROADCAST_BOXES = 20_000


def segments(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SEGMENT_ROWS, SEGMENTS)


def _box() -> Column:
    return F.struct("order", "id", "name", "type", "min_lat", "max_lat", "min_lon", "max_lon")


def _first_hit(rows: DataFrame, columns: list[str]) -> DataFrame:
    inside = lambda b: F.col("lat").between(b["min_lat"], b["max_lat"]) & F.col("lon").between(b["min_lon"], b["max_lon"])
    rows = rows.withColumn("hit", F.get(F.filter("boxes", inside), F.lit(0)))
    return rows.select(*[F.col(c) for c in columns], *[F.col(f"hit.{c}").alias(f"segment_{c}") for c in ("id", "name", "type")])


def _few(segs: DataFrame) -> bool:
    return segs.limit(BROADCAST_BOXES + 1).count() <= BROADCAST_BOXES


def tag(pings: DataFrame, segs: DataFrame) -> DataFrame:
    """Adds segment_id, segment_name, segment_type.  One row a route holds its boxes in
    order, so the join does not multiply rows.  Up to BROADCAST_BOXES boxes it is broadcast
    and shuffles nothing; beyond, `tag_by_cells` keeps what a ping meets small.  Works on
    streams."""
    if not _few(segs):
        return tag_by_cells(pings, segs)
    per_route = segs.groupBy("route").agg(F.sort_array(F.collect_list(_box())).alias("boxes"))
    return _first_hit(pings.join(F.broadcast(per_route), "route", "left"), pings.columns)


def tag_by_join(pings: DataFrame, segs: DataFrame) -> DataFrame:
    """The same in relational form: range join, then the first box of each ping.  Pings get
    a number of their own first, so rows that are equal in every column stay apart."""
    s = segs.select(*[F.col(c).alias(f"s_{c}") for c in segs.columns])
    s = F.broadcast(s) if _few(segs) else s
    on = (F.col("route") == F.col("s_route")) & F.col("lat").between(F.col("s_min_lat"), F.col("s_max_lat")) & F.col("lon").between(F.col("s_min_lon"), F.col("s_max_lon"))
    row, hit = F.struct(*pings.columns), F.struct("s_id", "s_name", "s_type")
    numbered = pings.withColumn("__row", F.monotonically_increasing_id())
    one = numbered.join(s, on, "left").groupBy("__row").agg(F.first(row).alias("ping"), F.min_by(hit, "s_order").alias("hit"))
    return one.select(*[F.col(f"ping.`{c}`").alias(c) for c in pings.columns], *[F.col(f"hit.s_{c}").alias(f"segment_{c}") for c in ("id", "name", "type")])


def tag_by_cells(pings: DataFrame, segs: DataFrame, cell: float = 0.01) -> DataFrame:
    """The same for many boxes: space is cut into square cells of ``cell`` degrees, one row a
    route and cell holds the boxes that touch it, in order, and a ping meets only those of
    its cell, by an equi-join.  A box of many cells takes a row in each."""
    low, high = lambda c: F.floor(F.col(c) / cell), lambda c: F.sequence(F.floor(F.col(f"min_{c}") / cell), F.floor(F.col(f"max_{c}") / cell))
    fit = segs.filter((F.col("min_lat") <= F.col("max_lat")) & (F.col("min_lon") <= F.col("max_lon")))
    rows = fit.withColumn("y", F.explode(high("lat"))).withColumn("x", F.explode(high("lon")))
    per_cell = rows.groupBy(F.col("route").alias("c_route"), "y", "x").agg(F.sort_array(F.collect_list(_box())).alias("boxes"))
    on = (F.col("route") == F.col("c_route")) & (low("lat") == F.col("y")) & (low("lon") == F.col("x"))
    return _first_hit(pings.join(per_cell, on, "left"), pings.columns)
