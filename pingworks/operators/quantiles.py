"""Exact quantiles of whole numbers by group, by selection and not by sorting a group.

Values are counted by group first; then each group's coarse histogram says in which buckets
the wanted ranks lie, and only those buckets are looked at value by value.  No task holds
more of a group than its coarse buckets or one bucket's values."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def counted(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value, n): how often each value occurs in each group; nulls are left out."""
    return rows.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))


def _same(keys: list[str], prefix: str):
    return functools.reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{prefix}{k}")) for k in keys])


def select(counts: DataFrame, keys: list[str], value: str, p: float, bits: int = 12) -> DataFrame:
    """(keys, quantile): between two values in proportion, as SQL's continuous percentile.
    ``counts`` is read twice, so it should be a stored table."""
    return select_many(counts, keys, value, {"quantile": p}, bits)


def select_many(counts: DataFrame, keys: list[str], value: str, ps: dict[str, float], bits: int = 12) -> DataFrame:
    """(keys, one column a name of ``ps``): several quantiles from the same two readings."""
    bucket = F.shiftright(F.col(value), bits)
    coarse = counts.groupBy(*keys, bucket.alias("bucket")).agg(F.sum("n").alias("n"))
    upto = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    coarse = coarse.withColumn("upto", F.sum("n").over(upto)).withColumn("total", F.sum("n").over(Window.partitionBy(*keys)))
    places = F.array(*[F.struct(F.lit(name).alias("name"), ((F.col("total") - 1) * F.lit(float(p))).alias("at")) for name, p in ps.items()])
    coarse = coarse.withColumn("place", F.explode(places)).withColumn("before", F.col("upto") - F.col("n"))
    coarse = coarse.withColumn("low", F.floor("place.at")).withColumn("high", F.ceil("place.at"))
    holds = lambda rank: (F.col("before") <= F.col(rank)) & (F.col(rank) < F.col("upto"))
    own = [F.col(k).alias(f"w_{k}") for k in keys]
    wanted = coarse.filter(holds("low") | holds("high")).select(*own, F.col("bucket").alias("w_bucket"), F.col("place.name").alias("name"), "low", "high", (F.col("place.at") - F.col("low")).alias("part"), F.col("before").alias("start"))
    fine = counts.withColumn("bucket", bucket).join(wanted, _same(keys, "w_") & (F.col("bucket") == F.col("w_bucket")))
    inner = Window.partitionBy(*keys, "bucket", "name").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fine = fine.withColumn("upto", F.col("start") + F.sum("n").over(inner)).withColumn("before", F.col("upto") - F.col("n"))
    # of a name's rows, those that hold its ranks
    of = lambda name, c: F.max(F.when(F.col("name") == name, F.col(c)))
    at = lambda name, rank: F.max(F.when((F.col("name") == name) & holds(rank), F.col(value)))
    between = lambda name: at(name, "low") + (at(name, "high") - at(name, "low")) * of(name, "part")
    return fine.groupBy(*keys).agg(*[between(name).alias(name) for name in ps])
