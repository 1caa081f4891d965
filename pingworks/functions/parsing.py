"""Scalar rules of the feed: leading numbers, empty text, strict flags, rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def empty_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def leading_float(c: Column) -> Column:
    """The number a text starts with, else null."""
    return empty_to_null(F.regexp_extract(c, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1)).try_cast("double")


def leading_int(c: Column) -> Column:
    return empty_to_null(F.regexp_extract(c, r"^\s*([+-]?\d+)", 1)).try_cast("int")


def leading_int_or_zero(c: Column) -> Column:
    return F.coalesce(leading_int(c), F.lit(0))


def strict_flag(c: Column) -> Column:
    """True only for the boolean true."""
    return F.coalesce(c, F.lit(False))


def round_to(c: Column, digits: int) -> Column:
    """Half away from zero on the scaled double."""
    scale = float(10**digits)
    return F.round(c * F.lit(scale)) / F.lit(scale)
