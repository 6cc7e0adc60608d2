"""Null-safe building blocks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def flag(cond: Column) -> Column:
    """0/1 integer flag; a NULL condition counts as false (never NULL)."""
    return F.coalesce(cond, F.lit(False)).cast("int")


def clip_lower(col, lower: float) -> Column:
    """``greatest(col, lower)`` that keeps NULL (``greatest`` alone skips it)."""
    c = _c(col)
    return F.when(c.isNotNull(), F.greatest(c, F.lit(lower)))


def clip(col, lower, upper) -> Column:
    """Cap into [lower, upper]; NULL stays NULL.  Bounds may be columns."""
    c = _c(col)
    lo = lower if isinstance(lower, Column) else F.lit(lower)
    hi = upper if isinstance(upper, Column) else F.lit(upper)
    return F.when(c.isNotNull(), F.least(F.greatest(c, lo), hi))


def as_text(col) -> Column:
    """Text rendering with a missing value shown as ``nan``."""
    return F.coalesce(_c(col).cast("string"), F.lit("nan"))
