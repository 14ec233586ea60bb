"""Rounding and integer helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_even(value: Column, digits: int = 0) -> Column:
    """Scale, round half to even, scale back.

    The scaling happens in floating point, so 0.575 to two digits is 0.57.
    Spark's `bround` works on the decimal text and would give 0.58.
    """
    if digits == 0:
        return F.rint(value)
    scale = F.lit(float(10**digits))
    return F.rint(value * scale) / scale


def percent_truncated(ratio: Column) -> Column:
    """Ratio rounded to two digits, then cut to a whole percent."""
    return (round_half_even(ratio, 2) * F.lit(100.0)).cast("int")


def share_percent(part: Column, whole: Column) -> Column:
    """Whole-percent share, half to even."""
    return round_half_even(part / whole * F.lit(100.0))


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    """Double division; NULL instead of an error on a zero denominator."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))
