"""Ratios with a named guard for a zero denominator, null-safe clipping, rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NODATA = -9999.0


def as_missing(x: Column) -> Column:
    """NaN as null: Spark orders NaN above all numbers and counts it in aggregates."""
    return F.when(~F.isnan(x), x)


def clip(x: Column, low: float, high: float) -> Column:
    """x within [low, high]; null stays null."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def ratio(num: Column, den: Column, guard: str = "null", eps: float = 1e-8) -> Column:
    """num / den; where den is 0: null, `zero`, `sentinel` (-9999); `eps` adds eps to every den, `tiny` is null for |den| <= 1e-10."""
    if guard == "eps":
        return num / (den + F.lit(eps))
    quotient = F.try_divide(num, den)
    if guard == "null":
        return quotient
    if guard == "zero":
        return F.when(den == 0, F.lit(0.0)).otherwise(quotient)
    if guard == "sentinel":
        return F.when(den == 0, F.lit(NODATA)).otherwise(quotient)
    if guard == "tiny":
        return F.when(F.abs(den) > 1e-10, quotient)
    raise ValueError(f"unknown guard {guard}")


def r6(x: Column) -> Column:
    """Rounded to 6 places, without a negative zero."""
    return F.round(x, 6) + F.lit(0.0)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))
