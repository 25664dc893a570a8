"""Exact percentiles of a whole table without gathering its values in one place.

A percentile lies between two values of known rank. Each pass over the values counts them in the bins
of the interval that holds a rank, and the next one looks into the one bin; a bin of few values is
sorted at last. A pass sends a row for each bin, so neither a task nor the driver holds more.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.sources.shared import staged

#: Bins of an interval, and values that the driver sorts.
BINS, FEW = 4096, 20_000


def _at_ranks(values: DataFrame, ranks: list[int], low: float, high: float) -> dict[int, float]:
    """The values of some ranks (from 0) in a table `v` between low and high."""
    out: dict[int, float] = {}
    todo = {(low, high): (0, ranks)}  # interval: number of values below it, and the ranks in it
    while todo:
        after: dict[tuple[float, float], tuple[int, list[int]]] = {}
        for (a, b), (below, own) in todo.items():
            inside = values.filter(F.col("v").between(a, b))
            step = b / BINS - a / BINS
            # Where the interval is too narrow for bins it has no more than BINS different values.
            spot = F.floor(F.col("v") / step - a / step).cast("double") if step else F.col("v")
            bins = sorted(inside.groupBy(spot.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("a"), F.max("v").alias("b")).collect(), key=lambda r: r.bin)  # BINS + 1 rows at most
            for r in bins:
                mine = [k for k in own if below <= k < below + r.n]
                if mine and r.a == r.b:
                    out |= dict.fromkeys(mine, r.a)
                elif mine and r.n <= FEW:
                    few = sorted(x.v for x in values.filter(F.col("v").between(r.a, r.b)).collect())
                    out |= {k: few[k - below] for k in mine}
                elif mine:
                    after[r.a, r.b] = (below, mine)
                below += r.n
        todo = after
    return out


def percentiles(df: DataFrame, value: str, shares: list[float]) -> list[float | None]:
    """Percentiles (shares from 0 to 1, between two values by linear interpolation) of a column, nulls, NaN and infinite values left out; None without values."""
    values = staged(df.select(F.col(value).cast("double").alias("v")).filter(F.abs("v") < float("inf")), "ranks")
    seen = values.agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).first()
    if not seen.n:
        return [None] * len(shares)
    at = [s * (seen.n - 1) for s in shares]
    found = _at_ranks(values, sorted({k for x in at for k in (math.floor(x), math.ceil(x))}), seen.low, seen.high)
    return [found[math.floor(x)] + (x - math.floor(x)) * (found[math.ceil(x)] - found[math.floor(x)]) for x in at]
