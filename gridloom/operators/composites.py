"""Temporal composites and per-pixel statistics: one shuffle on the pixel each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.guards import clip, ratio


def clear_value(band: str, clear: str = "clear") -> Column:
    return F.when(F.col(clear), F.col(band))


def median_composite(obs: DataFrame, pixel: list[str], bands: list[str], clear: str = "clear") -> DataFrame:
    """Median of each band over clear observations, their number, and the clear share."""
    return obs.groupBy(*pixel).agg(*[F.median(clear_value(b, clear)).alias(b) for b in bands], F.count_if(F.col(clear)).alias("n_clear"), F.avg(F.col(clear).cast("double")).alias("coverage"))


def mean_composite(obs: DataFrame, pixel: list[str], bands: list[str]) -> DataFrame:
    return obs.groupBy(*pixel).agg(*[F.avg(b).alias(b) for b in bands])


def percentile_composite(obs: DataFrame, pixel: list[str], bands: list[str], percent: float = 10, clear: str = "clear") -> DataFrame:
    return obs.groupBy(*pixel).agg(*[F.percentile(clear_value(b, clear), F.lit(percent / 100)).alias(b) for b in bands])


def best_pixel(obs: DataFrame, pixel: list[str], score: Column, order: list[str], clear: str = "clear") -> DataFrame:
    """The clear observation with the largest score of each pixel; the first in order of equals. Pixels without one are left out."""
    best = Window.partitionBy(*pixel).orderBy(F.desc_nulls_last("__score"), *order)
    return obs.filter(clear).withColumn("__score", score).withColumn("__rank", F.row_number().over(best)).filter("__rank = 1").drop("__rank", "__score")


def medoid(obs: DataFrame, pixel: list[str], bands: list[str], order: list[str], clear: str = "clear") -> DataFrame:
    """The clear observation closest to the pixel's median over all bands; null bands are skipped."""
    kept = obs.filter(clear)
    whole = Window.partitionBy(*pixel)
    away = sum((F.coalesce(F.pow(F.col(b) - F.col(f"__m_{b}"), 2), F.lit(0.0)) for b in bands), F.lit(0.0))
    near = Window.partitionBy(*pixel).orderBy("__away", *order)
    medians = kept.withColumns({f"__m_{b}": F.median(b).over(whole) for b in bands})
    return medians.withColumn("__away", F.round(away, 12)).withColumn("__rank", F.row_number().over(near)).filter("__rank = 1").drop("__rank", "__away", *[f"__m_{b}" for b in bands])


def sar_annual(sar: DataFrame, keys: list[str], pols: list[str]) -> DataFrame:
    """Mean, deviation and coefficient of variation (0..5) of each polarisation."""
    columns = []
    for p in pols:
        mean, std = F.avg(p), F.stddev_pop(p)
        columns += [mean.alias(f"{p}_mean"), std.alias(f"{p}_std"), clip(std / F.greatest(F.abs(mean), F.lit(1e-8)), 0, 5).alias(f"{p}_cov")]
    return sar.groupBy(*keys).agg(*columns)


def temporal_indicators(sar: DataFrame, pixel: list[str], date: str = "acq_date") -> DataFrame:
    """Cross-polar entropy, coherence proxy, and invariance of seasonal means (.5 with fewer than two seasons of three scenes)."""
    base = sar.withColumn("__ratio", F.col("vh") / F.greatest(F.col("vv"), F.lit(1e-10))).withColumn("__season", F.floor((F.month(date) % 12) / 3))
    cv = ratio(F.stddev_pop("__ratio"), F.greatest(F.avg("__ratio"), F.lit(1e-10)))
    spread = ratio(F.stddev_pop(F.sqrt("vv")), F.greatest(F.avg(F.sqrt("vv")), F.lit(1e-10)))
    overall = base.groupBy(*pixel).agg((1 - clip(cv, 0, 2) / 2).alias("entropy"), (1 - clip(spread, 0, 1)).alias("coherence"))
    seasons = base.groupBy(*pixel, "__season").agg(F.avg("vv").alias("__mean"), F.countDistinct(date).alias("__n")).filter("__n >= 3")
    among = seasons.groupBy(*pixel).agg(F.count(F.lit(1)).alias("__seasons"), F.stddev_pop("__mean").alias("__std"), F.avg("__mean").alias("__avg"))
    steady = F.when(F.col("__seasons") >= 2, 1 - clip(F.col("__std") / F.greatest(F.col("__avg"), F.lit(1e-10)), 0, 1)).otherwise(0.5)
    return overall.join(among, pixel, "left").select(*pixel, "entropy", "coherence", F.coalesce(steady, F.lit(0.5)).alias("seasonal"))


def phenology(annual: DataFrame, pixel: list[str], year: str, value: str) -> DataFrame:
    """Mean, deviation, range, lowest, latest value and slope over years; the slope is the mean product of deviations over the years' summed squares."""
    whole = Window.partitionBy(*pixel)
    base = annual.withColumn("__dev", F.col(year) - F.avg(year).over(whole))
    return base.groupBy(*pixel).agg(
        F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), (F.max(value) - F.min(value)).alias("amplitude"), F.min(value).alias("lowest"), F.max_by(value, year).alias("current"),
        ratio(F.avg(F.col(value) * F.col("__dev")), F.sum(F.pow("__dev", F.lit(2.0)))).alias("slope"),
    )


def frequency(obs: DataFrame, pixel: list[str], water: Column, valid: Column) -> DataFrame:
    """Counts of valid and wet observations, and their share (null without valid ones): partial sums before one shuffle."""
    return obs.groupBy(*pixel).agg(F.count_if(valid).alias("n_valid"), F.count_if(valid & water).alias("n_water")).withColumn("frequency", F.try_divide(F.col("n_water").cast("double"), F.col("n_valid")))


def fuse_sensors(first: Column, second: Column, difference_p95: Column) -> Column:
    """Mean of two sensors weighted by their agreement; a null falls to the other one. Where nearly all pairs agree in full, so that the percentile is 0, the first has the least weight."""
    w = F.coalesce(clip(1 - ratio(F.abs(first - second), difference_p95), 0.1, 1), F.lit(0.1))
    return F.when(first.isNull(), second).when(second.isNull(), first).otherwise(w * first + (1 - w) * second)
