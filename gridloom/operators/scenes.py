"""Scene search, mosaics and stack assembly: what stands before pixels are aligned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.guards import clip, ratio
from gridloom.operators.ranks import percentiles
from gridloom.operators.raster import box, box_mean_variance, percentile_stretch

# First day of each sensor.
FIRST_DAY = {"sentinel2": "2015-07-01", "sentinel1": "2014-10-01", "naip": "2003-01-01"}


def search(scenes: DataFrame, west: float, south: float, east: float, north: float, start: str, stop: str, max_cloud: float | None = None, inclusive: bool = False, **equal: str | list[str]) -> DataFrame:
    """Scenes whose box meets the area, dated within [start, stop], with cloud below (or at) a bound, and further properties equal to or in a list. Filters reach the scan."""
    out = scenes.filter((F.col("west") <= east) & (F.col("east") >= west) & (F.col("south") <= north) & (F.col("north") >= south) & F.col("date").between(F.lit(start).cast("date"), F.lit(stop).cast("date")))
    if max_cloud is not None:
        out = out.filter(F.col("cloud") <= max_cloud if inclusive else F.col("cloud") < max_cloud)
    for name, value in equal.items():
        out = out.filter(F.col(name).isin(*value) if isinstance(value, list) else F.col(name) == value)
    return out


def after_launch(scenes: DataFrame, sensor: str = "sensor", date: str = "date") -> DataFrame:
    """Scenes not older than their sensor."""
    first = F.coalesce(*[F.when(F.col(sensor) == s, F.lit(d).cast("date")) for s, d in FIRST_DAY.items()], F.lit("1980-01-01").cast("date"))
    return scenes.filter(F.col(date) >= first)


def first_filled(tiles: DataFrame, keys: list[str], order: list[Column], value: str, empty: float = 1e-6) -> DataFrame:
    """Of overlapping tiles, each cell's first value in order that is not empty; null where there is none."""
    w = Window.partitionBy(*keys).orderBy((F.coalesce(F.col(value), F.lit(0.0)) <= empty).cast("int"), *order)
    filled = tiles.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")
    return filled.withColumn(value, F.when(F.col(value) > empty, F.col(value)))


def fallback(first: DataFrame, second: DataFrame, keys: list[str], value: str) -> DataFrame:
    """A cell's value from the first source, else from the second, and which."""
    j = first.select(*keys, F.col(value).alias("__a")).join(second.select(*keys, F.col(value).alias("__b")), keys, "full_outer")
    return j.select(*keys, F.coalesce("__a", "__b").alias(value), F.when(F.col("__a").isNotNull(), "first").when(F.col("__b").isNotNull(), "second").alias("origin"))


def ordered_rings(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """way_id, ring of ways (way_id, node_ids) with their nodes (node_id, x, y) in order; ways of fewer than four known nodes go."""
    long = ways.select("way_id", F.posexplode("node_ids").alias("at", "node_id"))
    met = long.join(nodes, "node_id").groupBy("way_id").agg(F.array_sort(F.collect_list(F.struct("at", "x", "y"))).alias("p"))
    return met.filter(F.size("p") >= 4).select("way_id", F.transform("p", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("ring"))


def first_band(df: DataFrame, names: list[str]) -> Column:
    """The first of several names of a band that the table has; null if it has none."""
    found = [n for n in names if n in df.columns]
    return F.col(found[0]) if found else F.lit(None).cast("double")


def feature_stack(df: DataFrame, features: dict[str, Column]) -> DataFrame:
    """df with the features as columns and as an array, and whether all are there."""
    named = df.withColumns(features)
    stack = F.array(*[F.col(n).cast("double") for n in features])
    return named.withColumn("features", stack).withColumn("valid", ~F.exists("features", lambda x: x.isNull() | F.isnan(x)))


def pad_channels(values: Column, n: int) -> Column:
    """The first n values, zeros behind fewer."""
    return F.slice(F.concat(values, F.array_repeat(F.lit(0.0), n)), 1, n)


def lidar_products(surface: Column, ground: Column) -> dict[str, Column]:
    """Height above ground and what is estimated from it: penetration and height percentiles of the canopy."""
    height = clip(surface - ground, 0, 100)
    canopy = height > 5.0
    return {"ndsm": height, "penetration": F.when(canopy, 0.3).otherwise(0.95)} | {f"height_p{p}": F.when(canopy, height * p / 100).otherwise(0.0) for p in (25, 50, 75, 95)}


def homogeneity(df: DataFrame, value: str, k: int) -> DataFrame:
    """Local mean over local variance of a 0..255 stretch, itself stretched to 0..1."""
    scaled = percentile_stretch(df.select("row", "col", value), value).withColumn(value, F.coalesce(F.col(value) * 255, F.lit(0.0)))
    stats = box_mean_variance(scaled, value, k)
    return percentile_stretch(stats.select("row", "col", (F.col("mean") / (F.col("variance") + 1)).alias("homogeneity")), "homogeneity")


def circular_zscore(df: DataFrame, value: str, radius: int) -> DataFrame:
    """Deviations from the mean of a circular neighbourhood, cut at the edge: cells send their value to those in reach, sums meet in one shuffle."""
    reach = [(r, c) for r in range(-radius, radius + 1) for c in range(-radius, radius + 1) if r * r + c * c <= radius * radius]
    sent = df.select("row", "col", value).withColumn("__o", F.explode(F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in reach])))
    stats = sent.groupBy((F.col("row") + F.col("__o.r")).alias("row"), (F.col("col") + F.col("__o.c")).alias("col")).agg(F.avg(value).alias("__m"), F.stddev_pop(value).alias("__s"))
    return df.join(stats, ["row", "col"]).select("row", "col", ratio(F.col(value) - F.col("__m"), F.col("__s")).alias("zscore"))


def wrapped_differences(df: DataFrame, value: str, offsets: list[tuple[int, int]], size: DataFrame) -> DataFrame:
    """Mean absolute difference to the cells at some offsets, wrapping around the grid; size is one row with rows and cols."""
    grid = df.crossJoin(F.broadcast(size))
    out = grid.select("row", "col", F.col(value).alias("__v"), "rows", "cols")
    sent = out.withColumn("__o", F.explode(F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in offsets])))
    moved = sent.select(F.pmod(F.col("row") + F.col("__o.r"), F.col("rows")).cast("int").alias("row"), F.pmod(F.col("col") + F.col("__o.c"), F.col("cols")).cast("int").alias("col"), F.col("__v").alias("__w"))
    return out.join(moved, ["row", "col"]).groupBy("row", "col").agg(F.avg(F.abs(F.col("__v") - F.col("__w"))).alias("contrast"))


def shadow_proximity(df: DataFrame, mask: str) -> DataFrame:
    """Cells within six of a shadow, as two dilations of 7 x 7 reach."""
    return box(df, {mask: (F.col(mask).cast("int"), F.max)}, 6, "cut").withColumn(mask, F.col(mask) == 1)


def region_shapes(cells: DataFrame, label: str) -> DataFrame:
    """Area, axes from second moments, and the rule for roads: elongated, thin, four cells or more."""
    r, c = F.col("row").cast("double"), F.col("col").cast("double")
    m = cells.groupBy(label).agg(F.count(F.lit(1)).alias("area"), (F.var_pop(r) + 1 / 12).alias("__rr"), (F.var_pop(c) + 1 / 12).alias("__cc"), F.covar_pop(r, c).alias("__rc"))
    spread = F.sqrt(F.pow((F.col("__rr") - F.col("__cc")) / 2, F.lit(2.0)) + F.col("__rc") * F.col("__rc"))
    mid = (F.col("__rr") + F.col("__cc")) / 2
    axis = lambda sign: 4 * F.sqrt(F.greatest(mid + sign * spread, F.lit(0.0)))
    out = m.select(label, "area", axis(1).alias("major"), axis(-1).alias("minor"))
    return out.withColumn("road", (F.col("area") >= 4) & (F.col("major") / F.greatest(F.col("minor"), F.lit(1.0)) > 4) & (F.col("minor") < 5) & (F.col("minor") > 0))


def species_name(nir_red: Column, green: Column, ndvi: Column, nir: Column, group: Column) -> Column:
    """A group of trees by rules in order; bounds and names are fixed values."""
    return (
        F.when((ndvi > 0.6) & (nir_red > 2.0), "Deciduous Broadleaf")
        .when((ndvi > 0.5) & (nir_red < 1.6), "Conifer / Evergreen")
        .when(nir_red > 2.5, "High-NIR Deciduous")
        .when(green > 0.38, "Mixed / Broadleaf")
        .when(nir > 0.4, "Dense Canopy")
        .otherwise(F.concat(F.lit("Species Group "), group.cast("string")))
    )


def texture_proxies(df: DataFrame, value: str, k: int, levels: int = 32) -> DataFrame:
    """Contrast, homogeneity, entropy and angular second moment estimated from the local variance of a quantised band; edges repeated."""
    lo, hi = (F.lit(x).cast("double") for x in percentiles(df, value, [0.02, 0.98]))
    level = F.floor(clip((F.col(value) - lo) / (hi - lo + 1e-10) * (levels - 1), 0, levels - 1)).cast("double")
    stats = box_mean_variance(df.select("row", "col", level.alias(value)), value, k, "nearest")
    v = F.col("variance")
    return stats.select("row", "col", v.alias("contrast"), (1 / (1 + v)).alias("homogeneity"), F.log(F.sqrt(v) + 1e-8 + 1).alias("entropy"), (1 / ((1 + v) * (1 + v))).alias("asm"))


def shadows(df: DataFrame, value: str, k: float) -> DataFrame:
    """df with shadow: cells below the whole band's mean by k deviations."""
    bounds = df.agg(F.avg(value).alias("__m"), F.stddev_pop(value).alias("__s"))
    return df.crossJoin(F.broadcast(bounds)).withColumn("shadow", F.col(value) < F.col("__m") - k * F.col("__s")).drop("__m", "__s")


def grid_geometry(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: resolution from the extent and number of distinct centres, and the corner half a cell beyond the first centre."""
    g = df.agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.countDistinct(x).alias("nx"), F.min(y).alias("y0"), F.max(y).alias("y1"), F.countDistinct(y).alias("ny"))
    g = g.withColumns({"res_x": ratio((F.col("x1") - F.col("x0")).cast("double"), F.col("nx") - 1), "res_y": ratio((F.col("y1") - F.col("y0")).cast("double"), F.col("ny") - 1)})
    return g.select((F.col("x0") - F.col("res_x") / 2).alias("west"), (F.col("y0") - F.col("res_y") / 2).alias("north"), "res_x", "res_y")
