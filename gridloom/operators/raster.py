"""Focal, zonal and tiled operators on grids kept as tables (row, col, value).

A box of (2k+1) x (2k+1) is a window over columns within a row, then one over rows within a column.
Edges are padded with rows before the windows: `reflect` mirrors, `nearest` repeats, `cut` lets the
box end at the edge. Grids are dense; `by` names further keys such as the tile or the raster, which
bound what one window holds.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.guards import clip, ratio
from gridloom.operators.ranks import percentiles
from gridloom.sources.shared import staged

Aggregate = Callable[[Column], Column]


def _padded(df: DataFrame, axis: str, k: int, mode: str, size: DataFrame, by: list[str]) -> DataFrame:
    """df with copies of its edge rows beyond both ends of an axis; size has first and last of the axis, one row for each `by`."""
    if mode == "cut":
        return df
    bounded = df.join(F.broadcast(size), by) if by else df.crossJoin(F.broadcast(size))
    at, first, last = F.col(axis), F.col("__first"), F.col("__last")
    if mode == "reflect":
        spots = F.array(at, F.when(at < first + k, 2 * first - 1 - at), F.when(at > last - k, 2 * last + 1 - at))
    else:
        reach = F.sequence(F.lit(1), F.lit(k))
        none = F.array().cast("array<int>")
        spots = F.concat(F.array(at), F.when(at == first, F.transform(reach, lambda i: first - i)).otherwise(none), F.when(at == last, F.transform(reach, lambda i: last + i)).otherwise(none))
    return bounded.withColumn("__at", F.explode(F.filter(spots, lambda x: x.isNotNull()))).withColumn(axis, F.col("__at")).drop("__at")


def box(df: DataFrame, values: dict[str, tuple[Column, Aggregate]], k: int, mode: str = "reflect", by: list[str] = (), row: str = "row", col: str = "col") -> DataFrame:
    """by, row, col and each aggregate (sum, min or max: they may be taken axis by axis) over the box around a cell."""
    by = list(by)
    work = df.select(*by, row, col, *[c.alias(n) for n, (c, _) in values.items()])
    for axis, other in ((col, row), (row, col)):
        size = work.groupBy(*by).agg(F.min(axis).alias("__first"), F.max(axis).alias("__last")) if mode != "cut" else None
        w = Window.partitionBy(*by, other).orderBy(axis).rangeBetween(-k, k)
        padded = _padded(work, axis, k, mode, size, by)
        done = padded.withColumns({n: agg(F.col(n)).over(w) for n, (_, agg) in values.items()})
        work = (done if mode == "cut" else done.filter(F.col(axis).between(F.col("__first"), F.col("__last")))).select(*by, row, col, *values)
    return work


def box_mean_variance(df: DataFrame, value: str, k: int, mode: str = "reflect", by: list[str] = ()) -> DataFrame:
    """mean and variance (population, not below 0) over the box."""
    v = F.col(value)
    sums = box(df, {"__n": (F.lit(1.0), F.sum), "__s": (v, F.sum), "__q": (v * v, F.sum)}, k, mode, by)
    mean = F.col("__s") / F.col("__n")
    return sums.select(*by, "row", "col", mean.alias("mean"), F.greatest(F.col("__q") / F.col("__n") - mean * mean, F.lit(0.0)).alias("variance"))


def erode(df: DataFrame, mask: str, k: int = 1, by: list[str] = ()) -> DataFrame:
    """Cells whose whole box is set; beyond the edge nothing is set."""
    full = (2 * k + 1) ** 2
    return box(df, {"__s": (F.col(mask).cast("int"), F.sum)}, k, "cut", by).withColumn(mask, F.col("__s") == full).drop("__s")


def dilate(df: DataFrame, mask: str, k: int = 1, by: list[str] = ()) -> DataFrame:
    return box(df, {"__s": (F.col(mask).cast("int"), F.max)}, k, "cut", by).withColumn(mask, F.col("__s") == 1).drop("__s")


def opening(df: DataFrame, mask: str, k: int = 1, by: list[str] = ()) -> DataFrame:
    return dilate(erode(df, mask, k, by), mask, k, by)


def closing(df: DataFrame, mask: str, k: int = 1, by: list[str] = ()) -> DataFrame:
    return erode(dilate(df, mask, k, by), mask, k, by)


def lee(df: DataFrame, value: str, k: int, looks: float = 4.4, mode: str = "reflect", by: list[str] = ()) -> DataFrame:
    """Speckle filter: the local mean, corrected by how far the local variation exceeds that of speckle."""
    stats = box_mean_variance(df, value, k, mode, by)
    noise = 1 / looks
    cv2 = ratio(F.col("variance"), F.greatest(F.col("mean") * F.col("mean"), F.lit(1e-10)))
    weight = clip(1 - ratio(F.lit(noise), F.greatest(cv2, F.lit(1e-10))), 0, 1)
    return df.join(stats, [*by, "row", "col"]).select(*by, "row", "col", (F.col("mean") + weight * (F.col(value) - F.col("mean"))).alias("filtered"))


def lee_local(df: DataFrame, value: str, k: int, looks: float = 4.4, mode: str = "nearest", by: list[str] = ()) -> DataFrame:
    """Speckle filter by noise of mean**2 / looks: where the local variance is no larger, the local mean stands. Values are 1e-10 at least."""
    held = df.withColumn(value, F.greatest(F.col(value), F.lit(1e-10)))
    noise = F.col("mean") * F.col("mean") / looks
    weight = clip(F.when(F.col("variance") > noise, 1 - noise / F.greatest(F.col("variance"), F.lit(1e-10))).otherwise(0.0), 0, 1)
    return held.join(box_mean_variance(held, value, k, mode, by), [*by, "row", "col"]).select(*by, "row", "col", (F.col("mean") + weight * (F.col(value) - F.col("mean"))).alias("filtered"))


def lee_global(df: DataFrame, value: str, k: int, mode: str = "reflect") -> DataFrame:
    """Speckle filter of decibels: the weight of a cell is the local variance against that of the whole raster."""
    whole = df.filter(F.abs(value) < float("inf")).agg(F.coalesce(F.var_pop(value), F.lit(1.0)).alias("__all"))
    weight = clip(F.col("variance") / (F.col("variance") + F.col("__all") + 1e-12), 0, 1)
    joined = df.join(box_mean_variance(df, value, k, mode), ["row", "col"]).crossJoin(F.broadcast(whole))
    return joined.select("row", "col", (F.col("mean") + weight * (F.col(value) - F.col("mean"))).alias("filtered"))


def height_above_lowest(df: DataFrame, value: str, radius: int, mode: str = "reflect") -> DataFrame:
    """Height above the lowest cell of boxes of a quarter, half and the whole radius (3 at least): the boxes lie in each other, so the widest has the lowest."""
    lowest = box(df, {"__low": (F.col(value), F.min)}, max(radius, 3), mode)
    return df.join(lowest, ["row", "col"]).select("row", "col", F.greatest(F.col(value) - F.col("__low"), F.lit(0.0)).alias("hand"))


def least_height(df: DataFrame, value: str, sizes: tuple[int, ...] = (15, 31, 63), mode: str = "nearest") -> DataFrame:
    """The least of the value and its heights above the lowest cell of boxes of some sizes, of those that the raster is larger than, 0 at least: of boxes that lie in each other the smallest has it."""
    shape = df.agg(F.least(F.max("row") - F.min("row"), F.max("col") - F.min("col")).alias("n")).first()
    fitting = [s for s in sizes if shape.n is not None and shape.n + 1 > s]
    if not fitting:
        return df.select("row", "col", F.greatest(F.col(value), F.lit(0.0)).alias("hand"))
    lowest = box(df, {"__low": (F.col(value), F.min)}, min(fitting) // 2, mode)
    return df.join(lowest, ["row", "col"]).select("row", "col", F.greatest(F.least(F.col(value), F.col(value) - F.col("__low")), F.lit(0.0)).alias("hand"))


def gradient(df: DataFrame, value: str, cell: float = 1.0, by: list[str] = ()) -> DataFrame:
    """dx, dy by central differences, one-sided at the edges."""
    out = df
    for name, axis, other in (("dx", "col", "row"), ("dy", "row", "col")):
        w = Window.partitionBy(*by, other).orderBy(axis)
        before, after = F.lag(value).over(w), F.lead(value).over(w)
        v = F.col(value)
        out = out.withColumn(name, F.when(before.isNull(), after - v).when(after.isNull(), v - before).otherwise((after - before) / 2) / cell)
    return out


def horn(df: DataFrame, value: str, cell: float, by: list[str] = ()) -> DataFrame:
    """Slope in degrees from the 3 x 3 neighbourhood, edges mirrored: weighted sums along one axis, differences along the other."""
    v = F.col(value)
    by = list(by)

    def shift(frame: DataFrame, axis: str, other: str, names: list[str]) -> DataFrame:
        w = Window.partitionBy(*by, other).orderBy(axis)
        return frame.withColumns({f"{n}_{s}": F.coalesce(f(n).over(w), F.col(n)) for n in names for s, f in (("b", F.lag), ("a", F.lead))})

    a = shift(df.withColumn("__v", v), "col", "row", ["__v"])
    a = a.withColumns({"__sx": F.col("__v_a") - F.col("__v_b"), "__sm": F.col("__v_b") + 2 * F.col("__v") + F.col("__v_a")})
    b = shift(a, "row", "col", ["__sx", "__sm"])
    dx = (F.col("__sx_b") + 2 * F.col("__sx") + F.col("__sx_a")) / (8 * cell)
    dy = (F.col("__sm_a") - F.col("__sm_b")) / (8 * cell)
    return b.select(*by, "row", "col", F.degrees(F.atan(F.sqrt(dx * dx + dy * dy))).alias("slope"))


def majority(df: DataFrame, value: str, k: int = 1, by: list[str] = ()) -> DataFrame:
    """The most frequent class of the box (cut at the edge), the lowest of equals: each cell votes for its neighbours, votes are counted in one shuffle."""
    by = list(by)
    steps = F.sequence(F.lit(-k), F.lit(k))
    votes = df.select(*by, "row", "col", value).withColumn("__dr", F.explode(steps)).withColumn("__dc", F.explode(steps))
    votes = votes.select(*by, (F.col("row") + F.col("__dr")).alias("row"), (F.col("col") + F.col("__dc")).alias("col"), value)
    counts = votes.groupBy(*by, "row", "col", value).agg(F.count(F.lit(1)).alias("__n"))
    best = counts.groupBy(*by, "row", "col").agg(F.max(F.struct(F.col("__n"), (-F.col(value)).alias("__c"))).alias("__b"))
    return df.select(*by, "row", "col").join(best, [*by, "row", "col"]).select(*by, "row", "col", (-F.col("__b.__c")).alias(value))


def block_mean(df: DataFrame, value: str, factor: int, by: list[str] = ()) -> DataFrame:
    """Area downsample: the mean of factor x factor cells, nulls skipped."""
    cell = lambda c: F.floor(F.col(c) / factor).cast("int").alias(c)
    return df.groupBy(*by, cell("row"), cell("col")).agg(F.avg(value).alias(value))


def overview(df: DataFrame, factor: int) -> DataFrame:
    """Nearest-neighbour overview: every factor-th cell."""
    return df.filter((F.col("row") % factor == 0) & (F.col("col") % factor == 0)).withColumns({"row": (F.col("row") / factor).cast("int"), "col": (F.col("col") / factor).cast("int")})


def fill_gaps(df: DataFrame, value: str, k: int = 3, passes: int = 3, by: list[str] = ()) -> DataFrame:
    """Nulls become the median of the box, up to `passes` times; neighbours send their values to null cells."""
    by = list(by)
    steps = F.sequence(F.lit(-k), F.lit(k))
    for _ in range(passes):
        holes = df.filter(F.col(value).isNull()).select(*by, "row", "col")
        asked = holes.withColumn("__dr", F.explode(steps)).withColumn("__dc", F.explode(steps)).select(*by, F.col("row").alias("__row"), F.col("col").alias("__col"), (F.col("row") + F.col("__dr")).alias("row"), (F.col("col") + F.col("__dc")).alias("col"))
        # Both sides grow with the grid, and small files may hold many cells: neither may be gathered for a broadcast.
        found = asked.join(df.filter(F.col(value).isNotNull()).select(*by, "row", "col", value).hint("merge"), [*by, "row", "col"]).groupBy(*by, F.col("__row").alias("row"), F.col("__col").alias("col")).agg(F.median(value).alias("__fill"))
        df = df.join(found.hint("merge"), [*by, "row", "col"], "left").withColumn(value, F.coalesce(value, "__fill")).drop("__fill")
    return df


def tile_grid(rows: int, cols: int, size: int, overlap: int, frame: DataFrame) -> DataFrame:
    """Tiles in row-major order: the inner window, and the window padded by the overlap within the raster. frame is any one-row frame."""
    down, across = -(-rows // size), -(-cols // size)
    t = frame.select(F.explode(F.sequence(F.lit(0), F.lit(down * across - 1))).alias("tile_id"))
    r0, c0 = F.floor(F.col("tile_id") / across).cast("int") * size, (F.col("tile_id") % across).cast("int") * size
    t = t.withColumns({"row0": r0, "col0": c0, "row1": F.least(r0 + size, F.lit(rows)), "col1": F.least(c0 + size, F.lit(cols))})
    return t.withColumns({"pad_row0": F.greatest(F.col("row0") - overlap, F.lit(0)), "pad_col0": F.greatest(F.col("col0") - overlap, F.lit(0)), "pad_row1": F.least(F.col("row1") + overlap, F.lit(rows)), "pad_col1": F.least(F.col("col1") + overlap, F.lit(cols))})


def halo_tiles(df: DataFrame, size: int, overlap: int) -> DataFrame:
    """Each cell once for its tile (inner) and once for every tile whose padding it lies in: tile_row, tile_col, inner."""
    def reach(c: str) -> Column:
        return F.sequence(F.greatest(F.floor((F.col(c) - overlap) / size), F.lit(0)).cast("int"), F.floor((F.col(c) + overlap) / size).cast("int"))

    tiled = df.withColumn("tile_row", F.explode(reach("row"))).withColumn("tile_col", F.explode(reach("col")))
    inner = (F.floor(F.col("row") / size) == F.col("tile_row")) & (F.floor(F.col("col") / size) == F.col("tile_col"))
    return tiled.withColumn("inner", inner)


def blend(tiled: DataFrame, values: list[str], size: int, overlap: int) -> DataFrame:
    """Overlapping tiles blended with weights that fall off like a cosine towards a tile's padded edge."""
    def weight(c: str, tile: str) -> Column:
        inside = F.col(c) - F.col(tile) * size + overlap
        edge = F.least(inside, size + 2 * overlap - 1 - inside)
        return F.when(edge >= 2 * overlap, 1.0).otherwise(0.5 * (1 - F.cos(F.lit(3.141592653589793) * (edge + 1) / (2 * overlap + 1))))

    w = weight("row", "tile_row") * weight("col", "tile_col")
    return tiled.withColumn("__w", w).groupBy("row", "col").agg(*[ratio(F.sum(F.col(v) * F.col("__w")), F.sum("__w")).alias(v) for v in values])


def zonal(df: DataFrame, label: str, value: str) -> DataFrame:
    return df.filter(F.col(label) > 0).groupBy(label).agg(F.count(F.lit(1)).alias("area"), F.avg(value).alias("mean"), F.max(value).alias("highest"))


def segment_majority(df: DataFrame, segment: str, value: str, keys: list[str]) -> DataFrame:
    """Each cell with the most frequent class of its segment, the lowest of equals; segment 0 stays as it is."""
    counts = df.filter(F.col(segment) > 0).groupBy(segment, value).agg(F.count(F.lit(1)).alias("__n"))
    best = counts.groupBy(segment).agg(F.max(F.struct(F.col("__n"), (-F.col(value)).alias("__c"))).alias("__b"))
    return df.join(best, segment, "left").select(*keys, segment, F.coalesce(-F.col("__b.__c"), F.col(value)).alias(value))


def percentile_stretch(df: DataFrame, value: str, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """df with its value stretched: 0 at the low and 1 at the high percentile of all its rows."""
    lo, hi = (F.lit(x).cast("double") for x in percentiles(df, value, [low, high]))
    return df.withColumn(value, clip(ratio(F.col(value) - lo, hi - lo), 0, 1))


def _tile_regions(group: pd.DataFrame, size: int, eight: bool) -> pd.DataFrame:
    """The cells of a tile with the smallest cell number that each is connected to within the tile."""
    row, col = group["row"].to_numpy(np.int64), group["col"].to_numpy(np.int64)
    at = row % size * size + col % size
    taken = np.unique(at)
    spot = np.full((size + 2) * (size + 2), -1)
    place = (taken // size + 1) * (size + 2) + taken % size + 1
    spot[place] = np.arange(len(taken))
    steps = (1, size + 2, size + 1, size + 3) if eight else (1, size + 2)
    pairs = [np.stack([np.flatnonzero(spot[place + s] >= 0), spot[place + s][spot[place + s] >= 0]]) for s in steps]
    u, v = np.hstack(pairs)
    label = np.arange(len(taken))
    while True:  # numbers are in the order of cells, so the smallest index has the smallest number
        low, high = np.minimum(label[u], label[v]), np.maximum(label[u], label[v])
        open_ = low != high
        if not open_.any():
            break
        np.minimum.at(label, high[open_], low[open_])
        while (label[label] != label).any():
            label = label[label]
    first = taken[label[np.searchsorted(taken, at)]]
    return pd.DataFrame({"row": group["row"], "col": group["col"], "run": (row // size * size + first // size) * (1 << 31) + col // size * size + first % size})


def regions(df: DataFrame, mask: str, eight: bool = False, size: int = 256) -> DataFrame:
    """row, col, region of set cells: connected cells (4 or 8 neighbours) get their smallest cell number.

    Cells are first labelled within tiles of `size` cells a side, each tile in a task's memory. What is left is
    a graph of the labels that touch across the sides of tiles: rounds of smallest labels go on until nothing
    changes, and each is cut from its lineage by a table in the shared folder.
    """
    cells = df.filter(mask).select("row", "col")
    kinds = ", ".join(f"{c} {cells.schema[c].dataType.simpleString()}" for c in ("row", "col"))
    tiled = cells.groupBy(F.floor(F.col("row") / size).alias("__r"), F.floor(F.col("col") / size).alias("__c"))
    named = staged(tiled.applyInPandas(lambda group: _tile_regions(group, size, eight), f"{kinds}, run long"), "named")
    edge = lambda c: F.pmod(F.col(c), F.lit(size)).isin(0, size - 1)
    border = named.filter(edge("row") | edge("col"))
    steps = [(1, 0), (0, 1)] + ([(1, 1), (1, -1)] if eight else [])
    kept = [cells.schema[c].dataType for c in ("row", "col")]
    moved = F.explode(F.array(*[F.struct((F.col("row") + r).cast(kept[0]).alias("row"), (F.col("col") + c).cast(kept[1]).alias("col")) for r, c in steps]))
    near = border.select(F.col("run").alias("other"), moved.alias("m")).select("other", "m.row", "m.col")
    # Every side of these joins grows with the grid, and its files are far smaller than its rows: none may be gathered for a broadcast.
    edges = border.join(near.hint("merge"), ["row", "col"]).filter("run <> other").select(F.col("run").alias("u"), F.col("other").alias("v")).distinct()
    both = staged(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))), "edges")
    labels = staged(both.select(F.col("u").alias("run")).distinct().withColumn("region", F.col("run")), "labels")
    while True:
        new = labels.select("run", "region", F.col("region").alias("old"))
        for _ in range(2):  # two steps for each table that is written
            told = both.join(new.hint("merge"), F.col("u") == F.col("run")).groupBy(F.col("v").alias("run")).agg(F.min("region").alias("told"))
            new = new.join(told.hint("merge"), "run", "left").select("run", F.least("region", F.coalesce("told", "region")).alias("region"), "old")
            # Follow the label of the label: chains shorten by half.
            new = new.alias("a").join(new.alias("b").hint("merge"), F.col("a.region") == F.col("b.run")).select("a.run", F.col("b.region").alias("region"), "a.old")
        labels = staged(new, "labels")
        if labels.filter("region <> old").isEmpty():
            break
    return named.join(labels.select("run", "region").hint("merge"), "run", "left").select("row", "col", F.coalesce("region", "run").alias("region"))
