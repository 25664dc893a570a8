"""Polygon operators: hulls, rectangles, clipping and rasterizing of rings."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf, pandas_udf

from gridloom.functions.geo import EARTH_M, ring_area, ring_length
from gridloom.functions.guards import ratio
from gridloom.operators.features import by_place
from gridloom.operators.raster import regions
from gridloom.sources.shared import staged

RING = "array<struct<x:double,y:double>>"


def _points(ring) -> np.ndarray:
    return np.array([(p["x"], p["y"]) for p in ring], float).reshape(-1, 2) if ring is not None else np.zeros((0, 2))


def convex_hull(points: np.ndarray) -> np.ndarray:
    """Corners of the hull, counter-clockwise."""
    ordered = sorted(set(map(tuple, points)))
    if len(ordered) < 3:
        return np.array(ordered, float).reshape(-1, 2)

    def half(items):
        out: list[tuple[float, float]] = []
        for p in items:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(half(ordered) + half(ordered[::-1]))


def polygon_area(points: np.ndarray) -> float:
    if len(points) < 3:
        return 0.0
    x, y = points[:, 0] - points[0, 0], points[:, 1] - points[0, 1]
    return abs(float(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1)))) / 2


def smallest_rectangle(points: np.ndarray) -> tuple[float, float]:
    """Long and short side of the smallest rectangle, which lies on a side of the hull."""
    hull = convex_hull(points)
    if len(hull) < 3:
        return (float(np.ptp(points, axis=0).max()) if len(points) else 0.0), 0.0
    sides = np.diff(np.vstack([hull, hull[:1]]), axis=0)
    best = (math.inf, 0.0, 0.0)
    for angle in np.arctan2(sides[:, 1], sides[:, 0]):
        c, s = math.cos(angle), math.sin(angle)
        w, h = np.ptp(hull @ np.array([[c, -s], [s, c]]), axis=0)
        best = min(best, (w * h, max(w, h), min(w, h)))
    return best[1], best[2]


def _flat(rings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The points of all rings of a batch one after another, and how many each ring has."""
    points = rings.flatten()
    xy = [pc.struct_field(points, [i]).to_numpy(zero_copy_only=False).astype(float) for i in (0, 1)]
    return np.stack(xy, 1), pc.fill_null(pc.list_value_length(rings), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _rings(points: np.ndarray, counts: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(points[:, 0]), pa.array(points[:, 1])], ["x", "y"]))


def _half_hulls(items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rings of one size with ordered points (ring, point, axis): the lower half of each hull without its last corner, and its size."""
    each = np.arange(len(items))
    out, top = np.zeros_like(items), np.zeros(len(items), int)
    for k in range(items.shape[1]):
        p = items[:, k]
        while True:
            a, b = out[each, np.maximum(top - 2, 0)], out[each, np.maximum(top - 1, 0)]
            back = (top > 1) & ((b[:, 0] - a[:, 0]) * (p[:, 1] - a[:, 1]) - (b[:, 1] - a[:, 1]) * (p[:, 0] - a[:, 0]) <= 0)
            if not back.any():
                break
            top -= back
        out[each, top] = p
        top += 1
    return out, top - 1


def _extents(rings: np.ndarray) -> np.ndarray:
    """hull_area, long_side and short_side of rings of one size, all side by side; NaN where the hull has no area."""
    order = np.lexsort((rings[..., 1], rings[..., 0]))
    items = np.take_along_axis(rings, order[..., None], 1)
    (lower, m), (upper, n) = _half_hulls(items), _half_hulls(items[:, ::-1])
    place = np.arange(items.shape[1])
    hull = np.concatenate([np.where((place < m[:, None])[..., None], lower, np.nan), np.where((place < n[:, None])[..., None], upper, np.nan)], 1)
    corner = ~np.isnan(hull[..., 0])
    # Corners first, then the first corner again: it closes the ring and changes neither area nor extent.
    hull = np.take_along_axis(hull, np.argsort(~corner, 1, kind="stable")[..., None], 1)
    corner = np.arange(hull.shape[1]) < corner.sum(1)[:, None]
    hull = np.where(corner[..., None], hull, hull[:, :1])
    after = np.roll(hull, -1, 1)
    x, y = hull[..., 0] - hull[:, :1, 0], hull[..., 1] - hull[:, :1, 1]
    area = np.abs((x * np.roll(y, -1, 1) - np.roll(x, -1, 1) * y).sum(1)) / 2
    angle = np.arctan2(after[..., 1] - hull[..., 1], after[..., 0] - hull[..., 0])[..., None]
    c, s = np.cos(angle), np.sin(angle)
    hx, hy = hull[:, None, :, 0], hull[:, None, :, 1]
    w, h = np.ptp(hx * c + hy * s, axis=2), np.ptp(hy * c - hx * s, axis=2)
    size, long, short = np.where(corner, w * h, np.inf), np.maximum(w, h), np.minimum(w, h)
    long = np.where(size == size.min(1, keepdims=True), long, np.inf)
    short = np.where(long == long.min(1, keepdims=True), short, np.inf)
    return np.where(area[:, None] > 0, np.stack([area, long.min(1), short.min(1)], 1), np.nan)


#: Corners up to which rings of one size are measured side by side, and numbers that one step may hold.
_SIDE_BY_SIDE, _AT_ONCE = 64, 2_000_000


def _extent(rings: pa.Array) -> pa.Array:
    points, counts = _flat(rings)
    starts = np.cumsum(counts) - counts
    out = np.full((len(counts), 3), np.nan)
    for n in np.unique(counts):
        if 3 <= n <= _SIDE_BY_SIDE:
            own = np.flatnonzero(counts == n)
            for part in np.array_split(own, -(-len(own) * 4 * n * n // _AT_ONCE)):
                out[part] = _extents(points[starts[part][:, None] + np.arange(n)])
    for i in np.flatnonzero(np.isnan(out[:, 0])):
        p = points[starts[i] : starts[i] + counts[i]]
        out[i] = (polygon_area(convex_hull(p)), *smallest_rectangle(p))
    return pa.StructArray.from_arrays([pa.array(out[:, i]) for i in range(3)], ["hull_area", "long_side", "short_side"])


def shape_metrics(df: DataFrame, ring: str = "ring") -> DataFrame:
    """df with area, perimeter, compactness, solidity, rectangularity and aspect of closed rings; degenerate rings have nulls."""
    out = df.withColumns({"area": ring_area(F.col(ring)), "perimeter": ring_length(F.col(ring)), "__e": arrow_udf(_extent, "struct<hull_area:double,long_side:double,short_side:double>")(F.col(ring))})
    e = lambda n: F.col(f"__e.{n}")
    return out.withColumns({
        "compactness": F.least(ratio(4 * math.pi * F.col("area"), F.col("perimeter") ** 2), F.lit(1.0)),
        "solidity": ratio(F.col("area"), e("hull_area")), "rectangularity": ratio(F.col("area"), e("long_side") * e("short_side")), "aspect": ratio(e("long_side"), e("short_side")),
    }).drop("__e")


def _opened(points: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rings without the repeated point at their end."""
    starts = np.cumsum(counts) - counts
    last = (starts + counts - 1)[counts > 1]
    twice = last[(points[last] == points[starts[counts > 1]]).all(1)]
    shorter = counts.copy()
    shorter[np.searchsorted(starts, twice, "right") - 1] -= 1
    return np.delete(points, twice, 0), shorter


def _closed(points: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rings with their first point at the end."""
    ends, some = np.cumsum(counts), counts > 0
    return np.insert(points, ends[some], points[(ends - counts)[some]], 0), counts + some


def _cut_side(points: np.ndarray, counts: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All open rings of a batch cut by a line, of which depth is the distance to the inner side."""
    some = counts > 0
    ends = np.cumsum(counts)
    before = np.arange(len(points)) - 1
    before[(ends - counts)[some]] = ends[some] - 1
    inside = depth >= 0
    crosses = inside[before] != inside
    n = crosses.astype(np.int64) + inside
    at = np.cumsum(n) - n
    out = np.empty((int(n.sum()), 2))
    a, b, q, p = depth[before][crosses], depth[crosses], points[before][crosses], points[crosses]
    out[at[crosses]] = q + (a / (a - b))[:, None] * (p - q)
    out[(at + crosses)[inside]] = points[inside]
    ring = np.repeat(np.arange(len(counts)), counts)
    return out, np.bincount(ring, n, len(counts)).astype(np.int64)


def clip_to_box(df: DataFrame, ring: str, west: float, south: float, east: float, north: float) -> DataFrame:
    """Rings cut to a rectangle; those outside go."""

    def cut(rings: pa.Array) -> pa.Array:
        points, counts = _opened(*_flat(rings))
        for axis, limit, sign in ((0, west, 1), (0, east, -1), (1, south, 1), (1, north, -1)):
            points, counts = _cut_side(points, counts, sign * (points[:, axis] - limit))
        return _rings(*_closed(points, counts))

    return df.withColumn(ring, arrow_udf(cut, RING)(F.col(ring))).filter(F.size(ring) >= 4)


def triangles(ring: np.ndarray) -> list[np.ndarray]:
    """A simple ring as triangles, counter-clockwise, by cutting ears; a convex one stays whole."""
    p = [tuple(map(float, q)) for q in (ring[:-1] if len(ring) > 1 and (ring[0] == ring[-1]).all() else ring)]
    cross = lambda o, a, b: (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])
    if sum(p[i - 1][0] * q[1] - q[0] * p[i - 1][1] for i, q in enumerate(p)) < 0:
        p.reverse()
    if all(cross(p[i - 2], p[i - 1], p[i]) >= 0 for i in range(len(p))):
        return [np.array(p)] if len(p) > 2 else []
    out = []
    while len(p) > 3:
        for i in range(len(p)):
            a, b, c = p[i - 1], p[i], p[(i + 1) % len(p)]
            turn = cross(a, b, c)
            if turn == 0 or (turn > 0 and not any(q not in (a, b, c) and min(cross(a, b, q), cross(b, c, q), cross(c, a, q)) >= 0 for q in p)):
                if turn > 0:
                    out.append(np.array([a, b, c]))
                del p[i]
                break
        else:
            raise ValueError("the ring crosses itself")
    return [*out, np.array(p)] if cross(*p) > 0 else out


def clip_to_polygon(df: DataFrame, ring: str, area: list[tuple[float, float]]) -> DataFrame:
    """Rings cut to a polygon of any simple shape: a row for each piece, one piece for each convex part of the polygon that a ring has a share in; rings outside go."""
    parts = triangles(np.array(area, float))

    def cut(rings: pa.Array) -> pa.Array:
        points, counts = _opened(*_flat(rings))
        found = []
        for part in parts:
            p, n = points, counts
            for (x, y), (u, v) in zip(np.roll(part, 1, 0), part, strict=True):
                p, n = _cut_side(p, n, (u - x) * (p[:, 1] - y) - (v - y) * (p[:, 0] - x))
            p, n = _closed(p, n)
            owner, starts = np.repeat(np.arange(len(n)), n), np.cumsum(n) - n
            x, y = (p - p[np.repeat(starts, n)]).T
            twice = np.zeros(len(n))
            inner = np.flatnonzero(owner[:-1] == owner[1:])  # the ring is closed: its last point is its first
            np.add.at(twice, owner[inner], x[inner] * y[inner + 1] - x[inner + 1] * y[inner])
            found.append((p, n, starts, np.flatnonzero((n >= 4) & (np.abs(twice) > 0))))
        # Pieces in the order of rings, and of parts within a ring.
        row = np.concatenate([kept for *_, kept in found])
        order = np.argsort(row, kind="stable")
        shift = np.cumsum([0, *[len(p) for p, *_ in found]])
        starts = np.concatenate([s[kept] + at for (_, _, s, kept), at in zip(found, shift, strict=False)])[order]
        sizes = np.concatenate([n[kept] for _, n, _, kept in found])[order]
        at = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        pieces = _rings(np.concatenate([p for p, *_ in found])[at], sizes)
        per = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(counts)))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(per), pieces)

    return df.withColumn(ring, F.explode(arrow_udf(cut, f"array<{RING}>")(F.col(ring))))


def not_covered(cells: DataFrame, cover: DataFrame, key: str) -> DataFrame:
    """The rule that features must be covered by others: key and number of a feature's cells (row, col) that no feature of the cover has."""
    return cells.join(cover.select("row", "col").distinct(), ["row", "col"], "left_anti").groupBy(key).agg(F.count(F.lit(1)).alias("n_cells"))


def gaps(cells: DataFrame, rows: int, cols: int) -> DataFrame:
    """The rule that features must leave no gaps: regions of cells without a feature that do not reach the edge of the grid, by region, with their cells."""
    spark = cells.sparkSession
    grid = spark.range(rows * cols).select(F.floor(F.col("id") / cols).cast("int").alias("row"), (F.col("id") % cols).cast("int").alias("col"))
    bare = regions(grid.join(cells.select("row", "col").distinct(), ["row", "col"], "left_anti").withColumn("bare", F.lit(True)), "bare")
    edge = (F.col("row") == 0) | (F.col("row") == rows - 1) | (F.col("col") == 0) | (F.col("col") == cols - 1)
    return bare.groupBy("region").agg(F.count(F.lit(1)).alias("n_cells"), F.bool_or(edge).alias("open")).filter(~F.col("open")).drop("open")


def outline_sides(cells: DataFrame, label: str) -> DataFrame:
    """label, x0, y0, x1, y1: the sides of labelled cells (row, col) beyond which another label or none lies, with the label on their right hand."""
    x, y = F.col("col"), F.col("row")
    side = lambda dr, dc, a, b, c, d: F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc"), (x + a).alias("x0"), (y + b).alias("y0"), (x + c).alias("x1"), (y + d).alias("y1"))
    sides = F.array(side(-1, 0, 0, 0, 1, 0), side(0, 1, 1, 0, 1, 1), side(1, 0, 1, 1, 0, 1), side(0, -1, 0, 1, 0, 0))
    each = cells.select(label, "row", "col", F.explode(sides).alias("s")).select(label, (F.col("row") + F.col("s.dr")).alias("row"), (F.col("col") + F.col("s.dc")).alias("col"), "s.x0", "s.y0", "s.x1", "s.y1")
    return each.join(cells.select(label, "row", "col").hint("merge"), [label, "row", "col"], "left_anti").select(label, "x0", "y0", "x1", "y1")


def _way(a: tuple[int, int], b: tuple[int, int]) -> tuple[int, int]:
    return (b[0] > a[0]) - (b[0] < a[0]), (b[1] > a[1]) - (b[1] < a[1])


def _linked(labels: list, chains: list[list[tuple[int, int]]], size: int | None) -> list[tuple[int, list[tuple[int, int]], bool]]:
    """Chains of directed sides joined at the corners inside a tile (at all without a size): number of the first chain, corners, whether closed.

    Where two meet in a corner, the chain turns right, so cells that touch in a corner only stay apart.
    """
    begin: dict[tuple, list[int]] = {}
    for i, chain in enumerate(chains):
        begin.setdefault((labels[i], *chain[0]), []).append(i)
    after, led = [-1] * len(chains), bytearray(len(chains))
    for i, chain in enumerate(chains):
        x, y = chain[-1]
        if size is None or (x % size and y % size):
            found = begin[labels[i], x, y]
            if len(found) > 1:
                dx, dy = _way(chain[-2], chain[-1])
                found = [k for k in found if _way(*chains[k][:2]) == (-dy, dx)]
            after[i] = found[0]
            led[found[0]] = 1
    out, seen = [], bytearray(len(chains))
    for first in (*[i for i in range(len(chains)) if not led[i]], *range(len(chains))):
        if seen[first]:
            continue
        points, i = list(chains[first][:1]), first
        while i >= 0 and not seen[i]:
            seen[i] = 1
            points += chains[i][1:]
            i = after[i]
        closed = i == first
        corner = [p for a, p, b in zip(points, points[1:], points[2:], strict=False) if _way(a, p) != _way(p, b)]
        if closed:
            corner = corner if _way(points[-2], points[-1]) == _way(*points[:2]) else [points[0], *corner]
            k = corner.index(min(corner))
            points = [*corner[k:], *corner[: k + 1]]
        else:
            points = [points[0], *corner, points[-1]]
        out.append((first, points, closed))
    return out


#: Sides of the tiles in which outlines are linked, each a multiple of the one before; at last a label's open chains meet.
_OUTLINE_TILES = (128, 2048, 32768, None)


def outlines(cells: DataFrame, label: str, least: int = 1, tiles: tuple[int | None, ...] = _OUTLINE_TILES) -> DataFrame:
    """label, ring (in columns and rows, corners only), outer: the outlines of labelled regions of `least` cells or more, and of the holes in them.

    Sides are linked within tiles; only chains that leave a tile meet those of others, in larger tiles. A
    task holds the sides of one tile, or the corners of chains that are part of long rings.
    """
    kind = cells.schema[label].dataType.simpleString()
    kept = cells.filter(F.col(label).isNotNull())
    if least > 1:
        kept = kept.join(kept.groupBy(label).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") >= least).select(label), label, "left_semi")
    schema = f"{label} {kind}, r long, c long, xs array<long>, ys array<long>, closed boolean"

    def link(size: int | None) -> Callable[[pd.DataFrame], pd.DataFrame]:
        def run(group: pd.DataFrame) -> pd.DataFrame:
            labels = group[label].tolist()
            chains = [list(zip(x.tolist(), y.tolist(), strict=True)) for x, y in zip(group["xs"], group["ys"], strict=True)]
            done = _linked(labels, chains, size)
            first = [i for i, *_ in done]
            part = group[[label, "r", "c"]].iloc[first].reset_index(drop=True)
            return part.assign(xs=[[x for x, _ in p] for _, p, _ in done], ys=[[y for _, y in p] for _, p, _ in done], closed=[c for *_, c in done])

        return run

    x0, y0, dx, dy = F.col("x0"), F.col("y0"), F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    # The cell of a side: it lies on its right hand.
    r, c = F.when((dx == 1) | (dy == 1), y0).otherwise(y0 - 1), F.when((dx == 1) | (dy == -1), x0).otherwise(x0 - 1)
    open_ = outline_sides(kept, label).select(label, r.cast("long").alias("r"), c.cast("long").alias("c"), F.array(x0, F.col("x1")).cast("array<long>").alias("xs"), F.array(y0, F.col("y1")).cast("array<long>").alias("ys"))
    rings = None
    for size in tiles:
        by = [F.floor(F.col("r") / size).alias("__r"), F.floor(F.col("c") / size).alias("__c")] if size else [F.col(label)]
        done = staged(open_.groupBy(*by).applyInPandas(link(size), schema), "outlines")
        closed = done.filter("closed")
        rings = closed if rings is None else rings.unionByName(closed)
        open_ = done.filter("not closed").drop("closed")
        if size is None or open_.isEmpty():
            break
    corners = F.transform(F.arrays_zip("xs", "ys"), lambda p: F.struct(p["xs"].cast("double").alias("x"), p["ys"].cast("double").alias("y")))
    turn = F.aggregate(F.sequence(F.lit(1), F.size("xs") - 1), F.lit(0).cast("long"), lambda s, i: s + F.col("xs")[i - 1] * F.col("ys")[i] - F.col("xs")[i] * F.col("ys")[i - 1])
    return rings.select(label, corners.alias("ring"), (turn > 0).alias("outer"))


def box_ring(west: Column, south: Column, east: Column, north: Column) -> Column:
    corner = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    return F.array(corner(west, south), corner(east, south), corner(east, north), corner(west, north), corner(west, south))


def closed_ring(ring: Column) -> Column:
    """A ring with its first point at the end; one of fewer than three points is null."""
    return F.when(F.size(ring) >= 3, F.when(F.element_at(ring, 1) == F.element_at(ring, -1), ring).otherwise(F.concat(ring, F.slice(ring, 1, 1))))


def buffer_ring(lon: Column, lat: Column, km: float, points: int = 64) -> Column:
    """The circle of all points a distance away on the sphere, as a ring of longitudes and latitudes, clockwise from the north."""
    reach = km * 1000 / EARTH_M
    phi = F.radians(lat)

    def at(i: Column) -> Column:
        turn = i * (2 * math.pi / points)
        there = F.asin(F.sin(phi) * math.cos(reach) + F.cos(phi) * math.sin(reach) * F.cos(turn))
        move = F.atan2(F.sin(turn) * math.sin(reach) * F.cos(phi), math.cos(reach) - F.sin(phi) * F.sin(there))
        return F.struct((lon + F.degrees(move)).alias("x"), F.degrees(there).alias("y"))

    return F.transform(F.concat(F.sequence(F.lit(0), F.lit(points - 1)), F.array(F.lit(0))), at)


def _inside(x: pa.Array, y: pa.Array, rings: pa.Array) -> pa.Array:
    """The even-odd rule on closed rings, all points of a batch side by side."""
    points, counts = _flat(rings)
    owner = np.repeat(np.arange(len(counts)), counts)
    side = np.flatnonzero(owner[:-1] == owner[1:])
    px, py = (v.to_numpy(zero_copy_only=False).astype(float)[owner[side]] for v in (x, y))
    (ax, ay), (bx, by) = points[side].T, points[side + 1].T
    with np.errstate(divide="ignore", invalid="ignore"):
        crosses = ((ay > py) != (by > py)) & (px < (bx - ax) * ((py - ay) / (by - ay)) + ax)
    return pa.array(np.bincount(owner[side], crosses, len(counts)) % 2 == 1)


def rasterize(polygons: DataFrame, cells: DataFrame, ring: str, cell_bucket: float = 16.0) -> DataFrame:
    """Cells (with x, y of their centres) that lie in a polygon: both meet in buckets of the polygon's box, then the even-odd rule decides."""
    b = lambda v: F.floor(v / cell_bucket).cast("int")
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    boxed = polygons.withColumns({"__x0": F.array_min(xs), "__x1": F.array_max(xs), "__y0": F.array_min(ys), "__y1": F.array_max(ys)})
    spread = boxed.withColumn("__bx", F.explode(F.sequence(b(F.col("__x0")), b(F.col("__x1"))))).withColumn("__by", F.explode(F.sequence(b(F.col("__y0")), b(F.col("__y1")))))
    # A polygon stands in few buckets, a bucket may hold most of them: partitions are counted, and the box spares most of the rule's work.
    spread = spread.repartition(int(polygons.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    located = cells.withColumns({"__bx": b(F.col("x")), "__by": b(F.col("y"))})
    near = located.join(spread, ["__bx", "__by"]).filter(F.col("x").between(F.col("__x0"), F.col("__x1")) & F.col("y").between(F.col("__y0"), F.col("__y1")))
    return near.filter(arrow_udf(_inside, "boolean")(F.col("x"), F.col("y"), F.col(ring))).drop("__bx", "__by", "__x0", "__x1", "__y0", "__y1")


def _simple(rings: pd.Series) -> pd.Series:
    return pd.Series([_is_simple(_points(r)) for r in rings])


def _is_simple(p: np.ndarray) -> bool:
    """A closed ring of which no two sides cross."""
    if len(p) < 4 or not (p[0] == p[-1]).all():
        return False
    a, b = p[:-1], p[1:]
    side = lambda o, s, t: np.sign((s[..., 0] - o[..., 0]) * (t[..., 1] - o[..., 1]) - (s[..., 1] - o[..., 1]) * (t[..., 0] - o[..., 0]))
    for i in range(len(a) - 1):
        j = np.arange(i + 2, len(a) - (i == 0))
        if len(j) and ((side(a[i], b[i], a[j]) * side(a[i], b[i], b[j]) < 0) & (side(a[j], b[j], a[i]) * side(a[j], b[j], b[i]) < 0)).any():
            return False
    return True


def ring_is_valid(ring: Column) -> Column:
    """False for null, open, degenerate and self-crossing rings."""
    return pandas_udf(_simple, "boolean")(ring)


def overlaps(df: DataFrame, key: str, cell: float) -> DataFrame:
    """Pairs of boxes (west, south, east, north) that overlap, by shared grid cells; each pair once.

    Features of one box travel together, so boxes are compared once, and their pairs are dealt to all
    tasks before they are multiplied.
    """
    sides = ["west", "south", "east", "north"]
    b = lambda c: F.floor(F.col(c) / cell).cast("int")
    packed = by_place(df.select(key, *sides), sides, "__m")
    spread = packed.withColumn("__x", F.explode(F.sequence(b("west"), b("east")))).withColumn("__y", F.explode(F.sequence(b("south"), b("north"))))
    a, c = spread.alias("a"), spread.alias("b")
    touch = (F.col("a.west") < F.col("b.east")) & (F.col("b.west") < F.col("a.east")) & (F.col("a.south") < F.col("b.north")) & (F.col("b.south") < F.col("a.north"))
    # Of all cells that both cover, the pair counts in the lowest: no distinct is needed.
    lowest = (F.col("a.__x") == F.greatest(F.floor(F.col("a.west") / cell), F.floor(F.col("b.west") / cell))) & (F.col("a.__y") == F.greatest(F.floor(F.col("a.south") / cell), F.floor(F.col("b.south") / cell)))
    whole = lambda t: F.struct(*[F.col(f"{t}.{n}") for n in (*sides, "__m")])
    pairs = a.join(c, (F.col("a.__x") == F.col("b.__x")) & (F.col("a.__y") == F.col("b.__y")) & touch & lowest & (whole("a") <= whole("b")))
    dealt = pairs.select(F.col("a.__m").alias("l"), F.col("b.__m").alias("r"), (whole("a") == whole("b")).alias("same")).repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    both = dealt.withColumn("l", F.explode("l")).withColumn("r", F.explode("r")).select("same", F.col(f"l.{key}").alias("l"), F.col(f"r.{key}").alias("r"))
    return both.filter((F.col("l") < F.col("r")) | (~F.col("same") & (F.col("l") > F.col("r")))).select(F.least("l", "r").alias("left_id"), F.greatest("l", "r").alias("right_id"))
