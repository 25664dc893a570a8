"""Neighbourhood kernels without a relational form, as numpy on halo tiles.

apply_tiles() deals the cells to tiles with a halo as wide as the kernel reaches, runs a function on
each tile's dense array, and keeps the inner cells. A tile's size bounds what one task holds.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.raster import halo_tiles

Kernel = Callable[[np.ndarray], np.ndarray]


def apply_tiles(df: DataFrame, value: str, kernel: Kernel, halo: int, size: int = 256, result: str = "result") -> DataFrame:
    """row, col, result: kernel over the grid (row, col, value). Cells missing in a tile's rectangle are NaN; at the raster's edge the tile ends, so the kernel pads as it sees fit."""

    def run(tile: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = tile["row"].min(), tile["col"].min()
        grid = np.full((tile["row"].max() - r0 + 1, tile["col"].max() - c0 + 1), np.nan)
        grid[tile["row"] - r0, tile["col"] - c0] = tile[value].astype(float)
        out = kernel(grid)
        inner = tile[tile["inner"]]
        return pd.DataFrame({"row": inner["row"], "col": inner["col"], result: out[inner["row"] - r0, inner["col"] - c0]})

    tiles = halo_tiles(df.select("row", "col", value), size, halo)
    return tiles.groupBy("tile_row", "tile_col").applyInPandas(run, f"row int, col int, {result} double")


def _axis(grid: np.ndarray, weights: np.ndarray, axis: int) -> np.ndarray:
    k = len(weights) // 2
    padded = np.pad(grid, [(k, k) if a == axis else (0, 0) for a in range(2)], "symmetric")
    n = grid.shape[axis]
    return sum(w * np.take(padded, range(i, i + n), axis) for i, w in enumerate(weights))


def gaussian(sigma: float, truncate: float = 4.0) -> Kernel:
    """Gaussian smoothing; of a neighbourhood with missing cells the present ones count, with their weights."""
    k = int(truncate * sigma + 0.5)
    weights = np.exp(-0.5 * (np.arange(-k, k + 1) / sigma) ** 2)
    weights /= weights.sum()

    def run(grid: np.ndarray) -> np.ndarray:
        both = lambda x: _axis(_axis(x, weights, 0), weights, 1)
        there = ~np.isnan(grid)
        if there.all():
            return both(grid)
        with np.errstate(invalid="ignore", divide="ignore"):
            return both(np.where(there, grid, 0.0)) / both(there.astype(float))

    return run


def line_element(length: int, angle: int) -> list[tuple[int, int]]:
    """Offsets of a line of cells at 0, 45, 90 or 135 degrees."""
    step = {0: (0, 1), 45: (-1, 1), 90: (1, 0), 135: (1, 1)}[angle]
    return [(step[0] * i, step[1] * i) for i in range(-(length // 2), length - length // 2)]


def disk_element(radius: int) -> list[tuple[int, int]]:
    return [(r, c) for r in range(-radius, radius + 1) for c in range(-radius, radius + 1) if r * r + c * c <= radius * radius]


def _extreme(grid: np.ndarray, element: list[tuple[int, int]], pick: Callable, edge: float) -> np.ndarray:
    k = max(max(abs(r), abs(c)) for r, c in element)
    padded = np.pad(grid, k, constant_values=edge)
    h, w = grid.shape
    return pick(np.stack([padded[k + r : k + r + h, k + c : k + c + w] for r, c in element]), axis=0)


def grey_opening(element: list[tuple[int, int]]) -> Kernel:
    mirrored = [(-r, -c) for r, c in element]
    return lambda grid: _extreme(_extreme(grid, element, np.nanmin, np.inf), mirrored, np.nanmax, -np.inf)


def grey_closing(element: list[tuple[int, int]]) -> Kernel:
    mirrored = [(-r, -c) for r, c in element]
    return lambda grid: _extreme(_extreme(grid, element, np.nanmax, -np.inf), mirrored, np.nanmin, np.inf)


def building_index(lengths: tuple[int, ...] = (3, 5, 9, 15), angles: tuple[int, ...] = (0, 45, 90, 135)) -> Kernel:
    """Mean white top-hat over lines of several lengths and angles; its reach is twice the longest line."""

    def run(grid: np.ndarray) -> np.ndarray:
        hats = [grid - grey_opening(line_element(n, a))(grid) for n in lengths for a in angles]
        return np.mean(hats, axis=0)

    return run


def attribute_profile(radii: tuple[int, ...] = (3, 5, 8, 12)) -> Kernel:
    """Mean of white and black top-hats over disks."""

    def run(grid: np.ndarray) -> np.ndarray:
        hats = [h for r in radii for h in (grid - grey_opening(disk_element(r))(grid), grey_closing(disk_element(r))(grid) - grid)]
        return np.mean(hats, axis=0)

    return run


def edge_density(sigma: float = 1.5, spread: float = 5.0, high: float = 0.2, low: float = 0.1, strongest: float | None = None) -> Kernel:
    """Thinned gradient edges with two thresholds (shares of the strongest gradient), smoothed.

    On tiles the strongest gradient of the whole raster is to be given; without it the grid's own counts.
    """

    def run(grid: np.ndarray) -> np.ndarray:
        smooth = gaussian(sigma)(grid)
        gy, gx = np.gradient(smooth)
        size = np.hypot(gx, gy)
        sector = np.round(np.degrees(np.arctan2(gy, gx)) / 45).astype(int) % 4
        padded = np.pad(size, 1)
        h, w = size.shape
        keep = np.zeros_like(size, bool)
        for s, (r, c) in enumerate(((0, 1), (1, 1), (1, 0), (1, -1))):
            ahead, behind = padded[1 + r : 1 + r + h, 1 + c : 1 + c + w], padded[1 - r : 1 - r + h, 1 - c : 1 - c + w]
            keep |= (sector == s) & (size >= ahead) & (size >= behind)
        top = (np.nanmax(size) if strongest is None else strongest) or 1.0
        strong, weak = keep & (size >= high * top), keep & (size >= low * top)
        while True:
            grown = weak & (_extreme(strong.astype(float), disk_element(1) + [(1, 1), (1, -1), (-1, 1), (-1, -1)], np.max, 0) > 0)
            if (grown == strong).all():
                break
            strong = grown
        return gaussian(spread)(strong.astype(float))

    return run


def distance(limit: int = 30) -> Kernel:
    """Euclidean distance to the nearest set cell, up to the limit: column distances first, then rows over them."""

    def run(grid: np.ndarray) -> np.ndarray:
        unset = ~(np.nan_to_num(grid) > 0)
        far = float(limit + 1)
        column = np.where(unset, far, 0.0)
        for i in range(1, len(column)):
            column[i] = np.minimum(column[i], column[i - 1] + 1)
        for i in range(len(column) - 2, -1, -1):
            column[i] = np.minimum(column[i], column[i + 1] + 1)
        out = np.full(grid.shape, np.inf)
        padded = np.pad(column, ((0, 0), (limit, limit)), constant_values=far * 2)
        for d in range(-limit, limit + 1):
            out = np.minimum(out, np.hypot(padded[:, limit + d : limit + d + grid.shape[1]], d))
        return np.minimum(out, far)

    return run


def pyramid_down(grid: np.ndarray) -> np.ndarray:
    """A level of a Gaussian pyramid: smoothed, every second cell."""
    return gaussian(1.0)(grid)[::2, ::2]


def bicubic_up(grid: np.ndarray, factor: int) -> np.ndarray:
    """Cubic convolution to factor times the size."""

    def weight(t: np.ndarray, a: float = -0.5) -> np.ndarray:
        t = np.abs(t)
        return np.where(t <= 1, (a + 2) * t**3 - (a + 3) * t**2 + 1, np.where(t < 2, a * (t**3 - 5 * t**2 + 8 * t - 4), 0))

    def along(x: np.ndarray) -> np.ndarray:
        at = (np.arange(len(x) * factor) + 0.5) / factor - 0.5
        base = np.floor(at).astype(int)
        return sum(weight(at - base - o)[:, None] * x[np.clip(base + o, 0, len(x) - 1)] for o in (-1, 0, 1, 2))

    return along(along(grid).T).T


def peaks(grid: np.ndarray, apart: int, least: float) -> list[tuple[int, int]]:
    """Cells that are the largest within `apart` of themselves and above a bound; the first of equal neighbours."""
    best = _extreme(grid, [(r, c) for r in range(-apart, apart + 1) for c in range(-apart, apart + 1)], np.max, -np.inf)
    out: list[tuple[int, int]] = []
    for r, c in np.argwhere((grid == best) & (grid > least)).tolist():
        if all(max(abs(r - y), abs(c - x)) > apart for y, x in out):
            out.append((r, c))
    return out


def crowns(sigma: float = 1.0, apart: int = 3, least: float = 0.3, by_place: bool = False) -> Kernel:
    """Crown numbers (0 is none): a watershed that floods a smoothed grid from its peaks, highest cells first. by_place: the place of the peak in the grid, plus 1, is the number."""

    def run(grid: np.ndarray) -> np.ndarray:
        smooth = np.nan_to_num(gaussian(sigma)(grid), nan=-np.inf)
        label = np.zeros(grid.shape, np.int64)
        queue: list[tuple[float, int, int, int]] = []
        for i, (r, c) in enumerate(peaks(smooth, apart, least), 1):
            heapq.heappush(queue, (-smooth[r, c], r * grid.shape[1] + c + 1 if by_place else i, r, c))
        while queue:
            _, i, r, c = heapq.heappop(queue)
            if label[r, c]:
                continue
            label[r, c] = i
            for y, x in ((r - 1, c), (r + 1, c), (r, c - 1), (r, c + 1)):
                if 0 <= y < grid.shape[0] and 0 <= x < grid.shape[1] and not label[y, x] and smooth[y, x] > least:
                    heapq.heappush(queue, (-smooth[y, x], i, y, x))
        return label if by_place else label.astype(float)

    return run


def superpixels(side: int = 8, compactness: float = 10.0, rounds: int = 5) -> Callable[..., np.ndarray]:
    """Segment numbers by k-means over value and place, each centre within reach of its neighbourhood; missing cells get 0.

    Centres start in cells of `side` counted from the raster's corner (row0 and col0 are the grid's place
    in it), and a segment is named by its centre's first place in the grid, plus 1. What a cell gets depends on cells
    within `superpixel_reach` of it.
    """

    def run(grid: np.ndarray, row0: int = 0, col0: int = 0) -> np.ndarray:
        there = ~np.isnan(grid)
        filled = np.where(there, grid, 0.0)
        h, w = filled.shape
        first = lambda at, n: np.arange(at - at % side + side // 2 - at, n, side)
        rows, cols = ([x for x in first(at, n).tolist() if 0 <= x] or [min(side // 2, n - 1)] for at, n in ((row0, h), (col0, w)))
        start = np.array([(r, c) for r in rows for c in cols])
        name = start[:, 0] * w + start[:, 1] + 1
        centre = start.astype(float)
        value = filled[start[:, 0], start[:, 1]]
        label = np.zeros((h, w), np.int64)
        yy, xx = np.indices((h, w))
        for _ in range(rounds):
            best = np.full((h, w), np.inf)
            for k, ((r, c), v) in enumerate(zip(centre, value, strict=True)):
                y0, y1, x0, x1 = max(int(r) - side, 0), int(r) + side + 1, max(int(c) - side, 0), int(c) + side + 1
                d = (filled[y0:y1, x0:x1] - v) ** 2 + (compactness / side) ** 2 * ((yy[y0:y1, x0:x1] - r) ** 2 + (xx[y0:y1, x0:x1] - c) ** 2)
                closer = d < best[y0:y1, x0:x1]
                best[y0:y1, x0:x1][closer] = d[closer]
                label[y0:y1, x0:x1][closer] = k
            flat = label.ravel()
            count = np.bincount(flat, there.ravel().astype(float), len(centre))
            used = count > 0
            for target, weight in ((value, filled), (centre[:, 0], yy), (centre[:, 1], xx)):
                target[used] = np.bincount(flat, np.where(there, weight, 0).ravel().astype(float), len(centre))[used] / count[used]
        return np.where(there, name[label], 0)

    return run


def superpixel_reach(side: int, rounds: int) -> int:
    """In each round a cell's segment depends on centres within `side`, and these on cells within `side` of them and on their own move."""
    return 3 * side * rounds


def label_tiles(df: DataFrame, value: str, kernel: Callable[..., np.ndarray], halo: int, size: int, result: str, placed: bool = False) -> DataFrame:
    """row, col, result: kernels that number segments by the place of one of their cells (plus 1), on halo tiles.

    A segment is known by that cell's place in the raster, as row * 2**31 + col + 1, so tiles agree on it
    without merging, as long as the halo holds what a cell's segment depends on. placed: the kernel takes the tile's first row and column too.
    """

    def run(tile: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = int(tile["row"].min()), int(tile["col"].min())
        grid = np.full((tile["row"].max() - r0 + 1, tile["col"].max() - c0 + 1), np.nan)
        grid[tile["row"] - r0, tile["col"] - c0] = tile[value].astype(float)
        label = kernel(grid, r0, c0) if placed else kernel(grid)
        r, c = np.divmod(label - 1, grid.shape[1])
        name = np.where(label > 0, (r + r0) * (1 << 31) + c + c0 + 1, 0)
        inner = tile[tile["inner"]]
        return pd.DataFrame({"row": inner["row"], "col": inner["col"], result: name[inner["row"] - r0, inner["col"] - c0]})

    tiles = halo_tiles(df.select("row", "col", value), size, halo)
    return tiles.groupBy("tile_row", "tile_col").applyInPandas(run, f"row int, col int, {result} long")
