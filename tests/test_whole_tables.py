"""Queries cover the whole of their tables, also beyond the sizes of the smallest ones."""

import math
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from gridloom.plans.catalog import REGISTRY

N_PARTS = 3000


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    """A grid of 60 rows of 50 columns, and its heights by cell."""
    folder = str(tmp_path_factory.mktemp("parts"))
    k = F.col("id")
    df = spark.range(N_PARTS).select(k.alias("p_partkey"), (F.lit(900.0) + (k * 7919) % 1013).alias("p_retailprice"), (1 + k % 50).cast("int").alias("p_size"))
    df.write.parquet(f"{folder}/part.parquet")
    return folder, {divmod(r.p_partkey, 50): r.p_retailprice + r.p_size for r in df.collect()}


def test_regions_of_the_whole_grid(spark, parts):
    folder, z = parts
    todo, want = sorted(c for c, v in z.items() if math.floor(v) % 3), {}
    for cell in todo:
        if cell in want:
            continue
        stack = [cell]
        while stack:
            r, c = at = stack.pop()
            if at not in want and at in z and math.floor(z[at]) % 3:
                want[at] = cell[0] * 2**31 + cell[1]
                stack += [(r - 1, c), (r + 1, c), (r, c - 1), (r, c + 1)]
    got = {(r.row, r.col): r.region for r in REGISTRY.queries["m1_regions"](spark, folder).collect()}
    assert got == want and max(r for r, _ in got) == 59
    sizes = defaultdict(int)
    for region in want.values():
        sizes[region] += 1
    small = {r.region: r.n for r in REGISTRY.queries["m2_small_regions"](spark, folder).collect()}
    assert small == {k: n for k, n in sizes.items() if n >= 4} and max(small) >= 40 * 2**31
    assert {r.label: r.area for r in REGISTRY.queries["m3_region_shapes"](spark, folder).collect()} == {i: 60 * len(range(3 * i, min(3 * i + 3, 50))) for i in range(17)}


def test_rings_of_all_ways(spark, tmp_path):
    spark.range(100).select(F.col("id").alias("p_partkey"), (1 + F.col("id") % 50).cast("int").alias("p_size"), F.lit(1.0).alias("p_retailprice")).write.parquet(f"{tmp_path}/part.parquet")
    lines = [(way, n, (way + 3 * n) % 100, n) for way in (1, 2999, 3000, 3001, 70000) for n in range(7)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    want = {}
    for way in {x[0] for x in lines}:
        known = [p for w, _, p, _ in lines if w == way and p % 5]
        want[way] = (len(known), float(sum((1 + p % 50) * (i + 1) for i, p in enumerate(known))))
    got = {r.way_id: (r.n, r.digest) for r in REGISTRY.queries["s21_building_rings"](spark, str(tmp_path)).collect()}
    assert got == {k: v for k, v in want.items() if v[0] >= 4} and max(got) == 70000


def test_report_of_all_sites(spark, tmp_path):
    k = F.col("id")
    spark.range(300).select((k % 60).alias("user_id"), F.expr("timestamp'2024-01-01' + make_interval(0, 0, 0, cast(id % 7 as int))").alias("ts"), F.lit("purchase").alias("event_type"), (k / 3).alias("value")).write.parquet(f"{tmp_path}/events.parquet")
    report = REGISTRY.queries["k14_gauge_report"](spark, str(tmp_path))
    around = REGISTRY.queries["j5_readings_around_dates"](spark, str(tmp_path))
    keys = lambda df: sorted(map(tuple, df.select("day", "site_id", "window").collect()))
    assert keys(report) == keys(around) and {r.site_id for r in report.collect()} == set(range(60))


def test_all_rings_are_rasterized(spark, parts):
    want = {k: (2 + k % 7) + (3 + k % 5) - 1 for k in range(N_PARTS)}  # an L of width 1
    assert {r.id: r.cells for r in REGISTRY.queries["j9_rasterize"](spark, parts[0]).collect()} == want


def test_tiles_of_a_long_grid(spark, tmp_path):
    rows, cols = 1640, 50
    spark.range(rows * cols).select(F.col("id").alias("p_partkey"), (F.col("id") % 997).cast("double").alias("p_retailprice"), F.lit(1).alias("p_size")).write.parquet(f"{tmp_path}/part.parquet")
    span = lambda t, size: range(max(t * 16 - 4, 0), min(t * 16 + 20, size))
    inner = lambda t, size: len(range(t * 16, min(t * 16 + 16, size)))
    tiles = lambda size: [t for t in range(size // 16 + 2) if span(t, size)]
    want = {(a, b): (len(span(a, rows)) * len(span(b, cols)), inner(a, rows) * inner(b, cols)) for a in tiles(rows) for b in tiles(cols)}
    got = {(r.tile_row, r.tile_col): (r.n, r.n_inner) for r in REGISTRY.queries["t2_halo_tiles"](spark, str(tmp_path)).collect()}
    assert got == want and max(a for a, _ in got) > 99
    # Inside a tile, off every halo, a cell has that tile alone: its height and the number of the tile.
    mosaic = {(r.row, r.col): r.z for r in REGISTRY.queries["a34_blended_mosaic"](spark, str(tmp_path)).collect()}
    assert len(mosaic) == rows * cols
    assert all(abs(mosaic[t * 16 + 8, 24] - ((t * 16 + 8) * cols + 24) % 997 - 1 - t) < 1e-5 for t in range(rows // 16))
