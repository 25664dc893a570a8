"""Operators whose work must follow their input, also where many rows share a place, a shape or a cell."""

import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from gridloom.operators import composites, features, geometry, raster
from gridloom.plans.catalog import REGISTRY
from gridloom.sources import files


def _km(a, b):
    (lon1, lat1), (lon2, lat2) = a, b
    h = math.sin(math.radians(lat2 - lat1) / 2) ** 2 + math.cos(math.radians(lat1)) * math.cos(math.radians(lat2)) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 2 * 6371.0088 * math.asin(min(math.sqrt(h), 1.0))


def test_rings_of_crowded_places(spark):
    """A thousand points share a place: the rows of a place travel together, in several parts, and none is lost."""
    centres = [(i, *[(0.0, 0.0), (3.0, 1.0), (179.5, 88.0)][i % 3]) for i in range(12)] + [(12, None, 1.0)]
    points = [(i, "ab"[i % 2], *[(0.0, 0.1), (4.0, 1.0), (-179.0, 87.5), (90.0, -40.0)][i % 4]) for i in range(4400)] + [(4400, "a", 1.0, None)]
    c, p = spark.createDataFrame(centres, "centre_id int, lon double, lat double"), spark.createDataFrame(points, "id int, layer string, lon double, lat double")
    want = {}
    for i, *at in centres[:-1]:
        for j, layer, *to in points[:-1]:
            km = _km(at, to)
            if km <= 500:
                want[i, j] = (1 if km <= 200 else 2, layer, km)
    rows = features.ring_join(c, p, [200.0, 500.0])
    assert rows.columns == ["centre_id", "lon", "lat", "id", "layer", "p_lon", "p_lat", "distance_km", "ring"]
    assert {(r.centre_id, r.id): (r.ring, r.layer) for r in rows.collect()} == {k: v[:2] for k, v in want.items()} and rows.count() == len(want)
    assert features.by_place(p, ["lon", "lat"], "m", 100).count() == 44

    totals = Counter((i, ring, layer) for (i, _), (ring, layer, _) in want.items())
    got = features.ring_counts(c, p, [200.0, 500.0], "centre_id", "id", "layer").collect()
    assert {(r.centre_id, r.ring, r.layer): r.n_total for r in got} == totals and len(got) == len(totals)
    for r in got:
        own = sorted((km, j) for (i, j), (ring, layer, km) in want.items() if (i, ring, layer) == (r.centre_id, r.ring, r.layer))
        assert r.nearest == [j for _, j in own[:3]]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_gaps_are_filled_without_a_broadcast(spark):
    cells = spark.range(400).select((F.col("id") / 20).cast("int").alias("row"), (F.col("id") % 20).cast("int").alias("col"), F.when(F.col("id") % 5 != 0, F.col("id") * 1.0).alias("v"))
    filled = raster.fill_gaps(cells, "v", 3, 1)
    assert filled.filter("v is null").isEmpty() and "Broadcast" not in _plan(filled)


def test_sensors_that_agree_in_full(spark):
    """A percentile of 0 gives the least weight, as in the SQL of the query."""
    rows = spark.createDataFrame([(0.04, 0.04), (0.03, 0.05), (None, 0.02), (0.01, None)], "a double, b double")
    fused = [r[0] for r in rows.select(F.round(composites.fuse_sensors(F.col("a"), F.col("b"), F.lit(0.0)), 6)).collect()]
    assert fused == [0.04, 0.048, 0.02, 0.01]


def test_regions_over_tiles(spark):
    """Regions that wind through many tiles, cells of negative numbers too; nothing is gathered for a broadcast."""
    cells = {(r, c) for r in range(-9, 30) for c in range(-7, 21) if (r * 7 + c * 5 + r * c) % 3}
    df = spark.createDataFrame([(r, c, True) for r, c in cells], "row int, col int, set boolean")
    for eight in (False, True):
        steps = [(0, 1), (1, 0), (0, -1), (-1, 0)] + ([(1, 1), (1, -1), (-1, 1), (-1, -1)] if eight else [])
        want = {}
        for cell in sorted(cells):
            stack = [] if cell in want else [cell]
            while stack:
                at = stack.pop()
                if at in cells and at not in want:
                    want[at] = cell[0] * 2**31 + cell[1]
                    stack += [(at[0] + a, at[1] + b) for a, b in steps]
        labels = raster.regions(df, "set", eight, size=4)
        assert "Broadcast" not in _plan(labels)
        assert {(r.row, r.col): r.region for r in labels.collect()} == want


def test_outlines_over_tiles(spark):
    """Outlines linked in tiles of 4 and 8 cells are those of one tile, rings in rings and touching corners too."""
    cells = {(r, c): 1 + ((r // 5 + c // 4) % 2 if r < 20 else (r * 7 + c * 3) % 3) for r in range(-3, 30) for c in range(-2, 25) if (r, c) not in {(2, 2), (3, 3)}}
    df = spark.createDataFrame([(r, c, k) for (r, c), k in cells.items()], "row int, col int, label int")
    found = [sorted((o.label, o.outer, [(p.x, p.y) for p in o.ring]) for o in geometry.outlines(df, "label", tiles=tiles).collect()) for tiles in ((None,), (4, 8, None))]
    assert found[0] == found[1]
    for label in (1, 2, 3):
        own = [geometry.polygon_area(np.array(ring)) * (1 if outer else -1) for kind, outer, ring in found[1] if kind == label]
        assert sum(own) == sum(k == label for k in cells.values())


def test_shapes_of_many_rings_at_once(spark):
    rng = np.random.default_rng(5)
    rings = [[(float(x), float(y)) for x, y in rng.integers(0, 9, (n, 2))] for n in (3, 4, 6, 6, 9, 70) for _ in range(8)] + [[(1.0, 1.0)] * 5, [(0.0, 0.0), (1.0, 1.0), (2.0, 2.0), (0.0, 0.0)]]
    df = spark.createDataFrame([(i, [*r, r[0]]) for i, r in enumerate(rings)] + [(99, None)], f"id int, ring {geometry.RING}")
    got = {r.id: r for r in geometry.shape_metrics(df).collect()}
    for i, r in enumerate(rings):
        p = np.array([*r, r[0]])
        hull, (long, short) = geometry.polygon_area(geometry.convex_hull(p)), geometry.smallest_rectangle(p)
        want = [a / b if b else None for a, b in ((got[i].area, hull), (got[i].area, long * short), (long, short))]
        assert all((a is None) == (b is None) and (a is None or abs(a - b) < 1e-9) for a, b in zip((got[i].solidity, got[i].rectangularity), want, strict=False)), i
    assert got[99].solidity is None


def test_overlaps_of_crowded_boxes(spark):
    boxes = [(i, float(i % 3 * 2), 0.0, float(i % 3 * 2 + 3), 3.0) for i in range(1700)]
    df = spark.createDataFrame(boxes, "id int, west double, south double, east double, north double")
    want = sum(abs(i % 3 - j % 3) < 2 for i in range(1700) for j in range(i))
    found = geometry.overlaps(df, "id", 2.0)
    assert found.count() == found.distinct().count() == want and found.filter("left_id >= right_id").isEmpty()


def test_pages_come_in_few_waves(spark, monkeypatch):
    waves = []
    monkeypatch.setattr(files, "staged", lambda df, what, plain=files.staged: waves.append(df.rdd.getNumPartitions()) or plain(df, what))
    rows = files.paged(spark, lambda o, n: [{"i": i} for i in range(o, min(o + n, 1234))], None, 10, "i long", wave=2)
    assert sorted(r.i for r in rows.collect()) == list(range(1234)) and len(waves) <= 8 and max(waves) <= 2


def test_snapshots_are_compared_in_one_pass(spark):
    a = spark.createDataFrame([("n", 1), ("n", 1), ("n", 2), (None, 5)], "type string, id int")
    b = spark.createDataFrame([("n", 2), ("n", 3), ("n", 3), (None, 5)], "type string, id int")
    changes = features.snapshot_diff(a, b, ["type", "id"])
    assert sorted(map(tuple, changes.collect()), key=repr) == sorted([("n", 3, "added"), ("n", 1, "removed"), (None, 5, "added"), (None, 5, "removed")], key=repr)
    assert "Join" not in _plan(changes)


def test_noise_samples_are_dealt_before_they_are_drawn(spark, tmp_path):
    row = "1L l_orderkey, cast(id as int) l_linenumber, id l_partkey, id l_suppkey, date'1995-01-01' l_shipdate, 'R' l_returnflag, 0.05D l_discount, 0.04D l_tax, 5D l_quantity"
    spark.range(40).selectExpr(*row.split(", ")).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    plan = REGISTRY.queries["a36_noise_samples"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.index("Generate") < plan.index("Exchange")
