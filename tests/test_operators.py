"""Properties of operators on small grids and tables."""

import struct
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import composites, features, geometry, kernels, landcover, learning, raster
from gridloom.sources import files
from gridloom.streaming import monitor

C = F.col


def grid(spark, a, name="z"):
    a = np.asarray(a)
    return spark.createDataFrame([(r, c, None if v is None or v != v else v.item()) for (r, c), v in np.ndenumerate(a)], f"row int, col int, {name} {'boolean' if a.dtype == bool else 'double' if a.dtype.kind == 'f' else 'int'}")


def back(df, name, shape):
    out = np.full(shape, np.nan, object)
    for r in df.collect():
        out[r.row, r.col] = r[name]
    return out


@pytest.mark.parametrize("mode,pad", [("reflect", "symmetric"), ("nearest", "edge")])
def test_box_pads_like_numpy(spark, mode, pad):
    a = np.random.default_rng(0).random((6, 7))
    p = np.pad(a, 2, pad)
    want = np.array([[p[r : r + 5, c : c + 5].mean() for c in range(7)] for r in range(6)])
    assert np.allclose(back(raster.box_mean_variance(grid(spark, a), "z", 2, mode), "mean", a.shape).astype(float), want)


def test_horn_and_gradient_of_a_plane(spark):
    r, c = np.indices((5, 6))
    a = 3.0 * c + 4.0 * r
    slope = back(raster.horn(grid(spark, a), "z", 1.0), "slope", a.shape).astype(float)
    assert np.allclose(slope[1:-1, 1:-1], np.degrees(np.arctan(5)))
    g = raster.gradient(grid(spark, a), "z")
    assert {(x.dx, x.dy) for x in g.collect()} == {(3.0, 4.0)}


def test_morphology_identities(spark):
    m = np.zeros((9, 9), bool)
    m[2:6, 2:7], m[7, 7] = True, True
    opened = back(raster.opening(grid(spark, m, "s"), "s"), "s", m.shape).astype(bool)
    assert (opened[2:6, 2:7]).all() and not opened[7, 7] and (opened <= m).all()
    closed = back(raster.closing(grid(spark, m, "s"), "s"), "s", m.shape).astype(bool)
    assert (closed[1:-1, 1:-1] >= m[1:-1, 1:-1]).all()


def test_lee_keeps_a_flat_field(spark):
    assert np.allclose(back(raster.lee(grid(spark, np.full((5, 5), 7.0)), "z", 1), "filtered", (5, 5)).astype(float), 7)


def test_gap_fill_and_majority(spark):
    a = np.arange(25.0).reshape(5, 5)
    a[2, 2] = np.nan
    assert back(raster.fill_gaps(grid(spark, a), "z", 1, 1), "z", a.shape)[2, 2] == 12.0
    k = np.zeros((3, 3), int)
    k[1, 1] = 5
    assert (back(raster.majority(grid(spark, k, "k"), "k"), "k", k.shape) == 0).all()


@pytest.mark.parametrize("eight,want", [(False, 3), (True, 2)])
def test_regions(spark, eight, want):
    m = np.array([[1, 1, 0, 0, 1], [0, 1, 0, 0, 1], [1, 0, 0, 0, 1], [0, 0, 1, 1, 1]], bool)
    got = raster.regions(grid(spark, m, "s"), "s", eight)
    assert got.count() == m.sum() and got.select("region").distinct().count() == want


def test_tiles_cover_and_blend_to_the_input(spark):
    t = raster.tile_grid(40, 50, 16, 4, spark.range(1)).collect()
    assert sum((x.row1 - x.row0) * (x.col1 - x.col0) for x in t) == 2000
    a = np.random.default_rng(1).random((20, 20))
    tiles = raster.halo_tiles(grid(spark, a), 8, 2)
    assert tiles.filter("inner").count() == 400
    assert np.allclose(back(raster.blend(tiles, ["z"], 8, 2), "z", a.shape).astype(float), a)


def test_kernels_do_not_see_tile_seams(spark):
    a = np.random.default_rng(2).random((40, 40))
    one = back(kernels.apply_tiles(grid(spark, a), "z", kernels.building_index((3, 5)), 10, size=100), "result", a.shape).astype(float)
    many = back(kernels.apply_tiles(grid(spark, a), "z", kernels.building_index((3, 5)), 10, size=16), "result", a.shape).astype(float)
    assert np.allclose(one, many)
    mask = (a > 0.97).astype(float)
    dist = kernels.distance(6)(mask)
    want = [[min([np.hypot(r - y, c - x) for y, x in np.argwhere(mask > 0)] + [7]) for c in range(40)] for r in range(40)]
    assert np.allclose(dist, np.minimum(want, 7))
    assert kernels.bicubic_up(np.full((4, 5), 3.0), 2).shape == (8, 10) and np.allclose(kernels.bicubic_up(np.full((4, 5), 3.0), 2), 3)
    assert kernels.edge_density()(np.repeat([[0.0] * 10 + [1.0] * 10], 20, axis=0)).argmax(axis=1).mean() == pytest.approx(9.5, abs=1)


def test_segments_do_not_see_tile_seams(spark):
    rng = np.random.default_rng(8)
    r, c = np.indices((60, 70))
    wave = (np.sin(r / 3.1) * np.cos(c / 2.7) + 1) / 2 + rng.random((60, 70)) * 0.05
    wave[20:23, 30:40] = np.nan
    label = lambda kernel, halo, size, placed=False: back(kernels.label_tiles(grid(spark, wave), "z", kernel, halo, size, "label", placed), "label", wave.shape)
    assert (label(kernels.crowns(by_place=True), 24, 13) == label(kernels.crowns(by_place=True), 24, 200)).all()
    pixels = kernels.superpixels(4, 0.5, 2)
    assert (label(pixels, kernels.superpixel_reach(4, 2), 17, True) == label(pixels, 0, 200, True)).all()
    smooth = [back(kernels.apply_tiles(grid(spark, wave), "z", kernels.gaussian(2.0), 8, size=n), "result", wave.shape).astype(float) for n in (15, 200)]
    assert np.allclose(*smooth, equal_nan=True)
    # A missing neighbourhood counts by what is there: a constant stays constant.
    holes = np.where(rng.random((30, 30)) < 0.3, np.nan, 5.0)
    assert np.allclose(kernels.gaussian(1.5)(holes), 5.0)


def test_outlines_enclose_their_cells(spark):
    rng = np.random.default_rng(5)
    labels = rng.integers(0, 3, (12, 14))
    labels[3:9, 3:9] = 7
    labels[5:7, 5:7] = 1
    cells = spark.createDataFrame([(int(r), int(c), int(v)) for (r, c), v in np.ndenumerate(labels)], "row int, col int, label int")
    got = {}
    for r in geometry.outlines(cells, "label").collect():
        ring = np.array([(p.x, p.y) for p in r.ring])
        assert (ring[0] == ring[-1]).all() and len(set(map(tuple, ring[:-1]))) >= 4
        got[r.label] = got.get(r.label, 0) + (1 if r.outer else -1) * geometry.polygon_area(ring[:-1])
    assert got == {int(v): float((labels == v).sum()) for v in np.unique(labels)}
    seven = [r for r in geometry.outlines(cells, "label").filter("label = 7").collect()]
    assert sorted((r.outer, len(r.ring)) for r in seven) == [(False, 5), (True, 5)]
    assert geometry.outlines(cells, "label", least=1000).count() == 0
    rows = geometry.gaps(cells.filter("label <> 1"), 12, 14).collect()
    assert any(r.n_cells >= 4 and r.region == 5 * 2**31 + 5 for r in rows)


def test_clipping_to_any_polygon(spark):
    star = [(0, 0), (6, 0), (6, 6), (3, 2), (0, 6)]
    assert sum(geometry.polygon_area(t) for t in geometry.triangles(np.array(star, float))) == pytest.approx(24.0)
    assert len(geometry.triangles(np.array([(0, 0), (0, 2), (2, 2), (2, 0), (0, 0)], float))) == 1
    square = lambda x, y, w: [(x, y), (x + w, y), (x + w, y + w), (x, y + w), (x, y)]
    df = spark.createDataFrame([(1, square(1.0, 0.5, 1.0)), (2, square(20.0, 20.0, 1.0)), (3, square(-9.0, -9.0, 30.0)), (4, None)], "id int, ring array<struct<x:double,y:double>>")
    got = {}
    for r in geometry.clip_to_polygon(df, "ring", star).collect():
        got[r.id] = got.get(r.id, 0) + geometry.polygon_area(np.array([(p.x, p.y) for p in r.ring[:-1]]))
    assert got == {1: pytest.approx(1.0), 3: pytest.approx(24.0)}


def test_areas_of_interest(spark):
    df = spark.createDataFrame([(-95.0, 30.0, [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)]), (170.0, -60.0, [(0.0, 0.0), (1.0, 0.0)])], "lon double, lat double, ring array<struct<x:double,y:double>>")
    for r in df.select("lon", "lat", geometry.buffer_ring(C("lon"), C("lat"), 10.0, 16).alias("b"), geometry.closed_ring(C("ring")).alias("c"), geometry.box_ring(C("lon"), C("lat"), C("lon") + 1, C("lat") + 1).alias("box")).collect():
        assert len(r.b) == 17 and r.b[0] == r.b[-1] and len(r.box) == 5
        for p in r.b:
            a = np.radians([r.lat, p.y])
            d = 2 * 6371.0088 * np.arcsin(np.sqrt(np.sin((a[1] - a[0]) / 2) ** 2 + np.cos(a[0]) * np.cos(a[1]) * np.sin(np.radians(p.x - r.lon) / 2) ** 2))
            assert d == pytest.approx(10.0, rel=1e-9)
        assert r.c is None or (len(r.c) == 4 and r.c[0] == r.c[-1])


def test_change_products_need_maps(spark):
    maps = spark.createDataFrame([(p, y, (p * y) % 3) for p in range(6) for y in (2000, 2001, 2003) if (p, y) != (2, 2001)], "px int, year int, class_id int")
    with pytest.raises(ValueError):
        landcover.change_products(maps, ["px"], "year", "class_id", [2000], (2,), 0.09)
    with pytest.raises(ValueError, match="2002"):
        landcover.change_products(maps, ["px"], "year", "class_id", [2000, 2002], (2,), 0.09)
    p = landcover.change_products(maps, ["px"], "year", "class_id", [2003, 2000, 2001], (2,), 0.09)
    steps = {}
    for q in range(6):
        for a, b in ((2000, 2001), (2001, 2003)):
            if q != 2:
                k = (a, b, (q * a) % 3, (q * b) % 3)
                steps[k] = steps.get(k, 0) + 1
    assert {(r.from_year, r.to_year, r.from_class, r.to_class): r.n for r in p["steps"].collect()} == steps
    assert {(r.from_year, r.n) for r in p["intensity"].collect()} == {(2000, 5), (2001, 5)} and p["trajectory"].count() == 6


def test_percentiles_by_ranks(spark, monkeypatch):
    from gridloom.operators import ranks

    rng = np.random.default_rng(9)
    monkeypatch.setattr(ranks, "FEW", 5)
    monkeypatch.setattr(ranks, "BINS", 16)
    for values in (rng.normal(size=3000), rng.integers(0, 7, 500).astype(float), np.full(40, 2.5), np.concatenate((rng.random(200) * 1e-9, [1e12, -1e12])), np.array([3.0]), np.array([1.0, np.nextafter(1.0, 2.0)] * 9)):
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),), (float("inf"),)], "x double")
        assert np.allclose(ranks.percentiles(df, "x", [0.0, 0.02, 0.5, 0.98, 1.0]), np.percentile(values, [0, 2, 50, 98, 100]), rtol=1e-12, atol=0)
    assert ranks.percentiles(spark.createDataFrame([(None,)], "x double"), "x", [0.5]) == [None]


def test_composites(spark):
    rows = [(1, i, 0.1 * i, 0.2, i != 2) for i in range(4)] + [(2, 0, 0.3, 0.3, False)]
    obs = spark.createDataFrame(rows, "px int, t int, a double, b double, clear boolean")
    med = {r.px: r for r in composites.median_composite(obs, ["px"], ["a", "b"]).collect()}
    assert med[1].a == pytest.approx(0.1) and med[1].n_clear == 3 and med[2].a is None and med[2].coverage == 0
    best = composites.best_pixel(obs, ["px"], F.lit(1.0), ["t"]).collect()
    assert [(r.px, r.t) for r in best] == [(1, 0)]
    assert [r.t for r in composites.medoid(obs, ["px"], ["a", "b"], ["t"]).collect()] == [1]
    f = {r.px: r.frequency for r in composites.frequency(obs, ["px"], C("a") > 0.05, C("clear")).collect()}
    assert f == {1: pytest.approx(2 / 3), 2: None}


def test_confusion_of_known_pairs(spark):
    pairs = spark.createDataFrame(list(zip([0, 0, 0, 2, 2, 0], [0, 0, 0, 2, 2, 2], strict=True)), "p int, r int")
    m = landcover.confusion(pairs, "p", "r")
    assert landcover.overall_accuracy(m).first().accuracy == pytest.approx(5 / 6)
    by = {r.class_id: r for r in landcover.class_accuracy(m).collect()}
    assert (by[0].producers, by[0].users) == (1.0, 0.75) and by[2].f1 == pytest.approx(0.8)


def test_flip_flop_and_trends(spark):
    maps = spark.createDataFrame([(p, y, (y % 2) if p == 1 else 3 if y < 2003 else 5) for p in (1, 2) for y in range(2000, 2006)], "px int, year int, k int")
    t = {r.px: r for r in landcover.trajectory(maps, ["px"], "year", "k", (5, 6)).collect()}
    assert t[1].n_changes == 5 and t[1].hotspot and (t[2].trajectory, t[2].n_changes) == (1, 1)
    assert {r.px: r.trend for r in landcover.trend(maps, ["px"], "year", "k").collect()} == {1: 4, 2: 1}
    fixed = landcover.constrain(spark.createDataFrame([(1, 1, 6), (1, 2, 2), (1, 3, 6)], "px int, year int, k int"), ["px"], "year", "k", {6: (6,), 2: (2, 3)})
    assert [r.corrected for r in fixed.orderBy("year").collect()] == [6, 6, 6]


def test_matrix_gains_equal_losses(spark):
    maps = spark.createDataFrame([(i, y, (i * (y - 1999)) % 4) for i in range(50) for y in (2000, 2001)], "px int, year int, k int")
    m = landcover.transitions(maps, ["px"], "year", "k", 2000, 2001)
    assert m.agg(F.sum("n")).first()[0] == 50
    assert landcover.gains_losses(m).agg(F.sum("net")).first()[0] == 0


def test_nearest_year_prefers_the_earlier(spark):
    got = landcover.nearest_year(spark.createDataFrame([(2002,), (2010,)], "a int"), spark.createDataFrame([(2001,), (2003,)], "b int"), "a", "b", 2)
    assert [tuple(r) for r in got.collect()] == [(2002, 2001)]


def test_diffs(spark):
    a, b = spark.createDataFrame([("n", 1), ("n", 2), ("n", 2)], "type string, id int"), spark.createDataFrame([("n", 2), ("n", 3)], "type string, id int")
    assert {tuple(r) for r in features.snapshot_diff(a, b, ["type", "id"]).collect()} == {("n", 3, "added"), ("n", 1, "removed")}
    x, y = spark.createDataFrame([("k", 1), ("k", 2), ("m", 3)], "key string, i int"), spark.createDataFrame([("k", 1), ("k", 2), ("z", 3)], "key string, i int")
    assert {tuple(r) for r in features.consuming_diff(x, y, "key", "i").collect()} == {("k", 1, "unchanged"), ("k", 2, "added"), ("m", 1, "removed"), ("z", 1, "added")}


def test_ring_join_crosses_the_date_line(spark):
    centres, points = spark.createDataFrame([(1, 179.9, 0.0), (2, 0.0, 89.5)], "centre_id int, lon double, lat double"), spark.createDataFrame([(10, -179.9, 0.0), (11, 170.0, 0.0), (12, 180.0, 89.5)], "id int, lon double, lat double")
    assert {(r.centre_id, r.id, r.ring) for r in features.ring_join(centres, points, [50.0, 200.0]).collect()} == {(1, 10, 1), (2, 12, 2)}


def test_schema_edits_and_checks(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "OBJECTID int, name string")
    assert features.delete_fields(df, ["OBJECTID", "name", "x"]).columns == ["OBJECTID"]
    with pytest.raises(ValueError, match="lon"):
        features.require_columns(df, ["name", "lon"])
    r = features.health_report(df, [features.check("nulls", C("name").isNull(), "FAILED", "OBJECTID"), features.check("none", F.lit(False), "WARNING", "OBJECTID")])
    assert [(x.check_name, x.status, x.affected) for x in r.collect()] == [("nulls", "FAILED", [2]), ("none", "PASSED", [])]
    assert features.overall(r).first().overall == "FAILED"
    assert "| nulls | FAILED | 1 |" in files.health_markdown(r, "t") and "&lt;" in files.health_html(r, "<t>")


def test_files(spark, tmp_path):
    (tmp_path / "p.csv").write_text("x,y\n1,2\n")
    assert files.read_csv(spark, str(tmp_path / "p.csv"), ["x"]).first().y == "2"
    with pytest.raises(ValueError):
        files.read_csv(spark, str(tmp_path / "p.csv"), ["z"])
    (tmp_path / "f.json").write_text('{"type":"FeatureCollection","features":[{"id":"1","geometry":{"type":"Point","coordinates":[1,2]},"properties":{"a":"b"}},{"id":"2","geometry":null,"properties":{}}]}')
    got = files.read_geojson(spark, str(tmp_path / "f.json")).collect()
    assert (got[0].coordinates, got[0].properties, got[1].geometry_type) == ("[1,2]", {"a": "b"}, None)
    (tmp_path / "d.rdb").write_text("# note\nagency_cd\tsite_no\tdatetime\t1_00065_00003\t1_00065_00003_cd\n5s\t15s\t20d\t14n\t10s\nUSGS\t0801\t2024-01-01\t3.5\tA\nUSGS\t0801\t2024-01-02\tIce\tA\n")
    d = files.daily_values(files.read_rdb(spark, str(tmp_path / "d.rdb")), "00065").collect()
    assert [tuple(r) for r in d] == [("0801", date(2024, 1, 1), 3.5)]
    a = np.array([[1.5, np.nan], [2.0, 3.0], [4.0, 5.0]])
    (tmp_path / "r.tif").write_bytes(files.encode_tiff(a))
    cells = files.read_tiff(spark, str(tmp_path / "r.tif")).collect()
    assert {(c.band, c.row, c.col, c.value) for c in cells} == {(1, r, c, None if np.isnan(v) else v) for (r, c), v in np.ndenumerate(a)}
    with pytest.raises((ValueError, struct.error)):
        files.decode_tiff(b"nothing")
    rows = files.paged(spark, lambda o, n: [{"i": i} for i in range(o, min(o + n, 25))], 25, 10, "i long").collect()
    assert sorted(r.i for r in rows) == list(range(25))
    big = 1 << 60

    def page(offset, limit):
        if offset == 30:
            raise OSError("service is down")
        return [{"i": big + i} for i in range(offset, min(offset + limit, 57))]

    unknown = files.paged(spark, page, None, 10, "i long", wave=2, skip_failed=True)
    assert sorted(r.i - big for r in unknown.collect()) == [i for i in range(57) if not 30 <= i < 40]
    with pytest.raises(Exception, match="service is down"):
        files.paged(spark, page, None, 10, "i long", wave=4).collect()
    assert files.paged(spark, lambda o, n: [], None, 10, "i long").collect() == []
    features_ = features.to_geojson(spark.createDataFrame([(1, 2.0, 3.0)], "id int, lon double, lat double"), "lon", "lat")
    assert '"coordinates":[2.0,3.0]' in files.feature_collection(features_, 5)
    with pytest.raises(ValueError):
        files.feature_collection(features_.union(features_), 1)


@pytest.mark.parametrize("kind", ["u1", "i2", "f4", "f8"])
def test_geotiff_round_trip(kind):
    rng = np.random.default_rng(1)
    cube = (rng.random((2, 37, 45)) * 200).astype(kind)
    for compression in ("none", "lzw", "deflate"):
        for tile in (None, 16, 32):
            r = files.Raster(cube, -9999.0, 500000.0, 3300000.0, 30.0, 30.0, 32615, {"a & b": "<x>"})
            q = files.decode_geotiff(files.encode_geotiff(r, compression, tile))
            assert (q.cube == cube).all() and [getattr(q, n) for n in ("nodata", "west", "north", "dx", "dy", "epsg", "items")] == [-9999.0, 500000.0, 3300000.0, 30.0, 30.0, 32615, {"a & b": "<x>"}]
    assert files.decode_geotiff(files.encode_geotiff(files.Raster(cube, None, -95.0, 30.0, 0.1, 0.1, 4326))).epsg == 4326
    with pytest.raises(ValueError):
        files.encode_geotiff(files.Raster(cube), tile=10)


def test_tiff_codecs_by_their_definitions():
    # The example of the format's specification: codes of 9 bits.
    codes = [256, 7, 258, 8, 8, 258, 6, 6, 257]
    packed = int("".join(f"{c:09b}" for c in codes).ljust(88, "0"), 2).to_bytes(11, "big")
    assert files.lzw_encode(bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])) == packed and files.lzw_decode(packed) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])
    rng = np.random.default_rng(2)
    for n in (0, 1, 300, 30_000):
        for spread in (1, 3, 256):
            data = bytes(rng.integers(0, spread, n).astype("u1"))
            assert files.lzw_decode(files.lzw_encode(data)) == data
    with pytest.raises(ValueError):
        files.lzw_decode(bytes([128, 127, 255, 255]))
    assert files._unpack_bits(bytes([2, 1, 2, 3, 254, 9, 128, 0, 5])) == bytes([1, 2, 3, 9, 9, 9, 5])
    block = rng.integers(0, 60000, (4, 9, 3)).astype("<u2")
    steps = np.diff(block, axis=1, prepend=np.zeros((4, 1, 3), "<u2")).astype("<u2")
    assert (files._unpredict(steps, 2) == block).all()
    block = rng.normal(size=(4, 9, 3)).astype("<f4")
    planes = block.astype(">f4").reshape(4, 27).view("u1").reshape(4, 27, 4).transpose(0, 2, 1).reshape(4, 36, 3)  # bytes by weight
    steps = np.diff(planes, axis=1, prepend=np.zeros((4, 1, 3), "u1")).astype("u1")
    assert (files._unpredict(steps.reshape(4, 108).view("<f4").reshape(4, 9, 3), 3) == block).all()


def test_rasters_are_written_and_read(spark, tmp_path):
    grid_ = np.random.default_rng(3).random((20, 18)).round(3)
    rows = [(name, b, int(r), int(c), float(v) + b) for name in ("a.tif", "b.tif") for b in (1, 2) for (r, c), v in np.ndenumerate(grid_) if (r, c) != (5, 6)]
    place = files.Raster(np.zeros((1, 1, 1)), -9999.0, -95.0, 30.0, 0.5, 0.5, 4326, {"method": "mean"})
    out = files.encode_rasters(spark.createDataFrame(rows, "name string, band int, row int, col int, value double"), place, tile=16, dtype="f8")
    assert files.save_files(out, f"file://{tmp_path}/rasters") == 2
    cells = {(c.path.rsplit("/", 1)[1], c.band, c.row, c.col): c.value for c in files.read_tiff(spark, f"{tmp_path}/rasters").collect()}
    assert len(cells) == 2 * 2 * 360 and cells["a.tif", 1, 5, 6] is None and all(cells[n, b, r, c] == v for n, b, r, c, v in rows)
    info = files.raster_info(spark, f"{tmp_path}/rasters").first()
    assert (info.bands, info.rows, info.cols, info.nodata, info.west, info.north, info.dx, info.epsg, info["items"]) == (2, 20, 18, -9999.0, -95.0, 30.0, 0.5, 4326, {"method": "mean"})


def test_snapshot_monitor(spark, tmp_path):
    seen, snap = [], lambda ids: spark.createDataFrame([("n", i) for i in ids], "type string, id int")
    m = monitor.SnapshotMonitor(spark, str(tmp_path / "s"), ["type", "id"], [lambda c, n: 1 / 0, lambda c, n: seen.append((n, c.count()))])
    assert m.poll(snap([1, 2]), 0) is None
    changes = m.poll(snap([2, 3]), 1)
    assert seen == [(1, 2)] and len(m.errors) == 1 and monitor.message(changes, "id") == "1 added, 1 removed: 3"
    assert m.poll(snap([2, 3]), 2).count() == 0 and len(seen) == 1
    # Another monitor on the folder goes on where this one stopped; a poll that is tried again gives the same.
    again = monitor.SnapshotMonitor(spark, str(tmp_path / "s"), ["type", "id"], [])
    assert again.versions() == [0, 1, 2] and again.poll(snap([3, 4])).count() == 2
    assert again.poll(snap([3, 5]), 3).count() == 2 and again.versions() == [0, 1, 2, 3]
    monitor.append_json(str(tmp_path / "log"))(changes, 1)
    assert spark.read.json(str(tmp_path / "log")).count() == 2


def test_watch_goes_on_after_a_restart(spark, tmp_path):
    seen, source = [], str(tmp_path / "in")
    for ids in ([1, 2], [2, 3]):
        spark.createDataFrame([("n", i) for i in ids], "type string, id int").coalesce(1).write.mode("append").parquet(source)
        m = monitor.SnapshotMonitor(spark, str(tmp_path / "state"), ["type", "id"], [lambda c, n: seen.extend(sorted((r.id, r.status) for r in c.collect()))])
        query = m.watch(spark.readStream.schema("type string, id int").parquet(source))
        query.processAllAvailable()
        query.stop()
    assert seen == [(1, "removed"), (3, "added")]


def test_streams(spark, tmp_path):
    spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 3.0)], "k string, v double").write.parquet(str(tmp_path / "t.parquet"))
    out = monitor.drain(monitor.running_counts(monitor.stream_table(spark, str(tmp_path), "t"), ["k"], "v"))
    assert {(r.k, r.n, r.total) for r in out.collect()} == {("a", 2, 3.0), ("b", 1, 3.0)}


def test_learning_accuracy(spark):
    rng = np.random.default_rng(3)
    water = rng.random(300) < 0.5
    x = np.where(water[:, None], [0.1, 0.02], [0.06, 0.22]) + rng.normal(0, 0.02, (300, 2))
    df = spark.createDataFrame([(i, float(w), *map(float, v)) for i, (w, v) in enumerate(zip(water, x, strict=True))], "id int, y double, green double, nir double")
    for out, name in ((learning.probability(learning.forest(df, ["green", "nir"], "y", 10), df, "p"), "p"), (learning.stacked(df, ["green", "nir"], "y", "id", 2, 5, 3), "stacked")):
        assert out.filter((C(name) > 0.5) == (C("y") == 1)).count() / 300 >= 0.90
    assert learning.cluster(df.limit(2), ["green", "nir"], 5).first().cluster is None
    assert learning.cluster(df, ["green", "nir"], 2).select("cluster").distinct().count() == 2
    assert len(learning.reduce(df, ["green", "nir"], 1).first().reduced) == 1
    angles = [r.angles for r in learning.angles(df, ["green", "nir"]).collect()]
    assert np.min(angles) == 0 and np.max(angles) == pytest.approx(np.pi)


def test_crowns_and_superpixels():
    r, c = np.indices((30, 30))
    bumps = np.exp(-((r - 8) ** 2 + (c - 8) ** 2) / 20) + np.exp(-((r - 20) ** 2 + (c - 21) ** 2) / 20)
    label = kernels.crowns()(bumps)
    assert set(np.unique(label)) == {0, 1, 2} and label[8, 8] != label[20, 21] and label[0, 29] == 0
    halves = np.where(c < 15, 0.0, 100.0)
    seg = kernels.superpixels(8, 1.0)(halves)
    assert not set(seg[:, :15].ravel()) & set(seg[:, 15:].ravel())


def test_auto_encoder(spark):
    rng = np.random.default_rng(3)
    low = rng.normal(size=(400, 3))
    x = low @ rng.normal(size=(3, 12))
    x = (x - x.mean(axis=0)) / x.std(axis=0)
    net = learning.AutoEncoder(12, code=4)
    # Gradients against differences of the loss.
    small, step, before = x[:50], 1e-6, net.loss(x[:50])
    for i in range(4):
        w = net.weights[i].copy()
        trained = learning.AutoEncoder(12, code=4).fit(small, 1, 1.0, 50, 1e9).weights[i] - w
        net.weights[i][0, 1] += step
        slope = (net.loss(small) - before) / step * 12
        net.weights[i] = w
        assert -trained[0, 1] == pytest.approx(slope, rel=1e-3, abs=1e-6)
    assert learning.AutoEncoder(12, code=4).fit(x, 3000, 0.05).loss(x) < 0.2 * before
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x[:40])] + [(99, *[None] * 12)], "id int, " + ", ".join(f"f{i} double" for i in range(12)))
    codes = {r.id: r.code for r in learning.encode_spectra(df, [f"f{i}" for i in range(12)], 4).collect()}
    assert codes[99] is None and len(codes[0]) == 4 and codes[0] != codes[1]
    again = {r.id: r.code for r in learning.encode_spectra(df.repartition(3), [f"f{i}" for i in range(12)], 4).collect()}
    assert all(np.allclose(codes[i], again[i]) for i in range(40))


def test_circuit_by_full_matrices():
    c = learning.Circuit(3, 2)
    x = np.random.default_rng(4).uniform(0, np.pi, (5, 3))
    ry = lambda t: np.array([[np.cos(t / 2), -np.sin(t / 2)], [np.sin(t / 2), np.cos(t / 2)]])
    each = lambda t: np.kron(np.kron(ry(t[2]), ry(t[1])), ry(t[0]))  # noqa: E731  qubit 0 is the lowest bit
    ring = np.eye(8)
    for q in range(3):
        m = np.zeros((8, 8))
        for i in range(8):
            m[i ^ (1 << (q + 1) % 3) if i >> q & 1 else i, i] = 1
        ring = m @ ring
    for row, got in zip(x, c.expectations(x), strict=True):
        s = each(row)[:, 0]
        for t in c.theta:
            s = ring @ each(t) @ s
        assert np.allclose(got, [sum(s[i] ** 2 * (-1 if i >> q & 1 else 1) for i in range(8)) for q in range(3)])
    y = (x[:, 0] > 1.5).astype(float)
    before = ((c.expectations(x)[:, 0] - (1 - 2 * y)) ** 2).mean()
    assert ((c.fit(x, y, 15, 0.1).expectations(x)[:, 0] - (1 - 2 * y)) ** 2).mean() < before


def test_fidelity_kernel_separates_circles(spark):
    rng = np.random.default_rng(6)
    t = rng.uniform(0, 2 * np.pi, 300)
    y = (np.cos(t) ** 2 > 0.5).astype(float)
    df = spark.createDataFrame([(float(np.cos(a)), float(np.sin(a)), float(b)) for a, b in zip(t, y, strict=True)], "a double, b double, y double")
    out = learning.fidelity_svm(df, ["a", "b"], "y").transform(df)
    assert out.filter("prediction = y").count() / 300 > 0.95


def test_noise_is_the_same_each_time(spark):
    df = spark.createDataFrame([(i, 0.5) for i in range(200)], "id int, v double")
    a, b = (sorted(map(tuple, learning.noisy_samples(df, ["id"], "v", 8, 0.1).collect())) for _ in range(2))
    v = np.array([x[1] for x in a if x[2] > 0])
    assert a == b and all(x[1] == 0.5 for x in a if x[2] == 0) and abs(v.mean() - 0.5) < 0.01 and abs(v.std() - 0.1) < 0.01
