"""Properties of column functions on small hand-made inputs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import classes, encoders, geo, guards, radiometry, scores, spectral
from gridloom.operators import geometry, learning

C = F.col


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_guards(spark):
    got = values(spark, [(1.0, 0.0), (1.0, 2.0), (None, 2.0), (0.0, 1e-11)], "a double, b double", *[guards.ratio(C("a"), C("b"), g) for g in ("null", "zero", "sentinel", "tiny")], guards.clip(C("a"), 0, 0.5))
    assert got[0] == (None, 0.0, -9999.0, None, 0.5) and got[1] == (0.5, 0.5, 0.5, 0.5, 0.5)
    assert got[2] == (None,) * 5 and got[3][3] is None
    assert values(spark, [(float("nan"),), (1.0,)], "a double", guards.as_missing(C("a"))) == [(None,), (1.0,)]
    with pytest.raises(ValueError):
        guards.ratio(C("a"), C("b"), "other")


def test_index_registry(spark):
    df = spark.createDataFrame([(0.5, 0.1), (0.0, 0.0)], "b8 double, b4 double")
    got = spectral.with_indices(df, ["NDVI", "SAVI"], {"nir": "b8", "red": "b4"}).collect()
    assert got[0].ndvi == pytest.approx(2 / 3) and got[1].ndvi == -9999 and got[0].savi == pytest.approx(0.4 / 1.1 * 1.5)
    with pytest.raises(ValueError, match="blue"):
        spectral.with_indices(df, ["EVI"], {"nir": "b8", "red": "b4"})
    assert spectral.parse_index_list("ndvi, evi") == ["NDVI", "EVI"] and spectral.parse_index_list("all") == list(spectral.REGISTRY)
    with pytest.raises(ValueError):
        spectral.parse_index_list("nope")


def test_wilson_narrows_with_more_observations(spark):
    low, high = scores.wilson(C("k"), C("n"))
    got = values(spark, [(5, 10), (50, 100), (500, 1000), (0, 10), (10, 10), (0, 0)], "k long, n long", low, high)
    widths = [h - lo for lo, h in got[:3]]
    assert widths == sorted(widths, reverse=True) and got[3][0] == 0.0 and got[4][1] == pytest.approx(1.0) and got[5] == (None, None)


def test_zones_are_exhaustive(spark):
    z = values(spark, [(x,) for x in (None, 0.0, 0.049, 0.05, 0.2, 0.84, 0.85, 1.0)], "f double", scores.flood_zone(C("f")), scores.flood_zone(C("f"), F.lit(1.0)))
    assert [a for a, _ in z] == [0, 0, 0, 1, 2, 2, 3, 3] and z[5][1] == 3


def test_fusion(spark):
    with pytest.raises(ValueError):
        scores.fuse({"a": (C("a"), 0.5), "b": (C("b"), 0.2)})
    got = values(spark, [(1.0, 0.5), (1.0, None), (None, None)], "a double, b double", scores.fuse({"a": (C("a"), 0.25), "b": (C("b"), 0.75)}, True))
    assert [g[0] for g in got] == [0.625, 1.0, None]
    for w in (scores.STRUCTURE_WEIGHTS, scores.BUILDING_WEIGHTS, scores.CANOPY_WEIGHTS):
        assert sum(w.values()) == pytest.approx(1.0)


def test_softmax_and_attention(spark):
    got = values(spark, [([1.0, 3.0, 3.0],), ([0.0],)], "x array<double>", scores.softmax(C("x")), scores.argmax(C("x")))
    assert sum(got[0][0]) == pytest.approx(1) and got[0][1] == 1 and got[1][0] == [1.0]
    a = values(spark, [("naip", 0), ("landsat", 7), ("other", 13)], "s string, m int", scores.attention(C("s"), C("m")))
    assert all(sum(r[0]) == pytest.approx(1) for r in a) and a[0][0][0] == pytest.approx(math.exp(2.1) / (math.exp(2.1) + 2 * math.exp(0.45)))


def test_masks(spark):
    clear = radiometry.landsat_clear(C("q"))
    assert [r[0] for r in values(spark, [(64,), (64 | 8,), (64 | 16,), (64 | 2,), (0,), (64 | 1,)], "q int", clear)] == [True, False, False, False, False, True]


def test_decibels(spark):
    got = values(spark, [(1.0,), (0.0,), (0.01,), (None,)], "x double", radiometry.to_db(C("x")), radiometry.to_db(C("x"), -30, 10), radiometry.from_db(radiometry.to_db(C("x"))))
    assert got[0] == (0.0, 0.0, 1.0) and got[1][0] == -100 and got[1][1] == -30 and got[2][0] == pytest.approx(-20) and got[3] == (None, None, None)


def test_class_rules(spark):
    assert values(spark, [(1, 1), (1, 2)], "a int, b int", classes.transition_code(C("a"), C("b"), 8)) == [(-1,), (10,)]
    assert [r[0] for r in values(spark, [("AE", "FLOODWAY"), (" ve", None), ("X", "0.2 pct annual chance"), (None, None)], "z string, s string", classes.flood_category(C("z"), C("s")))] == ["floodway", "100-year", "500-year", "other"]
    assert [r[0] for r in values(spark, [("2024-07-01",), ("none",), (None,)], "d string", classes.month_of(C("d")))] == [7, 0, 0]
    assert [r[0] for r in values(spark, [(12,), (1,), (3,), (11,)], "m int", classes.season(C("m")))] == [0, 0, 1, 3]


def test_coordinates(spark):
    e, n = geo.transform(C("lon"), C("lat"), 4326, 32614)
    lon, lat = geo.transform(e, n, 32614, 4326)
    rows = [(-99.0, 0.0), (-97.7431, 30.2672), (-101.9, 60.0)]
    got = values(spark, rows, "lon double, lat double", e, n, lon, lat)
    assert got[0][:2] == (pytest.approx(500000, abs=1e-3), pytest.approx(0, abs=1e-3))
    assert got[1][0] == pytest.approx(620917, abs=2000) and got[1][1] == pytest.approx(3349378, abs=2000)
    for (a, b), g in zip(rows, got, strict=True):
        assert g[2] == pytest.approx(a, abs=1e-8) and g[3] == pytest.approx(b, abs=1e-8)
    with pytest.raises(geo.CrsError):
        geo.transform(C("lon"), C("lat"), 4326, 2193)
    assert values(spark, [(0.0, 0.0, 0.0, 90.0)], "a double, b double, c double, d double", geo.haversine_m(C("a"), C("b"), C("c"), C("d")))[0][0] == pytest.approx(geo.EARTH_M * math.pi / 2)


def test_keys_and_tags(spark):
    k, v = geo.key_value(C("t"))
    assert values(spark, [("a=b=c",), ("x",), ("=y",), ("z=",), (None,)], "t string", k, v) == [("a", "b=c")] + [(None, None)] * 4
    assert values(spark, [([[1.00000049, 2.0]],), (None,)], "c array<array<double>>", geo.geometry_key(C("c"))) == [("[[1.0,2.0]]",), ("null-geometry",)]
    assert values(spark, [("#ff8000",)], "h string", geo.hex_to_rgb(C("h"))) == [("255,128,0",)]


RING = "array<struct<x:double,y:double>>"
SQUARE = [(0.0, 0.0), (2.0, 0.0), (2.0, 1.0), (0.0, 1.0), (0.0, 0.0)]


def test_rings(spark):
    got = spark.createDataFrame([(1, SQUARE), (2, SQUARE[:2]), (3, None), (4, [])], f"id int, ring {RING}")
    m = {r.id: r for r in geometry.shape_metrics(got).collect()}
    assert (m[1].area, m[1].perimeter, m[1].solidity, m[1].rectangularity, m[1].aspect) == (2.0, 6.0, 1.0, pytest.approx(1.0), pytest.approx(2.0))
    assert m[2].solidity is None and m[4].area == 0.0
    at = spark.createDataFrame([(0.5, 0.5, SQUARE), (3.0, 0.5, SQUARE)], f"x double, y double, ring {RING}")
    assert [r[0] for r in at.select(geo.point_in_ring(C("x"), C("y"), C("ring"))).collect()] == [True, False]
    bow = [(0.0, 0.0), (1.0, 1.0), (1.0, 0.0), (0.0, 1.0), (0.0, 0.0)]
    v = spark.createDataFrame([(SQUARE,), (bow,), (None,), (SQUARE[:3],)], f"ring {RING}").select(geometry.ring_is_valid(C("ring")))
    assert [r[0] for r in v.collect()] == [True, False, False, False]


def test_encoder_circuits_are_unitary(spark):
    for u in (encoders.water_circuit(), encoders.class_circuit()):
        assert np.allclose(u @ u.T, np.eye(len(u)))
    rows = [(0.5, 0.3, 0.1), (-0.9, -0.5, -2.0), (0.0, None, None)]
    got = encoders.with_water_probability(spark.createDataFrame(rows, "a double, b double, c double"), C("a"), C("b"), C("c")).select("water", "confidence").collect()
    for (a, b, c), (w, s) in zip(rows, got, strict=True):
        t = [(1 - a) / 2 * math.pi, (1 - (b or 0)) / 2 * math.pi, (1 - 1 / (1 + math.exp(-(c or 0)))) * math.pi]
        psi = np.kron(np.kron(*[[math.cos(x / 2), math.sin(x / 2)] for x in t[:2]]), [math.cos(t[2] / 2), math.sin(t[2] / 2)]).astype(complex)
        psi[:2] *= np.exp(1j * t[2])
        p = abs(encoders.water_circuit() @ psi) ** 2
        assert w == pytest.approx(p[0] + p[1]) and s == pytest.approx(p.max())
    p = values(spark, [([0.3, -0.2],), ([0.0],)], "x array<double>", encoders.class_probabilities(C("x")))
    assert all(sum(r[0]) == pytest.approx(1) for r in p)


def test_logistic_growth_recovers_a_curve():
    x = np.arange(1985, 2021)
    y = 0.6 / (1 + np.exp(-0.2 * (x - 2000)))
    cap, rate, mid, r2 = learning.logistic_growth(x, y)
    assert (cap, rate, mid) == (pytest.approx(0.6, rel=1e-3), pytest.approx(0.2, rel=1e-3), pytest.approx(2000, rel=1e-4)) and r2 > 0.999
