"""Queries on indices, radiometry, masks and scores of single observations."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import classes, radiometry, scores, spectral
from gridloom.functions.guards import clip, r6
from gridloom.plans.registry import Registry
from gridloom.sources import fixtures as fx

REGISTRY = Registry()
C = F.col
K = fx.KEY_SQL


def _values(name: str, view: str, texts: dict[str, str], keys: list[str] | None = None, where: str = "") -> None:
    """Register a projection: keys and rounded columns, against the same in SQL."""
    keys = keys or fx.OBS_KEY

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = getattr(fx, view)(spark, sf_dir)
        df = df.filter(where) if where else df
        columns = _columns(spark.sparkContext.applicationId)[name]
        df = df.withColumns({n: c for n, c in columns.items() if n.startswith("__")})  # what several columns share is computed once
        return df.select(*keys, *[r6(c.cast("double")).alias(n) for n, c in columns.items() if not n.startswith("__")])

    picked = ", ".join(f"round(CAST({t} AS DOUBLE), 6) + 0.0 AS {n}" for n, t in texts.items())
    REGISTRY.add(name, query, fx.sql(f"SELECT {', '.join(keys)}, {picked} FROM {view}{' WHERE ' + where if where else ''}", view))


def _d(a: str, b: str, zero: str) -> str:
    return f"CASE WHEN ({a}) + ({b}) = 0 THEN {zero} ELSE (({a}) - ({b})) / nullif(({a}) + ({b}), 0) END"


def _clip(x: str, low: float, high: float) -> str:
    return f"CASE WHEN ({x}) IS NOT NULL THEN least(greatest(({x}), {low}), {high}) END"


_S = "CAST(-9999 AS DOUBLE)"
_values("x1_ndvi", "obs", {"ndvi": _d("nir", "red", _S)})
_values("x2_ndwi", "obs", {"ndwi": _d("green", "nir", _S)})
_values("x3_savi", "obs", {"savi": "(nir - red) / (nir + red + 0.5) * 1.5", "savi_bare": _d("nir", "red", _S)})
_values("x4_evi", "obs", {"evi": f"CASE WHEN nir + 6 * red - 7.5 * blue + 1 = 0 THEN {_S} ELSE 2.5 * (nir - red) / nullif(nir + 6 * red - 7.5 * blue + 1, 0) END"})
_values("x6_water_vegetation_built", "obs", {"ndwi": _d("green", "nir", "0"), "mndwi": _d("green", "swir1", "0"), "ndvi": _d("nir", "red", "0"), "ndbi": _d("swir1", "nir", "0")})
_values("x7_awei_bsi_wri", "obs", {"awei": "4 * (green - swir1) - (0.25 * nir + 2.75 * swir2)", "bsi": _d("swir1 + red", "nir + blue", "0"), "wri": "CASE WHEN nir + swir1 = 0 THEN 0 ELSE (green + red) / nullif(nir + swir1, 0) END"})
_e = lambda a, b: _clip(f"(({a}) - ({b})) / (({a}) + ({b}) + 1e-8)", -1, 1)
_w = lambda t: f"CASE WHEN swir1 IS NOT NULL AND swir2 IS NOT NULL THEN {t} ELSE 0 END"
_values("x11_index_bundle", "obs", {
        "ndvi": _e("nir", "red"), "evi": _clip("2.5 * (nir - red) / (nir + 6 * red - 7.5 * blue + 1 + 1e-8)", -1, 1), "savi": _clip("1.5 * (nir - red) / (nir + red + 0.5 + 1e-8)", -1, 2), "ndwi": _e("green", "nir"),
        "mndwi": _w(_e("green", "swir1")), "awei": _w(_clip("4 * (green - swir1) - (0.25 * nir + 2.75 * swir2)", -5, 5)), "ndbi": _w(_e("swir1", "nir")), "ui": _w(_e("swir2", "nir")),
        "bci": _e("blue + red", "nir"), "bsi": _w(_e("swir1 + red", "nir + blue")), "lswi": _w(_e("nir", "swir1")),
    })
_t = lambda n, d: f"CASE WHEN abs({d} + 1e-10) > 1e-10 THEN ({n}) / ({d} + 1e-10) END"
_td = lambda a, b: _t(f"{a} - {b}", f"{a} + {b}")
_values("x13_index_bundle_null", "obs", {
        "ndvi": _td("nir", "red"), "evi": f"2.5 * ({_t('nir - red', 'nir + 6 * red - 7.5 * blue + 1')})", "savi": f"1.5 * ({_t('nir - red', 'nir + red + 0.5')})", "ndwi": _td("green", "nir"), "mndwi": _td("green", "swir1"),
        "ndbi": _td("swir1", "nir"), "bsi": "(swir1 - nir - red) / nullif(swir1 + nir + red + 1e-10, 0)", "nbr": _td("nir", "swir2"), "evi2": f"2.5 * ({_t('nir - red', 'nir + 2.4 * red + 1')})", "arvi": _td("nir", "(2 * red - blue)"),
    }, where="nir <> 0.0 or red <> 0.0")
_values("x14_band_ratios", "obs", {"nir_red": _t("nir", "red"), "swir1_nir": _t("swir1", "nir"), "green_red": _t("green", "red")}, where="nir > 0")
_values("x15_detector_indices", "obs", {"ndvi": _clip("(nir - red) / (CASE WHEN nir + red = 0 THEN 1e-10 ELSE nir + red END)", -1, 1), "ndwi": _clip("(green - nir) / (CASE WHEN green + nir = 0 THEN 1e-10 ELSE green + nir END)", -1, 1), "brightness": "(red + green + blue) / 3"})
_values("x20_reflectance", "obs", {"landsat": _clip("(partkey * 50 + 5000) * 2.75e-5 - 0.2", 0, 1), "s2": _clip("partkey * 9 / 10000.0::DOUBLE", 0, 1), "s2_raw": "partkey * 9 / 10000.0::DOUBLE", "naip": _clip("suppkey * 3 / 255.0::DOUBLE", 0, 1), "tm_red": "CASE WHEN sensor = 'landsat' THEN red * 0.9047 + 0.0061 ELSE red END"})
_bit = lambda n: f"((qa >> {n}) & 1) = 1"
_values("f2_cloud_masks", "obs", {
        "landsat_clear": f"{_bit(6)} AND NOT ({_bit(1)}) AND NOT ({_bit(3)}) AND NOT ({_bit(4)})", "landsat_bad": f"({_bit(3)}) OR ({_bit(4)}) OR ({_bit(0)})", "s2_clear": "scl IN (4,5,6,7)", "s2_clear_snow": "scl IN (4,5,6,7,11)",
        "s2_bad": "scl IN (1,2,3,7,8,9,10,11)", "s2_cloud": "scl IN (3,8,9,10)",
    })
_SAR_KEYS = ["px_row", "px_col", "acq_date"]
_db = lambda x: f"10 * log10(greatest({x}, 1e-10))"
_SAR_SQL = {
    "vv_db": _db("vv"), "vv_clipped": _clip(_db("vv"), -30, 10), "back": "greatest(vv, 1e-10) * 1.0037", "swi": "1 - least(greatest(vv * 0.7234561, 0), 0.1) / 0.1", "swi_rel": "(vh - vv) / nullif(vh + vv, 0)", "cross": _clip("vh / greatest(vv, 1e-10)", 0, 2),
    "cross_db": _clip(f"{_db('vh')} - {_db('vv')}", -20, 20), "total": "10 * log10(greatest(vv, 1e-10) + greatest(vh, 1e-10) + 1e-20)", "water": f"CAST({_db('vv')} < -15 AS INT)", "building": f"CAST({_db('vv')} > -5 AS INT)", "forest": f"CAST({_db('vh')} - {_db('vv')} > -6 AS INT)",
}
_values("x24_sar_radiometry", "sar", _SAR_SQL, _SAR_KEYS)
_values("x30_terrain_and_height_scores", "dem", {"suscept": "1 / (1 + exp(z / 500 - 1)) * (1 / (1 + exp(z / 750 - 1)))", "ndsm": "1 / (1 + exp(-2 * (z / 300 - 2.5))) * (1 - least(greatest((z % 7) / 10, 0), 1))", "valid": "CAST(z > -500 AND z < 9000 AS INT)", "terrain_ok": "CAST(z / 50 < 30 AND z / 120 < 15 AS INT)"}, ["row", "col"])


def _urban() -> tuple[Column, Column]:
    ndbi, wri, ndvi = spectral.difference(C("swir1"), C("nir")), spectral.water_ratio(C("green"), C("red"), C("nir"), C("swir1")), spectral.difference(C("nir"), C("red"))
    hard = F.coalesce((ndbi > 0.10) & (wri < 0.60) & (ndvi < 0.20), F.lit(False))
    return hard, F.coalesce(ndbi > 0, F.lit(False)) & ~hard


_ndbi, _ndvi0, _ndwi0 = _d("swir1", "nir", "0"), _d("nir", "red", "0"), _d("green", "nir", "0")
_wri = "CASE WHEN nir + swir1 = 0 THEN 0 ELSE (green + red) / nullif(nir + swir1, 0) END"
_HARD = f"coalesce(({_ndbi}) > 0.10 AND ({_wri}) < 0.60 AND ({_ndvi0}) < 0.20, false)"
_SOFT = f"(coalesce(({_ndbi}) > 0, false) AND NOT {_HARD})"
_values("f15_land_masks", "obs", {"hard_urban": _HARD, "soft_urban": _SOFT, "forest": f"({_ndvi0}) >= 0.55 AND ({_ndwi0}) < 0.15"})
_B1 = f"CASE WHEN {_HARD} THEN 0 WHEN {_SOFT} THEN green * 10 * 0.3 ELSE green * 10 END"
_values("x51_posterior_adjustment", "obs", {"p": "p", "water": "CAST(p > 0.5 AS INT)"})
REGISTRY.oracles["x51_posterior_adjustment"] = fx.sql(
    f"SELECT {K}, round(p, 6) + 0.0 AS p, round(CAST(p > 0.5 AS INT)::DOUBLE, 6) + 0.0 AS water FROM s3", "obs",
    s0=f"SELECT *, CAST({_B1} AS DOUBLE) AS p0 FROM obs", s1="SELECT *, CASE WHEN qa % 5 = 0 THEN p0 * 0.1 ELSE p0 END AS p1 FROM s0",
    s2="SELECT *, CASE WHEN qa % 3 = 0 AND p1 > 0.2 THEN least(p1 * 1.4, 1.0) ELSE p1 END AS p2 FROM s1",
    s3="SELECT *, CASE WHEN scl <> 11 THEN least(greatest(p2 * (blue * 10 + 0.3), 0), 1) ELSE 0 END AS p FROM s2",
)
_values("x50_model_average", "obs", {"p": "(0.4 * blue * 10.331 * green * 9.731 + 0.35 * (1 - abs(nir * 10.137 - green * 9.731)) * nir * 10.137 + 0.25 * red * 9.917) / (0.4 * blue * 10.331 + 0.35 * (1 - abs(nir * 10.137 - green * 9.731)) + 0.25)"})
_values("x32_entropy", "obs", {"h": "-q * log2(q) - (1 - q) * log2(1 - q)"})
REGISTRY.oracles["x32_entropy"] = fx.sql(f"SELECT {K}, round(-q * log2(q) - (1 - q) * log2(1 - q), 6) + 0.0 AS h FROM c", "obs", c="SELECT *, least(greatest(green * 10, 1e-7), 1 - 1e-7) AS q FROM obs")
_LABEL = """CASE WHEN bsi > 0.15 AND ndvi < 0.25 AND NOT built THEN 7 WHEN NOT built AND ndbi > 0.05 AND ndvi < 0.50 THEN 5 WHEN built THEN 6
 WHEN NOT water AND NOT forest AND ndvi > 0.35 AND evi > 0.2 AND evi < 0.4 THEN 4 WHEN NOT water AND NOT forest AND ndvi > 0.25 AND ndvi <= 0.50 THEN 3
 WHEN forest THEN 2 WHEN NOT water AND ndwi > 0 AND ndvi > 0.15 AND ndvi < 0.45 THEN 1 WHEN water THEN 0 ELSE 3 END"""  # fmt: skip
_values("x53_pseudo_labels", "obs", {"label": "0"}, where="sensor <> 'naip'")
REGISTRY.oracles["x53_pseudo_labels"] = fx.sql(
    f"SELECT {K}, CAST({_LABEL} AS DOUBLE) AS label FROM m", "obs",
    i="SELECT *, nir * 10 - 0.3003 AS ndvi, red * 8.003 AS evi, green * 4 - 0.3003 AS ndwi, blue * 3 - 0.0503 AS mndwi, swir1 * 3.003 AS ndbi, swir2 * 4.003 AS bsi FROM obs WHERE sensor <> 'naip'",
    m="SELECT *, ndwi > 0.10 OR mndwi > 0.10 AS water, NOT (ndwi > 0.10 OR mndwi > 0.10) AND ndvi > 0.50 AND evi > 0.3 AS forest, ndbi > 0.05 + 0.10 AND ndvi < 0.25 AS built FROM i",
)
_SEASON = "[" + ", ".join(f"[{a}, {b}, {c}]" for a, b, c in scores.SEASONAL) + "]"
_values("x34_sensor_attention", "obs", {"w_ndwi": "0"})
REGISTRY.oracles["x34_sensor_attention"] = fx.sql(
    f"SELECT {K}, round(e1 / (e1 + e2 + e3), 6) AS w_ndwi, round(e2 / (e1 + e2 + e3), 6) AS w_mndwi, round(e3 / (e1 + e2 + e3), 6) AS w_awei, CAST(m AS DOUBLE) AS month, CAST((m % 12) // 3 AS DOUBLE) AS season FROM e", "obs",
    w=f"SELECT *, month(acq_date) AS m, CASE sensor WHEN 'naip' THEN [0.7, 0.15, 0.15] WHEN 'sentinel2' THEN [0.35, 0.3, 0.35] ELSE [0.3, 0.35, 0.35] END AS b, {_SEASON}[month(acq_date)] AS s FROM obs",
    e="SELECT *, exp(3 * b[1]::DOUBLE * s[1]::DOUBLE) AS e1, exp(3 * b[2]::DOUBLE * s[2]::DOUBLE) AS e2, exp(3 * b[3]::DOUBLE * s[3]::DOUBLE) AS e3 FROM w",
)
_E8 = "(0.18 * green * 10 + 0.12 * red * 10 + 0.12 * nir * 10 + 0.13 * blue * 10 + 0.10 * green * 5 + 0.13 * red * 5 + 0.12 * nir * 5 + 0.10 * blue * 5)"
_values("x45_structure_fusion", "obs", {"score": _E8, "zone": f"CASE WHEN round({_E8}, 9) >= 0.65 THEN 3 WHEN round({_E8}, 9) >= 0.45 THEN 2 ELSE 0 END"})
_values("x47_building_fusion", "obs", {"score": "(0.14 * green * 10 + 0.10 * red * 10 + 0.08 * (1 - least(greatest(nir * 10, 0), 1)) + coalesce(0.22 * swir1 * 10, 0) + coalesce(0.10 * swir2 * 10, 0)) / (0.32 + CASE WHEN swir1 IS NULL THEN 0 ELSE 0.22 END + CASE WHEN swir2 IS NULL THEN 0 ELSE 0.10 END)"})
_EV = {
    "lidar": "CASE WHEN green * 120 > 5 AND scl < 9 THEN least(greatest(red * 10 / 0.35, 0), 1) ELSE 0 END", "bounce": "CASE WHEN scl < 9 AND nir * 200 - 20 > -8 THEN least(greatest((nir * 200 - 20 + 8) / 8, 0), 1) ELSE 0 END",
    "thermal": "CASE WHEN scl < 9 AND blue * 60 > 1.5 THEN least(greatest((blue * 60 - 1.5) / 2, 0), 1) ELSE 0 END", "flood": "CASE WHEN scl < 9 AND red * 40 < 2 AND nir * 200 - 20 < -15 THEN least(greatest((-15 - (nir * 200 - 20)) / 5 * (1 - red * 40 / 2), 0), 1) ELSE 0 END",
}
_values("x48_canopy_evidence", "obs", _EV | {"score": f"0.35 * ({_EV['lidar']}) + 0.30 * ({_EV['bounce']}) + 0.20 * ({_EV['thermal']}) + 0.15 * ({_EV['flood']})"})


@lru_cache(maxsize=1)
def _columns(application: str) -> dict[str, dict[str, Column]]:
    """The columns of each query. They need a running session, which the registry must not."""
    out: dict[str, dict[str, Column]] = {}
    out["x1_ndvi"] = {"ndvi": spectral.REGISTRY["NDVI"].compute(C("nir"), C("red"))}
    out["x2_ndwi"] = {"ndwi": spectral.REGISTRY["NDWI"].compute(C("green"), C("nir"))}
    out["x3_savi"] = {"savi": spectral.savi(C("nir"), C("red")), "savi_bare": spectral.savi(C("nir"), C("red"), 0.0)}
    out["x4_evi"] = {"evi": spectral.evi(C("nir"), C("red"), C("blue"))}
    out["x6_water_vegetation_built"] = {"ndwi": spectral.difference(C("green"), C("nir")), "mndwi": spectral.difference(C("green"), C("swir1")), "ndvi": spectral.difference(C("nir"), C("red")), "ndbi": spectral.difference(C("swir1"), C("nir"))}
    out["x7_awei_bsi_wri"] = {"awei": spectral.awei_sh(C("green"), C("nir"), C("swir1"), C("swir2")), "bsi": spectral.bare_soil(C("blue"), C("red"), C("nir"), C("swir1")), "wri": spectral.water_ratio(C("green"), C("red"), C("nir"), C("swir1"))}
    _BANDS = [C(b) for b in ("blue", "green", "red", "nir", "swir1", "swir2")]
    out["x11_index_bundle"] = spectral.bundle_eps(*_BANDS)
    out["x13_index_bundle_null"] = spectral.bundle_tiny(*_BANDS)
    out["x14_band_ratios"] = spectral.band_ratios(C("green"), C("red"), C("nir"), C("swir1"))
    out["x15_detector_indices"] = {"ndvi": spectral.detector_index(C("nir"), C("red")), "ndwi": spectral.detector_index(C("green"), C("nir")), "brightness": spectral.brightness(C("red"), C("green"), C("blue"))}
    out["x20_reflectance"] = {"landsat": radiometry.landsat_reflectance(C("partkey") * 50 + 5000), "s2": radiometry.sentinel2_reflectance(C("partkey") * 9), "s2_raw": radiometry.sentinel2_reflectance(C("partkey") * 9, False), "naip": radiometry.naip_reflectance(C("suppkey") * 3), "tm_red": radiometry.harmonise("red", C("red"), F.when(C("sensor") == "landsat", "LC08").otherwise("LT05"))}
    out["f2_cloud_masks"] = {
            "landsat_clear": radiometry.landsat_clear(C("qa")), "landsat_bad": radiometry.landsat_bad(C("qa")), "s2_clear": radiometry.scene_class_clear(C("scl")), "s2_clear_snow": radiometry.scene_class_clear(C("scl"), (4, 5, 6, 7, 11)),
            "s2_bad": radiometry.scene_class_bad(C("scl")), "s2_cloud": radiometry.scene_class_bad(C("scl"), (3, 8, 9, 10)),
        }
    _vvdb, _vhdb = radiometry.to_db(C("vv")), radiometry.to_db(C("vh"))
    _SAR = {
        "vv_db": _vvdb, "vv_clipped": radiometry.to_db(C("vv"), -30, 10), "back": radiometry.from_db(_vvdb) * 1.0037, "swi": radiometry.water_index_absolute(C("vv") * 0.7234561), "swi_rel": radiometry.water_index_relative(C("vv"), C("vh")),
        "cross": radiometry.cross_ratio_linear(C("vv"), C("vh")), "cross_db": radiometry.cross_ratio_db(_vvdb, _vhdb, 20), "total": radiometry.total_power_db(_vvdb, _vhdb), **{k: v.cast("int") for k, v in radiometry.sar_masks(_vvdb, _vhdb).items()},
    }
    out["x24_sar_radiometry"] = _SAR
    out["x30_terrain_and_height_scores"] = {"suscept": scores.susceptibility(C("z") / 100, C("z") / 250), "ndsm": scores.ndsm_building(C("z") / 300, (C("z") % 7) / 10), "valid": ((C("z") > -500) & (C("z") < 9000)).cast("int"), "terrain_ok": ((C("z") / 50 < 30) & (C("z") / 120 < 15)).cast("int")}
    _hard, _soft = _urban()
    _forest = (spectral.difference(C("nir"), C("red")) >= 0.55) & (spectral.difference(C("green"), C("nir")) < 0.15)
    out["f15_land_masks"] = {"hard_urban": _hard, "soft_urban": _soft, "forest": _forest}
    _p = (C("green") * 10)
    _adjusted = scores.adjust_posterior(_p, _hard, _soft, C("qa") % 5 == 0, C("qa") % 3 == 0, C("blue") * 10 + 0.3, C("scl") != 11)
    out["x51_posterior_adjustment"] = {"__p": _adjusted, "p": C("__p"), "water": (C("__p") > 0.5).cast("int")}
    _q, _s, _g, _c = C("green") * 9.731, C("nir") * 10.137, C("red") * 9.917, C("blue") * 10.331
    out["x50_model_average"] = {"p": scores.model_average(_q, _s, _g, _c)}
    out["x32_entropy"] = {"h": scores.binary_entropy(C("green") * 10)}
    _labels = classes.pseudo_label(C("nir") * 10 - 0.3003, C("red") * 8.003, C("green") * 4 - 0.3003, C("blue") * 3 - 0.0503, C("swir1") * 3.003, C("swir2") * 4.003)
    out["x53_pseudo_labels"] = {"label": _labels}
    _att = scores.attention(C("sensor"), F.month("acq_date"))
    out["x34_sensor_attention"] = {"w_ndwi": _att[0], "w_mndwi": _att[1], "w_awei": _att[2], "month": F.month("acq_date"), "season": classes.season(F.month("acq_date"))}
    _struct = {n: (c, scores.STRUCTURE_WEIGHTS[n]) for n, c in zip(scores.STRUCTURE_WEIGHTS, [C("green") * 10, C("red") * 10, C("nir") * 10, C("blue") * 10, C("green") * 5, C("red") * 5, C("nir") * 5, C("blue") * 5], strict=True)}
    _score8 = scores.fuse(_struct)
    out["x45_structure_fusion"] = {"score": _score8, "zone": scores.confidence_zone(F.round(_score8, 9))}
    _build = {"mbi": (C("green") * 10, 0.14), "contrast": (C("red") * 10, 0.10), "non_veg": (1 - clip(C("nir") * 10, 0, 1), 0.08), "ndsm": (C("swir1") * 10, 0.22), "osm_prior": (C("swir2") * 10, 0.10)}
    out["x47_building_fusion"] = {"score": scores.fuse(_build, True)}
    _fo = C("scl") < 9
    _vv8 = C("nir") * 200 - 20
    _ev = {"lidar": scores.lidar_evidence(C("red") * 10, C("green") * 120, _fo), "bounce": scores.double_bounce_evidence(_vv8, _fo), "thermal": scores.thermal_evidence(C("blue") * 60, _fo), "flood": scores.inundation_evidence(_vv8, C("red") * 40, _fo)}
    _can = scores.fuse({n: (c, w) for (n, c), w in zip(_ev.items(), scores.CANOPY_WEIGHTS.values(), strict=True)})
    out["x48_canopy_evidence"] = _ev | {"score": _can}
    return out
