"""Queries on composites, flood frequency and per-pixel statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.functions import classes, radiometry, scores, spectral
from gridloom.functions.guards import r6
from gridloom.operators import composites as co
from gridloom.operators.ranks import percentiles
from gridloom.operators.raster import percentile_stretch
from gridloom.plans.registry import Registry
from gridloom.sources import fixtures as fx

REGISTRY = Registry()
PX = ["px_row", "px_col"]
BANDS = ["green", "red", "nir", "swir1"]
C = F.col


def _rounded(df: DataFrame, keys: list[str], whole: list[str] = ()) -> DataFrame:
    return df.select(*keys, *whole, *[r6(C(c)).alias(c) for c in df.columns if c not in (*keys, *whole)])


def _r(*pairs: str) -> str:
    """'expression AS name' texts, rounded."""
    return ", ".join(f"round({p.rsplit(' AS ', 1)[0]}, 6) + 0.0 AS {p.rsplit(' AS ', 1)[1]}" for p in pairs)


@REGISTRY.query("a1_band_statistics", fx.sql(f"SELECT sensor, band, count(v) AS n_valid, count(*) - count(v) AS n_nodata, {_r('min(v) AS lowest', 'max(v) AS highest', 'avg(v) AS mean', 'stddev_pop(v) AS std')} FROM u GROUP BY 1, 2", "obs", u=" UNION ALL ".join(f"SELECT sensor, '{b}' AS band, {b} AS v FROM obs" for b in ("blue", *BANDS, "swir2"))))
def band_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of each sensor's bands; nodata is null."""
    bands = ("blue", *BANDS, "swir2")
    long = fx.obs(spark, sf_dir).select("sensor", F.explode(F.array(*[F.struct(F.lit(b).alias("band"), C(b).alias("v")) for b in bands])).alias("x")).select("sensor", "x.*")
    out = long.groupBy("sensor", "band").agg(F.count("v").alias("n_valid"), F.count_if(C("v").isNull()).alias("n_nodata"), F.min("v").alias("lowest"), F.max("v").alias("highest"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))
    return _rounded(out, ["sensor", "band"], ["n_valid", "n_nodata"])


@REGISTRY.query("a2_index_summary", fx.sql(f"SELECT sensor, count(*) AS n_all, count(v) AS n, {_r('min(v) AS lowest', 'max(v) AS highest', 'avg(v) AS mean')} FROM i GROUP BY 1", "obs", i="SELECT sensor, CASE WHEN nir + red <> 0 THEN (nir - red) / nullif(nir + red, 0) END AS v FROM obs"))
def index_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summary of NDVI without the sentinel."""
    df = spectral.with_indices(fx.obs(spark, sf_dir), ["NDVI"]).withColumn("v", F.when(C("ndvi") != -9999, C("ndvi")))
    return _rounded(df.groupBy("sensor").agg(F.count(F.lit(1)).alias("n_all"), F.count("v").alias("n"), F.min("v").alias("lowest"), F.max("v").alias("highest"), F.avg("v").alias("mean")), ["sensor"], ["n_all", "n"])


@REGISTRY.query("a3_median_composite", fx.sql("SELECT px_row, px_col, " + ", ".join(f"round(median(CASE WHEN clear THEN {b} END), 6) + 0.0 AS {b}" for b in BANDS) + ", sum(clear::INT)::BIGINT AS n_clear, round(avg(clear::INT), 6) AS coverage FROM obs GROUP BY 1, 2", "obs"))
def median_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(co.median_composite(fx.obs(spark, sf_dir), PX, BANDS), PX, ["n_clear"])


@REGISTRY.query("a4_mean_composite", fx.sql(f"SELECT px_row, px_col, {_r('avg(vv) AS vv', 'avg(vh) AS vh')} FROM sar GROUP BY 1, 2", "sar"))
def mean_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(co.mean_composite(fx.sar(spark, sf_dir), PX, ["vv", "vh"]), PX)


@REGISTRY.query("a5_best_pixel", fx.sql(f"SELECT px_row, px_col, {fx.KEY_SQL}, {_r('green AS green', 'red AS red', 'nir AS nir')} FROM r WHERE n = 1", "obs", r=f"SELECT *, row_number() OVER (PARTITION BY px_row, px_col ORDER BY CASE WHEN nir + red = 0 THEN 0 ELSE (nir - red) / nullif(nir + red, 0) END DESC, {fx.KEY_SQL}) AS n FROM obs WHERE clear"))
def best_pixel(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = co.best_pixel(fx.obs(spark, sf_dir), PX, spectral.difference(C("nir"), C("red")), fx.OBS_KEY)
    return best.select(*PX, *fx.OBS_KEY, *[r6(C(b)).alias(b) for b in ("green", "red", "nir")])


@REGISTRY.query("a6_percentile_composite", fx.sql("SELECT px_row, px_col, " + ", ".join(f"round(quantile_cont(CASE WHEN clear THEN {b} END, 0.1), 6) + 0.0 AS {b}" for b in BANDS) + " FROM obs GROUP BY 1, 2", "obs"))
def percentile_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(co.percentile_composite(fx.obs(spark, sf_dir), PX, BANDS, 10), PX)


@REGISTRY.query("a7_medoid_composite", fx.sql(
    f"SELECT px_row, px_col, {fx.KEY_SQL} FROM r WHERE n = 1", "obs",
    m="SELECT *, median(green) OVER w AS mg, median(red) OVER w AS mr, median(nir) OVER w AS mn FROM obs WHERE clear WINDOW w AS (PARTITION BY px_row, px_col)",
    r=f"SELECT *, row_number() OVER (PARTITION BY px_row, px_col ORDER BY round((green - mg) ** 2 + (red - mr) ** 2 + (nir - mn) ** 2, 12), {fx.KEY_SQL}) AS n FROM m"))
def medoid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return co.medoid(fx.obs(spark, sf_dir), PX, ["green", "red", "nir"], fx.OBS_KEY).select(*PX, *fx.OBS_KEY)


@REGISTRY.query("a8_annual_sar", fx.sql("SELECT px_row, px_col, CAST(year(acq_date) AS INT) AS year, " + ", ".join(_r(f"avg({p}) AS {p}_mean", f"stddev_pop({p}) AS {p}_std", f"least(greatest(stddev_pop({p}) / greatest(abs(avg({p})), 1e-8), 0), 5) AS {p}_cov") for p in ("vv", "vh")) + " FROM sar GROUP BY 1, 2, 3", "sar"))
def annual_sar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(co.sar_annual(fx.sar(spark, sf_dir).withColumn("year", F.year("acq_date")), [*PX, "year"], ["vv", "vh"]), [*PX, "year"])


@REGISTRY.query("a9_sar_mean_db", fx.sql(f"SELECT px_row, px_col, {_r('10 * log10(greatest(avg(vv), 1e-10)) AS vv_db', '10 * log10(greatest(avg(vh), 1e-10)) AS vh_db', 'stddev_pop(vv) AS vv_std')}, count(*) AS n FROM sar GROUP BY 1, 2", "sar"))
def sar_mean_db(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean in linear units, then decibel."""
    out = fx.sar(spark, sf_dir).groupBy(*PX).agg(radiometry.to_db(F.avg("vv")).alias("vv_db"), radiometry.to_db(F.avg("vh")).alias("vh_db"), F.stddev_pop("vv").alias("vv_std"), F.count(F.lit(1)).alias("n"))
    return _rounded(out, PX, ["n"])


_WATER = "CASE WHEN green + nir = 0 THEN 0 ELSE (green - nir) / nullif(green + nir, 0) END > 0"
_FREQ = f"SELECT orderkey AS px, count(CASE WHEN clear THEN 1 END) AS n_valid, count(CASE WHEN clear AND {_WATER} THEN 1 END) AS n_water FROM obs GROUP BY 1"
_Z = 1.959963984540054
_WILSON = f"SELECT *, n_water / nullif(n_valid, 0)::DOUBLE AS p, {_Z * _Z} / nullif(n_valid, 0) AS zz FROM f"
_CI = f"SELECT *, (p + zz / 2) / (1 + zz) AS mid, {_Z} * sqrt(greatest((p * (1 - p) + zz / 4) / nullif(n_valid, 0), 0)) / (1 + zz) AS half FROM w"


@REGISTRY.query("a11_flood_frequency", fx.sql(
    "SELECT px, n_valid, n_water, round(p, 6) AS frequency, round(CASE WHEN mid IS NOT NULL THEN greatest(mid - half, 0) END, 6) + 0.0 AS ci_low, round(CASE WHEN mid IS NOT NULL THEN least(mid + half, 1) END, 6) + 0.0 AS ci_high,"
    " CASE WHEN p >= 0.85 THEN 3 WHEN p >= 0.20 THEN 2 WHEN p >= 0.05 THEN 1 ELSE 0 END AS zone FROM c", "obs", f=_FREQ, w=_WILSON, c=_CI))  # fmt: skip
def flood_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of clear observations that are water, its Wilson interval and zone: one hash aggregate."""
    f = co.frequency(fx.obs_sparse(spark, sf_dir), ["px"], spectral.difference(C("green"), C("nir")) > 0, C("clear"))
    low, high = scores.wilson(C("n_water"), C("n_valid"))
    return f.select("px", "n_valid", "n_water", F.round("frequency", 6).alias("frequency"), r6(low).alias("ci_low"), r6(high).alias("ci_high"), scores.flood_zone(C("frequency")).alias("zone"))


@REGISTRY.query("x42_zone_with_terrain", fx.sql("SELECT px, CASE WHEN p >= 0.85 THEN 3 WHEN px % 11 < 5 AND p >= 0.5 THEN 3 WHEN p >= 0.20 THEN 2 WHEN p >= 0.05 THEN 1 ELSE 0 END AS zone FROM w", "obs", f=_FREQ, w=_WILSON))
def zone_with_terrain(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = co.frequency(fx.obs_sparse(spark, sf_dir), ["px"], spectral.difference(C("green"), C("nir")) > 0, C("clear"))
    return f.select("px", scores.flood_zone(C("frequency"), (C("px") % 11).cast("double")).alias("zone"))


@REGISTRY.query("a11_sensor_counts", fx.sql("SELECT sensor, count(DISTINCT acq_date) AS n_scenes, count(*) AS n_obs, sum(clear::INT)::BIGINT AS n_clear FROM obs GROUP BY 1", "obs"))
def sensor_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.obs(spark, sf_dir).groupBy("sensor").agg(F.countDistinct("acq_date").alias("n_scenes"), F.count(F.lit(1)).alias("n_obs"), F.count_if("clear").alias("n_clear"))


@REGISTRY.query("a13_temporal_indicators", fx.sql(
    f"SELECT o.px_row, o.px_col, {_r('entropy AS entropy', 'coherence AS coherence', 'coalesce(CASE WHEN k >= 2 THEN 1 - least(greatest(s / greatest(a, 1e-10), 0), 1) ELSE 0.5 END, 0.5) AS seasonal')} FROM o LEFT JOIN g ON o.px_row = g.px_row AND o.px_col = g.px_col", "sar",
    b="SELECT *, vh / greatest(vv, 1e-10) AS r, (month(acq_date) % 12) // 3 AS q FROM sar",
    o="SELECT px_row, px_col, 1 - least(greatest(stddev_pop(r) / greatest(avg(r), 1e-10), 0), 2) / 2 AS entropy, 1 - least(greatest(stddev_pop(sqrt(vv)) / greatest(avg(sqrt(vv)), 1e-10), 0), 1) AS coherence FROM b GROUP BY 1, 2",
    q="SELECT px_row, px_col, q, avg(vv) AS m FROM b GROUP BY 1, 2, 3 HAVING count(DISTINCT acq_date) >= 3", g="SELECT px_row, px_col, count(*) AS k, stddev_pop(m) AS s, avg(m) AS a FROM q GROUP BY 1, 2"))
def temporal_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(co.temporal_indicators(fx.sar(spark, sf_dir), PX), PX)


@REGISTRY.query("a14_phenology", fx.sql(
    f"SELECT px_row, px_col, {_r('avg(v) AS mean', 'stddev_pop(v) AS std', 'max(v) - min(v) AS amplitude', 'min(v) AS lowest', 'arg_max(v, year) AS current', 'avg(v * d) / nullif(sum(d * d), 0) AS slope')} FROM d GROUP BY 1, 2", "obs",
    y="SELECT px_row, px_col, CAST(year(acq_date) AS INT) AS year, median(nir) AS v FROM obs WHERE clear GROUP BY 1, 2, 3", d="SELECT *, year - avg(year) OVER (PARTITION BY px_row, px_col) AS d FROM y"))
def phenology(spark: SparkSession, sf_dir: str) -> DataFrame:
    annual = fx.obs(spark, sf_dir).filter("clear").groupBy(*PX, F.year("acq_date").alias("year")).agg(F.median("nir").alias("v"))
    return _rounded(co.phenology(annual, PX, "year", "v"), PX)


@REGISTRY.query("x56_stability", fx.sql(
    "SELECT px_row, px_col, " + _r("least(greatest(s, 0.7), 1) AS stability", "least(greatest((s - 0.7) / 0.3, 0), 1) AS rescaled", "least(greatest((v / greatest(m, 1e-10) - 0.02) / 0.2800000001, 0), 1) AS pol", "1 - least(greatest((v / greatest(m, 1e-10) - 0.02) / 0.2800000001, 0), 1) AS bounce") + " FROM g", "sar",
    a="SELECT px_row, px_col, avg(vv) AS m, avg(vh) AS v, stddev_pop(vv) AS d FROM sar GROUP BY 1, 2", g="SELECT *, 1 - least(greatest(d / greatest(m, 1e-10), 0), 1) AS s FROM a"))
def stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = fx.sar(spark, sf_dir).groupBy(*PX).agg(F.avg("vv").alias("m"), F.avg("vh").alias("v"), F.stddev_pop("vv").alias("d"))
    s = lambda **kw: scores.stability(C("m"), C("d"), **kw)
    return a.select(*PX, r6(s()).alias("stability"), r6(s(rescaled=True)).alias("rescaled"), r6(scores.pol_ratio(C("m"), C("v"))).alias("pol"), r6(scores.pol_ratio(C("m"), C("v"), descending=True)).alias("bounce"))


@REGISTRY.query("f8_scene_filter", fx.sql(f"SELECT sensor, acq_date, count(*) AS n, {_r('avg(clear::INT) AS clear_share')} FROM obs GROUP BY 1, 2 HAVING avg(clear::INT) >= 0.5", "obs"))
def scene_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenes of which at least half is clear."""
    return fx.obs(spark, sf_dir).groupBy("sensor", "acq_date").agg(F.count(F.lit(1)).alias("n"), F.avg(C("clear").cast("double")).alias("share")).filter("share >= 0.5").select("sensor", "acq_date", "n", r6(C("share")).alias("clear_share"))


@REGISTRY.query("f9_year_filter", fx.sql("SELECT year, n, total FROM y, t WHERE n >= 0.1 * total", "obs", y="SELECT CAST(year(acq_date) AS INT) AS year, count(DISTINCT px_row * 16 + px_col) AS n FROM obs WHERE clear GROUP BY 1", t="SELECT count(DISTINCT px_row * 16 + px_col) AS total FROM obs"))
def year_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years in which a tenth of the grid is valid; the grid's size is one row, which is broadcast."""
    obs = fx.obs(spark, sf_dir).withColumn("px", C("px_row") * 16 + C("px_col"))
    years = obs.filter("clear").groupBy(F.year("acq_date").alias("year")).agg(F.countDistinct("px").alias("n"))
    return years.join(F.broadcast(obs.agg(F.countDistinct("px").alias("total"))), C("n") >= 0.1 * C("total")).select("year", "n", "total")


@REGISTRY.query("x72_sensor_fusion", fx.sql(
    f"SELECT px_row, px_col, {_r('CASE WHEN a IS NULL THEN b WHEN b IS NULL THEN a ELSE w * a + (1 - w) * b END AS fused')} FROM (SELECT j.*, least(greatest(1 - abs(a - b) / nullif(p, 0), 0.1), 1) AS w FROM j, t)", "obs",
    j="SELECT px_row, px_col, median(CASE WHEN sensor = 'landsat' THEN nir END) AS a, median(CASE WHEN sensor = 'sentinel2' AND acq_date < DATE '1996-01-01' THEN nir END) AS b FROM obs GROUP BY 1, 2", t="SELECT quantile_cont(abs(a - b), 0.95) AS p FROM j"))
def sensor_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sensors' composites fused by agreement, as against the 95th percentile of their difference."""
    j = fx.obs(spark, sf_dir).groupBy(*PX).agg(F.median(F.when(C("sensor") == "landsat", C("nir"))).alias("a"), F.median(F.when((C("sensor") == "sentinel2") & (C("acq_date") < F.lit("1996-01-01").cast("date")), C("nir"))).alias("b"))
    p = percentiles(j.select(F.abs(C("a") - C("b")).alias("d")), "d", [0.95])[0]
    return j.select(*PX, r6(co.fuse_sensors(C("a"), C("b"), F.lit(p).cast("double"))).alias("fused"))


@REGISTRY.query("a33_contrast_stretch", fx.sql(f"SELECT px_row, px_col, {_r('least(greatest((m - lo) / nullif(hi - lo, 0), 0), 1) ** 0.85 AS shade')} FROM m, s", "obs", m="SELECT px_row, px_col, avg(red) AS m FROM obs GROUP BY 1, 2", s="SELECT quantile_cont(m, 0.02) AS lo, quantile_cont(m, 0.98) AS hi FROM m"))
def contrast_stretch(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = fx.obs(spark, sf_dir).groupBy(*PX).agg(F.avg("red").alias("m"))
    return percentile_stretch(m, "m").select(*PX, r6(F.pow(C("m"), F.lit(0.85))).alias("shade"))


@REGISTRY.query("a21_histogram", fx.sql("SELECT sensor, CAST(CASE WHEN nir >= 0.08 THEN 51 ELSE floor(nir / 0.08 * 50) + 1 END AS BIGINT) AS bin, count(*) AS n FROM obs GROUP BY 1, 2", "obs"))
def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.obs(spark, sf_dir).groupBy("sensor", F.width_bucket("nir", F.lit(0.0), F.lit(0.08), F.lit(50)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


_SERIES = "SELECT event_type, CAST(ts AS DATE) AS day, avg(value) AS v FROM events GROUP BY 1, 2"


@REGISTRY.query("a22_scene_series", fx.sql(f"SELECT event_type, day, {_r('v AS mean', 'avg(v) OVER (PARTITION BY event_type ORDER BY day ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS smooth')} FROM s", s=_SERIES))
def scene_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily means and their centred rolling mean over five scenes."""
    s = fx.table(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.avg("value").alias("v"))
    w = Window.partitionBy("event_type").orderBy("day").rowsBetween(-2, 2)
    return s.select("event_type", "day", r6(C("v")).alias("mean"), r6(F.avg("v").over(w)).alias("smooth"))


@REGISTRY.query("x33_softmax_argmax", fx.sql(
    "SELECT vec_id, CAST(list_position(p, list_max(p)) - 1 AS INT) AS best, round(list_max(p), 6) AS top, round(list_sum(list_transform(p, lambda x: -x * log2(x))) / log2(12), 6) AS entropy FROM q", "probs",
    e="SELECT vec_id, list_transform(logits, lambda x: exp(x - list_max(logits))) AS e FROM probs", q="SELECT vec_id, list_transform(e, lambda x: x / list_sum(e)) AS p FROM e"))
def softmax_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = fx.probs(spark, sf_dir).select("vec_id", scores.softmax(C("logits")).alias("p"))
    return p.select("vec_id", scores.argmax(C("p")).alias("best"), F.round(F.array_max("p"), 6).alias("top"), F.round(scores.entropy_share(C("p")), 6).alias("entropy"))


@REGISTRY.query("x39_crosswalk", "SELECT p_partkey, code, " + "CASE " + " ".join(f"WHEN code = {k} THEN {v}" for k, v in classes.CROSSWALK_8.items()) + " ELSE 7 END AS class_8, CASE " + " ".join(f"WHEN code = {k} THEN {v}" for k, v in classes.CROSSWALK_12.items()) + " ELSE 0 END AS class_12 FROM (SELECT p_partkey, [11,21,22,23,24,31,41,42,43,52,71,81,82,90,95,255][1 + p_partkey % 16] AS code FROM part)")
def crosswalk(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = F.array(*[F.lit(x) for x in (11, 21, 22, 23, 24, 31, 41, 42, 43, 52, 71, 81, 82, 90, 95, 255)])
    t = fx.table(spark, sf_dir, "part").select("p_partkey", F.element_at(codes, (1 + C("p_partkey") % 16).cast("int")).alias("code"))
    return t.select("p_partkey", "code", classes.crosswalk(C("code"), classes.CROSSWALK_8, 7).alias("class_8"), classes.crosswalk(C("code"), classes.CROSSWALK_12, 0).alias("class_12"))


@REGISTRY.query("a38_stratified_sample", "SELECT p_brand, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY md5(p_partkey || ':42'), p_partkey) AS n FROM part) WHERE n <= 100")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundred parts of each brand, chosen by a seeded hash: the same on every run."""
    w = Window.partitionBy("p_brand").orderBy(F.md5(F.concat(C("p_partkey").cast("string"), F.lit(":42"))), "p_partkey")
    return fx.table(spark, sf_dir, "part").withColumn("n", F.row_number().over(w)).filter("n <= 100").select("p_brand", "p_partkey")
