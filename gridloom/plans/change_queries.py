"""Queries on yearly class maps: change, trajectories, accuracy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.functions import classes
from gridloom.functions.guards import r6
from gridloom.operators import landcover as lc
from gridloom.plans.registry import Registry
from gridloom.sources import fixtures as fx

REGISTRY = Registry()
C = F.col
PIXEL_HA = 0.09


def _maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.class_map(spark, sf_dir)


_TM = "SELECT a.class_id AS from_class, b.class_id AS to_class, count(*) AS n FROM class_map a JOIN class_map b ON a.px = b.px AND a.year = 1995 AND b.year = 2000 GROUP BY 1, 2"


@REGISTRY.query("a16_transition_matrix", fx.sql("SELECT *, round(n * 0.09, 6) AS ha FROM t", "class_map", t=_TM))
def transition_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lc.transitions(_maps(spark, sf_dir), ["px"], "year", "class_id", 1995, 2000).withColumn("ha", F.round(C("n") * PIXEL_HA, 6))


@REGISTRY.query("a17_gain_loss", fx.sql("SELECT class_id, sum(g)::BIGINT AS gain, sum(l)::BIGINT AS loss, (sum(g) - sum(l))::BIGINT AS net FROM (SELECT to_class AS class_id, n AS g, 0 AS l FROM t WHERE from_class <> to_class UNION ALL SELECT from_class, 0, n FROM t WHERE from_class <> to_class) GROUP BY 1", "class_map", t=_TM))
def gain_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lc.gains_losses(lc.transitions(_maps(spark, sf_dir), ["px"], "year", "class_id", 1995, 2000))


_YEARS = "SELECT year, lead(year) OVER (ORDER BY year) AS next FROM (SELECT DISTINCT year FROM class_map)"
_STEPS = "SELECT a.year AS y1, b.year AS y2, a.class_id AS c1, b.class_id AS c2, count(*) AS n FROM class_map a JOIN yr ON a.year = yr.year JOIN class_map b ON a.px = b.px AND b.year = yr.next GROUP BY ALL"
_PRODUCTS = """SELECT 'steps' AS product, y1 AS a, y2 AS b, c1 AS c, c2 AS d, CAST(n AS DOUBLE) AS value FROM s
 UNION ALL SELECT 'intensity', y1, y2, -1, -1, round(100.0 * sum(CASE WHEN c1 <> c2 THEN n ELSE 0 END) / sum(n), 6) FROM s GROUP BY 2, 3
 UNION ALL SELECT 'fractions', year, class_id, -1, -1, round(count(*) / sum(count(*)) OVER (PARTITION BY year)::DOUBLE, 6) FROM class_map GROUP BY 2, 3
 UNION ALL SELECT 'net', k, -1, -1, -1, CAST(sum(g) AS DOUBLE) FROM (SELECT b.class_id AS k, 1 AS g FROM class_map a JOIN class_map b ON a.px = b.px AND a.year = (SELECT min(year) FROM class_map) AND b.year = (SELECT max(year) FROM class_map) AND a.class_id <> b.class_id UNION ALL SELECT a.class_id, -1 FROM class_map a JOIN class_map b ON a.px = b.px AND a.year = (SELECT min(year) FROM class_map) AND b.year = (SELECT max(year) FROM class_map) AND a.class_id <> b.class_id) GROUP BY 2"""


@REGISTRY.query("a42_change_products", fx.sql(_PRODUCTS, "class_map", yr=_YEARS, s=_STEPS))
def change_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The products of an analysis over all years, as one table; -1 stands for a key that a product has not."""
    m = _maps(spark, sf_dir)
    years = sorted(r.year for r in m.select("year").distinct().collect())
    p = lc.change_products(m, ["px"], "year", "class_id", years, (5, 6), PIXEL_HA)
    row = lambda name, frame, keys, value: frame.select(F.lit(name).alias("product"), *[(C(k) if k else F.lit(-1)).cast("int").alias(n) for k, n in zip(keys, "abcd", strict=True)], value.cast("double").alias("value"))
    out = row("steps", p["steps"], ["from_year", "to_year", "from_class", "to_class"], C("n"))
    for name, keys, value in (("intensity", ["from_year", "to_year", None, None], F.round("percent", 6)), ("fractions", ["year", "class_id", None, None], F.round("share", 6))):
        out = out.unionByName(row(name, p[name], keys, value))
    return out.unionByName(row("net", p["gains_losses"], ["class_id", None, None, None], C("net")))


@REGISTRY.query("a24_top_flows", fx.sql("SELECT from_class, to_class, n FROM (SELECT *, row_number() OVER (ORDER BY n DESC, from_class, to_class) AS r FROM t WHERE from_class <> to_class) WHERE r <= 10", "class_map", t=_TM))
def top_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten largest flows between classes."""
    return lc.transitions(_maps(spark, sf_dir), ["px"], "year", "class_id", 1995, 2000).filter("from_class <> to_class").orderBy(F.desc("n"), "from_class", "to_class").limit(10)


@REGISTRY.query("x38_change_code", fx.sql("SELECT a.px, CASE WHEN a.class_id = b.class_id THEN -1 ELSE a.class_id * 8 + b.class_id END AS code FROM class_map a JOIN class_map b ON a.px = b.px AND a.year = 1995 AND b.year = 2000", "class_map"))
def change_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Then-and-now join of two years on the pixel, as one code."""
    m = _maps(spark, sf_dir)
    a, b = m.filter("year = 1995").select("px", C("class_id").alias("a")), m.filter("year = 2000").select("px", C("class_id").alias("b"))
    return a.join(b, "px").select("px", classes.transition_code(C("a"), C("b"), 8).alias("code"))


_STEP = "SELECT *, lag(class_id) OVER w AS prev, lead(class_id, 1) OVER w AS n1, lead(class_id, 2) OVER w AS n2 FROM class_map WINDOW w AS (PARTITION BY px ORDER BY year)"


@REGISTRY.query("w23_change_count", fx.sql("SELECT px, count(CASE WHEN prev <> class_id THEN 1 END) AS n_changes, count(*) AS n_years FROM s GROUP BY 1", "class_map", s=_STEP))
def change_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lc.year_steps(_maps(spark, sf_dir), ["px"], "year", "class_id").groupBy("px").agg(F.count_if(C("prev") != C("class_id")).alias("n_changes"), F.count(F.lit(1)).alias("n_years"))


@REGISTRY.query("w24_flip_flop", fx.sql("SELECT count(n2) AS triples, count(CASE WHEN class_id = n2 AND class_id <> n1 THEN 1 END) AS flips, round(count(CASE WHEN class_id = n2 AND class_id <> n1 THEN 1 END) / nullif(count(n2), 0)::DOUBLE, 6) AS share FROM s", "class_map", s=_STEP))
def flip_flop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples of years that go from a class to another and back."""
    flips = F.count_if((C("class_id") == C("next2")) & (C("class_id") != C("next1")))
    s = lc.year_steps(_maps(spark, sf_dir), ["px"], "year", "class_id").agg(F.count("next2").alias("triples"), flips.alias("flips"))
    return s.withColumn("share", F.round(F.try_divide(C("flips").cast("double"), C("triples")), 6))


@REGISTRY.query("w25_change_rate", fx.sql("SELECT round(avg(r), 6) AS mean_rate, round(max(r), 6) AS max_rate FROM (SELECT year, avg((prev <> class_id)::INT) AS r FROM s WHERE prev IS NOT NULL GROUP BY 1)", "class_map", s=_STEP))
def change_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = lc.year_steps(_maps(spark, sf_dir), ["px"], "year", "class_id").filter("prev is not null")
    return s.groupBy("year").agg(F.avg((C("prev") != C("class_id")).cast("double")).alias("r")).agg(F.round(F.avg("r"), 6).alias("mean_rate"), F.round(F.max("r"), 6).alias("max_rate"))


@REGISTRY.query("w26_trend", fx.sql(
    "SELECT px, n_years, n_changes, CASE WHEN ld > ed + 0.2::DOUBLE THEN 1 WHEN lv > ev + 0.2::DOUBLE THEN 2 WHEN ev > lv + 0.2::DOUBLE THEN 3 WHEN n_changes > n_years * 0.4::DOUBLE THEN 4 ELSE 0 END AS trend FROM g", "class_map",
    b="SELECT *, count(*) OVER (PARTITION BY px) AS n, row_number() OVER (PARTITION BY px ORDER BY year) AS i, lag(class_id) OVER (PARTITION BY px ORDER BY year) AS prev FROM class_map",
    g="""SELECT px, max(n) AS n_years, count(CASE WHEN prev <> class_id THEN 1 END) AS n_changes,
 coalesce(avg(CASE WHEN i <= n // 2 THEN (class_id IN (5, 6))::INT END), 0) AS ed, coalesce(avg(CASE WHEN i > n // 2 THEN (class_id IN (5, 6))::INT END), 0) AS ld,
 coalesce(avg(CASE WHEN i <= n // 2 THEN (class_id IN (2, 3))::INT END), 0) AS ev, coalesce(avg(CASE WHEN i > n // 2 THEN (class_id IN (2, 3))::INT END), 0) AS lv FROM b GROUP BY 1"""))  # fmt: skip
def trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lc.trend(_maps(spark, sf_dir), ["px"], "year", "class_id").select("px", "n_years", "n_changes", "trend")


_ALLOWED = " ".join(f"WHEN {k} THEN c IN ({', '.join(map(str, v))})" for k, v in classes.ALLOWED.items())


@REGISTRY.query("w27_transition_constraint", f"""WITH RECURSIVE class_map AS ({fx.SQL['class_map']}), s AS (SELECT px, year, class_id AS c, row_number() OVER (PARTITION BY px ORDER BY year) AS i FROM class_map),
 f AS (SELECT px, year, c, i, c AS fixed FROM s WHERE i = 1 UNION ALL SELECT s.px, s.year, s.c, s.i, CASE WHEN CASE f.fixed {_ALLOWED.replace('c IN', 's.c IN')} END THEN s.c ELSE f.fixed END FROM f JOIN s ON s.px = f.px AND s.i = f.i + 1)
 SELECT px, year, c AS class_id, fixed AS corrected FROM f""")
def transition_constraint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lc.constrain(_maps(spark, sf_dir), ["px"], "year", "class_id", classes.ALLOWED)


@REGISTRY.query("w28_decade_endpoints", fx.sql(
    "SELECT a.px, a.class_id AS end_90s, b.class_id AS start_00s FROM (SELECT * FROM class_map WHERE year < 2000 QUALIFY row_number() OVER (PARTITION BY px ORDER BY year DESC) = 1) a JOIN (SELECT * FROM class_map WHERE year >= 2000 QUALIFY row_number() OVER (PARTITION BY px ORDER BY year) = 1) b ON a.px = b.px", "class_map"))
def decade_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last class of one decade and the first of the next."""
    m = _maps(spark, sf_dir)
    out = m.groupBy("px").agg(F.max_by("class_id", F.when(C("year") < 2000, C("year"))).alias("end_90s"), F.min_by("class_id", F.when(C("year") >= 2000, C("year"))).alias("start_00s"))
    return out.dropna()


@REGISTRY.query("w29_trajectory", fx.sql(
    "SELECT px, n_changes, f AS first_class, l AS last_class, n_changes >= 3 AS hotspot, CASE WHEN f <> l AND f IN (5, 6) THEN 2 WHEN f <> l AND l IN (5, 6) THEN 1 WHEN f <> l THEN 3 ELSE 0 END AS trajectory FROM (SELECT px, count(CASE WHEN prev <> class_id THEN 1 END) AS n_changes, arg_min(class_id, year) AS f, arg_max(class_id, year) AS l FROM s GROUP BY 1)", "class_map", s=_STEP))
def trajectory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lc.trajectory(_maps(spark, sf_dir), ["px"], "year", "class_id", (5, 6))


@REGISTRY.query("a15_dominant_class", fx.sql("SELECT px, class_id, n FROM (SELECT px, class_id, count(*) AS n, row_number() OVER (PARTITION BY px ORDER BY count(*) DESC, class_id) AS r FROM class_map GROUP BY 1, 2) WHERE r = 1", "class_map"))
def dominant_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lc.dominant(_maps(spark, sf_dir), ["px"], "class_id")


@REGISTRY.query("a19_annual_fractions", fx.sql("SELECT year, class_id, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY year)::DOUBLE, 6) AS share FROM class_map GROUP BY 1, 2", "class_map"))
def annual_fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _maps(spark, sf_dir).groupBy("year", "class_id").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.round(C("n") / F.sum("n").over(Window.partitionBy("year")).cast("double"), 6))


@REGISTRY.query("a20_change_intensity", fx.sql("SELECT year, count(*) AS n, count(CASE WHEN prev <> class_id THEN 1 END) AS n_changed, round(100.0 * count(CASE WHEN prev <> class_id THEN 1 END) / count(*), 6) AS percent, round(count(CASE WHEN prev <> class_id THEN 1 END) * 0.09, 6) AS ha FROM s WHERE prev IS NOT NULL GROUP BY 1", "class_map", s=_STEP))
def change_intensity(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = lc.year_steps(_maps(spark, sf_dir), ["px"], "year", "class_id").filter("prev is not null").groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.count_if(C("prev") != C("class_id")).alias("n_changed"))
    return s.select("year", "n", "n_changed", F.round(100.0 * C("n_changed") / C("n"), 6).alias("percent"), F.round(C("n_changed") * PIXEL_HA, 6).alias("ha"))


@REGISTRY.query("k16_area_by_class", fx.sql("SELECT year, " + ", ".join(f"round(count(CASE WHEN class_id = {i} THEN 1 END) * 0.09, 6) AS class_{i}" for i in range(8)) + " FROM class_map GROUP BY 1", "class_map"))
def area_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hectares of each class as columns, a row for each year."""
    wide = _maps(spark, sf_dir).groupBy("year").pivot("class_id", list(range(8))).agg(F.count(F.lit(1)))
    return wide.select("year", *[F.round(F.coalesce(C(str(i)), F.lit(0)) * PIXEL_HA, 6).alias(f"class_{i}") for i in range(8)])


_PAIRS = "SELECT CAST(vec_id % 10 AS INT) AS pred, label AS ref, count(*) AS n FROM embeddings GROUP BY 1, 2"


def _matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lc.confusion(fx.table(spark, sf_dir, "embeddings").select((C("vec_id") % 10).alias("p"), "label"), "p", "label")


@REGISTRY.query("a18_confusion_matrix", _PAIRS)
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matrix(spark, sf_dir)


@REGISTRY.query("a18_overall_accuracy", fx.sql("SELECT total, round(po, 6) AS accuracy, round((po - pe) / nullif(1 - pe, 0), 6) + 0.0 AS kappa FROM (SELECT sum(n)::BIGINT AS total, sum(CASE WHEN pred = ref THEN n ELSE 0 END) / sum(n)::DOUBLE AS po, (SELECT sum(a.n::DOUBLE * b.n) FROM m a JOIN m b ON a.pred = b.ref) / sum(n)::DOUBLE ** 2 AS pe FROM m)", m=_PAIRS))
def overall_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lc.overall_accuracy(_matrix(spark, sf_dir)).select("total", F.round("accuracy", 6).alias("accuracy"), r6(C("kappa")).alias("kappa"))


@REGISTRY.query("a18_class_accuracy", fx.sql("SELECT class_id, round(h / nullif(r, 0)::DOUBLE, 6) AS producers, round(h / nullif(p, 0)::DOUBLE, 6) AS users, round(2.0::DOUBLE * h / nullif(r + p, 0), 6) AS f1 FROM (SELECT class_id, sum(p) AS p, sum(r) AS r, sum(h) AS h FROM (SELECT pred AS class_id, n AS p, 0 AS r, CASE WHEN pred = ref THEN n ELSE 0 END AS h FROM m UNION ALL SELECT ref, 0, n, 0 FROM m) GROUP BY 1)", m=_PAIRS))
def class_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lc.class_accuracy(_matrix(spark, sf_dir)).select("class_id", *[F.round(c, 6).alias(c) for c in ("producers", "users", "f1")])


@REGISTRY.query("a39_self_consistency", fx.sql(
    "SELECT a.class_id AS pred, b.class_id AS ref, count(*) AS n FROM class_map a JOIN class_map b ON a.px = b.px WHERE a.year = (SELECT y[len(y) // 2] FROM l) AND b.year = (SELECT y[len(y) // 2 + 1] FROM l) GROUP BY 1, 2", "class_map", l="SELECT list(DISTINCT year ORDER BY year) AS y FROM class_map"))
def self_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confusion of the two middle years, for want of a reference."""
    m = _maps(spark, sf_dir)
    years = m.agg(F.array_sort(F.collect_set("year")).alias("y"))
    middle = years.select(F.element_at("y", F.floor(F.size("y") / 2).cast("int")).alias("y1"), F.element_at("y", (F.floor(F.size("y") / 2) + 1).cast("int")).alias("y2"))
    a = m.join(F.broadcast(middle), C("year") == C("y1")).select("px", C("class_id").alias("pred"))
    b = m.join(F.broadcast(middle), C("year") == C("y2")).select("px", C("class_id").alias("ref"))
    return lc.confusion(a.join(b, "px"), "pred", "ref")


_NEAR = "SELECT l.y AS map_year, r.y AS ref_year, row_number() OVER (PARTITION BY l.y ORDER BY abs(l.y - r.y), r.y) AS k FROM (SELECT DISTINCT year AS y FROM class_map) l, (SELECT unnest([1992, 2001, 2004, 2006]) AS y) r"


@REGISTRY.query("j6_nearest_year", fx.sql("SELECT map_year, ref_year FROM n WHERE k = 1 AND abs(map_year - ref_year) <= 2", "class_map", n=_NEAR))
def nearest_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Map years with the reference year nearest to them, two years off at most."""
    refs = spark.createDataFrame([(1992,), (2001,), (2004,), (2006,)], "ref_year int")
    return lc.nearest_year(_maps(spark, sf_dir).withColumnRenamed("year", "map_year"), refs, "map_year", "ref_year", 2)


@REGISTRY.query("a41_valid_percent", fx.sql("SELECT year, round(100.0 * count(*) / (SELECT count(DISTINCT px) FROM class_map), 6) AS percent FROM class_map GROUP BY 1", "class_map"))
def valid_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _maps(spark, sf_dir)
    return m.groupBy("year").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(m.agg(F.countDistinct("px").alias("t")))).select("year", F.round(100.0 * C("n") / C("t"), 6).alias("percent"))
