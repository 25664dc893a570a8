"""Queries on encoders, kernels, geometry, learning and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import encoders, scores, spectral
from gridloom.functions.geo import ring_area, ring_length
from gridloom.functions.guards import r6
from gridloom.operators import geometry, kernels, learning
from gridloom.plans.registry import Registry
from gridloom.sources import fixtures as fx
from gridloom.streaming import monitor

REGISTRY = Registry()
C = F.col


_D = lambda a, b: f"CASE WHEN {a} + {b} = 0 THEN 0 ELSE ({a} - {b}) / nullif({a} + {b}, 0) END"


def _encoder_sql(select: str, source: str, ndwi: str, mndwi: str, awei: str, **more: str) -> str:
    """DuckDB text over `p`, the source's rows with the probabilities p0 to p7 of the water encoder."""
    u = encoders.water_circuit().tolist()
    terms = []
    for k in range(8):
        turned = f"(({u[k][0]!r}) * s0 + ({u[k][1]!r}) * s1)"
        rest = " + ".join(f"({u[k][j]!r}) * s{j}" for j in range(2, 8))
        terms.append(f"({turned} * cos(a3) + {rest}) ** 2 + ({turned} * sin(a3)) ** 2 AS p{k}")
    states = ", ".join(f"{'sin' if k & 4 else 'cos'}(a1 / 2) * {'sin' if k & 2 else 'cos'}(a2 / 2) * {'sin' if k & 1 else 'cos'}(a3 / 2) AS s{k}" for k in range(8))
    return fx.sql(
        select, "obs", **more,
        a=f"SELECT *, (1 - {ndwi}) / 2 * pi() AS a1, (1 - coalesce({mndwi}, 0)) / 2 * pi() AS a2, (1 - 1 / (1 + exp(-coalesce({awei}, 0)))) * pi() AS a3 FROM {source}",
        s=f"SELECT *, {states} FROM a", p=f"SELECT *, {', '.join(terms)} FROM s",
    )


_WATER_SQL = _encoder_sql(
    f"SELECT {fx.KEY_SQL}, round(p0 + p1, 6) + 0.0 AS water, round(greatest(p0, p1, p2, p3, p4, p5, p6, p7), 6) AS confidence FROM p",
    "obs", f"0.3::DOUBLE * ({_D('green', 'nir')})", f"0.35::DOUBLE * ({_D('green', 'swir1')})", "0.35::DOUBLE * (4 * (green - swir1) - (0.25 * nir + 2.75 * swir2))",
)
_DRAW = lambda part: f"(CAST('0x' || substr(md5(concat_ws('|', {fx.KEY_SQL}, sample, '{42 + part}')), 1, 10) AS BIGINT) + 0.5) / {1 << 40}::DOUBLE"
_NOISE_SQL = _encoder_sql(
    f"SELECT {fx.KEY_SQL}, round(avg(p0 + p1), 6) AS mean, round(stddev_pop(p0 + p1), 6) AS std FROM p GROUP BY ALL",
    "disturbed", f"0.3::DOUBLE * ({_D('green', 'nir')})", "0.0::DOUBLE", "0.0::DOUBLE",
    sampled="SELECT *, unnest(range(8)) AS sample FROM obs",
    disturbed=f"SELECT * REPLACE (CASE WHEN sample = 0 THEN green ELSE green + 0.02::DOUBLE * sqrt(-2 * ln({_DRAW(0)})) * cos(2 * pi() * {_DRAW(1)}) END AS green) FROM sampled",
)


def _classes_sql() -> str:
    rows = ", ".join(f"list_dot_product(v, {[float(x) for x in row]})" for row in encoders.class_circuit())
    return f"""WITH e AS (SELECT vec_id, list_transform(embedding[1:8], lambda x: x::DOUBLE) AS f FROM embeddings),
 n AS (SELECT vec_id, list_concat(f, list_transform(range(16 - len(f)), lambda i: 0.0::DOUBLE)) AS f, sqrt(list_sum(list_transform(f, lambda x: x * x))) AS norm FROM e),
 u AS (SELECT vec_id, CASE WHEN norm > 1e-10 THEN list_transform(f, lambda x: x / norm) ELSE list_concat([1.0::DOUBLE], list_transform(range(15), lambda i: 0.0::DOUBLE)) END AS v FROM n),
 b AS (SELECT vec_id, list_transform([{rows}], lambda x: x * x) AS q FROM u),
 p AS (SELECT vec_id, list_transform(range(1, 9), lambda c: q[2 * c - 1] + q[2 * c]) AS p FROM b)
 SELECT vec_id, CAST(list_position(p, list_max(p)) - 1 AS INT) AS best, round(list_max(p), 6) AS top, round(-list_sum(list_transform(p, lambda x: CASE WHEN x > 0 THEN x * log2(x) ELSE 0 END)) / 3, 6) AS entropy FROM p"""


def _smooth_sql(sigma: float, select: str) -> str:
    """DuckDB text over `g`: the grid (row, col, z) and its Gaussian surface s, edges mirrored as often as needed."""
    reach = int(4 * sigma + 0.5)
    mirror = lambda at, lo, hi: f"CASE WHEN (({at} - {lo}) % n2 + n2) % n2 < n2 / 2 THEN {lo} + (({at} - {lo}) % n2 + n2) % n2 ELSE {lo} + n2 - 1 - (({at} - {lo}) % n2 + n2) % n2 END"
    one = lambda axis, other, source: (
        f"SELECT t.{axis}, t.{other}, t.z, sum(x.s * t.w) AS s FROM (SELECT *, {mirror(f'{axis} + i', 'lo', 'hi')} AS at FROM {source}, w, (SELECT min({axis}) AS lo, max({axis}) AS hi, 2 * (max({axis}) - min({axis}) + 1) AS n2 FROM {source})) t JOIN {source} x ON x.{axis} = t.at AND x.{other} = t.{other} GROUP BY 1, 2, 3"
    )
    return fx.sql(
        select, "dem", w=f"SELECT i, exp(-0.5 * (i / {sigma}::DOUBLE) ** 2) / (SELECT sum(exp(-0.5 * (j / {sigma}::DOUBLE) ** 2)) FROM (SELECT unnest(range(-{reach}, {reach + 1})) AS j)) AS w FROM (SELECT unnest(range(-{reach}, {reach + 1})) AS i)",
        z0="SELECT row, col, z, z AS s FROM dem", z1=one("row", "col", "z0"), g=one("col", "row", "z1"),
    )


def _hats_sql(select: str, elements: list[list[tuple[int, int]]], hats: str) -> str:
    """DuckDB text over `h`: row, col and each element's opening (o) and closing (c) of the grid, cut at its edges."""
    values = ", ".join(f"({k}, {r}, {c})" for k, e in enumerate(elements) for r, c in e)
    step = lambda pick, source, sign: f"SELECT k, row, col, {pick}(v) AS v FROM (SELECT x.k, x.row {sign} e.r AS row, x.col {sign} e.c AS col, x.v FROM e JOIN {source} x ON x.k = e.n) SEMI JOIN dem USING (row, col) GROUP BY 1, 2, 3"
    return fx.sql(
        select, "dem", e=f"SELECT * FROM (VALUES {values}) t(n, r, c)", z="SELECT n AS k, row, col, z AS v FROM dem, (SELECT DISTINCT n FROM e)",
        lo=step("min", "z", "-"), op=step("max", "lo", "+"), hi=step("max", "z", "-"), cl=step("min", "hi", "+"),
        h=f"SELECT d.row, d.col, {hats} AS h FROM dem d JOIN op USING (row, col) JOIN cl USING (row, col, k) GROUP BY 1, 2",
    )


@REGISTRY.query("m9_water_encoder", _WATER_SQL)
def water_encoder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Water probability and confidence of the three-qubit encoder."""
    ndwi, mndwi = spectral.difference(C("green"), C("nir")), spectral.difference(C("green"), C("swir1"))
    awei = spectral.awei_sh(C("green"), C("nir"), C("swir1"), C("swir2"))
    df = encoders.with_water_probability(fx.obs(spark, sf_dir), 0.3 * ndwi, 0.35 * mndwi, 0.35 * awei)
    return df.select(*fx.OBS_KEY, r6(C("water")).alias("water"), F.round("confidence", 6).alias("confidence"))


@REGISTRY.query("m10_class_encoder", _classes_sql())
def class_encoder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class probabilities of the four-qubit encoder, the best class and the share of the entropy."""
    p = fx.table(spark, sf_dir, "embeddings").select("vec_id", encoders.class_probabilities(F.slice("embedding", 1, 8)).alias("p"))
    return p.select("vec_id", scores.argmax(C("p")).alias("best"), F.round(F.array_max("p"), 6).alias("top"), F.round(scores.entropy_share(C("p")), 6).alias("entropy"))


@REGISTRY.query("w10_anomaly", _smooth_sql(5.0, "SELECT row, col, round(least(greatest(((z - s) / (1.5 * d) + 3) / 6, 0), 1), 6) AS anomaly FROM g, (SELECT stddev_pop(z) AS d FROM g)"))
def anomaly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Residual of a Gaussian surface in deviations, as 0..1."""
    d = fx.dem(spark, sf_dir)
    j = d.join(kernels.apply_tiles(d, "z", kernels.gaussian(5.0), 20), ["row", "col"])
    std = j.agg(F.stddev_pop("z").alias("s"))
    return j.crossJoin(F.broadcast(std)).select("row", "col", F.round(F.least(F.greatest(((C("z") - C("result")) / (1.5 * C("s")) + 3) / 6, F.lit(0.0)), F.lit(1.0)), 6).alias("anomaly"))


@REGISTRY.query("w15_building_index", _hats_sql("SELECT row, col, round(h, 6) AS mbi FROM h", [kernels.line_element(n, a) for n in (3, 5) for a in (0, 45, 90, 135)], "avg(d.z - op.v)"))
def building_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernels.apply_tiles(fx.dem(spark, sf_dir), "z", kernels.building_index((3, 5)), 10, result="mbi").select("row", "col", F.round("mbi", 6).alias("mbi"))


@REGISTRY.query("w16_attribute_profile", _hats_sql("SELECT row, col, round(h, 6) AS profile FROM h", [kernels.disk_element(r) for r in (3, 5)], "avg(cl.v - op.v) / 2"))
def attribute_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernels.apply_tiles(fx.dem(spark, sf_dir), "z", kernels.attribute_profile((3, 5)), 10, result="profile").select("row", "col", F.round("profile", 6).alias("profile"))


@REGISTRY.query("w19_shadow_distance", fx.sql("SELECT d.row, d.col, round(least(coalesce(min(sqrt((d.row - p.row) ** 2 + (d.col - p.col) ** 2)), 9), 9), 6) AS distance FROM dem d LEFT JOIN (SELECT * FROM dem WHERE CAST(floor(z) AS BIGINT) % 17 = 0) p ON p.row BETWEEN d.row - 8 AND d.row + 8 AND p.col BETWEEN d.col - 8 AND d.col + 8 GROUP BY 1, 2", "dem"))
def shadow_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance to the nearest set cell, nine at most."""
    m = fx.dem(spark, sf_dir).select("row", "col", (F.floor("z") % 17 == 0).cast("double").alias("s"))
    return kernels.apply_tiles(m, "s", kernels.distance(8), 8, result="distance").select("row", "col", F.round("distance", 6).alias("distance"))


def _rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L-shaped rings of varying size."""
    k = C("p_partkey")
    w, h = 2 + k % 7, 3 + k % 5
    pts = [(0, 0), (w, 0), (w, 1), (1, 1), (1, h), (0, h), (0, 0)]
    ring = F.array(*[F.struct((F.lit(x) if isinstance(x, int) else x).cast("double").alias("x"), (F.lit(y) if isinstance(y, int) else y).cast("double").alias("y")) for x, y in pts])
    return fx.table(spark, sf_dir, "part").select(k.alias("id"), ring.alias("ring"))


@REGISTRY.query("x67_shape_metrics", "SELECT id, w + h - 1.0::DOUBLE AS area, 2.0::DOUBLE * (w + h) AS perimeter, round(least(4 * pi() * (w + h - 1) / (4.0::DOUBLE * (w + h) * (w + h)), 1.0), 6) AS compactness, round((w + h - 1) / (w * h - (w - 1) * (h - 1) / 2.0::DOUBLE), 6) AS solidity FROM (SELECT p_partkey AS id, 2 + p_partkey % 7 AS w, 3 + p_partkey % 5 AS h FROM part)")
def shape_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = geometry.shape_metrics(_rings(spark, sf_dir))
    return m.select("id", "area", "perimeter", F.round("compactness", 6).alias("compactness"), F.round("solidity", 6).alias("solidity"))


@REGISTRY.query("j8_clip", "SELECT id, round(least(w, 2.0) + least(h, 2.5) - 1, 6) AS area FROM (SELECT p_partkey AS id, 2.0::DOUBLE + p_partkey % 7 AS w, 3.0::DOUBLE + p_partkey % 5 AS h FROM part)")
def clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rings cut to a rectangle."""
    return geometry.clip_to_box(_rings(spark, sf_dir), "ring", -1.0, -1.0, 2.0, 2.5).select("id", F.round(ring_area(C("ring")), 6).alias("area"))


@REGISTRY.query("j8_clip_polygon", "SELECT id, round(least(w, 2.0) + least(h, 2.5) - 1 + least(w, 4.0) - 2, 6) AS area FROM (SELECT p_partkey AS id, 2.0::DOUBLE + p_partkey % 7 AS w, 3.0::DOUBLE + p_partkey % 5 AS h FROM part)")
def clip_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rings cut to an area of the shape of an L."""
    pieces = geometry.clip_to_polygon(_rings(spark, sf_dir), "ring", [(0, 0), (4, 0), (4, 1), (2, 1), (2, 2.5), (0, 2.5)])
    return pieces.groupBy("id").agg(F.round(F.sum(ring_area(C("ring"))), 6).alias("area"))


@REGISTRY.query("j9_rasterize", "SELECT id, count(*) AS cells FROM (SELECT p_partkey AS id, 2 + p_partkey % 7 AS w, 3 + p_partkey % 5 AS h FROM part), (SELECT unnest(range(12)) + 0.5 AS x) a, (SELECT unnest(range(12)) + 0.5 AS y) b WHERE (x < w AND y < 1) OR (x < 1 AND y < h) GROUP BY 1")
def rasterize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells whose centres lie in each ring."""
    cells = spark.range(144).select((C("id") % 12 + 0.5).alias("x"), (F.floor(C("id") / 12) + 0.5).alias("y"))
    return geometry.rasterize(_rings(spark, sf_dir), cells, "ring").groupBy("id").agg(F.count(F.lit(1)).alias("cells"))


@REGISTRY.query("j13_overlaps", "SELECT a.id AS left_id, b.id AS right_id FROM (SELECT s_suppkey AS id, s_suppkey * 37 % 50 AS x, s_suppkey * 17 % 40 AS y, 2 + s_suppkey % 4 AS w FROM supplier) a JOIN (SELECT s_suppkey AS id, s_suppkey * 37 % 50 AS x, s_suppkey * 17 % 40 AS y, 2 + s_suppkey % 4 AS w FROM supplier) b ON a.id < b.id AND a.x < b.x + b.w AND b.x < a.x + a.w AND a.y < b.y + b.w AND b.y < a.y + a.w")
def overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule that features must not overlap: its violations."""
    k = C("s_suppkey")
    s = fx.table(spark, sf_dir, "supplier").select(k.alias("id"), (k * 37 % 50).cast("double").alias("west"), (k * 17 % 40).cast("double").alias("south"), (2 + k % 4).alias("w"))
    return geometry.overlaps(s.withColumns({"east": C("west") + C("w"), "north": C("south") + C("w")}), "id", 8.0)


_BLOCKS = "SELECT id, CAST(y + unnest(range(w)) AS INT) AS row, CAST(x AS INT) AS col FROM (SELECT id, w, y, x + unnest(range(w)) AS x FROM (SELECT s_suppkey AS id, s_suppkey * 37 % 50 AS x, s_suppkey * 17 % 40 AS y, 2 + s_suppkey % 4 AS w FROM supplier))"


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells of squares."""
    k = C("s_suppkey")
    s = fx.table(spark, sf_dir, "supplier").select(k.alias("id"), (k * 37 % 50).alias("x"), (k * 17 % 40).alias("y"), (2 + k % 4).alias("w"))
    reach = lambda c: F.explode(F.sequence(C(c).cast("int"), (C(c) + C("w") - 1).cast("int")))
    return s.withColumn("row", reach("y")).withColumn("col", reach("x")).select("id", "row", "col")


@REGISTRY.query("j13_covered_by", fx.sql("SELECT id, count(*) AS n_cells FROM b WHERE id % 3 = 0 AND (row, col) NOT IN (SELECT (row, col) FROM b WHERE id % 3 <> 0) GROUP BY 1", b=_BLOCKS))
def covered_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule that features must be covered by those of another class: its violations."""
    b = _blocks(spark, sf_dir)
    return geometry.not_covered(b.filter("id % 3 = 0"), b.filter("id % 3 <> 0"), "id")


@REGISTRY.query("j13_gaps", f"""WITH RECURSIVE dem AS ({fx.SQL["dem"]}), size AS (SELECT max(row) AS bottom, max(col) AS side FROM dem), m AS (SELECT row, col, row * 2147483648 + col AS id FROM dem WHERE CAST(floor(z) AS BIGINT) % 3 = 0),
 e AS (SELECT a.id AS u, c.id AS v FROM m a JOIN m c ON abs(a.row - c.row) + abs(a.col - c.col) = 1),
 r(id, root) AS (SELECT id, id FROM m UNION SELECT e.v, r.root FROM r JOIN e ON e.u = r.id WHERE r.root < e.v),
 l AS (SELECT id, min(root) AS region FROM r GROUP BY 1)
 SELECT region, count(*) AS n_cells FROM l JOIN m USING (id), size GROUP BY 1 HAVING NOT bool_or(row IN (0, bottom) OR col IN (0, side))""")
def uncovered_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule that features must leave no gaps between them: its violations, on a grid of which two thirds are covered."""
    d = fx.dem(spark, sf_dir)
    size = d.agg(F.max("row").alias("rows"), F.max("col").alias("cols")).first()
    return geometry.gaps(d.filter(F.floor("z") % 3 != 0), size.rows + 1, size.cols + 1)


_KINDS = "SELECT row, col, CAST(floor(z) % 5 AS INT) AS kind FROM dem"


@REGISTRY.query("m5_outlines", fx.sql("SELECT kind, any_value(n) AS area, count(*) AS sides FROM (SELECT kind, row, col, unnest([-1, 0, 1, 0]) AS dr, unnest([0, 1, 0, -1]) AS dc FROM k) s JOIN (SELECT kind, count(*) AS n FROM k GROUP BY 1) USING (kind) WHERE (kind, row + dr, col + dc) NOT IN (SELECT (kind, row, col) FROM k) GROUP BY 1", "dem", k=_KINDS))
def outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outlines of labelled cells: what they enclose, less their holes, and how long they are."""
    cells = fx.dem(spark, sf_dir).select("row", "col", (F.floor("z") % 5).cast("int").alias("kind"))
    o = geometry.outlines(cells, "kind")
    area = ring_area(C("ring")) * F.when(C("outer"), 1).otherwise(-1)
    return o.groupBy("kind").agg(F.sum(area).cast("long").alias("area"), F.sum(ring_length(C("ring"))).cast("long").alias("sides"))


@REGISTRY.query("x65_areas", "SELECT s_suppkey, round(degrees(25 / 6371.0088), 6) AS half_height, round(degrees(asin(sin(25 / 6371.0088::DOUBLE) / cos(radians(lat)))), 3) AS half_width, 65 AS points FROM (SELECT s_suppkey, s_suppkey % 120 - 60 AS lat FROM supplier)")
def areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Circles of 25 km about points: how far they reach from their centres, in degrees."""
    k = C("s_suppkey")
    s = fx.table(spark, sf_dir, "supplier").select(k, (k * 7 % 300 - 150).cast("double").alias("lon"), (k % 120 - 60).cast("double").alias("lat"))
    ring = s.withColumn("ring", geometry.closed_ring(geometry.buffer_ring(C("lon"), C("lat"), 25.0)))
    top = lambda c, o: F.array_max(F.transform("ring", lambda p: p[c])) - C(o)
    return ring.select(k, F.round(top("y", "lat"), 6).alias("half_height"), F.round(top("x", "lon"), 3).alias("half_width"), F.size("ring").alias("points"))


@REGISTRY.query("q3_ring_validity", "SELECT n_nationkey, n_nationkey % 3 = 0 AS valid FROM nation")
def ring_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squares, bow-ties and nulls."""
    square = F.expr("array(struct(0D as x, 0D as y), struct(1D as x, 0D as y), struct(1D as x, 1D as y), struct(0D as x, 1D as y), struct(0D as x, 0D as y))")
    bow = F.expr("array(struct(0D as x, 0D as y), struct(1D as x, 1D as y), struct(1D as x, 0D as y), struct(0D as x, 1D as y), struct(0D as x, 0D as y))")
    ring = F.when(C("n_nationkey") % 3 == 0, square).when(C("n_nationkey") % 3 == 1, bow)
    return fx.table(spark, sf_dir, "nation").select("n_nationkey", geometry.ring_is_valid(ring).alias("valid"))


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fx.table(spark, sf_dir, "embeddings").filter("label is not null")
    return e.select("vec_id", (C("label") % 2).cast("double").alias("y"), *[C("embedding")[i].cast("double").alias(f"f{i}") for i in range(8)])


_F8 = [f"f{i}" for i in range(8)]


@REGISTRY.query("m6_clusters")
def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.cluster(_features(spark, sf_dir), _F8, 5).select("vec_id", "cluster")


@REGISTRY.query("m13_forest")
def forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _features(spark, sf_dir)
    return learning.probability(learning.forest(d, _F8, "y", 10), d, "p").select("vec_id", F.round("p", 6).alias("p"))


@REGISTRY.query("m14_stacked")
def stacked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.stacked(_features(spark, sf_dir), _F8, "y", "vec_id", 2, 5, 3).select("vec_id", F.round("stacked", 6).alias("p"))


@REGISTRY.query("m15_components")
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.reduce(_features(spark, sf_dir), _F8, 3).select("vec_id", F.transform("reduced", lambda x: F.round(F.abs(x), 5)).alias("reduced"))


@REGISTRY.query("m8_spectral_codes")
def spectral_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thirty features as codes of eight values, learnt without labels."""
    names = [f"f{i}" for i in range(30)]
    e = fx.table(spark, sf_dir, "embeddings").select("vec_id", *[C("embedding")[i].cast("double").alias(n) for i, n in enumerate(names)])
    return learning.encode_spectra(e, names).select("vec_id", F.transform("code", lambda x: F.round(x, 5)).alias("code"))


@REGISTRY.query("r4_running_counts", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def running_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of a stream, run over what is there."""
    out = monitor.drain(monitor.running_counts(monitor.stream_table(spark, sf_dir, "events"), ["event_type"], "value"))
    return out.select("event_type", "n", F.round("total", 4).alias("total"))


@REGISTRY.query("r4_windowed_counts", "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def windowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily event-time windows with a watermark."""
    out = monitor.drain(monitor.windowed_counts(monitor.stream_table(spark, sf_dir, "events"), "ts", "1 day", "2 days", ["event_type"]))
    return out.select(F.to_date(C("window.start")).alias("day"), "event_type", "n")


@REGISTRY.query("m4_crowns")
def crowns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crowns of a canopy surface and their areas, three cells at least; crowns of up to 48 cells across do not depend on the tiles."""
    d = fx.dem(spark, sf_dir).withColumn("v", (C("z") % 100) / 100)
    labels = kernels.label_tiles(d, "v", kernels.crowns(by_place=True), 48, 128, "crown")
    return labels.filter("crown > 0").groupBy("crown").agg(F.count(F.lit(1)).alias("area")).filter("area >= 3")


@REGISTRY.query("m7_superpixels")
def superpixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernels.label_tiles(fx.dem(spark, sf_dir), "z", kernels.superpixels(8), kernels.superpixel_reach(8, 5), 256, "segment", placed=True)


@REGISTRY.query("m11_circuit")
def circuit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expectations of an eight-qubit circuit over scaled features."""
    scaled = learning.angles(_features(spark, sf_dir), _F8)
    return learning.Circuit().apply(scaled, "angles").select("vec_id", F.transform("expectations", lambda x: F.round(x, 6)).alias("z"))


@REGISTRY.query("m12_fidelity_svm")
def fidelity_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _features(spark, sf_dir)
    return learning.fidelity_svm(d, _F8, "y", 10).transform(d).select("vec_id", C("prediction").cast("int").alias("predicted"))


@REGISTRY.query("a36_noise_samples", _NOISE_SQL)
def noise_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and deviation of the water probability over eight disturbed samples."""
    # Dealt by key before the samples are drawn: few files make few tasks, and the samples of a key need no shuffle of their own.
    obs = fx.obs(spark, sf_dir).select(*fx.OBS_KEY, "green", "nir").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *fx.OBS_KEY)
    s = learning.noisy_samples(obs, fx.OBS_KEY, "green")
    w = encoders.with_water_probability(s, 0.3 * spectral.difference(C("green"), C("nir")), F.lit(0.0), F.lit(0.0))
    return w.groupBy(*fx.OBS_KEY).agg(F.round(F.avg("water"), 6).alias("mean"), F.round(F.stddev_pop("water"), 6).alias("std"))
