"""Queries on grids: focal windows, terrain, tiles, regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.guards import r6
from gridloom.operators import raster as ra
from gridloom.plans.registry import Registry
from gridloom.sources import fixtures as fx

REGISTRY = Registry()
C = F.col


def _dem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.dem(spark, sf_dir)


def _pad(view: str, mode: str, k: int) -> dict[str, str]:
    """The grid with its edges padded on both axes, as named texts ending in `p`."""
    src = {"lim": f"SELECT min(row) AS r0, max(row) AS r1, min(col) AS c0, max(col) AS c1 FROM {view}"}
    if mode == "cut":
        return src | {"p": f"SELECT row, col, z FROM {view}"}

    def spots(a: str, lo: str, hi: str) -> str:
        if mode == "reflect":
            return f"list_filter([{a}, CASE WHEN {a} < {lo} + {k} THEN 2 * {lo} - 1 - {a} END, CASE WHEN {a} > {hi} - {k} THEN 2 * {hi} + 1 - {a} END], lambda x: x IS NOT NULL)"
        return f"list_concat([{a}], CASE WHEN {a} = {lo} THEN list_transform(range(1, {k + 1}), lambda i: {lo} - i) ELSE [] END, CASE WHEN {a} = {hi} THEN list_transform(range(1, {k + 1}), lambda i: {hi} + i) ELSE [] END)"

    return src | {"pc": f"SELECT row, unnest({spots('col', 'c0', 'c1')}) AS col, z FROM {view}, lim", "p": f"SELECT unnest({spots('row', 'r0', 'r1')}) AS row, col, z FROM pc, lim"}


def _focal(select: str, mode: str, k: int, view: str = "dem", more: str = "") -> str:
    """Aggregates over all cells of the padded box, by a plain range join."""
    texts = _pad(view, mode, k)
    return fx.sql(f"SELECT d.row, d.col, {select} FROM {view} d JOIN p ON p.row BETWEEN d.row - {k} AND d.row + {k} AND p.col BETWEEN d.col - {k} AND d.col + {k} GROUP BY d.row, d.col, d.z", *([view] if view in fx.SQL else []), **texts)


@REGISTRY.query("w1_box_statistics", _focal("round(avg(p.z), 6) AS mean, round(var_pop(p.z), 4) AS variance", "reflect", 2))
def box_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = ra.box_mean_variance(_dem(spark, sf_dir), "z", 2)
    return b.select("row", "col", F.round("mean", 6).alias("mean"), F.round("variance", 4).alias("variance"))


@REGISTRY.query("w2_texture", _focal("round(sqrt(greatest(var_pop(p.z), 0)), 4) AS std, round(ln(1 + sqrt(greatest(var_pop(p.z), 0))), 4) AS log_std, round(abs(d.z - avg(p.z)), 6) AS contrast, round(1 / (1 + abs(d.z - avg(p.z))), 6) AS homogeneity", "nearest", 2))
def texture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texture measures over 5 x 5, edges repeated."""
    d = _dem(spark, sf_dir)
    j = d.join(ra.box_mean_variance(d, "z", 2, "nearest"), ["row", "col"])
    std, contrast = F.sqrt("variance"), F.abs(C("z") - C("mean"))
    return j.select("row", "col", F.round(std, 4).alias("std"), F.round(F.log1p(std), 4).alias("log_std"), F.round(contrast, 6).alias("contrast"), F.round(1 / (1 + contrast), 6).alias("homogeneity"))


@REGISTRY.query("w3_morphology", fx.sql(
    "SELECT e.row, e.col, e.eroded, e.dilated, o.opened, c.closed FROM ed e JOIN op o ON e.row = o.row AND e.col = o.col JOIN cl c ON e.row = c.row AND e.col = c.col", "dem",
    m="SELECT row, col, z > 950 AS s FROM dem",
    ed="SELECT d.row, d.col, count(*) = 9 AND bool_and(p.s) AS eroded, bool_or(p.s) AS dilated FROM m d JOIN m p ON p.row BETWEEN d.row - 1 AND d.row + 1 AND p.col BETWEEN d.col - 1 AND d.col + 1 GROUP BY 1, 2",
    op="SELECT d.row, d.col, bool_or(p.eroded) AS opened FROM ed d JOIN ed p ON p.row BETWEEN d.row - 1 AND d.row + 1 AND p.col BETWEEN d.col - 1 AND d.col + 1 GROUP BY 1, 2",
    cl="SELECT d.row, d.col, count(*) = 9 AND bool_and(p.dilated) AS closed FROM ed d JOIN ed p ON p.row BETWEEN d.row - 1 AND d.row + 1 AND p.col BETWEEN d.col - 1 AND d.col + 1 GROUP BY 1, 2"))
def morphology(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _dem(spark, sf_dir).select("row", "col", (C("z") > 950).alias("s"))
    parts = [f(m, "s").withColumnRenamed("s", n) for f, n in ((ra.erode, "eroded"), (ra.dilate, "dilated"), (ra.opening, "opened"), (ra.closing, "closed"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, ["row", "col"])
    return out


@REGISTRY.query("w4_lee_filter", fx.sql(
    "SELECT row, col, round(m + least(greatest(1 - (1 / 4.4::DOUBLE) / greatest(v / greatest(m * m, 1e-10), 1e-10), 0), 1) * (z - m), 5) AS filtered FROM b", "dem", **_pad("dem", "reflect", 3),
    b="SELECT d.row, d.col, d.z, avg(p.z) AS m, var_pop(p.z) AS v FROM dem d JOIN p ON p.row BETWEEN d.row - 3 AND d.row + 3 AND p.col BETWEEN d.col - 3 AND d.col + 3 GROUP BY 1, 2, 3"))
def lee_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ra.lee(_dem(spark, sf_dir), "z", 3).select("row", "col", F.round("filtered", 5).alias("filtered"))


_STATS = lambda k: f"SELECT d.row, d.col, d.z, avg(p.z) AS m, var_pop(p.z) AS v FROM dem d JOIN p ON p.row BETWEEN d.row - {k} AND d.row + {k} AND p.col BETWEEN d.col - {k} AND d.col + {k} GROUP BY 1, 2, 3"


@REGISTRY.query("w4_lee_local", fx.sql("SELECT row, col, round(m + CASE WHEN v > m * m / 2000000 THEN least(greatest(1 - m * m / 2000000 / greatest(v, 1e-10), 0), 1) ELSE 0 END * (z - m), 5) AS filtered FROM b", "dem", **_pad("dem", "nearest", 3), b=_STATS(3)))
def lee_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filter by local noise, of so many looks that some cells lie on either side."""
    return ra.lee_local(_dem(spark, sf_dir), "z", 3, 2e6).select("row", "col", F.round("filtered", 5).alias("filtered"))


@REGISTRY.query("w4_lee_global", fx.sql("SELECT row, col, round(m + least(greatest(v / (v + a + 1e-12), 0), 1) * (z - m), 5) AS filtered FROM b, (SELECT var_pop(z) AS a FROM dem)", "dem", **_pad("dem", "reflect", 3), b=_STATS(3)))
def lee_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ra.lee_global(_dem(spark, sf_dir), "z", 3).select("row", "col", F.round("filtered", 5).alias("filtered"))


@REGISTRY.query("w8_hand_scales", fx.sql("SELECT d.row, d.col, round(d.z - min(p.z), 6) AS hand FROM dem d JOIN p ON p.row BETWEEN d.row - 12 AND d.row + 12 AND p.col BETWEEN d.col - 12 AND d.col + 12 GROUP BY d.row, d.col, d.z", "dem", **_pad("dem", "reflect", 12)))
def hand_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Height above the lowest cell over three scales up to 12 cells."""
    return ra.height_above_lowest(_dem(spark, sf_dir), "z", 12).select("row", "col", F.round("hand", 6).alias("hand"))


@REGISTRY.query("w8_least_height", fx.sql("SELECT d.row, d.col, round(CASE WHEN (SELECT least(max(row) - min(row), max(col) - min(col)) + 1 FROM dem) > 15 THEN d.z - min(p.z) ELSE d.z END, 6) AS hand FROM dem d JOIN p ON p.row BETWEEN d.row - 7 AND d.row + 7 AND p.col BETWEEN d.col - 7 AND d.col + 7 GROUP BY d.row, d.col, d.z", "dem", **_pad("dem", "nearest", 7)))
def least_height(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least height over the boxes of 15, 31 and 63 cells that the raster is larger than."""
    return ra.least_height(_dem(spark, sf_dir), "z").select("row", "col", F.round("hand", 6).alias("hand"))


_GRAD = """SELECT *, CASE WHEN lx IS NULL THEN ex - z WHEN ex IS NULL THEN z - lx ELSE (ex - lx) / 2 END AS dx, CASE WHEN ly IS NULL THEN ey - z WHEN ey IS NULL THEN z - ly ELSE (ey - ly) / 2 END AS dy FROM
 (SELECT *, lag(z) OVER (PARTITION BY row ORDER BY col) AS lx, lead(z) OVER (PARTITION BY row ORDER BY col) AS ex, lag(z) OVER (PARTITION BY col ORDER BY row) AS ly, lead(z) OVER (PARTITION BY col ORDER BY row) AS ey FROM dem)"""


@REGISTRY.query("w5_slope_aspect", fx.sql("SELECT row, col, round(degrees(atan(sqrt(dx * dx + dy * dy))), 6) AS slope, round(CASE WHEN degrees(atan2(-dx, dy)) < 0 THEN degrees(atan2(-dx, dy)) + 360 ELSE degrees(atan2(-dx, dy)) END, 6) + 0.0 AS aspect FROM g WHERE dx <> 0", "dem", g=_GRAD))
def slope_aspect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slope and aspect from central gradients."""
    g = ra.gradient(_dem(spark, sf_dir), "z").filter("dx <> 0")
    angle = F.degrees(F.atan2(-C("dx"), C("dy")))
    return g.select("row", "col", F.round(F.degrees(F.atan(F.sqrt(C("dx") ** 2 + C("dy") ** 2))), 6).alias("slope"), r6(F.when(angle < 0, angle + 360).otherwise(angle)).alias("aspect"))


@REGISTRY.query("w5_horn_slope", fx.sql(
    "SELECT row, col, round(degrees(atan(sqrt(dx * dx + dy * dy))), 6) AS slope FROM (SELECT d.row, d.col, sum(p.z * (p.col - d.col) * (2 - abs(p.row - d.row))) / 240 AS dx, sum(p.z * (p.row - d.row) * (2 - abs(p.col - d.col))) / 240 AS dy FROM dem d JOIN p ON p.row BETWEEN d.row - 1 AND d.row + 1 AND p.col BETWEEN d.col - 1 AND d.col + 1 GROUP BY 1, 2)", "dem", **_pad("dem", "reflect", 1)))
def horn_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ra.horn(_dem(spark, sf_dir), "z", 30.0).select("row", "col", F.round("slope", 6).alias("slope"))


@REGISTRY.query("w7_curvature", fx.sql(
    "SELECT row, col, round(-(CASE WHEN l IS NULL THEN e - dx WHEN e IS NULL THEN dx - l ELSE (e - l) / 2 END + CASE WHEN u IS NULL THEN v - dy WHEN v IS NULL THEN dy - u ELSE (v - u) / 2 END), 6) + 0.0 AS curvature FROM (SELECT *, lag(dx) OVER (PARTITION BY row ORDER BY col) AS l, lead(dx) OVER (PARTITION BY row ORDER BY col) AS e, lag(dy) OVER (PARTITION BY col ORDER BY row) AS u, lead(dy) OVER (PARTITION BY col ORDER BY row) AS v FROM g)", "dem", g=_GRAD))
def curvature(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = ra.gradient(_dem(spark, sf_dir), "z").select("row", "col", "dx", "dy")
    xx = ra.gradient(g.select("row", "col", C("dx").alias("v")), "v").select("row", "col", C("dx").alias("dxx"))
    yy = ra.gradient(g.select("row", "col", C("dy").alias("v")), "v").select("row", "col", C("dy").alias("dyy"))
    return xx.join(yy, ["row", "col"]).select("row", "col", r6(-(C("dxx") + C("dyy"))).alias("curvature"))


@REGISTRY.query("w8_hand_tpi", _focal("round(d.z - min(p.z), 6) AS hand, round(d.z - avg(p.z), 6) + 0.0 AS tpi", "nearest", 5))
def hand_tpi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Height above the lowest, and above the mean, of 11 x 11."""
    d = _dem(spark, sf_dir)
    b = ra.box(d, {"lowest": (C("z"), F.min), "s": (C("z"), F.sum), "n": (F.lit(1.0), F.sum)}, 5, "nearest")
    return d.join(b, ["row", "col"]).select("row", "col", F.round(C("z") - C("lowest"), 6).alias("hand"), r6(C("z") - C("s") / C("n")).alias("tpi"))


@REGISTRY.query("w14_local_contrast", fx.sql("SELECT row, col, round(least(greatest((v - lo) / nullif(hi - lo, 0), 0), 1), 6) AS contrast FROM c, s", "dem", **_pad("dem", "reflect", 3), c="SELECT d.row, d.col, d.z / greatest(avg(p.z), 1e-10) AS v FROM dem d JOIN p ON p.row BETWEEN d.row - 3 AND d.row + 3 AND p.col BETWEEN d.col - 3 AND d.col + 3 GROUP BY d.row, d.col, d.z", s="SELECT quantile_cont(v, 0.02) AS lo, quantile_cont(v, 0.98) AS hi FROM c"))
def local_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _dem(spark, sf_dir)
    v = d.join(ra.box_mean_variance(d, "z", 3), ["row", "col"]).select("row", "col", (C("z") / F.greatest("mean", F.lit(1e-10))).alias("contrast"))
    return ra.percentile_stretch(v, "contrast").select("row", "col", F.round("contrast", 6).alias("contrast"))


_KIND = "SELECT row, col, CAST(floor(z) % 5 AS INT) AS k FROM dem"


@REGISTRY.query("w20_majority", fx.sql("SELECT row, col, k FROM (SELECT d.row, d.col, p.k, row_number() OVER (PARTITION BY d.row, d.col ORDER BY count(*) DESC, p.k) AS r FROM m d JOIN m p ON p.row BETWEEN d.row - 1 AND d.row + 1 AND p.col BETWEEN d.col - 1 AND d.col + 1 GROUP BY d.row, d.col, p.k) WHERE r = 1", "dem", m=_KIND))
def majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ra.majority(_dem(spark, sf_dir).select("row", "col", (F.floor("z") % 5).cast("int").alias("k")), "k")


@REGISTRY.query("w21_gap_fill", fx.sql("SELECT d.row, d.col, round(coalesce(d.v, median(p.v)), 6) AS v FROM g d LEFT JOIN g p ON p.row BETWEEN d.row - 3 AND d.row + 3 AND p.col BETWEEN d.col - 3 AND d.col + 3 GROUP BY d.row, d.col, d.v", "dem", g="SELECT row, col, CASE WHEN (row * 7 + col) % 5 <> 0 THEN z END AS v FROM dem"))
def gap_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _dem(spark, sf_dir).select("row", "col", F.when((C("row") * 7 + C("col")) % 5 != 0, C("z")).alias("v"))
    return ra.fill_gaps(g, "v", 3, 1).select("row", "col", F.round("v", 6).alias("v"))


@REGISTRY.query("w31_block_mean", fx.sql("SELECT CAST(row // 4 AS INT) AS row, CAST(col // 4 AS INT) AS col, round(avg(z), 6) AS z FROM dem GROUP BY 1, 2", "dem"))
def block_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ra.block_mean(_dem(spark, sf_dir), "z", 4).select("row", "col", F.round("z", 6).alias("z"))


@REGISTRY.query("k8_overviews", fx.sql("SELECT CAST(2 AS INT) AS factor, CAST(row // 2 AS INT) AS row, CAST(col // 2 AS INT) AS col, round(z, 6) AS z FROM dem WHERE row % 2 = 0 AND col % 2 = 0 UNION ALL SELECT 8, CAST(row // 8 AS INT), CAST(col // 8 AS INT), round(z, 6) FROM dem WHERE row % 8 = 0 AND col % 8 = 0", "dem"))
def overviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _dem(spark, sf_dir)
    one = lambda k: ra.overview(d, k).select(F.lit(k).alias("factor"), "row", "col", F.round("z", 6).alias("z"))
    return one(2).unionByName(one(8))


@REGISTRY.query("t1_tile_grid", "SELECT t AS tile_id, r AS row0, c AS col0, least(r + 16, 40) AS row1, least(c + 16, 50) AS col1, greatest(r - 4, 0) AS pad_row0, greatest(c - 4, 0) AS pad_col0, least(least(r + 16, 40) + 4, 40) AS pad_row1, least(least(c + 16, 50) + 4, 50) AS pad_col1 FROM (SELECT CAST(t AS INT) AS t, CAST(t // 4 * 16 AS INT) AS r, CAST(t % 4 * 16 AS INT) AS c FROM (SELECT unnest(range(12)) AS t))")
def tile_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ra.tile_grid(40, 50, 16, 4, spark.range(1))


_TILED = "SELECT * EXCLUDE (tile_row), CAST(tile_row AS INT) AS tile_row, CAST(unnest(range(greatest(col - 4, 0) // 16, (col + 4) // 16 + 1)) AS INT) AS tile_col FROM (SELECT *, unnest(range(greatest(row - 4, 0) // 16, (row + 4) // 16 + 1)) AS tile_row FROM dem)"


@REGISTRY.query("t2_halo_tiles", fx.sql("SELECT tile_row, tile_col, count(*) AS n, count(*) FILTER (WHERE row // 16 = tile_row AND col // 16 = tile_col) AS n_inner, round(sum(z), 3) AS total FROM t GROUP BY 1, 2", "dem", t=_TILED))
def halo_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ra.halo_tiles(_dem(spark, sf_dir), 16, 4)
    return t.groupBy("tile_row", "tile_col").agg(F.count(F.lit(1)).alias("n"), F.count_if("inner").alias("n_inner"), F.round(F.sum("z"), 3).alias("total"))


_BW = lambda x, t: f"CASE WHEN least({x} - {t} * 16 + 4, 19 - ({x} - {t} * 16)) >= 8 THEN 1.0 ELSE 0.5 * (1 - cos(pi() * (least({x} - {t} * 16 + 4, 19 - ({x} - {t} * 16)) + 1) / 9)) END"


@REGISTRY.query("a34_blended_mosaic", fx.sql(f"SELECT row, col, round(sum((z + tile_row) * w) / nullif(sum(w), 0), 6) AS z FROM (SELECT *, ({_BW('row', 'tile_row')}) * ({_BW('col', 'tile_col')}) AS w FROM t) GROUP BY 1, 2", "dem", t=_TILED))
def blended_mosaic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles whose values differ a little, blended where they overlap."""
    t = ra.halo_tiles(_dem(spark, sf_dir), 16, 4).withColumn("z", C("z") + C("tile_row"))
    return ra.blend(t, ["z"], 16, 4).select("row", "col", F.round("z", 6).alias("z"))


@REGISTRY.query("a25_zonal_statistics", fx.sql("SELECT label, count(*) AS area, round(avg(z), 6) AS mean, max(z) AS highest FROM (SELECT *, CAST((row // 10) * 10 + col // 10 AS INT) AS label FROM dem) WHERE label > 0 GROUP BY 1", "dem"))
def zonal_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _dem(spark, sf_dir).withColumn("label", (F.floor(C("row") / 10) * 10 + F.floor(C("col") / 10)).cast("int"))
    return ra.zonal(d, "label", "z").select("label", "area", F.round("mean", 6).alias("mean"), "highest")


@REGISTRY.query("a26_segment_majority", fx.sql("SELECT m.row, m.col, m.seg, CASE WHEN m.seg > 0 THEN b.k ELSE m.k END AS k FROM m LEFT JOIN (SELECT seg, k FROM (SELECT seg, k, row_number() OVER (PARTITION BY seg ORDER BY count(*) DESC, k) AS r FROM m GROUP BY 1, 2) WHERE r = 1) b ON m.seg = b.seg", "dem", m="SELECT row, col, CAST(floor(z) % 5 AS INT) AS k, CAST((row // 8) * 8 + col // 8 AS INT) AS seg FROM dem"))
def segment_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _dem(spark, sf_dir).select("row", "col", (F.floor("z") % 5).cast("int").alias("k"), (F.floor(C("row") / 8) * 8 + F.floor(C("col") / 8)).cast("int").alias("seg"))
    return ra.segment_majority(m, "seg", "k", ["row", "col"])


_REACH = """WITH RECURSIVE dem AS ({dem}), m AS (SELECT row, col, row * 2147483648 + col AS id FROM dem WHERE CAST(floor(z) AS BIGINT) % 3 <> 0),
 e AS (SELECT a.id AS u, b.id AS v FROM m a JOIN m b ON abs(a.row - b.row) + abs(a.col - b.col) = 1),
 r(id, root) AS (SELECT id, id FROM m UNION SELECT e.v, r.root FROM r JOIN e ON e.u = r.id WHERE r.root < e.v),
 l AS (SELECT id, min(root) AS region FROM r GROUP BY 1)"""


@REGISTRY.query("m1_regions", _REACH.format(dem=fx.SQL["dem"]) + " SELECT m.row, m.col, l.region FROM m JOIN l ON m.id = l.id")
def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connected regions of a mask; four neighbours."""
    return ra.regions(_dem(spark, sf_dir).withColumn("set", F.floor("z") % 3 != 0), "set").withColumn("region", C("region"))


@REGISTRY.query("m2_small_regions", _REACH.format(dem=fx.SQL["dem"]) + " SELECT region, count(*) AS n FROM l GROUP BY 1 HAVING count(*) >= 4")
def small_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of four cells or more."""
    return regions(spark, sf_dir).groupBy("region").agg(F.count(F.lit(1)).alias("n")).filter("n >= 4")
