"""Queries on scenes, mosaics, textures and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.functions import classes
from gridloom.functions.guards import r6
from gridloom.operators import scenes as sc
from gridloom.operators.raster import overview, percentile_stretch
from gridloom.plans.raster_queries import _pad
from gridloom.plans.registry import Registry
from gridloom.sources import fixtures as fx

REGISTRY = Registry()
C = F.col

_SCENES = """SELECT o_orderkey AS scene_id, CAST(o_orderdate AS DATE) AS date, ['sentinel2', 'sentinel1', 'naip', 'landsat'][1 + o_orderkey % 4] AS sensor, o_totalprice / 5000 AS cloud, o_orderpriority AS platform,
 (o_custkey * 7) % 350 - 180.0::DOUBLE AS west, (o_custkey * 3) % 170 - 90.0::DOUBLE AS south, (o_custkey * 7) % 350 - 170.0::DOUBLE AS east, (o_custkey * 3) % 170 - 80.0::DOUBLE AS north, 1 + o_orderkey % 5 AS resolution FROM orders"""


def _scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, w, s = C("o_orderkey"), (C("o_custkey") * 7) % 350, (C("o_custkey") * 3) % 170
    sensor = F.element_at(F.array(*map(F.lit, ("sentinel2", "sentinel1", "naip", "landsat"))), (1 + k % 4).cast("int"))
    return fx.table(spark, sf_dir, "orders").select(
        k.alias("scene_id"), F.to_date("o_orderdate").alias("date"), sensor.alias("sensor"), (C("o_totalprice") / 5000).alias("cloud"), C("o_orderpriority").alias("platform"),
        (w - 180.0).alias("west"), (s - 90.0).alias("south"), (w - 170.0).alias("east"), (s - 80.0).alias("north"), (1 + k % 5).alias("resolution"),
    )


@REGISTRY.query("s7_scene_search", fx.sql("SELECT scene_id, sensor, date FROM s WHERE west <= 20 AND east >= -20 AND south <= 40 AND north >= 0 AND date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31' AND cloud < 30 AND platform IN ('5-LOW', '1-URGENT')", s=_SCENES))
def scene_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sc.search(_scenes(spark, sf_dir), -20, 0, 20, 40, "1996-01-01", "1999-12-31", 30, platform=["5-LOW", "1-URGENT"]).select("scene_id", "sensor", "date")


@REGISTRY.query("s11_sensor_floor", fx.sql("SELECT sensor, count(*) AS n FROM s WHERE date + 6570 >= CASE sensor WHEN 'sentinel2' THEN DATE '2015-07-01' WHEN 'sentinel1' THEN DATE '2014-10-01' WHEN 'naip' THEN DATE '2003-01-01' ELSE DATE '1980-01-01' END GROUP BY 1", s=_SCENES))
def sensor_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _scenes(spark, sf_dir).withColumn("date", F.date_add("date", 6570))
    return sc.after_launch(s).groupBy("sensor").agg(F.count(F.lit(1)).alias("n"))


@REGISTRY.query("o5_finest_scene", fx.sql("SELECT sensor, scene_id, resolution FROM (SELECT *, row_number() OVER (PARTITION BY sensor ORDER BY resolution, date DESC, scene_id) AS r FROM s WHERE west <= 0 AND east >= 0) WHERE r = 1", s=_SCENES))
def finest_scene(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each sensor the scene of the finest resolution, the latest of equals."""
    w = Window.partitionBy("sensor").orderBy("resolution", F.desc("date"), "scene_id")
    return _scenes(spark, sf_dir).filter("west <= 0 and east >= 0").withColumn("r", F.row_number().over(w)).filter("r = 1").select("sensor", "scene_id", "resolution")


_TILES = "SELECT px_row, px_col, acq_date, orderkey, linenumber, partkey, suppkey, nir FROM obs WHERE sensor = 'naip'"


@REGISTRY.query("s13_mosaic_median", fx.sql("SELECT px_row, px_col, round(median(nir), 6) AS nir, count(*) AS n FROM t GROUP BY 1, 2", "obs", t=_TILES))
def mosaic_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping tiles by their median."""
    return fx.obs(spark, sf_dir).filter("sensor = 'naip'").groupBy("px_row", "px_col").agg(F.round(F.median("nir"), 6).alias("nir"), F.count(F.lit(1)).alias("n"))


@REGISTRY.query("s15_first_filled", fx.sql("SELECT px_row, px_col, CASE WHEN nir > 1e-6 THEN nir END AS nir FROM (SELECT *, row_number() OVER (PARTITION BY px_row, px_col ORDER BY (nir <= 1e-6)::INT, acq_date DESC, orderkey, linenumber, partkey, suppkey) AS r FROM t) WHERE r = 1", "obs", t=_TILES))
def first_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest tile's value that is not empty."""
    t = fx.obs(spark, sf_dir).filter("sensor = 'naip'")
    return sc.first_filled(t, ["px_row", "px_col"], [F.desc("acq_date"), *map(C, ("orderkey", "linenumber", "partkey", "suppkey"))], "nir").select("px_row", "px_col", "nir")


@REGISTRY.query("s17_fallback", fx.sql("SELECT coalesce(a.row, b.row) AS row, coalesce(a.col, b.col) AS col, coalesce(a.z, b.z) AS z, CASE WHEN a.z IS NOT NULL THEN 'first' ELSE 'second' END AS origin FROM (SELECT * FROM dem WHERE (row + col) % 3 <> 0) a FULL JOIN (SELECT row, col, z + 1 AS z FROM dem WHERE (row + col) % 2 = 0) b ON a.row = b.row AND a.col = b.col", "dem"))
def fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fx.dem(spark, sf_dir)
    return sc.fallback(d.filter("(row + col) % 3 <> 0"), d.filter("(row + col) % 2 = 0").withColumn("z", C("z") + 1), ["row", "col"], "z")


@REGISTRY.query("s21_building_rings", "SELECT l_orderkey AS way_id, count(*) AS n, round(sum(p_size * rn), 6) AS digest FROM (SELECT l_orderkey, p_size, row_number() OVER (PARTITION BY l_orderkey ORDER BY pos) AS rn FROM (SELECT l_orderkey, unnest(ids) AS id, generate_subscripts(ids, 1) AS pos FROM (SELECT l_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS ids FROM lineitem GROUP BY 1)) JOIN part ON p_partkey = id WHERE p_partkey % 5 <> 0) GROUP BY 1 HAVING count(*) >= 4")
def building_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rings from ways and nodes; unknown nodes are skipped, short ways go."""
    ids = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))), lambda x: x["l_partkey"])
    ways = fx.table(spark, sf_dir, "lineitem").groupBy(C("l_orderkey").alias("way_id")).agg(ids.alias("node_ids"))
    nodes = fx.table(spark, sf_dir, "part").filter("p_partkey % 5 <> 0").select(C("p_partkey").alias("node_id"), C("p_size").cast("double").alias("x"), C("p_retailprice").alias("y"))
    rings = sc.ordered_rings(ways, nodes)
    digest = F.aggregate(F.transform("ring", lambda p, i: p["x"] * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return rings.select("way_id", F.size("ring").cast("long").alias("n"), F.round(digest, 6).alias("digest"))


@REGISTRY.query("w11_circular_zscore", fx.sql("SELECT row, col, round((z - m) / nullif(s, 0), 6) AS zscore FROM (SELECT d.row, d.col, d.z, avg(p.z) AS m, stddev_pop(p.z) AS s FROM dem d JOIN dem p ON (p.row - d.row) * (p.row - d.row) + (p.col - d.col) * (p.col - d.col) <= 9 AND p.row BETWEEN d.row - 3 AND d.row + 3 AND p.col BETWEEN d.col - 3 AND d.col + 3 GROUP BY 1, 2, 3)", "dem"))
def circular_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sc.circular_zscore(fx.dem(spark, sf_dir), "z", 3).select("row", "col", F.round("zscore", 6).alias("zscore"))


_STRETCH = "SELECT row, col, least(greatest((z - lo) / nullif(hi - lo, 0), 0), 1) * 255 AS z FROM dem, (SELECT quantile_cont(z, 0.02) AS lo, quantile_cont(z, 0.98) AS hi FROM dem)"


@REGISTRY.query("w12_homogeneity", fx.sql(
    "SELECT row, col, round(least(greatest((h - lo) / nullif(hi - lo, 0), 0), 1), 5) AS homogeneity FROM h, (SELECT quantile_cont(h, 0.02) AS lo, quantile_cont(h, 0.98) AS hi FROM h)", "dem", g=_STRETCH, **_pad("g", "reflect", 2),
    h="SELECT d.row, d.col, avg(p.z) / (var_pop(p.z) + 1) AS h FROM g d JOIN p ON p.row BETWEEN d.row - 2 AND d.row + 2 AND p.col BETWEEN d.col - 2 AND d.col + 2 GROUP BY 1, 2"))
def homogeneity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sc.homogeneity(fx.dem(spark, sf_dir), "z", 2).select("row", "col", F.round("homogeneity", 5).alias("homogeneity"))


@REGISTRY.query("w13_wrapped_contrast", fx.sql("SELECT d.row, d.col, round(avg(abs(d.z - p.z)), 6) AS contrast FROM dem d, (SELECT max(row) + 1 AS rows, max(col) + 1 AS cols FROM dem), (SELECT unnest([0, 1, 1, 1]) AS dr, unnest([1, 0, 1, -1]) AS dc) o JOIN dem p ON p.row = (d.row - o.dr + rows) % rows AND p.col = (d.col - o.dc + cols) % cols GROUP BY 1, 2", "dem"))
def wrapped_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean difference to four neighbours that wrap around."""
    d = fx.dem(spark, sf_dir)
    size = d.agg((F.max("row") + 1).alias("rows"), (F.max("col") + 1).alias("cols"))
    return sc.wrapped_differences(d, "z", [(0, 1), (1, 0), (1, 1), (1, -1)], size).select("row", "col", F.round("contrast", 6).alias("contrast"))


@REGISTRY.query("w18_shadow_proximity", fx.sql("SELECT d.row, d.col, bool_or(p.s) AS s FROM m d JOIN m p ON p.row BETWEEN d.row - 6 AND d.row + 6 AND p.col BETWEEN d.col - 6 AND d.col + 6 GROUP BY 1, 2", "dem", m="SELECT row, col, CAST(floor(z) AS BIGINT) % 41 = 0 AS s FROM dem"))
def shadow_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sc.shadow_proximity(fx.dem(spark, sf_dir).select("row", "col", (F.floor("z") % 41 == 0).alias("s")), "s")


@REGISTRY.query("m3_region_shapes", fx.sql(
    "SELECT label, area, round(major, 6) AS major, round(minor, 6) AS minor, area >= 4 AND major / greatest(minor, 1.0) > 4 AND minor < 5 AND minor > 0 AS road FROM (SELECT label, area, 4 * sqrt(greatest((a + b) / 2 + sqrt(((a - b) / 2) ** 2 + c * c), 0)) AS major, 4 * sqrt(greatest((a + b) / 2 - sqrt(((a - b) / 2) ** 2 + c * c), 0)) AS minor FROM (SELECT label, count(*) AS area, var_pop(row) + 1 / 12.0::DOUBLE AS a, var_pop(col) + 1 / 12.0::DOUBLE AS b, covar_pop(row, col) AS c FROM (SELECT row, col, CAST(col // 3 AS INT) AS label FROM dem) GROUP BY 1))", "dem"))
def region_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sc.region_shapes(fx.dem(spark, sf_dir).withColumn("label", F.floor(C("col") / 3).cast("int")), "label")
    return out.select("label", "area", F.round("major", 6).alias("major"), F.round("minor", 6).alias("minor"), "road")


@REGISTRY.query("x55_species_names", "SELECT l_suppkey, CASE WHEN d > 0.6 AND a > 2.0 THEN 'Deciduous Broadleaf' WHEN d > 0.5 AND a < 1.6 THEN 'Conifer / Evergreen' WHEN a > 2.5 THEN 'High-NIR Deciduous' WHEN g > 0.38 THEN 'Mixed / Broadleaf' WHEN n > 0.4 THEN 'Dense Canopy' ELSE 'Species Group ' || (1 + l_suppkey % 5) END AS name FROM (SELECT l_suppkey, round(avg(l_quantity) / 12, 4) AS a, round(avg(l_discount) * 7, 4) AS g, round(avg(l_tax) * 13, 4) AS d, round(avg(l_linenumber) / 9, 4) AS n FROM lineitem GROUP BY 1)")
def species_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = fx.table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.round(F.avg("l_quantity") / 12, 4).alias("a"), F.round(F.avg("l_discount") * 7, 4).alias("g"), F.round(F.avg("l_tax") * 13, 4).alias("d"), F.round(F.avg("l_linenumber") / 9, 4).alias("n"))
    return a.select("l_suppkey", sc.species_name(C("a"), C("g"), C("d"), C("n"), 1 + C("l_suppkey") % 5).alias("name"))


@REGISTRY.query("x73_lidar_products", fx.sql("SELECT row, col, round(h, 6) AS ndsm, CASE WHEN h > 5 THEN 0.3 ELSE 0.95 END::DOUBLE AS penetration, round(CASE WHEN h > 5 THEN h * 0.5 ELSE 0 END, 6) AS height_p50 FROM (SELECT row, col, least(greatest(z - (z % 100) * 0.9::DOUBLE - 895, 0), 100) AS h FROM dem)", "dem"))
def lidar_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = sc.lidar_products(C("z"), (C("z") % 100) * 0.9 + 895)
    return fx.dem(spark, sf_dir).select("row", "col", F.round(p["ndsm"], 6).alias("ndsm"), p["penetration"].alias("penetration"), F.round(p["height_p50"], 6).alias("height_p50"))


@REGISTRY.query("x80_feature_stack", fx.sql("SELECT sensor, count(*) AS n, count(*) FILTER (WHERE swir1 IS NOT NULL AND swir2 IS NOT NULL) AS n_valid, round(sum(green + red + coalesce(swir1, 0)), 4) AS total FROM obs GROUP BY 1", "obs"))
def feature_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features as an array, valid where all are there; bands by the first name that the table has."""
    o = fx.obs(spark, sf_dir)
    s = sc.feature_stack(o, {"f_green": sc.first_band(o, ["B03", "green"]), "f_red": sc.first_band(o, ["red"]), "f_swir1": C("swir1"), "f_swir2": C("swir2")})
    first3 = F.aggregate(F.slice("features", 1, 3), F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))
    return s.groupBy("sensor").agg(F.count(F.lit(1)).alias("n"), F.count_if("valid").alias("n_valid"), F.round(F.sum(first3), 4).alias("total"))


@REGISTRY.query("x83_canopy_labels", fx.sql("SELECT px_row, px_col, count(*) FILTER (WHERE green * 10 >= 0.6 AND nir * 10 > 0.4) AS n_buildings, count(*) FILTER (WHERE green * 10 >= 0.4 AND red * 10 > 0.3) AS n_flooded FROM obs GROUP BY 1, 2", "obs"))
def canopy_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buildings: high score and double bounce; flooded forest: detected and inundated."""
    score = C("green") * 10
    return fx.obs(spark, sf_dir).groupBy("px_row", "px_col").agg(F.count_if((score >= 0.6) & (C("nir") * 10 > 0.4)).alias("n_buildings"), F.count_if((score >= 0.4) & (C("red") * 10 > 0.3)).alias("n_flooded"))


@REGISTRY.query("a23_region_reducers", fx.sql("SELECT px_row, count(*) FILTER (WHERE clear) AS n_clear, round(quantile_cont(nir, 0.02), 6) AS p2, round(quantile_cont(nir, 0.98), 6) AS p98 FROM obs GROUP BY 1", "obs"))
def region_reducers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and two percentiles of a region in one pass."""
    o = fx.obs(spark, sf_dir).groupBy("px_row").agg(F.count_if("clear").alias("n_clear"), F.percentile("nir", F.array(F.lit(0.02), F.lit(0.98))).alias("p"))
    return o.select("px_row", "n_clear", F.round(C("p")[0], 6).alias("p2"), F.round(C("p")[1], 6).alias("p98"))


@REGISTRY.query("a35_embedding_map", "SELECT CAST(vec_id // 10 AS BIGINT) AS cell, CAST(i - 1 AS INT) AS dim, round(avg(embedding[i]::DOUBLE), 6) + 0.0 AS mean FROM embeddings, (SELECT unnest(range(1, 65)) AS i) GROUP BY 1, 2")
def embedding_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of tiles' embeddings over a cell, by dimension."""
    e = fx.table(spark, sf_dir, "embeddings").select(F.floor(C("vec_id") / 10).alias("cell"), F.posexplode("embedding").alias("dim", "v"))
    return e.groupBy("cell", "dim").agg(r6(F.avg(C("v").cast("double"))).alias("mean"))


@REGISTRY.query("w32_grid_harmonised", fx.sql("SELECT CAST(row // 2 AS INT) AS row, CAST(col // 2 AS INT) AS col, z FROM dem WHERE row % 2 = 0 AND col % 2 = 0 AND row // 2 >= 2 AND col // 2 >= 2 AND col // 2 < 23", "dem"))
def grid_harmonised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grid on a coarser one by its nearest cells, two cells trimmed at the sides."""
    return overview(fx.dem(spark, sf_dir), 2).filter("row >= 2 and col >= 2 and col < 23")


@REGISTRY.query("k30_risk_levels", "SELECT p_partkey, CASE WHEN z IN ('A','AE','AH','AO','AR','A99','V','VE') THEN 'high' WHEN z = 'X' THEN 'moderate' WHEN z = 'D' THEN 'undetermined' ELSE 'minimal' END AS risk FROM (SELECT p_partkey, upper(trim([' ae', 'X', 'VE ', 'd', 'b'][1 + p_partkey % 5])) AS z FROM part)")
def risk_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = F.element_at(F.array(*map(F.lit, (" ae", "X", "VE ", "d", "b"))), (1 + C("p_partkey") % 5).cast("int"))
    return fx.table(spark, sf_dir, "part").select("p_partkey", classes.risk_level(z).alias("risk"))


@REGISTRY.query("k18_notification", fx.sql("SELECT type, count(*) AS n, array_to_string(list(name ORDER BY id)[1:5], '; ') AS first_names FROM snap WHERE id % 10 = 0 GROUP BY 1 HAVING count(*) >= 3", "snap"))
def notification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a notifier gets: counts of added features by type, from three on, and five names."""
    a, b = fx.snapshots(spark, sf_dir)
    added = b.join(a, ["type", "id"], "left_anti")
    names = F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(F.struct("id", "name"))), 1, 5), lambda x: x["name"]), "; ")
    return added.groupBy("type").agg(F.count(F.lit(1)).alias("n"), names.alias("first_names")).filter("n >= 3")


@REGISTRY.query("w13_texture_proxies", fx.sql(
    "SELECT row, col, round(v, 5) AS contrast, round(1 / (1 + v), 5) AS homogeneity, round(ln(sqrt(v) + 1e-8 + 1), 5) AS entropy, round(1 / ((1 + v) * (1 + v)), 5) AS asm FROM t", "dem",
    g="SELECT row, col, floor(least(greatest((z - lo) / (hi - lo + 1e-10) * 31, 0), 31)) AS z FROM dem, (SELECT quantile_cont(z, 0.02) AS lo, quantile_cont(z, 0.98) AS hi FROM dem)", **_pad("g", "nearest", 3),
    t="SELECT d.row, d.col, greatest(var_pop(p.z), 0) AS v FROM g d JOIN p ON p.row BETWEEN d.row - 3 AND d.row + 3 AND p.col BETWEEN d.col - 3 AND d.col + 3 GROUP BY 1, 2"))
def texture_proxies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texture from the local variance of 32 levels."""
    t = sc.texture_proxies(fx.dem(spark, sf_dir), "z", 3)
    return t.select("row", "col", *[F.round(c, 5).alias(c) for c in ("contrast", "homogeneity", "entropy", "asm")])


@REGISTRY.query("x74_pseudo_colour", fx.sql("SELECT row, col, round(least(greatest((z - lo) / nullif(hi - lo, 0), 0), 1), 6) AS green, round(CASE WHEN z < m - 1.5::DOUBLE * s THEN 0.6 ELSE 0 END::DOUBLE, 6) AS blue FROM dem, (SELECT quantile_cont(z, 0.02) AS lo, quantile_cont(z, 0.98) AS hi, avg(z) AS m, stddev_pop(z) AS s FROM dem)", "dem"))
def pseudo_colour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stretched band, and shadows: cells below the mean by 1.5 deviations."""
    d = fx.dem(spark, sf_dir)
    shaded = sc.shadows(d, "z", 1.5)
    return percentile_stretch(shaded, "z").select("row", "col", F.round("z", 6).alias("green"), F.when(C("shadow"), 0.6).otherwise(0.0).alias("blue"))


@REGISTRY.query("x82_grid_geometry", fx.sql("SELECT min(row) - 0.5::DOUBLE AS north, min(col) - 0.5::DOUBLE AS west, (max(row) - min(row)) / nullif(count(DISTINCT row) - 1, 0)::DOUBLE AS res_y, (max(col) - min(col)) / nullif(count(DISTINCT col) - 1, 0)::DOUBLE AS res_x FROM dem", "dem"))
def grid_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corner and resolution of a grid from its cells' centres, half a cell off."""
    return sc.grid_geometry(fx.dem(spark, sf_dir), "col", "row").select("north", "west", "res_y", "res_x")


@REGISTRY.query("x84_channels", "SELECT vec_id, round(list_sum(list_transform(embedding[1:9], lambda x: x::DOUBLE)), 5) + 0.0 AS total, 9 AS n FROM embeddings")
def channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine channels, padded or cut."""
    e = fx.table(spark, sf_dir, "embeddings").select("vec_id", sc.pad_channels(F.transform("embedding", lambda x: x.cast("double")), 9).alias("c"))
    return e.select("vec_id", (F.round(F.aggregate("c", F.lit(0.0), lambda a, x: a + x), 5) + 0.0).alias("total"), F.size("c").alias("n"))


@REGISTRY.query("w30_area_downsample", fx.sql("SELECT CAST(row // 3 AS INT) AS row, CAST(col // 3 AS INT) AS col, round(avg(z), 6) AS z, round(1 / (1 + 10 * sqrt(avg((z - m) * (z - m)))), 6) AS quality FROM (SELECT *, avg(z) OVER (PARTITION BY row // 3, col // 3) AS m FROM dem) GROUP BY 1, 2", "dem"))
def area_downsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block means, and how well a block's mean stands for its cells."""
    b = lambda c: F.floor(C(c) / 3).cast("int").alias(c)
    d = fx.dem(spark, sf_dir).groupBy(b("row"), b("col")).agg(F.avg("z").alias("z"), F.stddev_pop("z").alias("s"))
    return d.select("row", "col", F.round("z", 6).alias("z"), F.round(1 / (1 + 10 * C("s")), 6).alias("quality"))
