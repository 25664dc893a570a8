"""Queries on features: diffs, joins, checks, coordinates, text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.functions import classes, geo, scores
from gridloom.functions.guards import r6
from gridloom.operators import features as fe
from gridloom.plans.registry import Registry
from gridloom.sources import fixtures as fx

REGISTRY = Registry()
C = F.col


@REGISTRY.query("j2_snapshot_diff", fx.sql("SELECT type, id, 'removed' AS status FROM snap WHERE id % 10 = 1 UNION ALL SELECT type, id, 'added' FROM snap WHERE id % 10 = 0", "snap"))
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = fx.snapshots(spark, sf_dir)
    return fe.snapshot_diff(a, b, ["type", "id"])


@REGISTRY.query("j3_consuming_diff", fx.sql(
    "SELECT coalesce(a.key, b.key) AS key, coalesce(a.turn, b.turn)::INT AS turn, CASE WHEN a.key IS NOT NULL AND b.key IS NOT NULL THEN 'unchanged' WHEN b.key IS NOT NULL THEN 'added' ELSE 'removed' END AS status FROM a FULL JOIN b ON a.key = b.key AND a.turn = b.turn",
    a="SELECT DISTINCT s_suppkey * 37 % 50 AS key, 1 AS turn FROM supplier WHERE s_suppkey % 3 <> 0", b="SELECT s_suppkey * 37 % 50 AS key, row_number() OVER (PARTITION BY s_suppkey * 37 % 50 ORDER BY s_suppkey) AS turn FROM supplier WHERE s_suppkey % 4 <> 0"))
def consuming_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fx.table(spark, sf_dir, "supplier").select(C("s_suppkey").alias("id"), (C("s_suppkey") * 37 % 50).alias("key"))
    return fe.consuming_diff(s.filter("id % 3 <> 0"), s.filter("id % 4 <> 0"), "key", "id")


@REGISTRY.query("o8_key_sets", fx.sql("SELECT type, count(*) FILTER (WHERE id % 10 > 1) AS n_both, count(*) FILTER (WHERE id % 10 = 1) AS n_before, count(*) FILTER (WHERE id % 10 = 0) AS n_after FROM snap GROUP BY 1", "snap"))
def key_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intersection and both differences of two key sets, by type."""
    a, b = (x.select("type", "id") for x in fx.snapshots(spark, sf_dir))
    count = lambda df, name: df.groupBy("type").agg(F.count(F.lit(1)).alias(name))
    out = count(a.intersect(b), "n_both").join(count(a.join(b, ["type", "id"], "left_anti"), "n_before"), "type", "full_outer").join(count(b.join(a, ["type", "id"], "left_anti"), "n_after"), "type", "full_outer")
    return out.fillna(0)


@REGISTRY.query("j4_station_lookup", fx.sql("SELECT r.site_id, s.site_name, r.date, round(r.gage, 6) AS gage, r.discharge FROM readings r JOIN stations s ON r.site_id = s.site_id", "readings", "stations"))
def station_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings of known stations only; Spark broadcasts the stations while they are small."""
    return fx.readings(spark, sf_dir).join(fx.stations(spark, sf_dir), "site_id").select("site_id", "site_name", "date", F.round("gage", 6).alias("gage"), "discharge")


_DAYS = "SELECT DISTINCT CAST(ts AS DATE) AS day FROM events WHERE event_type = 'purchase'"


def _around(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = fx.table(spark, sf_dir, "events").filter("event_type = 'purchase'").select(F.to_date("ts").alias("day")).distinct()
    return fe.around_dates(days, fx.readings(spark, sf_dir), "day", "date")


@REGISTRY.query("j5_readings_around_dates", fx.sql("SELECT d.day, r.site_id, CASE WHEN r.date < d.day THEN 'before' WHEN r.date > d.day THEN 'after' ELSE 'day_of' END AS \"window\", round(r.gage, 6) AS gage, r.discharge FROM days d JOIN readings r ON r.date BETWEEN d.day - 1 AND d.day + 1", "readings", days=_DAYS))
def readings_around_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _around(spark, sf_dir).select("day", "site_id", "window", F.round("gage", 6).alias("gage"), "discharge")


@REGISTRY.query("a30_gauge_maximum", fx.sql("SELECT d.day, r.site_id, round(max(r.gage), 6) AS max_gage, bool_or(r.gage > 0.6) AS any_flooding FROM days d JOIN readings r ON r.date BETWEEN d.day - 1 AND d.day + 1 GROUP BY 1, 2", "readings", days=_DAYS))
def gauge_maximum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Highest gauge within a day of each observation, and whether any reading is above flood stage."""
    return _around(spark, sf_dir).groupBy("day", "site_id").agg(F.round(F.max("gage"), 6).alias("max_gage"), F.bool_or(C("gage") > 0.6).alias("any_flooding"))


@REGISTRY.query("k14_gauge_report", fx.sql("SELECT d.day, r.site_id, CASE WHEN r.date < d.day THEN 'before' WHEN r.date > d.day THEN 'after' ELSE 'day_of' END AS \"window\", printf('%.2f', r.gage * 1.0007) AS gage_ft, printf('%.2f', r.gage * 0.30501) AS gage_m FROM days d JOIN readings r ON r.date BETWEEN d.day - 1 AND d.day + 1", "readings", days=_DAYS))
def gauge_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _around(spark, sf_dir)
    return a.select("day", "site_id", "window", F.format_string("%.2f", C("gage") * 1.0007).alias("gage_ft"), F.format_string("%.2f", C("gage") * 0.30501).alias("gage_m"))


_RINGS = [500.0, 1000.0, 2000.0]
_HAV = "2 * 6371.0088 * asin(least(sqrt(sin(radians(p.lat - c.lat) / 2) ** 2 + cos(radians(c.lat)) * cos(radians(p.lat)) * sin(radians(p.lon - c.lon) / 2) ** 2), 1.0))"
_RING = f"SELECT c.centre_id, p.id, p.layer, {_HAV} AS km FROM centres c, points p WHERE {_HAV} <= 2000"


@REGISTRY.query("j7_ring_join", fx.sql("SELECT centre_id, id, layer, CASE WHEN km <= 500 THEN 1 WHEN km <= 1000 THEN 2 ELSE 3 END AS ring, round(km, 6) AS distance_km FROM r", "centres", "points", r=_RING))
def ring_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features in rings around each centre, by grid cells."""
    j = fe.ring_join(fx.centres(spark, sf_dir), fx.points(spark, sf_dir), _RINGS)
    return j.select("centre_id", "id", "layer", "ring", F.round("distance_km", 6).alias("distance_km"))


@REGISTRY.query("a31_ring_counts", fx.sql("SELECT centre_id, ring, layer, count(*) AS n_total, array_to_string(list(id ORDER BY km, id)[1:3], ',') AS nearest FROM (SELECT *, CASE WHEN km <= 500 THEN 1 WHEN km <= 1000 THEN 2 ELSE 3 END AS ring FROM r) GROUP BY 1, 2, 3", "centres", "points", r=_RING))
def ring_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by ring and layer, with the three nearest features."""
    counts = fe.ring_counts(fx.centres(spark, sf_dir), fx.points(spark, sf_dir), _RINGS, "centre_id", "id", "layer")
    return counts.withColumn("nearest", F.array_join(F.transform("nearest", lambda x: x.cast("string")), ","))


@REGISTRY.query("j11_agreement", fx.sql("SELECT layer, count(*) AS n, count(*) FILTER (WHERE id IN (SELECT s_suppkey * 7 FROM supplier)) AS n_agree, count(*) FILTER (WHERE id NOT IN (SELECT s_suppkey * 7 FROM supplier)) AS n_novel FROM points GROUP BY 1", "points"))
def agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features that a reference layer has too, and novel ones: semi- and anti-join."""
    p = fx.points(spark, sf_dir)
    ref = fx.table(spark, sf_dir, "supplier").select((C("s_suppkey") * 7).alias("id"))
    by = lambda df, name: df.groupBy("layer").agg(F.count(F.lit(1)).alias(name))
    return by(p, "n").join(by(p.join(ref, "id", "left_semi"), "n_agree"), "layer", "left").join(by(p.join(ref, "id", "left_anti"), "n_novel"), "layer", "left").fillna(0)


@REGISTRY.query("a28_duplicate_features", "SELECT doc_id, copies FROM (SELECT doc_id, count(*) OVER (PARTITION BY text) AS copies FROM documents) WHERE copies > 1")
def duplicate_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fe.duplicates(fx.table(spark, sf_dir, "documents").select("doc_id", "text"), C("text")).select("doc_id", "copies")


@REGISTRY.query("a29_category_counts", fx.sql("SELECT category, count(*) AS n FROM c GROUP BY 1", c="""SELECT CASE WHEN s LIKE '%FLOODWAY%' THEN 'floodway' WHEN z IN ('A','AE','AH','AO','AR','A99','V','VE') THEN '100-year' WHEN s LIKE '%0.2 PCT ANNUAL CHANCE%' THEN '500-year' ELSE 'other' END AS category
 FROM (SELECT upper(trim([' ae', 'X', 'VE ', 'd', 'x'][1 + p_partkey % 5])) AS z, upper(trim(['', 'Floodway fringe', '0.2 pct annual chance flood', 'none'][1 + p_partkey % 4])) AS s FROM part)"""))
def category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flood categories by ordered rules."""
    z = F.element_at(F.array(*map(F.lit, (" ae", "X", "VE ", "d", "x"))), (1 + C("p_partkey") % 5).cast("int"))
    s = F.element_at(F.array(*map(F.lit, ("", "Floodway fringe", "0.2 pct annual chance flood", "none"))), (1 + C("p_partkey") % 4).cast("int"))
    return fx.table(spark, sf_dir, "part").groupBy(classes.flood_category(z, s).alias("category")).agg(F.count(F.lit(1)).alias("n"))


@REGISTRY.query("a32_bounding_box", fx.sql("SELECT layer, min(lon) AS west, min(lat) AS south, max(lon) AS east, max(lat) AS north FROM points GROUP BY 1", "points"))
def bounding_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.points(spark, sf_dir).groupBy("layer").agg(F.min("lon").alias("west"), F.min("lat").alias("south"), F.max("lon").alias("east"), F.max("lat").alias("north"))


@REGISTRY.query("x59_feature_keys", fx.sql("SELECT id, '[[' || CAST(round(lon, 6) AS VARCHAR) || ',' || CAST(round(lat, 6) AS VARCHAR) || ']]' AS geometry_key, coalesce(layer, '') || '|' || CAST(id AS VARCHAR) AS property_key FROM points WHERE lon % 1 <> 0 AND lat % 1 <> 0 AND id % 5 <> 0 UNION ALL SELECT id, 'null-geometry', coalesce(layer, '') || '|' || CAST(id AS VARCHAR) FROM points WHERE lon % 1 <> 0 AND lat % 1 <> 0 AND id % 5 = 0", "points"))
def feature_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys by rounded geometry and by properties."""
    p = fx.points(spark, sf_dir).filter("lon % 1 <> 0 and lat % 1 <> 0")
    return p.select("id", geo.geometry_key(F.when(C("id") % 5 != 0, F.array(F.array("lon", "lat")))).alias("geometry_key"), geo.property_key(C("layer"), C("id")).alias("property_key"))


@REGISTRY.query("x61_key_value", "SELECT p_partkey, CASE WHEN ok THEN k END AS k, CASE WHEN ok THEN v END AS v FROM (SELECT *, k <> '' AND v <> '' AND instr(tag, '=') > 0 AS ok FROM (SELECT p_partkey, tag, trim(substr(tag, 1, instr(tag, '=') - 1)) AS k, trim(substr(tag, instr(tag, '=') + 1)) AS v FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_brand || '=' || p_type WHEN 1 THEN p_brand WHEN 2 THEN '=x' ELSE ' a = b=c' END AS tag FROM part)))")
def key_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = C("p_partkey") % 4
    tag = F.when(m == 0, F.concat("p_brand", F.lit("="), "p_type")).when(m == 1, C("p_brand")).when(m == 2, F.lit("=x")).otherwise(F.lit(" a = b=c"))
    k, v = geo.key_value(C("tag"))
    return fx.table(spark, sf_dir, "part").select("p_partkey", tag.alias("tag")).select("p_partkey", k.alias("k"), v.alias("v"))


@REGISTRY.query("x62_utm_and_boxes", fx.sql(
    "SELECT id, CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END + CAST(floor((lon + 180) / 6) + 1 AS INT) AS epsg, round(lon - 5 / (111.32 * cos(radians(lat))), 6) + 0.0 AS west, round(lat - 5 / 111.32, 6) + 0.0 AS south, lon < -180 OR lat < -90 OR lon > 180 OR lat > 90 AS outside,"
    " CAST(trunc((90.0 - lat) / 0.7) AS INT) AS row, CAST(trunc((lon + 180.0) / 0.7) AS INT) AS col FROM points WHERE abs(lat) < 89", "points"))  # fmt: skip
def utm_and_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UTM zones, boxes around points, world bounds, and grid indices."""
    box = geo.bbox_around(C("lon"), C("lat"), 5.0)
    row, col = geo.world_to_pixel(C("lon"), C("lat"), -180.0, 90.0, 0.7)
    return fx.points(spark, sf_dir).filter("abs(lat) < 89").select("id", geo.utm_epsg(C("lon"), C("lat")).alias("epsg"), r6(box["west"]).alias("west"), r6(box["south"]).alias("south"), geo.outside_world(C("lon"), C("lat"), C("lon"), C("lat")).alias("outside"), row.alias("row"), col.alias("col"))


@REGISTRY.query("x63_crs_transform", fx.sql("SELECT id, round(radians(lon) * 6378137, 3) + 0.0 AS x, round(ln(tan(pi() / 4 + radians(lat) / 2)) * 6378137, 3) + 0.0 AS y, round(lon, 6) + 0.0 AS lon, round(lat, 6) + 0.0 AS lat FROM points WHERE abs(lat) < 85", "points"))
def crs_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web Mercator coordinates and back; rows without both coordinates would be left out."""
    p = fx.points(spark, sf_dir).filter("abs(lat) < 85 and lon is not null")
    x, y = geo.transform(C("lon"), C("lat"), 4326, 3857)
    lon, lat = geo.transform(C("x"), C("y"), 3857, 4326)
    return p.select("id", x.alias("x"), y.alias("y")).select("id", (F.round("x", 3) + 0.0).alias("x"), (F.round("y", 3) + 0.0).alias("y"), r6(lon).alias("lon"), r6(lat).alias("lat"))


@REGISTRY.query("x63_utm_round_trip", fx.sql("SELECT id, round(lon, 6) + 0.0 AS lon, round(lat, 6) + 0.0 AS lat FROM points WHERE abs(lat) < 80 AND lon BETWEEN -102 AND -96", "points"))
def utm_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of a UTM zone there and back; zone 14 by its series."""
    p = fx.points(spark, sf_dir).filter("abs(lat) < 80 and lon between -102 and -96")
    e, n = geo.transform(C("lon"), C("lat"), 4326, 32614)
    lon, lat = geo.transform(C("e"), C("n"), 32614, 4326)
    return p.select("id", e.alias("e"), n.alias("n")).select("id", r6(lon).alias("lon"), r6(lat).alias("lat"))


@REGISTRY.query("f1_valid_rows", "SELECT count(*) AS n_all, count(lon) FILTER (WHERE lat IS NOT NULL) AS n_valid, count(*) - count(lon) FILTER (WHERE lat IS NOT NULL) AS n_skipped FROM (SELECT TRY_CAST(CASE WHEN c_custkey % 9 = 0 THEN 'abc' WHEN c_custkey % 7 = 0 THEN NULL ELSE CAST(c_custkey AS VARCHAR) END AS DOUBLE) AS lon, TRY_CAST(CASE WHEN c_custkey % 5 = 0 THEN '' ELSE '1.5' END AS DOUBLE) AS lat FROM customer)")
def valid_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with two numeric coordinates, and how many are skipped."""
    k = C("c_custkey")
    raw = fx.table(spark, sf_dir, "customer").select(F.when(k % 9 == 0, "abc").when(k % 7 == 0, F.lit(None)).otherwise(k.cast("string")).alias("lon"), F.when(k % 5 == 0, "").otherwise("1.5").alias("lat"))
    ok = C("lon").try_cast("double").isNotNull() & C("lat").try_cast("double").isNotNull()
    return raw.agg(F.count(F.lit(1)).alias("n_all"), F.count_if(ok).alias("n_valid"), F.count_if(~ok).alias("n_skipped"))


@REGISTRY.query("s33_gazetteer_join", "SELECT c_custkey, n_name AS place, n_name IS NOT NULL AS success FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 2 = 0) ON c_nationkey = n_nationkey")
def gazetteer_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses looked up in a gazetteer; those not found stay, marked."""
    n = fx.table(spark, sf_dir, "nation").filter("n_nationkey % 2 = 0")
    return fx.table(spark, sf_dir, "customer").join(n, C("c_nationkey") == C("n_nationkey"), "left").select("c_custkey", C("n_name").alias("place"), C("n_name").isNotNull().alias("success"))


_BAD = "SELECT c_custkey AS id, CASE WHEN c_custkey % 11 <> 0 THEN (c_custkey * 37) % 400 - 200.0 END AS lon, (c_custkey * 17) % 200 - 100.0 AS lat, CASE WHEN c_custkey % 13 = 0 THEN 'dup' ELSE c_name END AS name FROM customer"


@REGISTRY.query("q7_health_report", fx.sql(
    "SELECT n AS check_name, s AS status, c AS n_affected, a AS affected FROM (SELECT 'null_geometry' AS n, CASE WHEN count(*) > 0 THEN 'FAILED' ELSE 'PASSED' END AS s, count(*) AS c, coalesce(array_to_string(list(id ORDER BY id)[1:20], ','), '') AS a FROM b WHERE lon IS NULL UNION ALL SELECT 'extent', CASE WHEN count(*) > 0 THEN 'FAILED' ELSE 'PASSED' END, count(*), coalesce(array_to_string(list(id ORDER BY id)[1:20], ','), '') FROM b WHERE lon < -180 OR lat < -90 OR lon > 180 OR lat > 90"
    " UNION ALL SELECT 'encoding', 'PASSED', 0, '' UNION ALL SELECT 'duplicates', CASE WHEN count(*) > 0 THEN 'WARNING' ELSE 'PASSED' END, count(*), coalesce(array_to_string(list(id ORDER BY id)[1:20], ','), '') FROM b WHERE name IN (SELECT name FROM b GROUP BY 1 HAVING count(*) > 1))", b=_BAD))  # fmt: skip
def health_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null geometries, extent, encoding and duplicates, a row each."""
    k = C("c_custkey")
    b = fx.table(spark, sf_dir, "customer").select(k.alias("id"), F.when(k % 11 != 0, (k * 37) % 400 - 200.0).alias("lon"), ((k * 17) % 200 - 100.0).alias("lat"), F.when(k % 13 == 0, "dup").otherwise(C("c_name")).alias("name"))
    repeated = lambda df: fe.check("duplicates", F.lit(True), "WARNING")(fe.duplicates(df, C("name")))
    outside = geo.outside_world(C("lon"), C("lat"), C("lon"), C("lat"))
    return fe.health_report(b, [fe.check("null_geometry", C("lon").isNull(), "FAILED"), fe.check("extent", outside, "FAILED"), fe.check("encoding", ~F.is_valid_utf8("name"), "WARNING"), repeated]).withColumn("affected", F.array_join(F.transform("affected", lambda x: x.cast("string")), ","))


@REGISTRY.query("a27_health_overall", "SELECT 1::BIGINT AS n_passed, 1::BIGINT AS n_warnings, 2::BIGINT AS n_failed, 'FAILED' AS overall")
def health_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fe.overall(health_report(spark, sf_dir))


@REGISTRY.query("f24_schema_edits", "SELECT c_custkey AS OBJECTID, c_name AS title, c_acctbal, NULL::VARCHAR AS note FROM customer")
def schema_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delete (protected fields stay), rename and add fields."""
    t = fx.table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "OBJECTID")
    t = fe.delete_fields(t, ["OBJECTID", "c_nationkey", "c_mktsegment", "nowhere"])
    return fe.add_fields(fe.rename_fields(t, {"c_name": "title", "nowhere": "x"}), {"note": "TEXT", "title": "LONG"})


@REGISTRY.query("f27_domains", "SELECT c_mktsegment AS value, count(*) AS n FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY') GROUP BY 1 UNION ALL SELECT 'acctbal', count(*) FROM customer WHERE c_acctbal NOT BETWEEN 0 AND 5000")
def domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values outside a coded and a range domain."""
    t = fx.table(spark, sf_dir, "customer")
    coded = fe.domain_violations(t, "c_mktsegment", coded={"BUILDING": "b", "MACHINERY": "m"}).groupBy(C("c_mktsegment").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return coded.unionByName(fe.domain_violations(t, "c_acctbal", between=(0, 5000)).agg(F.count(F.lit(1)).alias("n")).select(F.lit("acctbal").alias("value"), "n"))


@REGISTRY.query("k2_geojson_features", fx.sql("""SELECT '{"type":"Feature","geometry":' || CASE WHEN id % 3 <> 0 THEN '{"type":"Point","coordinates":[' || lon::VARCHAR || ',' || lat::VARCHAR || ']}' ELSE 'null' END || ',"properties":{"id":' || id || ',"layer":"' || layer || '"}}' AS feature FROM points""", "points"))
def geojson_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fe.to_geojson(fx.points(spark, sf_dir), "lon", "lat", C("id") % 3 != 0)


@REGISTRY.query("s31_json_config", "SELECT event_type, count(*) AS n, sum(coalesce(CAST(json_extract(props, '$.k') AS INT), 0))::BIGINT AS total FROM events GROUP BY 1")
def json_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON text with a schema and defaults."""
    k = F.coalesce(F.from_json("props", "k int")["k"], F.lit(0))
    return fx.table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(k).alias("total"))


_COMPACT = "least(4 * pi() * area / nullif(perimeter * perimeter, 0), 1.0)"


@REGISTRY.query("x54_building_score", fx.sql(
    f"SELECT fid, round(compact, 6) AS compactness, round(0.18 * least(edge_sharpness / 0.70, 1.0) + 0.14 * least(compact / 0.50, 1.0) + 0.14 * least(prob_max / 0.75, 1.0) + 0.13 * least(edge_sharpness / 0.1, 1.0) + 0.13 * CASE WHEN area < 30 THEN 0.1 WHEN area <= 5000 THEN 1.0 WHEN area <= 20000 THEN greatest(1 - (area - 5000) / 15000, 0.0) ELSE 0.0 END + 0.12 * least(prob_mean / 0.60, 1.0) + 0.16 * greatest(1 - greatest(ndwi_mean, 0.0) * 5, 0.0), 6) AS score FROM c", "footprints", c=f"SELECT *, {_COMPACT} AS compact FROM footprints"))
def building_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fx.footprints(spark, sf_dir).withColumn("compact", scores.compactness(C("area"), C("perimeter")))
    s = scores.building_score(C("edge_sharpness"), C("compact"), C("prob_max"), C("edge_sharpness"), C("prob_mean"), C("ndwi_mean"), C("area"))
    return f.select("fid", F.round("compact", 6).alias("compactness"), F.round(s, 6).alias("score"))


@REGISTRY.query("f20_cutoffs_top", fx.sql(f"SELECT fid, round(area, 6) AS area, round({_COMPACT}, 6) AS compactness FROM footprints WHERE area BETWEEN 100 AND 20000 AND {_COMPACT} >= 0.2 ORDER BY area DESC, fid LIMIT 20", "footprints"))
def cutoffs_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Footprints within the cutoffs, the twenty largest."""
    f = fx.footprints(spark, sf_dir).withColumn("compact", scores.compactness(C("area"), C("perimeter"))).filter("area between 100 and 20000 and compact >= 0.2")
    return f.orderBy(F.desc("area"), "fid").limit(20).select("fid", F.round("area", 6).alias("area"), F.round("compact", 6).alias("compactness"))


@REGISTRY.query("a40_result_summary", fx.sql("SELECT count(*) AS n, round(sum(area), 3) AS total_area, round(avg(prob_mean), 6) AS mean_prob, count(*) FILTER (WHERE prob_mean >= 0.5) AS n_high FROM footprints", "footprints"))
def result_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.footprints(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("area"), 3).alias("total_area"), F.round(F.avg("prob_mean"), 6).alias("mean_prob"), F.count_if(C("prob_mean") >= 0.5).alias("n_high"))


@REGISTRY.query("o6_union_sensors", fx.sql("SELECT sensor, band, count(*) AS n, count(v) AS n_valid FROM (SELECT 'optical' AS sensor, 'nir' AS band, nir AS v FROM obs UNION ALL SELECT 'radar', 'vv', vv FROM sar UNION ALL SELECT 'optical', 'swir1', swir1 FROM obs) GROUP BY 1, 2", "obs", "sar"))
def union_sensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One observation list of several sensors; bands that one lacks are null."""
    o = fx.obs(spark, sf_dir).select(F.lit("optical").alias("sensor"), "nir", "swir1")
    r = fx.sar(spark, sf_dir).select(F.lit("radar").alias("sensor"), "vv")
    u = o.unionByName(r, allowMissingColumns=True)
    pairs = F.when(C("sensor") == "optical", F.array(F.struct(F.lit("nir").alias("band"), C("nir").alias("v")), F.struct(F.lit("swir1").alias("band"), C("swir1").alias("v")))).otherwise(F.array(F.struct(F.lit("vv").alias("band"), C("vv").alias("v"))))
    return u.select("sensor", F.explode(pairs).alias("x")).groupBy("sensor", "x.band").agg(F.count(F.lit(1)).alias("n"), F.count("x.v").alias("n_valid"))


@REGISTRY.query("o10_distinct_dates", "SELECT DISTINCT CAST(ts AS DATE) AS day FROM events WHERE event_type = 'view'")
def distinct_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "events").filter("event_type = 'view'").select(F.to_date("ts").alias("day")).distinct()


@REGISTRY.query("x70_palette", "SELECT n_nationkey, (n_nationkey * 9 % 256)::VARCHAR || ',' || (n_nationkey * 5 % 256)::VARCHAR || ',' || (n_nationkey * 3 % 256)::VARCHAR AS rgb FROM nation")
def palette(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colours as hexadecimal text and back."""
    n = C("n_nationkey")
    code = F.format_string("#%02x%02x%02x", n * 9 % 256, n * 5 % 256, n * 3 % 256)
    return fx.table(spark, sf_dir, "nation").select("n_nationkey", geo.hex_to_rgb(code).alias("rgb"))
