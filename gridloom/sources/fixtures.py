"""Observation, raster and feature views over the plain tables, as DataFrames and as SQL.

The tables that queries run on are ordinary business tables; these views give them the shapes that
the engine works on: observations (pixel x date x sensor), SAR scenes, an elevation grid, yearly
class maps, feature snapshots, gauges and points. SQL[name] is the same view as DuckDB text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What tells observations apart.
OBS_KEY = ["orderkey", "linenumber", "partkey", "suppkey", "acq_date"]
KEY_SQL = ", ".join(OBS_KEY)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surface-reflectance observations; naip has no short-wave bands."""
    t = table(spark, sf_dir, "lineitem")
    sensor = F.when(F.col("l_returnflag") == "R", "landsat").when(F.col("l_returnflag") == "A", "sentinel2").otherwise("naip")
    short = lambda c: F.when(F.col("l_returnflag") != "N", c)
    return t.select(
        F.col("l_orderkey").alias("orderkey"), F.col("l_linenumber").alias("linenumber"), F.col("l_partkey").alias("partkey"), F.col("l_suppkey").alias("suppkey"), F.to_date("l_shipdate").alias("acq_date"),
        (F.col("l_partkey") % 16).cast("int").alias("px_row"), (F.col("l_suppkey") % 16).cast("int").alias("px_col"), sensor.alias("sensor"),
        (F.col("l_orderkey") % 128).cast("int").alias("qa"), (F.col("l_partkey") % 12).cast("int").alias("scl"),
        ((F.col("l_partkey") % 7) / 100).alias("blue"), F.col("l_discount").alias("green"), (F.col("l_linenumber") / 100).alias("red"), F.col("l_tax").alias("nir"),
        short((F.floor("l_quantity") % 10) / 100).alias("swir1"), short((F.col("l_orderkey") % 9) / 100).alias("swir2"),
        (F.col("l_partkey") % 12).isin(4, 5, 6, 7).alias("clear"),
    )


def obs_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations with a few per pixel: the order is the pixel."""
    return obs(spark, sf_dir).withColumn("px", F.col("orderkey"))


def sar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Radar backscatter in linear units."""
    t = table(spark, sf_dir, "lineitem")
    return t.select(
        (F.col("l_partkey") % 16).cast("int").alias("px_row"), (F.col("l_suppkey") % 16).cast("int").alias("px_col"), F.to_date("l_shipdate").alias("acq_date"),
        (F.col("l_extendedprice") / 1e6).alias("vv"), (F.col("l_quantity") / 1e3).alias("vh"),
    )


def dem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elevation grid of 50 columns."""
    t = table(spark, sf_dir, "part")
    return t.select(F.floor(F.col("p_partkey") / 50).cast("int").alias("row"), (F.col("p_partkey") % 50).cast("int").alias("col"), (F.col("p_retailprice") + F.col("p_size")).alias("z"))


def class_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yearly classes 0..7 of pixels; most pixels miss some years."""
    t = table(spark, sf_dir, "orders")
    return t.groupBy(F.col("o_custkey").alias("px"), F.year("o_orderdate").alias("year")).agg((F.sum("o_orderkey") % 8).cast("int").alias("class_id"))


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The features of two polls: ids, type, name and brand."""
    t = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("type"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"))
    return t.filter("id % 10 <> 0"), t.filter("id % 10 <> 1")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Point features in layers."""
    t = table(spark, sf_dir, "customer")
    return t.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("layer"), ((F.col("c_custkey") * 37) % 3600 / 10 - 180).alias("lon"), ((F.col("c_custkey") * 17) % 1800 / 10 - 90).alias("lat"))


def centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "supplier")
    return t.select(F.col("s_suppkey").alias("centre_id"), ((F.col("s_suppkey") * 53) % 3600 / 10 - 180).alias("lon"), ((F.col("s_suppkey") * 29) % 1600 / 10 - 80).alias("lat"))


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily gauge readings of sites."""
    t = table(spark, sf_dir, "events")
    return t.groupBy(F.col("user_id").alias("site_id"), F.to_date("ts").alias("date")).agg((F.round(F.avg("value"), 6) / 100).alias("gage"), F.max("value").alias("discharge"))


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("site_id"), F.col("c_name").alias("site_name")).filter("site_id % 2 = 0")


def footprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detected footprints with shape and evidence measures."""
    t = table(spark, sf_dir, "lineitem")
    return t.groupBy(F.col("l_suppkey").alias("fid")).agg(
        F.sum("l_quantity").alias("area"), (F.sqrt(F.sum("l_quantity")) * (4 + F.count(F.lit(1)) % 5)).alias("perimeter"), F.round(F.avg("l_discount") * 10, 9).alias("prob_mean"), (F.max("l_tax") * 10).alias("prob_max"),
        F.round(F.avg("l_tax") - F.avg("l_discount"), 9).alias("ndwi_mean"), F.round(F.avg("l_linenumber") / 7, 9).alias("edge_sharpness"),
    )


def probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve scores of a pixel."""
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 12), lambda x: x.cast("double")).alias("logits"), F.col("label"))


SQL: dict[str, str] = {
    "obs": """SELECT l_orderkey AS orderkey, l_linenumber AS linenumber, l_partkey AS partkey, l_suppkey AS suppkey, CAST(l_shipdate AS DATE) AS acq_date,
 CAST(l_partkey % 16 AS INTEGER) AS px_row, CAST(l_suppkey % 16 AS INTEGER) AS px_col,
 CASE l_returnflag WHEN 'R' THEN 'landsat' WHEN 'A' THEN 'sentinel2' ELSE 'naip' END AS sensor,
 CAST(l_orderkey % 128 AS INTEGER) AS qa, CAST(l_partkey % 12 AS INTEGER) AS scl,
 (l_partkey % 7) / 100.0::DOUBLE AS blue, l_discount AS green, l_linenumber / 100.0::DOUBLE AS red, l_tax AS nir,
 CASE WHEN l_returnflag <> 'N' THEN (floor(l_quantity) % 10) / 100.0::DOUBLE END AS swir1, CASE WHEN l_returnflag <> 'N' THEN (l_orderkey % 9) / 100.0::DOUBLE END AS swir2,
 (l_partkey % 12) IN (4, 5, 6, 7) AS clear FROM lineitem""",
    "sar": "SELECT CAST(l_partkey % 16 AS INTEGER) AS px_row, CAST(l_suppkey % 16 AS INTEGER) AS px_col, CAST(l_shipdate AS DATE) AS acq_date, l_extendedprice / 1e6 AS vv, l_quantity / 1e3 AS vh FROM lineitem",
    "dem": "SELECT CAST(p_partkey // 50 AS INTEGER) AS row, CAST(p_partkey % 50 AS INTEGER) AS col, p_retailprice + p_size AS z FROM part",
    "class_map": "SELECT o_custkey AS px, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(sum(o_orderkey) % 8 AS INTEGER) AS class_id FROM orders GROUP BY 1, 2",
    "snap": "SELECT p_partkey AS id, p_type AS type, p_name AS name, p_brand AS brand FROM part",
    "points": "SELECT c_custkey AS id, c_mktsegment AS layer, (c_custkey * 37) % 3600 / 10.0::DOUBLE - 180 AS lon, (c_custkey * 17) % 1800 / 10.0::DOUBLE - 90 AS lat FROM customer",
    "centres": "SELECT s_suppkey AS centre_id, (s_suppkey * 53) % 3600 / 10.0::DOUBLE - 180 AS lon, (s_suppkey * 29) % 1600 / 10.0::DOUBLE - 80 AS lat FROM supplier",
    "readings": "SELECT user_id AS site_id, CAST(ts AS DATE) AS date, round(avg(value), 6) / 100 AS gage, max(value) AS discharge FROM events GROUP BY 1, 2",
    "stations": "SELECT c_custkey AS site_id, c_name AS site_name FROM customer WHERE c_custkey % 2 = 0",
    "footprints": """SELECT l_suppkey AS fid, sum(l_quantity) AS area, sqrt(sum(l_quantity)) * (4 + count(*) % 5) AS perimeter, round(avg(l_discount) * 10, 9) AS prob_mean, max(l_tax) * 10 AS prob_max,
 round(avg(l_tax) - avg(l_discount), 9) AS ndwi_mean, round(avg(l_linenumber) / 7, 9) AS edge_sharpness FROM lineitem GROUP BY 1""",
    "probs": "SELECT vec_id, list_transform(embedding[1:12], lambda x: CAST(x AS DOUBLE)) AS logits, label FROM embeddings",
}


def sql(body: str, *views: str, **more: str) -> str:
    """DuckDB text with views (of SQL) and further named texts in front."""
    parts = [f"{v} AS ({SQL[v]})" for v in views] + [f"{k} AS ({v})" for k, v in more.items()]
    return f"WITH {', '.join(parts)} {body}" if parts else body


View = Callable[[SparkSession, str], DataFrame]
