"""Queries on sources and sinks: what is written is read again, and must be what it was."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators import features as fe
from gridloom.operators import scenes as sc
from gridloom.plans.registry import Registry
from gridloom.sources import files
from gridloom.sources import fixtures as fx
from gridloom.sources.shared import shared_folder
from gridloom.streaming.monitor import SnapshotMonitor

REGISTRY = Registry()
C = F.col


def _folder(spark: SparkSession, what: str) -> str:
    return f"{shared_folder(spark)}/gridloom-{what}-{uuid.uuid4().hex}"


_FILE_ROWS = 32


@REGISTRY.query("s4_raster_files", fx.sql(f"SELECT 'rows' || (row // {_FILE_ROWS}) || '.tif' AS name, b AS band, CAST(row % {_FILE_ROWS} AS INT) AS row, col, CASE WHEN b = 1 THEN z WHEN col % 7 <> 3 THEN CAST(floor(z) % 5 AS DOUBLE) END AS value FROM dem, (SELECT unnest([1, 2]) AS b)", "dem"))
def raster_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heights and classes as tiled LZW rasters of 32 rows with missing cells, written and read."""
    second = F.when(C("col") % 7 != 3, (F.floor("z") % 5).cast("double"))
    cells = fx.dem(spark, sf_dir).select(F.concat(F.lit("rows"), F.floor(C("row") / _FILE_ROWS).cast("string"), F.lit(".tif")).alias("name"), (C("row") % _FILE_ROWS).alias("row"), "col", F.posexplode(F.array(C("z"), second)).alias("band", "value"))
    place = files.Raster(np.zeros((1, 1, 1)), -9999.0, -95.8, 30.1, 0.0003, 0.0003, 4326, {"bands": "height,class"})
    folder = _folder(spark, "rasters")
    files.save_files(files.encode_rasters(cells.withColumn("band", C("band") + 1), place, "lzw", 16, "f8"), folder)
    return files.read_tiff(spark, folder).select(F.regexp_extract("path", "[^/]+$", 0).alias("name"), "band", "row", "col", "value")


@REGISTRY.query("s5_raster_band", fx.sql(f"SELECT row // {_FILE_ROWS} AS part, CAST(row % {_FILE_ROWS} AS INT) AS row, col, z AS value FROM dem", "dem"))
def raster_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One band of two, from rasters deflated in strips: the reader's band selection."""
    part = F.floor(C("row") / _FILE_ROWS)
    cells = fx.dem(spark, sf_dir).select(F.concat(part.cast("string"), F.lit(".tif")).alias("name"), (C("row") % _FILE_ROWS).alias("row"), "col", F.posexplode(F.array(-C("z"), C("z"))).alias("band", "value"))
    folder = _folder(spark, "bands")
    files.save_files(files.encode_rasters(cells.withColumn("band", C("band") + 1), files.Raster(np.zeros((1, 1, 1)), float("nan")), "deflate", None, "f8"), folder)
    return files.read_tiff(spark, folder, [2]).filter("value is not null").select(F.regexp_extract("path", r"(\d+)\.tif$", 1).cast("long").alias("part"), "row", "col", "value")


@REGISTRY.query("s3_geojson_files", fx.sql("SELECT CAST(id AS VARCHAR) AS id, layer, lon, lat FROM points", "points"))
def geojson_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Point features as GeoJSON lines, written by all tasks and read."""
    folder = _folder(spark, "geojson")
    files.write_geojson_lines(fe.to_geojson(fx.points(spark, sf_dir), "lon", "lat"), folder)
    read = files.read_geojson_lines(spark, folder, "struct<id:string,layer:string>")
    at = F.from_json("coordinates", "array<double>")
    return read.select("properties.id", "properties.layer", at[0].alias("lon"), at[1].alias("lat"))


@REGISTRY.query("s22_gauge_text", fx.sql("SELECT CAST(site_id AS VARCHAR) AS site_no, date, round(discharge, 4) AS value FROM readings WHERE site_id % 5 <> 0", "readings"))
def gauge_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily values as tab text with comments and a line of types, sites under ice without a value; written and read."""
    header = ["# daily values", "agency_cd\tsite_no\tdatetime\t7_00060_00003\t7_00060_00003_cd", "5s\t15s\t20d\t14n\t10s"]

    def with_header(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"value": header})
        yield from batches

    value = F.when(C("site_id") % 5 == 0, "Ice").otherwise(F.format_string("%.4f", "discharge"))
    lines = fx.readings(spark, sf_dir).select(F.concat_ws("\t", F.lit("USGS"), C("site_id").cast("string"), C("date").cast("string"), value, F.lit("A")).alias("value"))
    folder = _folder(spark, "rdb")
    lines.mapInPandas(with_header, "value string").write.text(folder)
    return files.daily_values(files.read_rdb(spark, folder), "00060")


@REGISTRY.query("s26_paged_service", "SELECT range AS id, range * 7 % 13 AS value FROM (SELECT unnest(range((SELECT count(*) FROM customer))) AS range)")
def paged_service(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A service that tells no total, read in waves until a page comes short."""
    n = fx.table(spark, sf_dir, "customer").count()
    return files.paged(spark, lambda offset, limit: [{"id": i, "value": i * 7 % 13} for i in range(offset, min(offset + limit, n))], None, 100, "id long, value long", wave=32)


@REGISTRY.query("s35_no_scenes", fx.sql("SELECT site_id AS scene_id, date FROM readings WHERE false", "readings"))
def no_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search that finds no scene gives an empty table of its columns."""
    r = fx.readings(spark, sf_dir).select(C("site_id").alias("scene_id"), "date", F.lit(0.0).alias("west"), F.lit(0.0).alias("south"), F.lit(1.0).alias("east"), F.lit(1.0).alias("north"), F.lit(50.0).alias("cloud"))
    return sc.search(r, 0, 0, 1, 1, "1900-01-01", "2100-01-01", 10).select("scene_id", "date")


@REGISTRY.query("k9_yearly_maps", fx.sql("SELECT year, px, class_id FROM class_map WHERE year BETWEEN 1994 AND 1996", "class_map"))
def yearly_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class maps written as a folder for each year; three years are read, and only their folders."""
    folder = _folder(spark, "maps")
    fx.class_map(spark, sf_dir).write.partitionBy("year").parquet(folder)
    return spark.read.parquet(folder).filter("year between 1994 and 1996").select("year", "px", "class_id")


@REGISTRY.query("k12_category_files", fx.sql("SELECT layer, count(*) AS n FROM points GROUP BY 1", "points"))
def category_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features split into a folder of GeoJSON lines for each category; a category without features has none."""
    folder = _folder(spark, "categories")
    points = fx.points(spark, sf_dir)
    split = fe.to_geojson(points, "lon", "lat").withColumn("category", F.get_json_object("feature", "$.properties.layer"))
    split.select("category", "feature").write.partitionBy("category").text(folder)
    return spark.read.text(folder).groupBy(C("category").alias("layer")).agg(F.count(F.lit(1)).alias("n"))


@REGISTRY.query("r2_snapshot_polls", fx.sql("SELECT poll, type, id, status FROM (SELECT 1 AS poll, type, id, 'removed' AS status FROM snap WHERE id % 10 = 1 UNION ALL SELECT 1, type, id, 'added' FROM snap WHERE id % 10 = 0 UNION ALL SELECT 2, type, id, 'added' FROM snap WHERE id % 10 = 1)", "snap"))
def snapshot_polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three polls, each by a monitor of its own as after a restart: the first is the baseline, the others give changes."""
    a, b = fx.snapshots(spark, sf_dir)
    folder = _folder(spark, "polls")
    polls = [SnapshotMonitor(spark, folder, ["type", "id"], []).poll(s) for s in (a, b, b.unionByName(a.filter("id % 10 = 1")))]
    found = [p.withColumn("poll", F.lit(i)) for i, p in enumerate(polls) if p is not None]
    return found[0].unionByName(found[1]).select("poll", "type", "id", "status")
