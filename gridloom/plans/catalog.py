"""All queries outside the llm subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridloom.plans import change_queries, feature_queries, model_queries, pixel_queries, raster_queries, scene_queries, source_queries, spectral_queries
from gridloom.plans.registry import Registry

REGISTRY = Registry()
for module in (spectral_queries, pixel_queries, change_queries, feature_queries, raster_queries, model_queries, scene_queries, source_queries):
    for name, query in module.REGISTRY.queries.items():
        REGISTRY.add(name, query, module.REGISTRY.oracles.get(name))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flood frequency with its interval and zone."""
    return REGISTRY.queries["a11_flood_frequency"](spark, sf_dir)
