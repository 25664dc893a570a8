"""Queries of the corpus operators, one for each, over their whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import decontaminate, jaccard_join, line_dedup, lz_dedup, piece_codec, quality, secret_scan, substring_dedup, token_files, url_filter
from gridloom.llm.common import table
from gridloom.plans.registry import Registry

REGISTRY = Registry()


@REGISTRY.query("op1_url_filter", url_filter.ORACLE)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = table(spark, sf_dir, "pages").select("page_id", "url", F.expr(url_filter.FETCHED_ON).alias("fetched_on"))
    entries = spark.createDataFrame(url_filter.ENTRIES, "list_name string, pattern string, action string, listed_on string, seq int").withColumn("listed_on", F.to_date("listed_on"))
    return url_filter.evaluate(captures, entries).withColumnRenamed("capture_id", "page_id")


@REGISTRY.query("op2_token_files")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.digests(token_files.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1))


@REGISTRY.query("op3_suffix_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digests(substring_dedup.remove_repeats(table(spark, sf_dir, "documents")))


@REGISTRY.query("op4_jaccard_join", jaccard_join.oracle())
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.classes(table(spark, sf_dir, "documents"))


@REGISTRY.query("op5_line_dedup", line_dedup.ORACLE)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = line_dedup.remove_repeats(docs)
    return done.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_removed").alias("n_removed"), F.col("__n_chunks").alias("n_chunks"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


@REGISTRY.query("op6_secret_scan")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.find_secrets(table(spark, sf_dir, "documents"))


@REGISTRY.query("op7_decontamination")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaks = decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return leaks.withColumn("score", F.round("score", 6))


@REGISTRY.query("op8_piece_codec")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.digests(piece_codec.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model")))


@REGISTRY.query("op9_quality_rules", quality.oracle())
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


@REGISTRY.query("op10_lz_dedup", lz_dedup.oracle())
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lz_dedup.digests(lz_dedup.remove_repeats(table(spark, sf_dir, "documents")))
