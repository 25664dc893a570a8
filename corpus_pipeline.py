"""Corpus pipeline: quality rules, line dedup, near-duplicate removal, decontamination, tokenization.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before it left, and returns the
columns of documents, but for the last, which returns the token ids. run() writes the result of each
stage as Parquet in the shared folder and reads it again.

Defined results, of all stages: an empty table gives an empty table; columns beyond those of documents
are carried, whatever their names (but by the last stage, which gives its own); texts of any length are
worked on whole; nulls may stand in any column. What each stage makes of nulls, repeated rows and ties is said there.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import decontaminate, jaccard_join, line_dedup, piece_codec, quality
from gridloom.llm.common import staged, table

PIECE_MODEL = "piece_bpe_32k.model"


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    Each row is judged by its own text and language: rows of one id, repeated rows and rows without an id
    stay or go by themselves. A null text has no words and goes; a null language counts as unknown; a
    distance equal to its bound passes.
    """
    return quality.keep_good(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that occur earlier in runs; n_chars is that of the new text, and a document of which nothing is left goes.

    Earlier is under a smaller id, or further up in the same document. Rows of one id are put apart by their
    text, equal rows of one id are one document and each gets its result; rows without an id, null texts and
    texts of one line stay as they are.
    """
    done = line_dedup.remove_repeats(docs).filter((F.col("__n_removed") == 0) | F.col("text").rlike(line_dedup.FILLED))
    return done.withColumn("n_chars", F.when(F.col("__n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: that of the smallest id.

    Of several rows with that id the one of the smallest hash of text stays, and of equal ones of these one,
    by a hash of all columns. A row whose text is in another class than its id's other texts is not lost.
    Rows without an id and texts without words are near to none and stay.
    """
    return jaccard_join.keep_one(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a leaked test item.

    Equal texts are judged alike, whatever their ids; null texts and texts without words hold none; null items
    and items without words are in none; a score equal to the bound is a leak.
    """
    return decontaminate.remove_leaks(docs, table(spark, sf_dir, "benchmark"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (binary) and digests of ids and decoded text of each row.

    A null text is empty and has the begin and end ids; repeated rows and rows without an id get a row each.
    """
    encoded = piece_codec.encode(docs, public_tokenizers.path(PIECE_MODEL))
    return encoded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), "ids")


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("near-duplicate removal", near_stage),
    ("benchmark decontamination", benchmark_stage),
    ("piece encoding", token_stage),
]
# Alignment, banding and the piece model have no SQL form; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
