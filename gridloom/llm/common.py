"""Helpers shared by the corpus operators: tables, shared folder, text access."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.sources.shared import shared_folder

#: Tables staged by this process.
_STAGED: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, what: str, ids_only: bool = False) -> DataFrame:
    """Write a table in the shared folder and read it back: cuts lineage and survives lost executors.

    ids_only: its rows are a few numbers, far smaller than the documents that the number of shuffle
    partitions is chosen for, so a task writes several partitions into one file.
    """
    spark = df.sparkSession
    if ids_only:
        df = df.coalesce(max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // 4))
    path = f"{shared_folder(spark)}/gridloom-{what}-{uuid.uuid4().hex}"
    _STAGED.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(spark: SparkSession) -> int:
    """Delete the tables that this process has staged; results that still read them must have been written. Gives their number."""
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    count = len(_STAGED)
    while _STAGED:
        path = spark._jvm.org.apache.hadoop.fs.Path(_STAGED.pop())
        path.getFileSystem(hadoop).delete(path, True)
    return count


def input_bytes(df: DataFrame, text_col: str = "text") -> int:
    """Bytes of all texts, from a scan of that column alone; sizes of files tell little, as texts pack well or badly."""
    return int(df.agg(F.coalesce(F.sum(F.octet_length(F.col(f"`{text_col}`").cast("string"))), F.lit(0))).first()[0])


def groups_for(size: int, bytes_each: int, least: int = 1) -> int:
    """How many groups of about bytes_each an input makes; grows with the input, without a cap."""
    return max(least, math.ceil(size / bytes_each))


def texts_of(column: pa.Array | pa.ChunkedArray) -> list[str]:
    """Texts of a column, null as the empty text."""
    return [t if t is not None else "" for t in column.to_pylist()]


def utf8_of(column: pa.Array | pa.ChunkedArray) -> Iterator[bytes]:
    """UTF-8 bytes of each text without building str objects, null as empty."""
    for chunk in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        wide = pa.types.is_large_string(chunk.type) or pa.types.is_large_binary(chunk.type)
        _, offsets, data = chunk.buffers()
        at = np.frombuffer(offsets, np.int64 if wide else np.int32)[chunk.offset : chunk.offset + len(chunk) + 1]
        view = memoryview(data) if data is not None else memoryview(b"")
        valid = chunk.is_valid().to_pylist() if chunk.null_count else None
        for i in range(len(chunk)):
            yield b"" if valid and not valid[i] else bytes(view[at[i] : at[i + 1]])


def pieces(batch: pa.RecordBatch, column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `limit` bytes of text each; a longer text is a slice of its own."""
    lengths = np.array([0 if n is None else n for n in pa.compute.binary_length(batch.column(column)).to_pylist()], np.int64)
    start, size = 0, 0
    for i, n in enumerate(lengths):
        if i > start and size + n > limit:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if start < len(lengths):
        yield batch.slice(start)


def documents(df: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """The columns an operator needs under fixed names, so that clashing extra columns do no harm."""
    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), *[F.col(f"`{c}`").cast("string").alias(c) for c in more])


def splittable_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join of rows with a row for each key (an integer), of which one may hold a large part of all rows.

    What an aggregate on the key has dealt out is joined as it lies, and then a large key stays in one
    task. Here the inverted key is joined, so both sides are dealt out for the join itself, and adaptive
    execution splits the rows of a large key over several tasks, each with the key's only row.
    """
    inverted = F.bitwise_not(F.col(key))
    return left.withColumn("__k", inverted).join(right.withColumn("__k", inverted).drop(key), "__k").drop("__k")


def join_by_count(left: DataFrame, right: DataFrame, key: str, total: int, count: str = "n", share: int = 1000) -> DataFrame:
    """Inner join of rows with a table of their distinct keys, which counts the rows of each key.

    A key may hold a large part of all rows. Keys of more than 1/share of the total are fewer than
    `share`, so these are broadcast and their rows stay where they are; the other rows are shuffled, and no key of theirs is large.
    """
    bound = max(total // share, 1)
    hot = right.filter(F.col(count) > bound).withColumn("__hot", F.lit(True))
    marked = left.join(F.broadcast(hot), key, "left")
    columns = [*left.columns, *[c for c in right.columns if c not in left.columns]]
    rest = marked.filter(F.col("__hot").isNull()).select(left.columns).join(right.filter(F.col(count) <= bound), key)
    return marked.filter("__hot").select(columns).unionByName(rest.select(columns))
