"""Incremental operators on Structured Streaming: running counters, snapshot diffs, sinks."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gridloom.operators.features import snapshot_diff
from gridloom.sources.shared import shared_folder

Sink = Callable[[DataFrame, int], None]


def stream_table(spark: SparkSession, sf_dir: str, name: str, files_per_batch: int = 1000) -> DataFrame:
    """A table's files as a stream, with the schema of the table."""
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{path}*")


def running_counts(stream: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Counters per key that grow with every batch."""
    return stream.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))


def windowed_counts(stream: DataFrame, time: str, window: str, late: str, keys: list[str]) -> DataFrame:
    """Counts by event-time window; rows later than `late` are dropped once their window is out."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, window).alias("window"), *keys).agg(F.count(F.lit(1)).alias("n"))


def _folder(spark: SparkSession, what: str) -> str:
    return f"{shared_folder(spark)}/gridloom-{what}-{uuid.uuid4().hex}"


def drain(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Run a stream over what is there, and return its last result as a table."""
    spark = stream.sparkSession
    path, checkpoint = _folder(spark, "stream"), _folder(spark, "checkpoint")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(path)

    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    return spark.read.parquet(path)


class SnapshotMonitor:
    """Diffs each poll with the one before; the first is the baseline and gives no event.

    The state is in a folder alone: a poll writes a version under its number, and compares it with the last
    whole version of a smaller number. So a monitor that is started anew goes on where the last one ended,
    a poll that failed half-way leaves no version, and one that is tried again under its number gives the same
    changes. Every sink gets the changes; one that fails does not stop the others.
    """

    def __init__(self, spark: SparkSession, folder: str, key: list[str], sinks: list[Sink]):
        self.spark, self.folder, self.key, self.sinks = spark, folder.rstrip("/"), key, sinks
        self.errors: list[tuple[int, Exception]] = []

    def versions(self) -> list[int]:
        """The numbers of the whole versions, in order."""
        pattern = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/version=*/_SUCCESS")
        found = pattern.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(pattern)
        return sorted(int(f.getPath().getParent().getName().removeprefix("version=")) for f in found or [])

    def poll(self, snapshot: DataFrame, number: int | None = None) -> DataFrame | None:
        """Changes since the poll before, or None for the first; without a number it is the one after the last."""
        known = self.versions()
        number = (known[-1] + 1 if known else 0) if number is None else number
        path = f"{self.folder}/version={number}"
        snapshot.write.mode("overwrite").parquet(path)
        before = [n for n in known if n < number]
        if not before:
            return None
        changes = snapshot_diff(self.spark.read.parquet(f"{self.folder}/version={before[-1]}"), self.spark.read.parquet(path), self.key)
        if not changes.isEmpty():
            for sink in self.sinks:
                try:
                    sink(changes, number)
                except Exception as error:  # a sink's failure is kept for the caller and must not stop the others
                    self.errors.append((number, error))
        return changes

    def watch(self, stream: DataFrame, minutes: int = 1) -> StreamingQuery:
        """Poll with every batch of a stream, at once and then every few minutes; stop() ends it after the batch at hand. Its numbers go on after a restart, as its checkpoint is in the folder."""
        polled = stream.writeStream.option("checkpointLocation", f"{self.folder}/checkpoint").foreachBatch(lambda batch, number: self.poll(batch, number) and None)
        return polled.trigger(processingTime=f"{max(1, minutes)} minutes").start()


def append_json(path: str) -> Sink:
    """A sink that appends changes as JSON lines."""
    return lambda changes, number: changes.withColumn("poll", F.lit(number)).write.mode("append").json(path)


def message(changes: DataFrame, name: str, least: int = 1) -> str | None:
    """A short text on a change set: counts and the first five names added; None below `least` changes."""
    counts = {r.status: r.n for r in changes.groupBy("status").agg(F.count(F.lit(1)).alias("n")).collect()}
    if sum(counts.values()) < least:
        return None
    first = [str(r[0]) for r in changes.filter("status = 'added'").orderBy(name).select(name).limit(5).collect()]
    return f"{counts.get('added', 0)} added, {counts.get('removed', 0)} removed" + (f": {', '.join(first)}" if first else "")
