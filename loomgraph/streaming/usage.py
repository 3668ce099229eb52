"""Structured Streaming over an event log: daily counters as additive upserts, resumable ingest, and a watch that reports changes between batches.

What a stream leaves behind lies in the shared folder, in versions that are complete or absent, and each version names the batch it came from. So a job that is
lost between writing and the checkpoint runs its batch again without counting it twice, and a restart goes on where the last one ended.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def event_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """A stream of the parquet file or folder of files at `path`, with the schema of what is there."""
    schema = spark.read.option("recursiveFileLookup", True).parquet(path).schema
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    if fs.getFileStatus(jpath).isDirectory():
        return reader.option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).parquet(path)
    return reader.option("pathGlobFilter", jpath.getName()).parquet(jpath.getParent().toString())


def usage_counters(events: DataFrame, at: str, keys: list[str], window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Requests per window and keys; rows later than `late` behind the newest are dropped, and state is kept no longer than that."""
    stamped = events.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late)
    return stamped.groupBy(F.window("_at", window).alias("w"), *keys).agg(F.count("*").alias("requests")).select(F.col("w.start").alias("start"), *keys, "requests")


class Versions:
    """Versions of a table under `path`, one a batch: batch=N is complete once its mark is there."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._at(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def batches(self) -> list[int]:
        if not self._fs.exists(self._at(self.path)):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at(self.path))]
        return sorted(int(n.removeprefix("batch=")) for n in names if n.startswith("batch=") and self._fs.exists(self._at(f"{self.path}/{n}/_SUCCESS")))

    def read(self, before: int | None = None) -> DataFrame | None:
        known = [b for b in self.batches() if before is None or b < before]
        return self.spark.read.parquet(f"{self.path}/batch={known[-1]}") if known else None

    def write(self, df: DataFrame, batch: int, keep: int = 2) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/batch={batch}")
        for b in self.batches()[:-keep]:
            self._fs.delete(self._at(f"{self.path}/batch={b}"), True)


def additive_upserts(stream: DataFrame, keys: list[Column], measures: dict[str, Column], path: str, checkpoint: str):
    """Sums per key of each micro-batch are added to the table at `path`: a new version a batch. Keys that come late only add to their old row."""
    spark = stream.sparkSession
    versions = Versions(spark, path)

    def step(batch: DataFrame, number: int) -> None:
        new = batch.groupBy(*keys).agg(*[m.alias(n) for n, m in measures.items()])
        old = versions.read(before=number)
        names = [c for c in new.columns if c not in measures]
        both = new if old is None else old.unionByName(new)
        versions.write(both.groupBy(*names).agg(*[F.sum(n).alias(n) for n in measures]), number)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def resumable_ingest(stream: DataFrame, facts: Callable[[DataFrame], DataFrame], path: str, checkpoint: str):
    """Facts of each micro-batch, written under the batch's number: a batch that runs again replaces its own files."""

    def step(batch: DataFrame, number: int) -> None:
        facts(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def watch(stream: DataFrame, snapshot: Callable[[DataFrame], DataFrame], deliver: Callable[[DataFrame, int], None], path: str, checkpoint: str):
    """Each micro-batch becomes a snapshot that is compared with the one before; the first is the baseline and delivers nothing, an empty one changes nothing. Snapshots lie at `path`, so a restart goes on from the last."""
    from ..operators.facts import snapshot_diff

    versions = Versions(stream.sparkSession, path)

    def step(batch: DataFrame, number: int) -> None:
        now = snapshot(batch)
        if now.isEmpty():
            return
        old = versions.read(before=number)
        versions.write(now, number, keep=3)
        if old is not None:
            deliver(snapshot_diff(old, versions.read(before=number + 1)), number)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
