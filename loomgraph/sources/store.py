"""A graph that is written: versions of a frame of quads in a folder, each complete and never changed. A version is there once its mark is, so a lost job leaves nothing half-written to read."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession

from ..model import QUAD
from ..sparql.update import update


class GraphStore:
    """quads under `path`/version=N. Written by predicate, so that a pattern's constant predicate prunes folders."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._of = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._of(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        if not self._fs.exists(self._of(self.path)):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._of(self.path))]
        return sorted(int(n.removeprefix("version=")) for n in names if n.startswith("version=") and self._fs.exists(self._of(f"{self.path}/{n}/_SUCCESS")))

    def read(self, version: int | None = None) -> DataFrame:
        at = version if version is not None else self.versions()[-1]
        return self.spark.read.schema("g string, s string, o string, kind string, dtype string, p string").parquet(f"{self.path}/version={at}").select(*QUAD)

    def write(self, quads: DataFrame) -> int:
        """A new version; returns its number. The files are written aside and moved in one step."""
        number = (self.versions() or [0])[-1] + 1
        aside = f"{self.path}/.{uuid.uuid4().hex}"
        # rebalanced by predicate: small ones share files, one that holds most facts is split
        quads.select(*QUAD).hint("rebalance", "p").write.partitionBy("p").parquet(aside)
        if not self._fs.rename(self._of(aside), self._of(f"{self.path}/version={number}")):
            raise OSError(f"version {number} could not be put in place")
        return number

    def update(self, text: str, graph: str = "kg", now: Column | None = None) -> int:
        return self.write(update(self.read(), text, graph, now))

    def drop(self, keep: int = 2) -> None:
        """Removes all but the newest `keep` versions."""
        for v in self.versions()[:-keep]:
            self._fs.delete(self._of(f"{self.path}/version={v}"), True)
