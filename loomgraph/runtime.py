"""Session-level helpers every operator shares: tables, shared folder, materialisation."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The parquet table `name` under `root`."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); one of our own only where it is unset on a single machine, as in tests."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = os.path.join(tempfile.gettempdir(), f"loomgraph-{os.getpid()}")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


#: Folders that this process has materialised and that may be removed once their results are read.
_WRITTEN: list[str] = []


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes `df` as parquet into the shared folder and reads it back, which cuts lineage and survives lost executors. The files stay until release(), since the result may be read late."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_materialized(df: DataFrame) -> None:
    """Removes the files behind a frame made by materialize(); only those inside the shared folder."""
    spark = df.sparkSession
    root = shared_dir(spark)
    jvm = spark.sparkContext._jvm
    for folder in {os.path.dirname(f) for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        if path.toUri().getPath().startswith(jvm.org.apache.hadoop.fs.Path(root).toUri().getPath() + "/"):
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> int:
    """Removes all that this process has materialised, and says how many folders there were; to be called when the results of its queries have been read or written."""
    jvm, n = spark.sparkContext._jvm, 0
    while _WRITTEN:
        path = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        n += path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return n


def bounded_rows(df: DataFrame, limit: int, what: str) -> list:
    """Rows of a table that may go to every task because its size is bounded; ValueError beyond the bound."""
    rows = df.take(limit + 1)
    if len(rows) > limit:
        raise ValueError(f"{what} has more than {limit} rows and cannot be sent to every task")
    return rows


def unused_name(taken: list[str], base: str) -> str:
    """`base`, or `base` with underscores put in front until no column in `taken` bears it (case-insensitively)."""
    names = {t.lower() for t in taken}
    while base.lower() in names:
        base = "_" + base
    return base


def computed(df: DataFrame, keep: list, **columns: Column) -> DataFrame:
    """`keep` and the new `columns`, each evaluated once a row.

    The generator between the expressions and what is built on them stops the optimizer from copying a costly expression
    into every filter and column that refers to it.
    """
    return df.select(*keep, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))
