"""A chunk index beside its source: replace a document, find what is missing, stale or left over, hand out pending work."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def replace_documents(index: DataFrame, chunks: DataFrame, keys: list[str]) -> DataFrame:
    """The index with all chunks of the incoming documents in place of those that were there."""
    return index.join(chunks.select(*keys).distinct(), keys, "left_anti").unionByName(chunks, allowMissingColumns=True)


def reconcile(index: DataFrame, source: DataFrame, keys: list[str], hash_col: str, complete: bool = True) -> DataFrame:
    """(keys, action): write what is missing or has another hash, delete what the source no longer holds (only after a complete scan)."""
    i = index.select(*keys, F.col(hash_col).alias("_ih")).distinct()
    s = source.select(*keys, F.col(hash_col).alias("_sh")).distinct()
    both = i.withColumn("_in", F.lit(True)).join(s.withColumn("_src", F.lit(True)), keys, "full_outer")
    action = F.when(F.col("_in").isNull(), "missing").when(F.col("_src").isNull(), "ghost").when(~F.col("_ih").eqNullSafe(F.col("_sh")), "stale")
    out = both.select(*keys, action.alias("action")).filter("action IS NOT NULL")
    return out if complete else out.filter("action <> 'ghost'")


def pending(index: DataFrame, vector: str, attempts: str, order: list, limit: int, max_attempts: int = 5) -> DataFrame:
    """The next rows without a vector that have not failed too often."""
    return index.filter(F.col(vector).isNull() & (F.coalesce(F.col(attempts), F.lit(0)) < max_attempts)).orderBy(*order).limit(limit)


def capped(df: DataFrame, group: list[str], order: list, cap: int) -> DataFrame:
    """At most `cap` rows a group, the first in order."""
    return df.select("*", F.row_number().over(Window.partitionBy(*group).orderBy(*order)).alias("_n")).filter(F.col("_n") <= cap).drop("_n")


def expand_neighbours(chosen: DataFrame, edges: DataFrame, cap: int) -> DataFrame:
    """Chosen nodes and those one edge away, the chosen first, at most `cap` (a bounded set)."""
    near = edges.join(chosen.select(F.col("node").alias("source")), "source").select(F.col("target").alias("node")).unionByName(edges.join(chosen.select(F.col("node").alias("target")), "target").select(F.col("source").alias("node")))
    all_nodes = chosen.select("node", F.lit(0).alias("hop")).unionByName(near.withColumn("hop", F.lit(1)))
    return all_nodes.groupBy("node").agg(F.min("hop").alias("hop")).orderBy("hop", "node").limit(cap)
