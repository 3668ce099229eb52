"""Schemas, layers and rows: what ingestion and the type catalogue need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..model import closure


def shadowed(layers: DataFrame, name: str, rank: str) -> DataFrame:
    """The first visible definition of each name: that of the least rank."""
    return layers.select("*", F.row_number().over(Window.partitionBy(name).orderBy(rank)).alias("_n")).filter("_n = 1").drop("_n")


def inherited(settings: DataFrame, tree: DataFrame, cls: str, value: str) -> DataFrame:
    """(class, value): a class's own setting or else that of its nearest ancestor. tree: (src, dst) class to parent."""
    up = closure(tree).select(F.col("src").alias("c"), F.col("dst").alias("a"), "depth")
    nodes = tree.select(F.col("src").alias("c")).union(tree.select("dst")).union(settings.select(cls)).distinct()
    every = nodes.select("c", F.col("c").alias("a"), F.lit(0).alias("depth")).unionByName(up)
    met = every.join(settings.select(F.col(cls).alias("a"), F.col(value).alias("v")), "a")
    return met.groupBy("c").agg(F.min_by("v", "depth").alias(value)).withColumnRenamed("c", cls)


def labels_of(df: DataFrame, column: str, labels: DataFrame) -> DataFrame:
    """With `label`: the entity's label, or the last segment of its id."""
    l = labels.select(F.col("s").alias("_s"), F.col("o").alias("_l"))
    return df.join(l, df[column] == l["_s"], "left").withColumn("label", F.coalesce("_l", F.regexp_extract(column, "([^/#]*)$", 1))).drop("_s", "_l")


def consolidate(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One row a key: the most frequent filled value of each column, the least among equals.

    Values are counted per (key, column, value) with map-side combining, so no group of rows is gathered.
    """
    cells = df.select(key, F.inline(F.array(*[F.struct(F.lit(c).alias("c"), F.when(F.trim(F.col(c).cast("string")) != "", F.trim(F.col(c).cast("string"))).alias("v")) for c in columns])))
    counts = cells.groupBy(key, "c", "v").agg(F.count("v").alias("n"))
    best = counts.filter("v IS NOT NULL").groupBy(key, "c").agg(F.min_by("v", F.struct(-F.col("n"), F.col("v"))).alias("v"))
    keys = df.select(key).distinct()
    wide = best.groupBy(key).agg(*[F.max(F.when(F.col("c") == c, F.col("v"))).alias(c) for c in columns])
    return keys.join(wide, key, "left")


def deduplicated(df: DataFrame, key: Column, order: list) -> DataFrame:
    """The first row of each key; rows without a key all stay."""
    keyed = df.withColumn("_k", key)
    first = keyed.filter("_k IS NOT NULL").select("*", F.row_number().over(Window.partitionBy("_k").orderBy(*order)).alias("_n")).filter("_n = 1").drop("_n", "_k")
    return first.unionByName(keyed.filter("_k IS NULL").drop("_k"))


def redact(df: DataFrame, tags: dict[str, str], mask: str = "***") -> DataFrame:
    """Columns tagged secret are dropped, those tagged pii masked."""
    keep = [c for c in df.columns if tags.get(c) != "secret"]
    return df.select(*[F.when(F.col(c).isNotNull(), F.lit(mask)).alias(c) if tags.get(c) == "pii" else F.col(c) for c in keep])


def majority(votes: DataFrame, item: str, vote: str) -> DataFrame:
    """(item, accepted): more than half of the votes are for it."""
    return votes.groupBy(item).agg((F.count_if(F.col(vote)) * 2 > F.count("*")).alias("accepted"), F.count("*").alias("n_votes"))


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of the Wilson interval of a share."""
    p = hits / n
    centre, half = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return (centre - half) / (1 + z * z / n), (centre + half) / (1 + z * z / n)


def within_tolerance(got: Column, want: Column, share: float) -> Column:
    return F.when(want == 0, got == 0).otherwise(F.abs(got - want) <= share * F.abs(want))
