"""Canonical ids from undirected links: connected components by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..runtime import drop_materialized, materialize


def undirected(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Each pair once, the smaller end first, without loops."""
    return links.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).filter("a <> b").distinct()


def canonical_ids(links: DataFrame) -> DataFrame:
    """(id, canonical): every id in links (a, b) with the least id it is connected to.

    Each round points every node's larger neighbours, then every node's smaller ones, at the least neighbour; both are aggregations and equi-joins
    over the links, so no component is ever gathered in one place. Rounds are written to the shared folder and go on until the links stay the same.
    """
    edges = materialize(undirected(links).select(F.col("b").alias("u"), F.col("a").alias("v")), "links")
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u")
        new = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        new = materialize(new, "links")
        same = new.count() == edges.count() and new.exceptAll(edges).isEmpty()
        drop_materialized(edges)
        edges = new
        if same:
            break
    return edges.select(F.col("u").alias("id"), F.col("v").alias("canonical")).union(edges.select(F.col("v").alias("id"), F.col("v").alias("canonical")).distinct())
