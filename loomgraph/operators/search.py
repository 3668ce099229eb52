"""Lexical, vector and hybrid ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.text import cosine, lexical_score


def lexical_rank(df: DataFrame, key: str, text: str, query: list[str], k: int = 50) -> DataFrame:
    """The k best texts by lexical score; ties by key. One bounded top-k, no global sort."""
    # most texts hold none of the words and need not be cut into words at all
    some = F.lit(False)
    for q in query:
        some = some | F.lower(text).contains(q)
    return df.filter(some).select(key, lexical_score(query, F.col(text)).alias("score")).filter("score > 0").orderBy(F.desc("score"), key).limit(k)


def vector_rank(df: DataFrame, key: str, vector: str, query: list[float], k: int = 50) -> DataFrame:
    q = F.array(*[F.lit(float(x)) for x in query])
    return df.select(key, cosine(F.col(vector), q).alias("score")).orderBy(F.desc("score"), key).limit(k)


def reciprocal_rank_fusion(legs: list[DataFrame], key: str, entity: DataFrame | None, k: int = 10, constant: int = 60) -> DataFrame:
    """Sum of 1 / (constant + rank) over the legs (each small: a top-k); an entity counts by its best row where rows map to entities."""
    scored = None
    for leg in legs:
        one = leg.select(key, (1.0 / (constant + F.row_number().over(Window.orderBy(F.desc("score"), key)))).alias("r"))
        scored = one if scored is None else scored.unionByName(one)
    rows = scored.groupBy(key).agg(F.sum("r").alias("score"))
    if entity is not None:
        rows = rows.join(entity, key).groupBy("entity").agg(F.max("score").alias("score")).withColumnRenamed("entity", key)
    return rows.orderBy(F.desc("score"), key).limit(k)


def keyset_page(df: DataFrame, keys: list[str], after: tuple | None, size: int) -> DataFrame:
    """The next `size` rows in order of the keys, strictly after the given ones: a range filter that reaches the scan, and a bounded sort."""
    if after is not None:
        condition = F.lit(False)
        for i, k in enumerate(keys):
            step = F.col(k) > after[i]
            for j in range(i):
                step = (F.col(keys[j]) == after[j]) & step
            condition = condition | step
        df = df.filter(condition)
    return df.orderBy(*keys).limit(size)


def best_per_group(df: DataFrame, group: list[str], order: list) -> DataFrame:
    """The first row of each group in the given order."""
    return df.select("*", F.row_number().over(Window.partitionBy(*group).orderBy(*order)).alias("_n")).filter("_n = 1").drop("_n")


def hash_sample(df: DataFrame, key: str, k: int, seed: int = 0) -> DataFrame:
    """k rows that depend on the key and seed only, not on partitions or order."""
    return df.orderBy(F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed)))), key).limit(k)
