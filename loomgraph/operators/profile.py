"""Statistics of tables and graphs: column profiles, functional dependencies, coverage, edges, drift."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame, functions as F

from ..model import LABEL, TYPE, VirtualGraph

_DATE = r"^\d{4}-\d{1,2}-\d{1,2}([ T].*)?$|^\d{1,2}/\d{1,2}/\d{2,4}$"
_CODE = r"^[A-Za-z0-9][A-Za-z0-9._/-]*$"


def cells(df: DataFrame, columns: list[str]) -> DataFrame:
    """(name, value) of every cell, trimmed; empty ones are null."""
    return df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.when(F.trim(F.col(c).cast("string")) != "", F.trim(F.col(c).cast("string"))).alias("value")) for c in columns])))


def column_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row a column: completeness, distinct values, uniqueness, cardinality ratio, shape and flags.

    All columns are profiled in one pass: cells are counted per (column, value) with map-side combining, so the second aggregation sees
    each distinct value once.
    """
    counts = cells(df, columns).groupBy("name", "value").agg(F.count("*").alias("n"))
    share = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0)) / F.sum(F.when(F.col("value").isNotNull(), F.col("n")).otherwise(0))
    v = F.col("value")
    p = counts.groupBy("name").agg(
        F.sum("n").alias("rows"),
        F.sum(F.when(v.isNotNull(), F.col("n")).otherwise(0)).alias("filled"),
        F.count("value").alias("distinct"),
        share(v.rlike(_DATE)).alias("dates"),
        share(v.try_cast("double").isNotNull()).alias("numbers"),
        share(v.rlike(_CODE)).alias("codes"),
        share(v.rlike(r"\s")).alias("spaced"),
        (F.sum(F.length(v) * F.col("n")) / F.sum(F.when(v.isNotNull(), F.col("n")).otherwise(0))).alias("avg_len"),
    )
    shape = (
        F.when(F.col("filled") == 0, "empty").when(F.col("dates") > 0.8, "date").when(F.col("numbers") > 0.8, "number")
        .when((F.col("codes") > 0.9) & (F.col("avg_len") <= 24), "code").when((F.col("spaced") > 0.5) & (F.col("avg_len") > 25), "text").otherwise("label")
    )
    complete, unique = F.col("filled") / F.col("rows"), F.when(F.col("filled") > 0, F.col("distinct") / F.col("filled")).otherwise(0.0)
    ratio = F.col("distinct") / F.col("rows")
    return p.select(
        "name", "rows", "distinct", complete.alias("completeness"), unique.alias("uniqueness"), ratio.alias("card_ratio"), shape.alias("shape"),
        ((complete > 0.99) & (unique > 0.99)).alias("is_key"), (complete < 0.98).alias("incomplete"), ((F.col("distinct") > 1) & (ratio < 0.5) & (F.col("filled") > F.col("distinct"))).alias("repeats"),
    )


def text_candidacy(df: DataFrame, columns: list[str], free_text: float = 120.0) -> DataFrame:
    """(name, candidacy) by values alone: columns shaped like text are free text if long on average, else ambiguous; all others are none."""
    c = cells(df, columns).filter("value IS NOT NULL")
    v = F.col("value")
    share = lambda x: F.avg(F.when(x, 1).otherwise(0))
    p = c.groupBy("name").agg(share(v.rlike(_DATE)).alias("dates"), share(v.try_cast("double").isNotNull()).alias("numbers"), share(v.rlike(_CODE)).alias("codes"), share(v.rlike(r"\s")).alias("spaced"), F.avg(F.length(v)).alias("avg_len"))
    text = (F.col("dates") <= 0.8) & (F.col("numbers") <= 0.8) & ~((F.col("codes") > 0.9) & (F.col("avg_len") <= 24)) & (F.col("spaced") > 0.5) & (F.col("avg_len") > 25)
    return p.select("name", F.when(text & (F.col("avg_len") >= free_text), "free_text").when(text, "ambiguous").otherwise("none").alias("candidacy"))


def functional_dependencies(df: DataFrame, columns: list[str], max_distinct: int = 400, min_support: int = 5, near_unique: float = 0.95) -> DataFrame:
    """(determinant, dependent) among columns of at most `max_distinct` values: every filled determinant stands with one dependent.

    All pairs are checked in one pass: rows explode into pairs of columns, which are counted per pair of values with map-side combining.
    """
    few = [r[0] for r in cells(df, columns).groupBy("name").agg(F.count_distinct("value").alias("d")).filter(F.col("d").between(1, max_distinct)).collect()]
    pairs = list(combinations([c for c in columns if c in few], 2))
    if not pairs:
        return df.sparkSession.createDataFrame([], "determinant string, dependent string")
    text = lambda c: F.when(F.trim(F.col(c).cast("string")) != "", F.trim(F.col(c).cast("string")))
    met = df.select(F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), text(a).alias("x"), text(b).alias("y")) for a, b in pairs]))).filter("x IS NOT NULL AND y IS NOT NULL")
    met = met.groupBy("a", "b", "x", "y").agg(F.count("*").alias("n"))

    def one_way(left: str, key: str, other: str) -> DataFrame:
        per = met.groupBy("a", "b", key).agg(F.count("*").alias("partners"), F.sum("n").alias("n"))
        return per.groupBy("a", "b").agg(F.max("partners").alias("most"), F.count("*").alias("keys"), F.sum("n").alias("support")).select("a", "b", F.lit(left).alias("side"), "most", "keys", "support")

    both = one_way("a", "x", "y").unionByName(one_way("b", "y", "x"))
    wide = both.groupBy("a", "b").agg(*[F.max(F.when(F.col("side") == s, F.col(c))).alias(f"{c}_{s}") for s in "ab" for c in ("most", "keys", "support")])
    ok = lambda s: (F.col(f"most_{s}") == 1) & (F.col(f"keys_{s}") < near_unique * F.col(f"support_{s}"))
    base = wide.filter((F.col("support_a") >= min_support) & (F.col("keys_a") > 1) & (F.col("keys_b") > 1))
    return base.filter(ok("a")).select(F.col("a").alias("determinant"), F.col("b").alias("dependent")).unionByName(base.filter(ok("b")).select(F.col("b").alias("determinant"), F.col("a").alias("dependent")))


def primary_types(quads: DataFrame) -> DataFrame:
    """(s, type): the least type of each entity, so that an entity of several types counts once."""
    return quads.filter(F.col("p") == TYPE).groupBy("s").agg(F.min("o").alias("type"))


def type_counts(quads: DataFrame) -> DataFrame:
    return quads.filter(F.col("p") == TYPE).groupBy(F.col("o").alias("type")).agg(F.count_distinct("s").alias("entities"))


def graph_statistics(quads: DataFrame) -> DataFrame:
    """(type, p) of the whole graph: entities that have it, facts, literal and edge facts, coverage in percent."""
    typed = quads.filter(~F.col("p").isin(TYPE, LABEL)).join(primary_types(quads), "s")
    per = typed.groupBy("type", "p").agg(F.count_distinct("s").alias("entities"), F.count("*").alias("facts"), F.count_if(F.col("kind") == "iri").alias("edges"))
    totals = primary_types(quads).groupBy("type").agg(F.count("*").alias("of"))
    return per.join(totals, "type").select("type", "p", "entities", "facts", "edges", F.round(F.col("entities") / F.col("of") * 100, 1).alias("coverage"))


def table_statistics(graph: VirtualGraph) -> DataFrame:
    """graph_statistics of a virtual graph whose sources have one row an entity and a type each: one aggregation a table, without any join."""
    parts = []
    for source, branches in zip(graph.sources, graph.branches):
        own = [b for b in branches if b.p not in (TYPE, LABEL)]
        if not source.unique or not own:
            continue
        counts = source.df.agg(F.count("*").alias("_of"), *[(F.count("*") if b.where is None else F.count_if(b.where)).alias(f"_{i}") for i, b in enumerate(own)])
        rows = F.array(*[F.struct(F.lit(f"types/{min([source.map.type_name, *source.map.types])}").alias("type"), F.lit(b.p).alias("p"), F.col(f"_{i}").alias("entities"), F.col(f"_{i}").alias("facts"), (F.col(f"_{i}") if b.kind == "iri" else F.lit(0).cast("long")).alias("edges"), F.round(F.col(f"_{i}") / F.col("_of") * 100, 1).alias("coverage")) for i, b in enumerate(own)])
        parts.append(counts.select(F.inline(rows)).filter("facts > 0"))
    return reduce(lambda a, b: a.unionByName(b), parts)


def table_edges(graph: VirtualGraph, min_support: int = 1) -> DataFrame:
    """type_edges of a virtual graph whose sources have one row an entity and a type each: every edge's table meets the table it points at, no other is read."""
    first = lambda s: f"types/{min([s.map.type_name, *s.map.types])}"
    parts = []
    for source, branches in zip(graph.sources, graph.branches):
        for b in branches:
            if b.p == TYPE or b.kind != "iri":
                continue
            edges = (source.df if b.where is None else source.df.filter(b.where)).groupBy(b.o.alias("o")).agg(F.count("*").alias("k"))
            for other in graph.sources:
                if other.map.type_name == b.target:
                    met = edges.join(other.df.select(other.subject.alias("o")), "o")
                    parts.append(met.agg(F.sum("k").alias("n")).select(F.lit(first(source)).alias("source"), F.lit(b.p).alias("p"), F.lit(first(other)).alias("target"), F.coalesce("n", F.lit(0)).alias("n")))
    return reduce(lambda a, b: a.unionByName(b), parts).filter(F.col("n") >= min_support)


def type_edges(quads: DataFrame, min_support: int = 1) -> DataFrame:
    """(source, p, target, n): edges between types."""
    t = primary_types(quads)
    e = quads.filter((F.col("kind") == "iri") & (F.col("p") != TYPE)).select("s", "p", "o")
    e = e.join(t.withColumnRenamed("type", "source"), "s").join(t.select(F.col("s").alias("o"), F.col("type").alias("target")), "o")
    return e.groupBy("source", "p", "target").agg(F.count("*").alias("n")).filter(F.col("n") >= min_support)


def drift_split(stats: DataFrame, core: list[str], min_coverage: float = 20.0, min_support: int = 5) -> DataFrame:
    """Each (type, p) as declared or quarantined: core predicates always stay, others need coverage and support."""
    keep = F.col("p").isin(*core) if core else F.lit(False)
    return stats.select("type", "p", F.when(keep | ((F.col("coverage") >= min_coverage) & (F.col("entities") >= min_support)), "declared").otherwise("quarantined").alias("state"))


def enum_values(quads: DataFrame, max_values: int = 25) -> DataFrame:
    """Literal predicates with their count of distinct values, and the values where there are few."""
    v = quads.filter("kind = 'literal'").select("p", "o").distinct()
    counts = v.groupBy("p").agg(F.count("*").alias("n_values"))
    # values are gathered only of predicates that are known to have few
    few = v.join(counts.filter(F.col("n_values") <= max_values).select("p"), "p", "left_semi").groupBy("p").agg(F.array_join(F.array_sort(F.collect_list("o")), "|").alias("listed"))
    return counts.join(few, "p", "left").select("p", "n_values", "listed")


def content_hash(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Digest of the sorted distinct trimmed values of each key."""
    return df.groupBy(*keys).agg(F.sha2(F.array_join(F.array_sort(F.collect_set(F.trim(F.col(value)))), "\n\n"), 256).alias("hash"))
