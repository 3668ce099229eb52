"""The graph's logical schema: one row a fact, typed by kind and datatype, and identifiers as Column expressions.

A quads frame has g, s, p, o (lexical), kind (`iri` or `literal`) and dtype (short name of the XSD type, null for IRIs). Graphs built from
tables stay virtual: they are unions of projections with constant predicates, so a filter on `p` removes all other branches at
planning time and the scan reads only the columns of the branches that are left.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

QUAD = ["g", "s", "p", "o", "kind", "dtype"]
TYPE, LABEL, SUBCLASS, SAME = "rdf:type", "rdfs:label", "rdfs:subClassOf", "owl:sameAs"


def safe_id(c: Column) -> Column:
    """A value as the last segment of an entity's identifier: at most 200 of letters, digits, `_` and `-`; `unknown` if empty."""
    t = F.substring(F.regexp_replace(F.trim(c.cast("string")), "[^a-zA-Z0-9_-]", "_"), 1, 200)
    return F.when(t.isNull() | (t == ""), "unknown").otherwise(t)


def entity(type_name: str, key: Column) -> Column:
    return F.concat(F.lit(f"entities/{type_name}/"), safe_id(key))


def fact_id(s: Column, p: Column, o: Column) -> Column:
    return F.sha1(F.concat_ws("|", s, p, o))


@dataclass
class EntityMap:
    """How rows of a frame become entities: key column, label, attributes (name -> column, datatype), edges (name -> target type, column)."""

    type_name: str
    key: str
    label: str | None = None
    attributes: dict[str, tuple[str, str]] = field(default_factory=dict)
    edges: dict[str, tuple[str, str]] = field(default_factory=dict)
    types: tuple[str, ...] = ()


@dataclass(frozen=True)
class Branch:
    """One projection of a source with a constant predicate: object, kind and datatype, and what the object is (a type of entity, a class, or null for literals)."""

    p: str
    o: Column
    kind: str
    dtype: str | None
    where: Column | None
    target: str | None


@dataclass(frozen=True)
class Source:
    """A frame read through an entity map; `unique` says that no two of its rows have one identifier."""

    df: DataFrame
    map: EntityMap
    graph: str = "kg"
    unique: bool = False

    @property
    def subject(self) -> Column:
        return entity(self.map.type_name, F.col(self.map.key))

    def branches(self, classes: dict[str, set[str]] | None = None) -> list[Branch]:
        """All predicates of the source; `classes` adds the classes above each type."""
        m = self.map
        types = list(dict.fromkeys(c for t in (m.type_name, *m.types) for c in (t, *sorted((classes or {}).get(t, ())))))
        out = [Branch(TYPE, F.lit(f"types/{t}"), "iri", None, None, f"types/{t}") for t in types]
        if m.label:
            out.append(Branch(LABEL, F.col(m.label).cast("string"), "literal", "string", F.col(m.label).isNotNull(), None))
        out += [Branch(f"attrs/{n}", F.col(c).cast("string"), "literal", t, F.col(c).isNotNull(), None) for n, (c, t) in m.attributes.items()]
        out += [Branch(f"onto/{n}", entity(t, F.col(c)), "iri", None, F.col(c).isNotNull(), t) for n, (t, c) in m.edges.items()]
        return out


class VirtualGraph:
    """A graph over tables that is never written: sources with their predicates, from which a pattern takes only those that can match it."""

    def __init__(self, sources: list[Source], classes: dict[str, set[str]] | None = None, spark: SparkSession | None = None):
        self.sources, self.classes = sources, classes or {}
        self.branches = [s.branches(self.classes) for s in sources]
        self.spark = spark or sources[0].df.sparkSession

    def only(self, graphs: list[str]) -> VirtualGraph:
        return VirtualGraph([s for s in self.sources if s.graph in graphs], self.classes, self.spark)

    def with_classes(self, above: dict[str, set[str]]) -> VirtualGraph:
        """The graph in which an instance of a class is one of the classes above it, too."""
        return VirtualGraph(self.sources, {t: self.classes.get(t, set()) | above.get(t, set()) for t in {*self.classes, *above}}, self.spark)

    def quads(self, predicates: list[str] | None = None) -> DataFrame:
        """The facts as a frame, of some predicates only if asked."""
        parts = []
        for source, branches in zip(self.sources, self.branches):
            for b in branches:
                if predicates is None or b.p in predicates:
                    base = source.df if b.where is None else source.df.filter(b.where)
                    parts.append(base.select(F.lit(source.graph).alias("g"), source.subject.alias("s"), F.lit(b.p).alias("p"), b.o.alias("o"), F.lit(b.kind).alias("kind"), F.lit(b.dtype).cast("string").alias("dtype")))
        return union(parts) if parts else self.spark.createDataFrame([], ", ".join(f"{c} string" for c in QUAD))


def quads_of(df: DataFrame, m: EntityMap, graph: str = "kg") -> DataFrame:
    """Facts of an entity map over a frame: type, label, attributes and edges, one projection each."""
    return VirtualGraph([Source(df, m, graph)]).quads()


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def classes(spark, pairs: list[tuple[str, str | None]], graph: str = "ontology") -> DataFrame:
    """Facts of a class tree given as (class, parent)."""
    rows = [(graph, f"types/{c}", TYPE, "rdfs:Class", "iri", None) for c, _ in pairs]
    rows += [(graph, f"types/{c}", LABEL, c, "literal", "string") for c, _ in pairs]
    rows += [(graph, f"types/{c}", SUBCLASS, f"types/{p}", "iri", None) for c, p in pairs if p]
    return spark.createDataFrame(rows, "g string, s string, p string, o string, kind string, dtype string")


def closure(edges: DataFrame) -> DataFrame:
    """(src, dst, depth >= 1) of all pairs joined by a path in edges (src, dst), least depth; cycles end.

    Semi-naive iteration: each round joins only the pairs that are new, until there are none; every round is written to the shared folder.
    """
    step = edges.select("src", "dst").filter("src IS NOT NULL AND dst IS NOT NULL").distinct()
    return _spread(step, step.withColumn("depth", F.lit(1)))


def reachable(edges: DataFrame, start: str) -> DataFrame:
    """The rows (src, dst, depth) of closure(edges) whose src is `start`; only what can be reached from there is ever joined."""
    step = edges.select("src", "dst").filter("src IS NOT NULL AND dst IS NOT NULL").distinct()
    return _spread(step, step.filter(F.col("src") == start).withColumn("depth", F.lit(1)))


def _spread(step: DataFrame, first: DataFrame) -> DataFrame:
    from .runtime import drop_materialized, materialize

    known = materialize(first, "closure")
    new, depth = known, 1
    while True:
        depth += 1
        reached = new.select("src", F.col("dst").alias("mid")).join(step.select(F.col("src").alias("mid"), "dst"), "mid").select("src", "dst").distinct()
        fresh = materialize(reached.join(known.select("src", "dst"), ["src", "dst"], "left_anti").withColumn("depth", F.lit(depth)), "closure")
        if fresh.isEmpty():
            drop_materialized(fresh)
            return known
        grown = materialize(known.unionByName(fresh), "closure")
        for old in {id(x): x for x in (known, new)}.values():
            drop_materialized(old)
        known, new = grown, fresh
