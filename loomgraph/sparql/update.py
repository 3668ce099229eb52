"""Updates of a graph: INSERT DATA, DELETE DATA, DELETE WHERE and DELETE/INSERT ... WHERE. A graph is a frame of quads; an update gives the graph after it.

Graphs are sets: what is there already isn't inserted again. Names of graphs in GRAPH blocks hold for the facts inside, others go to the default graph.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..model import QUAD, VirtualGraph
from ..runtime import materialize
from .compiler import Engine, Solutions
from .parser import Parser, SparqlError

_KEYS = ["g", "s", "p", "o", "kind"]


class Updater(Parser):
    """Parses and applies one update or several, separated by semicolons."""

    def __init__(self, text: str, graph: str = "kg"):
        super().__init__(text)
        self.default = graph

    def apply(self, quads: DataFrame | VirtualGraph, now: Column | None = None) -> DataFrame:
        quads = quads.quads() if isinstance(quads, VirtualGraph) else quads
        while self.word("PREFIX"):
            self.take()
            name = self.take()
            self.prefixes[name.rstrip(":")] = self.take()[1:-1]
        while self.peek()[0] != "end":
            quads = self.one(quads.select(*QUAD), now)
            if not self.accept(";"):
                break
        if self.peek()[0] != "end":
            raise SparqlError(f"unexpected {self.peek()[1]!r}")
        return quads

    def one(self, quads: DataFrame, now: Column | None) -> DataFrame:
        if self.accept_word("INSERT"):
            if self.accept_word("DATA"):
                return self.inserted(quads, self.facts(quads, self.group(), None))
            return self.where(quads, None, self.group(), now)
        if not self.accept_word("DELETE"):
            raise SparqlError("INSERT or DELETE expected")
        if self.accept_word("DATA"):
            return self.deleted(quads, self.facts(quads, self.group(), None))
        if self.accept_word("WHERE"):
            pattern = self.group()
            return self.deleted(quads, self.facts(quads, pattern, Engine(quads, now).group(pattern, quads)))
        gone = self.group()
        new = self.group() if self.accept_word("INSERT") else None
        return self.where(quads, gone, new, now)

    def where(self, quads: DataFrame, gone: list | None, new: list | None, now: Column | None) -> DataFrame:
        if not self.accept_word("WHERE"):
            raise SparqlError("WHERE expected")
        found = Engine(quads, now).group(self.group(), quads)
        # both templates are filled from the graph as it was; written once, since it is read twice
        rows = Solutions(materialize(found.df, "update"), found.variables, found.maybe)
        after = quads if gone is None else self.deleted(quads, self.facts(quads, gone, rows))
        return after if new is None else self.inserted(after, self.facts(quads, new, rows))

    def facts(self, quads: DataFrame, template: list, rows: Solutions | None) -> DataFrame:
        """Quads of a template for each solution; those with an unbound variable are left out."""
        triples = [(self.default, x) for x in template if x[0] == "triple"] + [(x[1][1], y) for x in template if x[0] == "graph" for y in x[2] if y[0] == "triple"]
        base = quads.sparkSession.range(1) if rows is None else rows.df
        known = set() if rows is None else set(rows.variables)

        def of(term) -> tuple[Column, Column]:
            if term[0] == "var":
                if term[1] not in known:
                    raise SparqlError(f"?{term[1]} is not bound")
                return F.col(term[1]), F.col(f"{term[1]}~t")
            return F.lit(term[1]), F.lit("iri" if term[0] == "iri" else term[2] or "string")

        parts = []
        for g, (_, s, p, o) in triples:
            if p[0] not in ("p", "v"):
                raise SparqlError("a template takes plain predicates only")
            (sc, _), (oc, ot) = of(s), of(o)
            pc = F.lit(p[1]) if p[0] == "p" else of(("var", p[1]))[0]
            iri = ot == "iri"
            parts.append(base.select(F.lit(g).alias("g"), sc.alias("s"), pc.alias("p"), oc.alias("o"), F.when(iri, "iri").otherwise("literal").alias("kind"), F.when(~iri, ot).alias("dtype")))
        if not parts:
            return quads.limit(0)
        return reduce(lambda a, b: a.unionByName(b), parts).filter("s IS NOT NULL AND p IS NOT NULL AND o IS NOT NULL").distinct()

    @staticmethod
    def inserted(quads: DataFrame, facts: DataFrame) -> DataFrame:
        return quads.unionByName(facts.join(quads.select(*_KEYS), _KEYS, "left_anti").select(*QUAD))

    @staticmethod
    def deleted(quads: DataFrame, facts: DataFrame) -> DataFrame:
        return quads.join(facts.select(*_KEYS).distinct(), _KEYS, "left_anti").select(*QUAD)


def update(quads: DataFrame | VirtualGraph, text: str, graph: str = "kg", now: Column | None = None) -> DataFrame:
    """The graph after an update."""
    return Updater(text, graph).apply(quads, now)
