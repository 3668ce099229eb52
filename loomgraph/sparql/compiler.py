"""From the parsed tree to one DataFrame plan.

A solution is a row; variable `v` is the column `v` (lexical text, null if unbound) with its datatype in `v~t` (`iri` for IRIs). Groups become joins on
shared variables, and Catalyst does the rest: filters are pushed into scans, adaptive execution picks the joins.

Over a virtual graph, patterns are matched with the graph's predicates before anything is planned. What a variable can stand for (a type of
entity, a class, a literal) is narrowed by all patterns of its group until nothing changes, so `?x rdfs:label ?l` reads the table of cities only
where an edge says that ?x is a city. All patterns of one subject that one table can answer are one projection of it, without any join.

Where a shared variable may be unbound, bound and unbound rows are joined apart, so that bound ones meet by equality (unbound is compatible with anything).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, functions as F

from ..model import SUBCLASS, TYPE, Branch, Source, VirtualGraph, closure, reachable
from .parser import Parser, Select, SparqlError

_NUMERIC = ("integer", "float", "decimal", "double", "int", "long")


class Solutions:
    """A frame of solutions: bound variables, and those that may be null."""

    def __init__(self, df: DataFrame, variables: list[str], maybe: set[str]):
        self.df, self.variables, self.maybe = df, variables, maybe


class Value:
    """A compiled expression: text and datatype columns, or a plain numeric or boolean column."""

    def __init__(self, text: Column, dtype: Column | None = None, kind: str = "term"):
        self.text, self.dtype, self.kind = text, dtype, kind  # kind: term | number | boolean | string

    def string(self) -> Column:
        return self.text.cast("string")

    def number(self) -> Column:
        return self.text.cast("double") if self.kind == "number" else self.text.try_cast("double")

    def truth(self) -> Column:
        return self.text if self.kind == "boolean" else (self.number() != 0) if self.kind == "number" else (F.lower(self.string()) == "true")


#: What a variable can stand for besides entities of a type and classes.
LITERAL = "literal"
_T = lambda: F.when(F.col("kind") == "iri", "iri").otherwise(F.coalesce("dtype", F.lit("string")))


class Engine:
    """Runs queries over a virtual graph or a frame of quads. now: the instant that NOW() stands for (a Column), injected so that results repeat."""

    def __init__(self, graph: DataFrame | VirtualGraph, now: Column | None = None):
        self.graph, self.now = graph, now
        self.spark = graph.spark if isinstance(graph, VirtualGraph) else graph.sparkSession
        self.functions: dict[str, Callable[..., Column]] = {}
        self.fresh = 0

    def register(self, name: str, fn: Callable[..., Column]) -> None:
        """Adds a function of Columns, callable by its name in any expression."""
        self.functions[name.upper()] = fn

    def query(self, text: str) -> DataFrame:
        q = Parser(text).parse()
        return self.select(q, self.graph)

    # patterns

    def bind(self, rows: DataFrame, terms: list[tuple]) -> Solutions:
        """Solutions of (term, column, datatype column): constants and repeated variables filter, other variables are bound."""
        cols, names, seen = [], [], {}
        for term, column, dtype in terms:
            if term[0] == "var":
                if term[1] in seen:
                    rows = rows.filter(F.col(column) == F.col(seen[term[1]]))
                    continue
                seen[term[1]] = column
                cols += [F.col(column).alias(term[1]), dtype.alias(f"{term[1]}~t")]
                names.append(term[1])
            elif term[0] == "lit" and term[2] in _NUMERIC:
                rows = rows.filter(F.col(column).try_cast("double") == float(term[1]))
            else:
                rows = rows.filter(F.col(column) == term[1])
        return Solutions(rows.select(*cols) if cols else rows.select(F.lit(1).alias("_")), names, set())

    def pattern(self, graph: DataFrame | VirtualGraph, s, p, o, gvar: str | None = None) -> Solutions:
        """One pattern over a frame of quads, or one with a path of any length."""
        if gvar is not None and not isinstance(graph, VirtualGraph) and (p[0] == "v" or self.plain(p)):
            rows = graph if p[0] == "v" else graph.filter(F.col("p").isin(*self.plain(p)))
            rows = rows.select("g", "s", "p", "o", _T().alias("t"))
        elif gvar is not None:
            raise SparqlError("GRAPH with a variable does not take a path here")
        elif p[0] == "v":
            rows = (graph.quads() if isinstance(graph, VirtualGraph) else graph).select("s", "p", "o", _T().alias("t"))
        else:
            rows = self.path(graph, p, s[1] if s[0] == "iri" else None, o[1] if o[0] == "iri" else None)
        terms = [(s, "s", F.lit("iri")), *([(("var", p[1]), "p", F.lit("iri"))] if p[0] == "v" else []), (o, "o", F.col("t"))]
        return self.bind(rows, terms + ([(("var", gvar), "g", F.lit("iri"))] if gvar else []))

    def facts(self, graph: DataFrame | VirtualGraph, names: list[str]) -> DataFrame:
        rows = graph.quads(names) if isinstance(graph, VirtualGraph) else graph.filter(F.col("p").isin(*names))
        return rows.select("s", "o", _T().alias("t"))

    def path(self, graph: DataFrame | VirtualGraph, p, start: str | None = None, end: str | None = None) -> DataFrame:
        """(s, o, t) of a property path. Only what leads from `start` or to `end` need be right where they are given."""
        if names := self.plain(p):
            return self.facts(graph, names)
        if p[0] == "^":
            return self.path(graph, p[1], end, start).filter("t = 'iri'").select(F.col("o").alias("s"), F.col("s").alias("o"), F.lit("iri").alias("t"))
        if p[0] == "/":
            a, b = self.path(graph, p[1], start), self.path(graph, p[2], None, end)
            return a.select("s", F.col("o").alias("m")).join(b.select(F.col("s").alias("m"), "o", "t"), "m").select("s", "o", "t")
        if p[0] == "|":
            return self.path(graph, p[1], start, end).unionByName(self.path(graph, p[2], start, end))
        one = self.path(graph, p[1]).filter("t = 'iri'")
        constant = start if start is not None else end
        if constant is not None:
            same = self.spark.range(1).select(*[F.lit(x).alias(n) for x, n in ((constant, "s"), (constant, "o"), ("iri", "t"))])
        else:
            quads = graph.quads() if isinstance(graph, VirtualGraph) else graph
            nodes = quads.select(F.col("s").alias("n")).union(quads.filter("kind = 'iri'").select("o")).distinct()
            same = nodes.select(F.col("n").alias("s"), F.col("n").alias("o"), F.lit("iri").alias("t"))
        if p[0] == "?":
            return one.unionByName(same).distinct()
        if start is not None:
            reach = reachable(one.select(F.col("s").alias("src"), F.col("o").alias("dst")), start).select(F.col("src").alias("s"), F.col("dst").alias("o"))
        elif end is not None:  # the same, walked backwards
            reach = reachable(one.select(F.col("o").alias("src"), F.col("s").alias("dst")), end).select(F.col("dst").alias("s"), F.col("src").alias("o"))
        else:
            reach = closure(one.select(F.col("s").alias("src"), F.col("o").alias("dst"))).select(F.col("src").alias("s"), F.col("dst").alias("o"))
        reach = reach.withColumn("t", F.lit("iri"))
        return reach if p[0] == "+" else reach.unionByName(same).distinct()

    def plain(self, p) -> list[str] | None:
        if p[0] == "p":
            return [p[1]]
        if p[0] == "|":
            a, b = self.plain(p[1]), self.plain(p[2])
            return a + b if a and b else None
        return None

    def join(self, a: Solutions, b: Solutions, how: str = "inner", condition: Callable[[Solutions], Column] | None = None) -> Solutions:
        shared = [v for v in b.variables if v in a.variables]
        unsure = [v for v in shared if v in a.maybe or v in b.maybe]
        if how == "inner" and condition is None and 0 < len(unsure) <= 2:
            return self.join_unsure(a, b, shared, unsure)
        right = b.df
        for v in shared:
            right = right.withColumnRenamed(v, f"{v}~r").withColumnRenamed(f"{v}~t", f"{v}~rt")
        on = None
        for v in shared:
            c = F.col(v) == F.col(f"{v}~r")
            if v in unsure:
                c = c | F.col(v).isNull() | F.col(f"{v}~r").isNull()
            on = c if on is None else on & c
        names = a.variables + [v for v in b.variables if v not in shared]
        both = Solutions(right, names, a.maybe | b.maybe)
        if condition is not None:
            extra = condition(both)
            on = extra if on is None else on & extra
        if "_" in a.df.columns and "_" in right.columns:
            right = right.drop("_")
        df = a.df.join(right, on, how) if on is not None else a.df.crossJoin(right) if how == "inner" else a.df.join(right, F.lit(True), how)
        if how in ("left_semi", "left_anti"):
            return Solutions(df, a.variables, a.maybe)
        for v in shared:
            if v in a.maybe:
                df = df.withColumn(v, F.coalesce(v, f"{v}~r")).withColumn(f"{v}~t", F.coalesce(f"{v}~t", f"{v}~rt"))
            df = df.drop(f"{v}~r", f"{v}~rt")
        if how == "left":
            maybe = a.maybe | {v for v in b.variables if v not in shared}
        else:
            maybe = {v for v in names if (v in a.maybe or v not in a.variables) and (v in b.maybe or v not in b.variables)}
        return Solutions(df, names, maybe)

    def join_unsure(self, a: Solutions, b: Solutions, shared: list[str], unsure: list[str]) -> Solutions:
        """An inner join where some shared variables may be unbound: one join for each way in which they are bound on either side, by equality of what both bind."""
        names = a.variables + [v for v in b.variables if v not in shared]
        ways = lambda x: list(product(*[(True, False) if v in x.maybe else (True,) for v in unsure]))
        part = lambda x, way: reduce(lambda d, vb: d.filter(F.col(vb[0]).isNotNull() if vb[1] else F.col(vb[0]).isNull()), [(v, k) for v, k in zip(unsure, way) if v in x.maybe], x.df)
        frames = []
        for wa, wb in product(ways(a), ways(b)):
            left, right = part(a, wa), part(b, wb)
            keys = [v for v in shared if v not in unsure or (wa[unsure.index(v)] and wb[unsure.index(v)])]
            for v in shared:
                right = right.withColumnRenamed(v, f"{v}~r").withColumnRenamed(f"{v}~t", f"{v}~rt")
            met = left.join(right, reduce(lambda x, y: x & y, [F.col(v) == F.col(f"{v}~r") for v in keys])) if keys else left.crossJoin(right)
            cols = []
            for v in names:
                both = v in unsure
                cols += [(F.coalesce(v, f"{v}~r") if both else F.col(v)).alias(v), (F.coalesce(f"{v}~t", f"{v}~rt") if both else F.col(f"{v}~t")).alias(f"{v}~t")]
            frames.append(met.select(*cols))
        maybe = {v for v in names if (v in a.maybe or v not in a.variables) and (v in b.maybe or v not in b.variables)}
        return Solutions(reduce(lambda x, y: x.unionByName(y), frames), names, maybe)

    # what patterns can match in a virtual graph

    def flat(self, items: list) -> list:
        """Sequences of steps and inverse steps as patterns of their own."""
        out = []
        for x in items:
            if x[0] == "triple" and x[2][0] == "/":
                self.fresh += 1
                middle = ("var", f"_path{self.fresh}")
                out += self.flat([("triple", x[1], x[2][1], middle), ("triple", middle, x[2][2], x[3])])
            elif x[0] == "triple" and x[2][0] == "^" and x[3][0] != "lit":
                out += self.flat([("triple", x[3], x[2][1], x[1])])
            else:
                out.append(x)
        return out

    def candidates(self, graph: VirtualGraph, s, p, o, spaces: dict[str, set[str]]) -> list[tuple[int, Branch]]:
        """Sources and branches that a pattern can match, given what its variables can stand for."""
        names = None if p[0] == "v" else self.plain(p)

        def fits(term, kind: str, space: str) -> bool:
            if term[0] == "var":
                return term[1] not in spaces or space in spaces[term[1]]
            if term[0] == "lit":
                return kind == "literal"
            return kind == "iri" and (term[1] == space if space.startswith("types/") else term[1].startswith(f"entities/{space}/"))

        out = []
        for i, source in enumerate(graph.sources):
            if fits(s, "iri", source.map.type_name):
                out += [(i, b) for b in graph.branches[i] if (names is None or b.p in names) and fits(o, b.kind, b.target or LITERAL)]
        return out

    def narrowed(self, items: list, graph: VirtualGraph, known: dict[str, set[str]]) -> dict[str, set[str]]:
        """What each variable can stand for, by all patterns of the group that must match."""
        spaces = dict(known)
        plain = [x for x in items if x[0] == "triple" and (x[2][0] == "v" or self.plain(x[2]))]
        changed = True
        while changed:
            changed = False
            for _, s, p, o in plain:
                found = self.candidates(graph, s, p, o, spaces)
                for term, seen in ((s, {graph.sources[i].map.type_name for i, _ in found}), (o, {b.target or LITERAL for _, b in found})):
                    if term[0] == "var" and seen != spaces.get(term[1]):
                        spaces[term[1]], changed = seen, True
        return spaces

    def star(self, graph: VirtualGraph, s, triples: list, spaces: dict[str, set[str]], gvar: str | None) -> list[Solutions]:
        """All patterns of one subject: one projection a source where its rows are entities of their own, else one part a pattern."""
        found: dict[int, dict[int, list[Branch]]] = {}
        for k, (_, _, p, o) in enumerate(triples):
            for i, b in self.candidates(graph, s, p, o, spaces):
                found.setdefault(i, {}).setdefault(k, []).append(b)
        types = [graph.sources[i].map.type_name for i in found]
        if len(triples) > 1 and not (all(graph.sources[i].unique for i in found) and len(set(types)) == len(types)):
            return [x for t in triples for x in self.star(graph, s, [t], spaces, gvar)]
        frames = [self.projection(graph.sources[i], s, [(t, picks[k]) for k, t in enumerate(triples)], gvar) for i, picks in found.items() if len(picks) == len(triples)]
        if not frames:
            names = list(dict.fromkeys([t[1] for x in triples for t in (x[1], ("var", x[2][1]) if x[2][0] == "v" else ("", ""), x[3]) if t[0] == "var"] + ([gvar] if gvar else [])))
            schema = ", ".join(f"`{n}` string, `{n}~t` string" for n in names) or "_ int"
            return [Solutions(self.spark.createDataFrame([], schema), names, set())]
        return [Solutions(reduce(lambda x, y: x.unionByName(y), [f.df for f in frames]), frames[0].variables, set())]

    def projection(self, source: Source, s, picks: list[tuple[tuple, list[Branch]]], gvar: str | None) -> Solutions:
        df, cols, several = source.df, [source.subject.alias("_s")], []
        dtype = lambda b: "iri" if b.kind == "iri" else b.dtype or "string"
        terms = [(s, "_s", F.lit("iri"))]
        for k, ((_, _, p, o), branches) in enumerate(picks):
            if len(branches) == 1:
                b = branches[0]
                df = df if b.where is None else df.filter(b.where)
                cols += [b.o.alias(f"_o{k}"), F.lit(dtype(b)).alias(f"_t{k}"), F.lit(b.p).alias(f"_p{k}")]
            else:
                several.append(k)
                each = [F.struct((b.o if b.where is None else F.when(b.where, b.o)).alias("o"), F.lit(dtype(b)).alias("t"), F.lit(b.p).alias("p")) for b in branches]
                cols.append(F.array(*each).alias(f"_m{k}"))
            terms += ([(("var", p[1]), f"_p{k}", F.lit("iri"))] if p[0] == "v" else []) + [(o, f"_o{k}", F.col(f"_t{k}"))]
        df = df.select(*cols)
        for k in several:
            df = df.select("*", F.inline(f"_m{k}").alias(f"_o{k}", f"_t{k}", f"_p{k}")).drop(f"_m{k}").filter(F.col(f"_o{k}").isNotNull())
        if gvar:
            df = df.withColumn("_g", F.lit(source.graph))
            terms.append((("var", gvar), "_g", F.lit("iri")))
        return self.bind(df, terms)

    def joined(self, parts: list[Solutions]) -> Solutions:
        """Parts that must all match, each joined as soon as it shares a variable with those before."""
        current, rest = parts[0], list(parts[1:])
        while rest:
            k = max(range(len(rest)), key=lambda i: (bool(set(rest[i].variables) & set(current.variables)), -i))
            current = self.join(current, rest.pop(k))
        return current

    def segment(self, items: list, graph, spaces: dict[str, set[str]], current: Solutions | None, gvar: str | None) -> Solutions | None:
        """Items whose order does not matter, joined to what is there."""
        small, parts, stars = [], [], {}
        for x in items:
            if x[0] == "values":
                small.append(self.values(x[1], x[2]))
            elif x[0] == "union":
                parts.append(self.union([self.group(b, graph, spaces, gvar) for b in x[1]]))
            elif x[0] == "select":
                parts.append(self.subselect(x[1], graph))
            elif x[0] == "graph":
                inner = self.graph if x[1][0] == "var" else self.graph.only([x[1][1]]) if isinstance(self.graph, VirtualGraph) else self.graph.filter(F.col("g") == x[1][1])
                parts.append(self.group(x[2], inner, spaces, x[1][1] if x[1][0] == "var" else None))
            elif isinstance(graph, VirtualGraph) and (x[2][0] == "v" or self.plain(x[2])):
                stars.setdefault(x[1], []).append(x)
            else:
                parts.append(self.pattern(graph, x[1], x[2], x[3], gvar))
        stars = [p for s, triples in stars.items() for p in self.star(graph, s, triples, spaces, gvar)]
        parts = ([current] if current is not None else []) + small + stars + parts
        return self.joined(parts) if parts else None

    def group(self, items: list, graph, known: dict[str, set[str]] | None = None, gvar: str | None = None) -> Solutions:
        """Solutions of a group. known: what variables of the outer group can stand for; others are of no use to it."""
        items = self.flat(items)
        spaces = self.narrowed(items, graph, known or {}) if isinstance(graph, VirtualGraph) else known or {}
        current, waiting, late = None, [], []

        def settled() -> Solutions | None:
            out = self.segment(waiting, graph, spaces, current, gvar) if waiting else current
            waiting.clear()
            return out

        split = lambda xs: ([y for y in xs if y[0] != "filter"], [y[1] for y in xs if y[0] == "filter"])
        for x in items:
            if x[0] in ("triple", "values", "union", "select", "graph"):
                waiting.append(x)
            elif x[0] in ("filter", "exists"):
                late.append(x)
            elif x[0] == "optional":
                inner, conditions = split(x[1])
                current = settled() or self.unit()
                part = self.group(inner, graph, spaces, gvar)
                current = self.join(current, part, "left", (lambda s, cs=conditions: self.all_true(cs, s)) if conditions else None)
            elif x[0] == "minus":
                current = settled()
                part = self.group(x[1], graph, spaces, gvar)
                if current is not None and (own := [v for v in part.variables if v in current.variables]):
                    current = self.join(current, Solutions(part.df.select(*[c for v in own for c in (v, f"{v}~t")]), own, part.maybe), "left_anti")
            elif x[0] == "bind":
                current = settled() or self.unit()
                v = self.expr(x[1], current)
                df = current.df.withColumn(x[2], v.string()).withColumn(f"{x[2]}~t", self.dtype(v))
                current = Solutions(df, current.variables + [x[2]], current.maybe | {x[2]})
        current = settled() or self.unit()
        for x in late:
            if x[0] == "exists":
                inner, conditions = split(x[2])
                part = self.group(inner, graph, spaces, gvar)
                current = self.join(current, part, "left_semi" if x[1] else "left_anti", (lambda s, cs=conditions: self.all_true(cs, s)) if conditions else None)
        for x in late:
            if x[0] == "filter":
                current = Solutions(current.df.filter(self.expr(x[1], current).truth()), current.variables, current.maybe)
        return current

    def all_true(self, conditions: list, s: Solutions) -> Column:
        out = None
        for c in conditions:
            t = self.expr(c, s).truth()
            out = t if out is None else out & t
        return out

    def unit(self) -> Solutions:
        return Solutions(self.spark.range(1).select(F.lit(1).alias("_")), [], set())

    def union(self, parts: list[Solutions]) -> Solutions:
        names = list(dict.fromkeys(v for p in parts for v in p.variables))
        frames = []
        for p in parts:
            cols = []
            for v in names:
                have = v in p.variables
                cols += [(F.col(v) if have else F.lit(None).cast("string")).alias(v), (F.col(f"{v}~t") if have else F.lit(None).cast("string")).alias(f"{v}~t")]
            frames.append(p.df.select(*cols))
        df = frames[0]
        for f in frames[1:]:
            df = df.unionByName(f)
        maybe = {v for v in names if any(v not in p.variables or v in p.maybe for p in parts)}
        return Solutions(df, names, maybe)

    def values(self, names: list[str], rows: list) -> Solutions:
        data = [tuple(x for t in row for x in ((None, None) if t is None else (t[1], "iri" if t[0] == "iri" else t[2] or "string"))) for row in rows]
        schema = ", ".join(f"`{n}` string, `{n}~t` string" for n in names)
        maybe = {n for i, n in enumerate(names) if any(row[i] is None for row in rows)}
        return Solutions(self.spark.createDataFrame(data, schema), list(names), maybe)

    def subselect(self, q: Select, graph) -> Solutions:
        df, types = self.solve(q, graph)
        return Solutions(df.select(*[c for v in types for c in (F.col(v).cast("string").alias(v), types[v].alias(f"{v}~t"))]), list(types), set(types))

    # expressions

    def dtype(self, v: Value) -> Column:
        if v.kind == "number":
            return F.lit("float")
        return F.lit("boolean") if v.kind == "boolean" else v.dtype if v.dtype is not None else F.lit("string")

    def expr(self, e, s: Solutions) -> Value:
        kind = e[0]
        if kind == "var":
            if e[1] not in s.variables:
                return Value(F.lit(None).cast("string"), F.lit(None).cast("string"))
            return Value(F.col(e[1]), F.col(f"{e[1]}~t"))
        if kind == "iri":
            return Value(F.lit(e[1]), F.lit("iri"))
        if kind == "lit":
            if e[2] in _NUMERIC:
                return Value(F.lit(float(e[1])) if e[2] != "integer" else F.lit(int(e[1])), F.lit(e[2]), "number")
            if e[2] == "boolean":
                return Value(F.lit(e[1] == "true"), F.lit("boolean"), "boolean")
            return Value(F.lit(e[1]), F.lit(e[2] or "string"), "duration" if e[2] in ("duration", "dayTimeDuration", "yearMonthDuration") else "date" if e[2] in ("dateTime", "date") else "string")
        if kind in ("and", "or"):
            a, b = self.expr(e[1], s).truth(), self.expr(e[2], s).truth()
            return Value(a & b if kind == "and" else a | b, None, "boolean")
        if kind == "not":
            return Value(~self.expr(e[1], s).truth(), None, "boolean")
        if kind == "cmp":
            return Value(self.compare(e[1], self.expr(e[2], s), self.expr(e[3], s)), None, "boolean")
        if kind == "in":
            v = self.expr(e[2], s)
            out = F.lit(False)
            for x in e[3]:
                out = out | self.compare("=", v, self.expr(x, s))
            return Value(out if e[1] else ~out, None, "boolean")
        if kind == "math":
            a, b = self.expr(e[2], s), self.expr(e[3], s)
            if "duration" in (a.kind, b.kind):
                span = F.expr(f"make_dt_interval({self.days(e[3])})")
                t = a.text if a.kind == "date" and a.dtype is None else a.string().try_cast("timestamp")
                return Value(t - span if e[1] == "-" else t + span, None, "date")
            x, y = a.number(), b.number()
            return Value({"+": x + y, "-": x - y, "*": x * y, "/": F.when(y != 0, x / y)}[e[1]], None, "number")
        if kind == "call":
            return self.call(e[1], e[2], s)
        if kind == "agg":
            raise SparqlError("an aggregate stands outside of SELECT, HAVING or ORDER BY")
        raise SparqlError(f"unknown expression {kind}")

    @staticmethod
    def days(e) -> str:
        import re

        m = re.fullmatch(r"P(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)S)?)?", e[1])
        if not m:
            raise SparqlError(f"unsupported duration {e[1]!r}")
        return ", ".join(x or "0" for x in m.groups())

    def compare(self, op: str, a: Value, b: Value) -> Column:
        apply = {"=": lambda x, y: x == y, "!=": lambda x, y: x != y, "<": lambda x, y: x < y, ">": lambda x, y: x > y, "<=": lambda x, y: x <= y, ">=": lambda x, y: x >= y}[op]
        if "number" in (a.kind, b.kind):
            return apply(a.number(), b.number())
        if "boolean" in (a.kind, b.kind):
            return apply(a.truth(), b.truth())
        if "date" in (a.kind, b.kind):
            return apply(a.text.cast("string").try_cast("timestamp"), b.text.cast("string").try_cast("timestamp"))
        if "string" in (a.kind, b.kind) or op in ("=", "!="):
            return apply(a.string(), b.string())
        x, y = a.number(), b.number()
        return F.when(x.isNotNull() & y.isNotNull(), apply(x, y)).otherwise(apply(a.string(), b.string()))

    def call(self, name: str, args: list, s: Solutions) -> Value:
        v = [self.expr(a, s) for a in args]
        t = [x.string() for x in v]
        boolean = lambda c: Value(c, None, "boolean")
        text = lambda c: Value(c, F.lit("string"), "string")
        number = lambda c: Value(c, None, "number")
        if name in self.functions:
            return text(self.functions[name](*t))
        if name in ("IF",):
            c = v[0].truth()
            if v[1].kind == v[2].kind == "number":
                return number(F.when(c, v[1].number()).otherwise(v[2].number()))
            return Value(F.when(c, t[1]).otherwise(t[2]), F.when(c, self.dtype(v[1])).otherwise(self.dtype(v[2])))
        if name == "COALESCE":
            if all(x.kind == "number" for x in v):
                return number(F.coalesce(*[x.number() for x in v]))
            return Value(F.coalesce(*t), F.lit("string"))
        table = {
            "STR": lambda: text(t[0]), "LCASE": lambda: text(F.lower(t[0])), "UCASE": lambda: text(F.upper(t[0])), "CONCAT": lambda: text(F.concat(*t)),
            "CONTAINS": lambda: boolean(t[0].contains(t[1])), "STRSTARTS": lambda: boolean(t[0].startswith(t[1])), "STRENDS": lambda: boolean(t[0].endswith(t[1])),
            "STRLEN": lambda: number(F.length(t[0])), "STRAFTER": lambda: text(F.when(F.instr(t[0], self.constant(args[1])) > 0, F.substring_index(F.concat(F.lit(""), t[0].substr(F.instr(t[0], self.constant(args[1])) + F.length(t[1]), F.length(t[0]))), "\u0000", 1)).otherwise("")),
            "STRBEFORE": lambda: text(F.when(F.instr(t[0], self.constant(args[1])) > 0, F.substring_index(t[0], self.constant(args[1]), 1)).otherwise("")),
            "SUBSTR": lambda: text(t[0].substr(v[1].text.cast("int"), v[2].text.cast("int") if len(v) > 2 else F.length(t[0]))),
            "REPLACE": lambda: text(F.regexp_replace(t[0], self.constant(args[1]), self.constant(args[2]))), "REGEX": lambda: boolean(t[0].rlike(("(?i)" if len(args) > 2 and "i" in self.constant(args[2]) else "") + self.constant(args[1]))),
            "BOUND": lambda: boolean(v[0].text.isNotNull()), "ISIRI": lambda: boolean(v[0].dtype == "iri"), "ISURI": lambda: boolean(v[0].dtype == "iri"), "ISLITERAL": lambda: boolean(v[0].dtype != "iri"), "ISNUMERIC": lambda: boolean(v[0].dtype.isin(*_NUMERIC)),
            "DATATYPE": lambda: Value(F.when(self.dtype(v[0]) != "iri", F.concat(F.lit("xsd:"), self.dtype(v[0]))), F.lit("iri")), "LANG": lambda: text(F.lit("")), "IRI": lambda: Value(t[0], F.lit("iri")), "URI": lambda: Value(t[0], F.lit("iri")),
            "ABS": lambda: number(F.abs(v[0].number())), "ROUND": lambda: number(F.floor(v[0].number() + 0.5)), "CEIL": lambda: number(F.ceil(v[0].number())), "FLOOR": lambda: number(F.floor(v[0].number())),
            "YEAR": lambda: number(F.year(t[0].try_cast("timestamp"))), "MONTH": lambda: number(F.month(t[0].try_cast("timestamp"))), "DAY": lambda: number(F.dayofmonth(t[0].try_cast("timestamp"))), "HOURS": lambda: number(F.hour(t[0].try_cast("timestamp"))),
            "NOW": lambda: Value(self.now if self.now is not None else F.current_timestamp(), None, "date"), "MD5": lambda: text(F.md5(t[0])), "SHA1": lambda: text(F.sha1(t[0])), "SHA256": lambda: text(F.sha2(t[0], 256)),
            "XSD_INTEGER": lambda: number(v[0].number().cast("long")), "XSD_FLOAT": lambda: number(v[0].number()), "XSD_DOUBLE": lambda: number(v[0].number()), "XSD_DECIMAL": lambda: number(v[0].number()), "XSD_STRING": lambda: text(t[0]),
            "XSD_DATETIME": lambda: Value(t[0].try_cast("timestamp"), None, "date"), "XSD_BOOLEAN": lambda: boolean(t[0].try_cast("boolean")),
        }
        if name not in table:
            raise SparqlError(f"unknown function {name}")
        return table[name]()

    @staticmethod
    def constant(e) -> str:
        if e[0] != "lit":
            raise SparqlError("a constant is expected here")
        return e[1]

    # selection

    def aggregate(self, e, s: Solutions) -> Column:
        """An expression over aggregates as a Column for agg()."""
        if e[0] == "agg":
            _, name, distinct, inner, separator = e
            if inner is None:
                return F.count(F.lit(1))
            v = self.expr(inner, s)
            if name == "COUNT":
                return F.count_distinct(v.string()) if distinct else F.count(v.text)
            if name in ("SUM", "AVG"):
                return {("SUM", False): F.sum, ("SUM", True): F.sum_distinct, ("AVG", False): F.avg}[name, distinct](v.number()) if (name, distinct) != ("AVG", True) else F.expr("1") * F.sum_distinct(v.number()) / F.count_distinct(v.number())
            if name in ("MIN", "MAX"):
                f = F.min if name == "MIN" else F.max
                if v.kind == "number":
                    return f(v.number())
                # numbers compare as numbers, other terms as text
                n = v.number()
                return F.when(F.count(n) == F.count(v.text), f(n).cast("string")).otherwise(f(v.string()))
            if name == "SAMPLE":
                return F.min(v.string())  # any member will do; the least one repeats
            values = F.collect_set(v.string()) if distinct else F.collect_list(v.string())
            return F.array_join(F.array_sort(values), separator)
        if e[0] == "math":
            a, b = self.aggregate(e[2], s).cast("double"), self.aggregate(e[3], s).cast("double")
            return {"+": a + b, "-": a - b, "*": a * b, "/": F.when(b != 0, a / b)}[e[1]]
        if e[0] == "cmp":
            a, b = self.aggregate(e[2], s), self.aggregate(e[3], s)
            return {"=": a == b, "!=": a != b, "<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[e[1]]
        if e[0] in ("and", "or"):
            a, b = self.aggregate(e[1], s), self.aggregate(e[2], s)
            return a & b if e[0] == "and" else a | b
        if e[0] == "call" and e[1] in ("ROUND", "ABS", "FLOOR", "CEIL"):
            x = self.aggregate(e[2][0], s)
            return {"ROUND": F.floor(x + 0.5), "ABS": F.abs(x), "FLOOR": F.floor(x), "CEIL": F.ceil(x)}[e[1]]
        if e[0] == "var":
            return F.first(F.col(e[1]))
        return self.expr(e, s).text

    def has_aggregate(self, e) -> bool:
        return isinstance(e, tuple) and (e[0] == "agg" or any(self.has_aggregate(x) for x in e[1:] if isinstance(x, (tuple, list))) or any(self.has_aggregate(y) for x in e[1:] if isinstance(x, list) for y in x))

    def solve(self, q: Select, graph) -> tuple[DataFrame, dict[str, Column]]:
        """The frame of a query's result and, for each of its columns, a Column of the datatype."""
        if q.graphs:
            graph = self.graph.only(q.graphs) if isinstance(self.graph, VirtualGraph) else self.graph.filter(F.col("g").isin(*q.graphs))
            if len(q.graphs) > 1:  # the union of several graphs is a set
                graph = (graph.quads() if isinstance(graph, VirtualGraph) else graph).dropDuplicates(["s", "p", "o", "kind"])
        s = self.group(q.where, graph)
        if q.ask:
            return s.df.limit(1).agg((F.count(F.lit(1)) > 0).alias("answer")), {"answer": F.lit("boolean")}
        grouped = bool(q.group) or any(e is not None and self.has_aggregate(e) for e, _ in q.items) or bool(q.having)
        types: dict[str, Column] = {}
        if grouped:
            df = s.df
            keys = []
            for e, name in q.group:
                if e is not None:
                    df = df.withColumn(name, self.expr(e, s).string())
                keys.append(name)
            aggs, plain = [], []
            for e, name in q.items:
                if e is None:
                    plain.append(name)
                else:
                    aggs.append(self.aggregate(e, s).alias(name))
            extra, having, order = [], [], []
            for k, h in enumerate(q.having):
                extra.append(self.aggregate(h, s).alias(f"_having{k}"))
                having.append(f"_having{k}")
            named = {name for _, name in q.items}
            for k, (e, down) in enumerate(q.order):
                if e[0] == "var" and e[1] in named | set(keys):
                    order.append((e[1], down))
                else:
                    extra.append(self.aggregate(e, s).alias(f"_order{k}"))
                    order.append((f"_order{k}", down))
            key_types = [F.min(f"{k}~t").alias(f"{k}~t") for k in keys if f"{k}~t" in df.columns]
            every = aggs + extra + key_types
            df = df.groupBy(*keys).agg(*(every or [F.count(F.lit(1)).alias("_n")])) if keys else df.agg(*every)
            for h in having:
                df = df.filter(h)
            types = {name: (F.col(f"{name}~t") if f"{name}~t" in df.columns else F.lit("float") if name not in keys else F.lit("string")) for _, name in q.items}
            df = self.sort(df, [(F.col(c), c in keys, down) for c, down in order])
            names = [name for _, name in q.items]
        else:
            df = s.df
            names = [v for v in s.variables if not v.startswith("_")] if q.star else [name for _, name in q.items]
            for e, name in q.items:
                if e is not None:
                    v = self.expr(e, s)
                    df = df.withColumn(name, v.text).withColumn(f"{name}~t", self.dtype(v))
                elif name not in s.variables:
                    df = df.withColumn(name, F.lit(None).cast("string")).withColumn(f"{name}~t", F.lit(None).cast("string"))
            types = {n: F.col(f"{n}~t") for n in names}
            if q.distinct:
                df = df.select(*names, *[f"{n}~t" for n in names]).distinct()
            elif q.order:
                pass
            extended = Solutions(df, list(dict.fromkeys([*s.variables, *names])), s.maybe)
            keys = []
            for e, down in q.order:
                v = self.expr(e, extended)
                keys.append((v.text, v.kind == "term", down))
            df = self.sort(df, keys)
        if q.distinct and grouped:
            df = df.select(*names, *[c for n in names if (c := f"{n}~t") in df.columns]).distinct()
        if q.offset:
            df = df.offset(q.offset)
        if q.limit is not None:
            df = df.limit(q.limit)
        return df, {n: types[n] for n in names}

    @staticmethod
    def sort(df: DataFrame, keys: list) -> DataFrame:
        """Orders by (column, is a term, descending); terms that read as numbers compare as numbers, before their text."""
        if not keys:
            return df
        out = []
        for c, term, down in keys:
            for x in ([c.try_cast("double"), c] if term else [c]):
                out.append(x.desc_nulls_last() if down else x.asc_nulls_first())
        return df.orderBy(*out)

    def select(self, q: Select, graph) -> DataFrame:
        df, types = self.solve(q, graph)
        return df.select(*types)

    # rewrites

    def with_subclasses(self, ontology: DataFrame, max_classes: int = 10_000) -> "Engine":
        """An engine in which an instance of a class is also one of all its ancestors. A class tree of up to `max_classes` edges becomes constants of the plan; a larger one is joined."""
        edges = ontology.filter(F.col("p") == SUBCLASS).select(F.col("s").alias("src"), F.col("o").alias("dst")).distinct()
        if isinstance(self.graph, VirtualGraph) and len(rows := edges.take(max_classes + 1)) <= max_classes:
            parents: dict[str, set[str]] = {}
            for child, parent in rows:
                parents.setdefault(child.removeprefix("types/"), set()).add(parent.removeprefix("types/"))
            above: dict[str, set[str]] = {}
            for c in parents:
                todo, seen = list(parents[c]), set()
                while todo:
                    if (x := todo.pop()) not in seen:
                        seen.add(x)
                        todo += parents.get(x, ())
                above[c] = seen - {c}
            engine = Engine(self.graph.with_classes(above), self.now)
        else:
            quads = self.graph.quads() if isinstance(self.graph, VirtualGraph) else self.graph
            typed = quads.filter(F.col("p") == TYPE)
            lifted = typed.join(closure(edges).select(F.col("src").alias("o"), "dst"), "o").select("g", "s", "p", F.col("dst").alias("o"), "kind", "dtype").distinct()
            engine = Engine(quads.unionByName(lifted), self.now)
        engine.functions = dict(self.functions)
        return engine
