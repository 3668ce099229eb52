"""Names of types and attributes, requests and query texts, as Column expressions."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, functions as F

#: Prefixes that say nothing about an attribute.
IDLE_PREFIXES = ("listing_", "property_", "total_", "current_", "primary_", "default_", "original_", "actual_", "base_")
#: Words that name a property, quality or state, and those that end a compound of that kind.
PROPERTY_WORDS = ("colour", "color", "online", "offline", "mode", "status", "format", "style", "size", "kind", "type", "flag", "option", "instruction", "level", "rank", "grade")
PROPERTY_ENDS = ("mode", "status", "format", "style", "kind", "type", "flag", "option", "level", "rank")
#: Last parts of attribute names by which one can point at a thing.
IDENTITY_LEAVES = ("name", "id", "label", "title", "street", "code", "number", "key", "identifier", "uri", "url", "address", "value", "line1", "line_1")
#: Features of a query's text.
QUERY_TAGS = {"count": r"(?i)COUNT\s*\(", "avg": r"(?i)AVG\s*\(", "max": r"(?i)MAX\s*\(", "sum": r"(?i)SUM\s*\(", "filter": r"(?i)FILTER\s*\(", "contains": r"(?i)CONTAINS\s*\(", "date_filter": r"(?i)xsd:dateTime", "group_by": r"(?i)GROUP\s+BY"}
#: Family of a request by the first segment after the tenant; others are `other`.
ROUTES = {"ask": "ask", "agent": "agent", "agent-chat": "agent", "query": "query", "search": "search", "explore": "explore", "ingest": "ingest", "enrich": "enrich", "normalize": "normalize", "kgs": "kgs", "jobs": "jobs", "schedules": "jobs", "actions": "actions", "ontology": "ontology", "usage": "usage"}


def attribute_key(c: Column) -> Column:
    """An attribute's name in lower case, with underscores for blanks and hyphens."""
    return F.translate(F.trim(F.lower(c)), " -", "__")


def without_idle_prefix(c: Column) -> Column:
    """Without one prefix that says nothing, unless nothing would be left."""
    stripped = F.regexp_replace(c, "^(" + "|".join(IDLE_PREFIXES) + ")(?=.)", "")
    return stripped


def closest_name(declared: list[str], least: float = 0.85):
    """Arrow function: the declared name of equal key, else the one most alike by matching blocks of the names without idle prefixes, if alike enough."""
    plain = lambda x: x.strip().lower().replace(" ", "_").replace("-", "_")
    bare = lambda x: next((x[len(p) :] for p in IDLE_PREFIXES if x.startswith(p) and len(x) > len(p)), x)
    by_key = {}
    for d in declared:
        by_key.setdefault(plain(d), d)

    def find(name: str | None) -> str | None:
        if name is None:
            return None
        if plain(name) in by_key:
            return by_key[plain(name)]
        scored = [(SequenceMatcher(None, bare(plain(name)), bare(k)).ratio(), d) for k, d in by_key.items()]
        ratio, best = max(scored, key=lambda x: x[0], default=(0.0, None))
        return best if ratio >= least else None

    @F.pandas_udf("string")
    def closest(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([find(x if isinstance(x, str) else None) for x in b], dtype="object")

    return closest


def singular(c: Column) -> Column:
    low, n = F.lower(c), F.length(c)
    return (
        F.when((n > 3) & low.endswith("ies"), F.concat(low.substr(F.lit(1), n - 3), F.lit("y"))).when((n > 4) & low.rlike("(ches|shes|sses|xes|zes)$"), low.substr(F.lit(1), n - 2))
        .when((n > 1) & low.endswith("s") & ~low.endswith("ss"), low.substr(F.lit(1), n - 1)).otherwise(low)
    )


def words_of_camel(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(c, r"(?<=[a-z0-9])(?=[A-Z])", " "), r"[_\s]+", " "))


def type_tokens(c: Column) -> Column:
    """Words of a type's name, by capitals and separators."""
    return F.filter(F.split(F.lower(F.regexp_replace(c, r"(?<=[a-z0-9])(?=[A-Z])", " ")), "[^a-z0-9]+"), lambda w: w != "")


def is_junk_type(c: Column) -> Column:
    """Whether a name says a property, quality or state: all its words do (in the plural, too), or all but those of a last word that ends such compounds."""
    words, property_words = type_tokens(c), F.array(*[F.lit(w) for w in PROPERTY_WORDS])
    inside = lambda ws: F.size(F.array_except(ws, property_words)) == 0
    one = F.transform(words, lambda w: F.when(w.endswith("s") & F.array_contains(property_words, w.substr(F.lit(1), F.length(w) - 1)), w.substr(F.lit(1), F.length(w) - 1)).otherwise(w))
    compact = F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    compound = F.lit(False)
    for end in PROPERTY_ENDS:
        rest = F.array_except(words, F.array(F.lit(end), F.lit(end.removesuffix("s"))))
        compound = compound | (compact.endswith(end) & (F.length(compact) > len(end)) & (F.size(rest) > 0) & inside(rest))
    return c.isNull() | (F.size(words) == 0) | inside(words) | inside(one) | compound


def pattern_tags(c: Column) -> Column:
    """Sorted names of the features that a query's text shows; `join`: two subjects or more, `multi_hop`: three patterns or more."""
    subjects = F.size(F.array_distinct(F.regexp_extract_all(c, F.lit(r"(\?\w+\s+<)"), F.lit(1))))
    ends = F.size(F.regexp_extract_all(c, F.lit(r"(\.\s*(?:\n|$|\}))"), F.lit(1))) + F.size(F.split(c, r" \. ")) - 1
    tags = [F.when(c.rlike(p), F.lit(n)) for n, p in QUERY_TAGS.items()] + [F.when(subjects >= 2, F.lit("join")), F.when(ends >= 3, F.lit("multi_hop"))]
    return F.array_sort(F.array_compact(F.array(*tags)))


def route_family(c: Column) -> Column:
    """Struct of kg_name and family of a request by its path `/graphs/tenant/...`; null for other paths."""
    rest = F.regexp_extract(c, r"^/graphs/[^/]+(/.*)?$", 1)
    families = F.create_map(*[F.lit(x) for kv in ROUTES.items() for x in kv])
    segment = F.regexp_extract(rest, "^/*([^/]*)", 1)
    kg = F.substring(F.regexp_extract(rest, "^/(?:explore/)?kgs/([^/]+)", 1), 1, 128)
    return F.when(c.rlike("^/graphs/[^/]+(/.*)?$"), F.struct(kg.alias("kg_name"), F.coalesce(F.element_at(families, segment), F.lit("other")).alias("family")))


#: Probes of the datatypes in the order in which they are tried; all values must fit.
_NUMBER = r"[-+]?[0-9]+(?:\.[0-9]+)?"
PROBES = {
    "integer": r"^[-+]?[0-9]+$",
    "float": r"^[-+]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][-+]?[0-9]+)?$",
    "datetime": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]+)?)?(Z|[-+][0-9]{2}:?[0-9]{2})?)?$",
    "geo": rf"^(?i:POINT)\s*\(\s*{_NUMBER}\s+{_NUMBER}\s*\)$|^{_NUMBER}\s*,\s*{_NUMBER}$",
}


def lexical(v: Column) -> Column:
    """The trimmed value without a datatype suffix `^^type`."""
    return F.trim(F.regexp_replace(v, r"\^\^[^^]*$", ""))


def entity_type(v: Column) -> Column:
    """The type in an entity's identifier, null for other texts."""
    t = F.regexp_extract(v, r"^(?:https?://\S*/)?entities/([^/\s]+)/[^/\s]+$", 1)
    return F.when(t != "", t)


def inferred_datatype(df, keys: list, value: Column):
    """(keys, datatype): the first datatype that all filled values of a key fit, an entity's type where all name entities of one type, else string. Sums of fits, so nothing is gathered."""
    v = lexical(value)
    rows = df.select(*keys, F.when(v != "", v).alias("v"))
    fits = {n: F.count_if(F.col("v").rlike(p)) for n, p in PROBES.items()}
    agg = rows.groupBy(*keys).agg(F.count("v").alias("n"), *[c.alias(f"n_{n}") for n, c in fits.items()], F.count(entity_type(F.col("v"))).alias("n_iri"), F.min(entity_type(F.col("v"))).alias("low"), F.max(entity_type(F.col("v"))).alias("high"))
    kind = F.when(F.col("n") == 0, "string")
    for n in PROBES:
        kind = kind.when(F.col("n") == F.col(f"n_{n}"), n)
    return agg.select(*keys, kind.when((F.col("n") == F.col("n_iri")) & (F.col("low") == F.col("high")), F.col("low")).otherwise("string").alias("datatype"))


def token_estimate(c: Column, chars_per_token: float = 4.0) -> Column:
    """Tokens a text is likely to take, from its length."""
    return F.ceil(F.length(c) / chars_per_token)
