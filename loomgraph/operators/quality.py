"""Invariants of a graph, audits, classes of failures, and decisions on found values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..model import LABEL, SUBCLASS, TYPE, closure

DOMAIN_RANGE = "rdfs:range"


def edges_on_attributes(quads: DataFrame) -> DataFrame:
    """Edges to entities that are written on an attribute's predicate."""
    return quads.filter(F.col("p").startswith("attrs/") & (F.col("kind") == "iri") & F.col("o").startswith("entities/")).select("s", "p", "o")


def declared_ranges(ontology: DataFrame) -> DataFrame:
    """(type, leaf, range) of declarations types/T/attrs/leaf."""
    d = ontology.filter((F.col("p") == DOMAIN_RANGE) & F.col("o").startswith("types/"))
    return d.select(F.regexp_extract("s", "^(types/[^/]+)/attrs/", 1).alias("type"), F.regexp_extract("s", "/attrs/(.+)$", 1).alias("leaf"), F.col("o").alias("range")).filter("type <> ''")


def _edges(quads: DataFrame, ontology: DataFrame) -> DataFrame:
    """Facts on relationship predicates whose subject's own type declares a range for them: the join key is made of type and predicate."""
    typed = quads.filter(F.col("p") == TYPE).select("s", F.col("o").alias("type"))
    e = quads.filter(F.col("p").startswith("onto/")).select("s", "p", "o", "kind", F.expr("substr(p, 6)").alias("leaf"))
    return e.join(typed, "s").join(declared_ranges(ontology), ["type", "leaf"])


def literals_on_relationships(quads: DataFrame, ontology: DataFrame) -> DataFrame:
    return _edges(quads, ontology).filter("kind = 'literal'").select("s", "p", "o").distinct()


def wrong_targets(quads: DataFrame, ontology: DataFrame) -> DataFrame:
    """Edges to typed entities none of whose types is one of the declared ranges or below one. Ranges are alternatives; untyped targets are another invariant's matter."""
    e = _edges(quads, ontology).filter("kind = 'iri'").select("s", "p", "o", "range")
    above = closure(ontology.filter(F.col("p") == SUBCLASS).select(F.col("s").alias("src"), F.col("o").alias("dst"))).select(F.col("src").alias("t"), F.col("dst").alias("range"))
    types = quads.filter(F.col("p") == TYPE).select(F.col("s").alias("o"), F.col("o").alias("t"))
    reach = types.select("o", F.col("t").alias("range")).unionByName(types.join(above, "t").select("o", "range")).distinct()
    typed = e.join(types.select("o").distinct(), "o", "left_semi")
    fits = typed.join(reach, ["o", "range"], "left_semi").select("s", "p", "o").distinct()
    return typed.select("s", "p", "o").distinct().join(fits, ["s", "p", "o"], "left_anti")


def untyped_nodes(quads: DataFrame) -> DataFrame:
    nodes = quads.filter((F.col("kind") == "iri") & F.col("o").startswith("entities/")).select(F.col("o").alias("s")).distinct()
    return nodes.join(quads.filter(F.col("p") == TYPE).select("s"), "s", "left_anti")


def unlabelled_nodes(quads: DataFrame) -> DataFrame:
    nodes = quads.filter((F.col("p") == TYPE) & F.col("s").startswith("entities/")).select("s").distinct()
    return nodes.join(quads.filter(F.col("p") == LABEL).select("s"), "s", "left_anti")


def audit(quads: DataFrame, ontology: DataFrame) -> DataFrame:
    """(invariant, severity, violations, sample) of all invariants; a graph fails if one of severity error has any."""
    text = F.concat_ws(" ", "s", "p", "o")
    checks = [("edge_on_attribute", "error", edges_on_attributes(quads).select(text.alias("x"))), ("literal_on_relationship", "error", literals_on_relationships(quads, ontology).select(text.alias("x"))), ("wrong_target", "error", wrong_targets(quads, ontology).select(text.alias("x"))), ("untyped_node", "error", untyped_nodes(quads).select(F.col("s").alias("x"))), ("unlabelled_node", "warn", unlabelled_nodes(quads).select(F.col("s").alias("x")))]
    out = None
    for name, severity, found in checks:
        one = found.agg(F.count("*").alias("violations"), F.min("x").alias("sample")).select(F.lit(name).alias("invariant"), F.lit(severity).alias("severity"), "violations", "sample")
        out = one if out is None else out.unionByName(one)
    return out


#: Categories of failures that are a query's fault.
QUERY_FAULTS = ("bad_predicate_uri", "wrong_filter", "wrong_aggregation", "missing_join")


def failure_class(expected: Column, answer: Column, query: Column, category: Column, explanation: Column) -> Column:
    """Struct of layer and kind of a wrong answer, by the first sign that holds; null if none does."""
    want = F.regexp_replace(expected, r"[^\d.\-]", "").try_cast("double")
    got = F.regexp_extract(answer, r"(\d+\.?\d*)", 1).try_cast("double")
    ratio = F.when(want > 0, got / want)
    low = F.lower(explanation)
    is_ = lambda layer, kind: F.struct(F.lit(layer).alias("layer"), kind.alias("kind") if isinstance(kind, Column) else F.lit(kind).alias("kind"))
    return (
        F.when(answer.contains("|") & ~answer.contains("HTTP"), is_("ingestion", "pipe_splitting"))
        .when((ratio > 0) & (ratio < 0.5), is_("ingestion", "missing_data"))
        .when(low.contains("case") & (low.contains("mismatch") | low.contains("sensitivity")), is_("ingestion", "normalization"))
        .when(category.isin(*QUERY_FAULTS), is_("query", category))
        .when((category == "empty_result") | (answer == "No results found."), is_("query", "empty_result"))
        .when(category == "uri_instead_of_value", is_("query", "uri_instead_of_value"))
        .when(query.isNull() | (F.length(F.trim(query)) < 20), is_("query", "generation_failure"))
    )


def best_verdicts(verdicts: DataFrame, existing: DataFrame, keys: list[str], floor: float = 0.6) -> DataFrame:
    """(keys, value, confidence, action): the best candidate value of each key at or above the floor, against what is there: fill, verify (loosely equal) or conflict."""
    from ..functions.cleaning import loosely_equal

    best = verdicts.filter(F.col("confidence") >= floor).groupBy(*keys).agg(F.max(F.struct("confidence", (-F.col("chain")).alias("c"), "value")).alias("b"))
    both = best.join(existing.select(*keys, F.col("value").alias("_old")), keys, "left")
    action = F.when(F.col("_old").isNull(), "fill").when(loosely_equal(F.col("_old"), F.col("b.value")), "verify").otherwise("conflict")
    return both.select(*keys, F.col("b.value").alias("value"), F.col("b.confidence").alias("confidence"), action.alias("action"))


def first_verdicts(verdicts: DataFrame, keys: list[str], floor: float = 0.6) -> tuple[DataFrame, DataFrame]:
    """(verdicts, tally): of each key the first in the chain that reaches the floor; and of each provider how often it was asked (until a verdict came) and how often it answered."""
    ok = F.col("confidence") >= floor
    stop = verdicts.groupBy(*keys).agg(F.min(F.when(ok, F.col("chain"))).alias("stop"))
    asked = verdicts.join(stop, keys).filter(F.col("stop").isNull() | (F.col("chain") <= F.col("stop")))
    tally = asked.groupBy("provider").agg(F.count("*").alias("asked"), F.count_if(ok).alias("answered"))
    return asked.filter(F.col("chain") == F.col("stop")).select(*keys, "value", "provider", "confidence"), tally


def write_set(decided: DataFrame, policy: str) -> DataFrame:
    """What is written of best_verdicts by a policy: stage none, overwrite all, skip what is there, verify only what agrees or fills."""
    allowed = {"stage": [], "overwrite": ["fill", "verify", "conflict"], "skip": ["fill"], "verify": ["fill", "verify"]}[policy]
    return decided.withColumn("written", F.col("action").isin(*allowed) if allowed else F.lit(False))


def chain_cost(prices: DataFrame, chains: DataFrame) -> DataFrame:
    """(tier, cost, paid): what one look-up through each tier's chain costs if all of it is walked."""
    return chains.join(prices, "provider", "left").groupBy("tier").agg(F.round(F.sum(F.coalesce("price", F.lit(0.0))), 4).alias("cost"), F.count_if(F.col("price") > 0).alias("paid"))


def tier_of(attributes: Column, web: list[str], structured: list[str]) -> Column:
    """core if an attribute is a fact of the open web, or if not all are identifiers; lite for identifiers only, or none at all."""
    low = F.transform(attributes, lambda a: F.lower(a))
    return F.when(F.arrays_overlap(low, F.array(*[F.lit(w) for w in web])), "core").when(F.size(F.array_except(low, F.array(*[F.lit(w) for w in structured]))) == 0, "lite").otherwise("core")


def halt_reason(status: Column, sustained: Column, timed_out: Column, spend: Column, ceiling: float) -> Column:
    """Why a run must stop: its ceiling of cost, then what the service answered (no credit, limits that last, no access), a timeout, another error; null if it may go on. A single limit is none."""
    limited = F.coalesce(sustained, F.lit(False))
    return F.when(spend > ceiling, "cost_ceiling").when(status == 402, "billing").when((status == 429) & limited, "rate_limit").when(status == 401, "auth").when(timed_out, "timeout").when((status >= 400) & (status != 429), "error")
