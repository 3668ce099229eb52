"""What is written beside facts: validity, provenance, suppression, events, and the reading of it. All frames; an update gives the frame after it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .facts import AUTHORITY, UNKNOWN


def insert_facts(facts: DataFrame, incoming: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(facts as a set, receipt): incoming facts that are not there yet are added once; the receipt says of each whether it was new."""
    new = incoming.select(*facts.columns).dropDuplicates(keys)
    there = facts.select(*keys).distinct().withColumn("_there", F.lit(True))
    marked = new.join(there, keys, "left")
    return facts.unionByName(marked.filter("_there IS NULL").select(*facts.columns)), marked.select(*keys, F.when(F.col("_there").isNull(), "added").otherwise("known").alias("receipt"))


def without_pairs(quads: DataFrame, pairs: DataFrame) -> DataFrame:
    """Without any object of the given (s, p), whatever its datatype."""
    return quads.join(pairs.select("s", "p").distinct(), ["s", "p"], "left_anti")


def set_intervals(intervals: DataFrame, changes: DataFrame) -> DataFrame:
    """Intervals (fact_id, valid_from, valid_to) after changes (fact_id, action, at): open starts one that isn't there, close ends it at `at`, reopen takes its end away. The last change of a fact counts for its end, the first opening for its start."""
    c = changes.groupBy("fact_id").agg(F.min(F.when(F.col("action") != "close", F.col("at"))).alias("first"), F.max_by("action", "at").alias("last"), F.max("at").alias("at"))
    both = intervals.join(c, "fact_id", "full_outer")
    start = F.coalesce("valid_from", "first")
    end = F.when(F.col("last") == "close", F.col("at")).when(F.col("last") == "reopen", F.lit(None)).otherwise(F.col("valid_to"))
    return both.select("fact_id", start.alias("valid_from"), end.cast(intervals.schema["valid_to"].dataType).alias("valid_to"))


def with_provenance(facts: DataFrame, source: Column, authority: Column, confidence: Column, at: Column) -> DataFrame:
    """Facts with source, authority, confidence (the level's own where none is given) and time."""
    usual = F.create_map(*[F.lit(x) for k, (_, c) in AUTHORITY.items() for x in (k, c)])
    return facts.select("*", source.alias("source"), authority.alias("authority"), F.coalesce(confidence, F.element_at(usual, authority), F.lit(UNKNOWN[1])).alias("confidence"), at.alias("recorded_at"))


def existing_claims(facts: DataFrame, intervals: DataFrame, provenance: DataFrame, keys: list[str]) -> DataFrame:
    """Current claims with their trust signals: facts without a closed interval, best provenance of each (highest confidence, then latest)."""
    closed = intervals.filter("valid_to IS NOT NULL").select("fact_id")
    best = provenance.groupBy("fact_id").agg(F.max(F.struct("confidence", "recorded_at", "source", "authority")).alias("b"))
    return facts.join(closed, "fact_id", "left_anti").join(best, "fact_id", "left").select(*keys, "fact_id", F.col("b.source").alias("source"), F.col("b.authority").alias("authority"), F.col("b.confidence").alias("confidence"), F.col("b.recorded_at").alias("recorded_at"))


def corrections(claims: DataFrame, asserted: DataFrame, keys: list[str], value: str, level: str) -> DataFrame:
    """Claims with what a user or a verifier asserts: a correction outranks what is weaker and equal, an equal value only raises confidence. Gives (keys, value, authority, action)."""
    rank = F.create_map(*[F.lit(x) for k, (r, _) in AUTHORITY.items() for x in (k, r)])
    new = asserted.select(*keys, F.col(value).alias("_new"))
    both = claims.join(new, keys, "full_outer")
    stronger = F.coalesce(F.element_at(rank, F.col("authority")), F.lit(UNKNOWN[0])) < AUTHORITY[level][0]
    action = F.when(F.col("_new").isNull(), "kept").when(F.col(value).isNull(), "added").when(F.col(value) == F.col("_new"), "confirmed").when(stronger, "refused").otherwise("superseded")
    out = both.withColumn("action", action)
    takes = F.col("action").isin("added", "superseded", "confirmed")
    return out.select(*keys, F.when(takes, F.col("_new")).otherwise(F.col(value)).alias(value), F.when(takes, F.lit(level)).otherwise(F.col("authority")).alias("authority"), "action")


def recency_decides(type_name: Column, attribute: Column, multivalued: list[tuple[str, str]] = (), single: list[tuple[str, str]] = (), default_multivalued: bool = False) -> Column:
    """Whether a later value supersedes the earlier one, by (type, attribute): always where it is said to hold one value, never where it is said to hold several, else by the default, which is one."""
    named = lambda pairs: F.array_contains(F.array(*[F.lit(f"{t}\u0001{a}") for t, a in pairs]), F.concat_ws("\u0001", type_name, attribute)) if pairs else F.lit(False)
    return F.when(named(single), True).when(named(multivalued), False).otherwise(F.lit(not default_multivalued))


def citations(answers: DataFrame, provenance: DataFrame, keys: list[str]) -> DataFrame:
    """Answer rows with their best source and whether it covers them; rows without one carry a caveat."""
    best = provenance.groupBy(*keys).agg(F.max(F.struct("confidence", "recorded_at", "source")).alias("b"), F.count_distinct("source").alias("n_sources"))
    out = answers.join(best, keys, "left")
    return out.select(*answers.columns, F.col("b.source").alias("source"), F.coalesce("n_sources", F.lit(0)).alias("n_sources"), F.when(F.col("b").isNull(), "no source").alias("caveat"))


def companions(facts: DataFrame, p: str, values: dict[str, Column]) -> DataFrame:
    """One companion fact (s, p~name, o) for each given value that is there."""
    return facts.select("s", F.inline(F.array(*[F.struct(F.concat(F.col(p), F.lit(f"~{n}")).alias("p"), v.cast("string").alias("o")) for n, v in sorted(values.items())]))).filter("o IS NOT NULL")


def append_events(log: DataFrame, events: DataFrame, order: list[str]) -> DataFrame:
    """An append-only log with a running number, which goes on from the largest there is."""
    last = log.agg(F.coalesce(F.max("n"), F.lit(0)).alias("_last"))
    # numbers come from counts a partition of the order's first column, so that no window spans all events
    head = order[0]
    counts = events.groupBy(head).agg(F.count("*").alias("_c"))
    before = counts.select(F.col(head).alias("_h"), (F.sum("_c").over(Window.orderBy(head)) - F.col("_c")).alias("_before"))
    own = F.row_number().over(Window.partitionBy(head).orderBy(*order))
    rows = events.withColumn("_own", own).join(before, events[head].eqNullSafe(F.col("_h"))).crossJoin(last)
    return log.unionByName(rows.withColumn("n", F.col("_last") + F.col("_before") + F.col("_own")).select(*log.columns))


def streaks(log: DataFrame, keys: list[str], order: list[str], hit: Column, threshold: int) -> DataFrame:
    """(keys, length, first, last) of runs of consecutive hits that reach the threshold: gaps and islands within a key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = log.select(*keys, *order, hit.alias("_hit"), F.row_number().over(w).alias("_n"))
    runs = rows.filter("_hit").select("*", (F.col("_n") - F.row_number().over(w)).alias("_run"))
    return runs.groupBy(*keys, "_run").agg(F.count("*").alias("length"), F.min(order[0]).alias("first"), F.max(order[0]).alias("last")).filter(F.col("length") >= threshold).drop("_run")


def run_manifest(items: DataFrame, run: str, state: str, at: Column, cost: Column, ceiling: float, max_attempts: int = 3) -> DataFrame:
    """One row a run: items done, dropped (failed as often as allowed), open; attempts; spend and whether it passed the ceiling; coverage and state."""
    item = items.groupBy(run, "item").agg(F.max_by(state, at).alias("state"), F.count_if(F.col(state) == "failed").alias("failures"), F.count("*").alias("attempts"), F.sum(cost).alias("cost"))
    done, dropped = F.col("state") == "done", (F.col("state") == "failed") & (F.col("failures") >= max_attempts)
    out = item.groupBy(run).agg(F.count("*").alias("n_items"), F.count_if(done).alias("done"), F.count_if(dropped).alias("dropped"), F.sum("attempts").alias("attempts"), F.round(F.sum("cost"), 2).alias("spend"))
    over = F.col("spend") > ceiling
    left = F.col("n_items") - F.col("done") - F.col("dropped")
    return out.select("*", F.round(F.col("done") / F.col("n_items"), 4).alias("coverage"), F.when(over, "halted").when(left > 0, "running").when(F.col("dropped") > 0, "partial").otherwise("complete").alias("status"))
