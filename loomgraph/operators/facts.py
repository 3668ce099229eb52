"""Facts over time: current values, history, conflicts, retractions, renames, receipts, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Rank of each authority (less is stronger) and the confidence it has where none is given.
AUTHORITY = {"user_assertion": (0, 0.99), "source_of_truth": (1, 0.95), "machine_reverification": (2, 0.9), "authoritative": (3, 0.85), "supplementary": (4, 0.6)}
UNKNOWN = (9, 0.5)


def current_facts(facts: DataFrame, closed: DataFrame, keys: list[str]) -> DataFrame:
    """Facts without a closed interval."""
    return facts.join(closed.select(*keys).distinct(), keys, "left_anti")


def fact_history(facts: DataFrame, intervals: DataFrame, keys: list[str]) -> DataFrame:
    """All facts with their interval where there is one."""
    return facts.join(intervals, keys, "left")


def value_changes(log: DataFrame, keys: list[str], value: str, at: str, tie: str) -> DataFrame:
    """Transitions old -> new in order of time, where the value differs; never for a first value."""
    w = Window.partitionBy(*keys).orderBy(at, tie)
    return log.select(*keys, F.lag(value).over(w).alias("old"), F.col(value).alias("new"), F.col(at).alias("changed_at")).filter("old IS NOT NULL AND old <> new")


def recorded_changes(incoming: DataFrame, current: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Changes of an incoming batch against the current values: only where both exist and differ."""
    old = current.select(*keys, F.col(value).alias("old"))
    return incoming.select(*keys, F.col(value).alias("new")).join(old, keys).filter("old <> new")


def resolve_conflicts(claims: DataFrame, keys: list[str], value: str, authority: str, confidence: str, at: str) -> DataFrame:
    """One winner a key: strongest authority, then confidence, then time (none is earliest), then value; equal values are one claim.

    One aggregation of a struct in that order, so partial results combine before the shuffle.
    """
    rank = F.create_map(*[F.lit(x) for k, (r, _) in AUTHORITY.items() for x in (k, r)])
    usual = F.create_map(*[F.lit(x) for k, (_, c) in AUTHORITY.items() for x in (k, c)])
    a = F.coalesce(F.element_at(rank, F.col(authority)), F.lit(UNKNOWN[0]))
    c = F.coalesce(F.col(confidence), F.element_at(usual, F.col(authority)), F.lit(UNKNOWN[1]))
    best = F.max(F.struct((-a).alias("a"), c.alias("c"), F.coalesce(F.unix_micros(F.col(at).cast("timestamp")), F.lit(-(2**62))).alias("t"), F.col(value).alias("v")))
    return claims.groupBy(*keys).agg(best.alias("w"), F.count_distinct(value).alias("n_values")).select(*keys, F.col("w.v").alias("winner"), (-F.col("w.a")).alias("authority_rank"), F.col("w.c").alias("confidence"), (F.col("n_values") > 1).alias("contested"))


def supersede(history: DataFrame, keys: list[str], value: str, at: str, tie: str) -> DataFrame:
    """Intervals of a functional attribute from its assertions: each runs until the next different value."""
    w = Window.partitionBy(*keys).orderBy(at, tie)
    starts = history.select(*keys, value, at, tie, F.lag(value).over(w).alias("before")).filter(F.col("before").isNull() | (F.col("before") != F.col(value)))
    return starts.select(*keys, value, F.col(at).alias("valid_from"), F.lead(at).over(w).alias("valid_to"))


def without_suppressed(facts: DataFrame, facts_marked: DataFrame, entities_marked: DataFrame, keys: list[str], entity: str) -> DataFrame:
    return facts.join(facts_marked.select(*keys).distinct(), keys, "left_anti").join(entities_marked.select(entity).distinct(), entity, "left_anti")


def rename_subjects(quads: DataFrame, mapping: DataFrame) -> DataFrame:
    """Quads with old names replaced by new ones in both positions, as a set. mapping: (old, new), few against the quads."""
    m1, m2 = mapping.select(F.col("old").alias("_s"), F.col("new").alias("_ns")), mapping.select(F.col("old").alias("_o"), F.col("new").alias("_no"))
    out = quads.join(m1, quads["s"] == m1["_s"], "left").join(m2, (quads["o"] == m2["_o"]) & (quads["kind"] == "iri"), "left")
    return out.select("g", F.coalesce("_ns", "s").alias("s"), "p", F.coalesce("_no", "o").alias("o"), "kind", "dtype").distinct()


def merge_entities(quads: DataFrame, loser: str, winner: str, merge_id: str) -> tuple[DataFrame, DataFrame]:
    """(merged, lineage): the loser's facts and edges move to the winner; lineage (merge_id, g, s, p, o, kind, dtype, ns, no) keeps each moved fact and where it went."""
    moved = quads.filter((F.col("s") == loser) | ((F.col("o") == loser) & (F.col("kind") == "iri")))
    end = lambda c: F.when(F.col(c) == loser, F.lit(winner)).otherwise(F.col(c))
    lineage = moved.distinct().select(F.lit(merge_id).alias("merge_id"), "g", "s", "p", "o", "kind", "dtype", end("s").alias("ns"), F.when(F.col("kind") == "iri", end("o")).otherwise(F.col("o")).alias("no"))
    # what the winner already said is marked, so that a split does not take it away
    own = quads.select("g", F.col("s").alias("ns"), "p", F.col("o").alias("no"), F.lit(True).alias("kept")).distinct()
    lineage = lineage.join(own, ["g", "ns", "p", "no"], "left").withColumn("kept", F.coalesce("kept", F.lit(False)))
    stay = quads.join(moved.select("g", "s", "p", "o", "kind").distinct(), ["g", "s", "p", "o", "kind"], "left_anti").select("g", "s", "p", "o", "kind", "dtype")
    return stay.unionByName(lineage.select("g", F.col("ns").alias("s"), "p", F.col("no").alias("o"), "kind", "dtype")).distinct(), lineage


def split_entity(quads: DataFrame, lineage: DataFrame, merge_id: str) -> DataFrame:
    """The facts with one merge undone: what it moved is put back, facts that the winner had before, or got since, stay."""
    own = lineage.filter(F.col("merge_id") == merge_id)
    gone = own.filter("NOT kept").select("g", F.col("ns").alias("s"), "p", F.col("no").alias("o"), "kind").distinct()
    return quads.join(gone, ["g", "s", "p", "o", "kind"], "left_anti").select("g", "s", "p", "o", "kind", "dtype").unionByName(own.select("g", "s", "p", "o", "kind", "dtype")).distinct()


def rename_predicates(quads: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Aliases of predicates, chains followed to their end."""
    def end(p: str) -> str:
        seen = {p}
        while mapping.get(p) and mapping[p] not in seen:
            p = mapping[p]
            seen.add(p)
        return p

    flat = F.create_map(*[F.lit(x) for k in sorted(mapping) for x in (k, end(k))])
    return quads.withColumn("p", F.coalesce(F.element_at(flat, F.col("p")), F.col("p")))


def delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """Facts added and removed, each once with its id: a receipt that repeats."""
    cols = ["s", "p", "o"]
    added, removed = after.select(*cols).distinct(), before.select(*cols).distinct()
    both = added.join(removed, cols, "left_anti").withColumn("change", F.lit("added")).unionByName(removed.join(added, cols, "left_anti").withColumn("change", F.lit("removed")))
    return both.withColumn("fact_id", F.sha1(F.concat_ws("|", *cols)))


def snapshot(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value): the sorted values of each key joined by bars."""
    return df.groupBy(F.col(key).alias("key")).agg(F.array_join(F.array_sort(F.collect_list(F.col(value).cast("string"))), "|").alias("value"))


def snapshot_diff(previous: DataFrame | None, current: DataFrame) -> DataFrame:
    """Added and changed keys; removals are not reported, nor is anything without a previous snapshot."""
    if previous is None:
        return current.limit(0).select("key", F.lit("").alias("change"), F.lit("").alias("old"), F.col("value").alias("new"))
    p = previous.select("key", F.col("value").alias("old"))
    both = current.join(p, "key", "left")
    return both.select("key", F.when(F.col("old").isNull(), "added").when(F.col("old") != F.col("value"), "changed").alias("change"), "old", F.col("value").alias("new")).filter("change IS NOT NULL")


def as_of(df: DataFrame, instant: Column, lo: Column, hi: Column) -> DataFrame:
    """Rows whose half-open interval holds the instant; null ends are open."""
    return df.filter((lo.isNull() | (lo <= instant)) & (hi.isNull() | (instant < hi)))


def overlapping(df: DataFrame, start: Column, end: Column, lo: Column, hi: Column) -> DataFrame:
    """Rows whose half-open interval meets the window [start, end)."""
    return df.filter((lo.isNull() | (lo < end)) & (hi.isNull() | (start < hi)))
