"""Record matching by weighted signals: block keys, candidate pairs, scores, decisions, clusters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.names import block_keys
from .linking import canonical_ids


@dataclass(frozen=True)
class MatchConfig:
    """Weights of signals, those that decide alone, and the thresholds for merging and for review."""

    weights: tuple[tuple[str, float], ...]
    decisive: tuple[str, ...] = ()
    auto: float = 0.90
    review: float = 0.70


#: Configurations by kind of entity.
GUEST = MatchConfig((("email", 0.45), ("phone", 0.25), ("name", 0.20), ("address", 0.05), ("dob", 0.05)), ("email",))
CUSTOMER = MatchConfig((("email", 0.50), ("phone", 0.25), ("name", 0.20), ("address", 0.05)), ("email",))
PROPERTY = MatchConfig((("address", 0.70), ("name", 0.30)), (), 0.95, 0.80)


def token_ratio(a: Column, b: Column) -> Column:
    """Similarity of two texts of words whatever their order: edit ratio of the sorted words, or 1 if one's words are all among the other's."""
    x, y = F.array_sort(F.array_distinct(F.split(a, " "))), F.array_sort(F.array_distinct(F.split(b, " ")))
    p, q = F.array_join(x, " "), F.array_join(y, " ")
    inside = (F.size(F.array_except(x, y)) == 0) | (F.size(F.array_except(y, x)) == 0)
    return F.when(inside, 1.0).otherwise(1.0 - F.levenshtein(p, q) / F.greatest(F.length(p), F.length(q)))


def similarity(signal: str) -> Column:
    a, b = F.col(f"a.{signal}"), F.col(f"b.{signal}")
    if signal == "email":
        local = lambda c: F.regexp_replace(c, "@[^@]*$", "")
        return F.when(a == b, 1.0).when(local(a) == local(b), 0.6).otherwise(0.0)
    if signal in ("name", "address"):
        return token_ratio(a, b)
    return F.when(a == b, 1.0).otherwise(0.0)


def candidate_pairs(records: DataFrame, max_block: int = 400) -> DataFrame:
    """(id_a, id_b) that share a block key; records: id, name, phone, email, dob (normalised). A block of more than `max_block` records is spread over parts, and each part meets each part."""
    keyed = records.select("id", F.explode(block_keys(F.col("name"), F.col("phone"), F.col("email"), F.col("dob"))).alias("key"))
    sizes = keyed.groupBy("key").agg(F.ceil(F.count("*") / max_block).cast("int").alias("parts"))
    keyed = keyed.join(sizes, "key").select("id", "key", F.pmod(F.xxhash64("id"), "parts").cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    a = keyed.select(F.col("id").alias("id_a"), "key", F.col("part").alias("x"), F.col("other").alias("y"))
    b = keyed.select(F.col("id").alias("id_b"), "key", F.col("other").alias("x"), F.col("part").alias("y"))
    return a.join(b, ["key", "x", "y"]).filter("id_a < id_b").select("id_a", "id_b").distinct()


def score_pairs(pairs: DataFrame, records: DataFrame, config: MatchConfig) -> DataFrame:
    """(id_a, id_b, score, decision). Weights count over the signals that both sides have; a decisive signal alone gives 1; equal phones with like names give 0.92 at least."""
    joined = pairs.join(records.alias("a"), F.col("id_a") == F.col("a.id")).join(records.alias("b"), F.col("id_b") == F.col("b.id"))
    total, used = F.lit(0.0), F.lit(0.0)
    for signal, weight in config.weights:
        both = F.col(f"a.{signal}").isNotNull() & F.col(f"b.{signal}").isNotNull()
        total = total + F.when(both, weight * similarity(signal)).otherwise(0.0)
        used = used + F.when(both, weight).otherwise(0.0)
    score = F.when(used > 0, total / used).otherwise(0.0)
    signals = [s for s, _ in config.weights]
    if "phone" in signals and "name" in signals:
        last = lambda side: F.element_at(F.array_sort(F.split(F.col(f"{side}.name"), " ")), -1)
        same = (F.col("a.phone") == F.col("b.phone")) & ((similarity("name") >= 0.85) | (last("a") == last("b")))
        score = F.when(F.coalesce(same, F.lit(False)), F.greatest(score, F.lit(0.92))).otherwise(score)
    for d in config.decisive:
        score = F.when(F.coalesce(F.col(f"a.{d}") == F.col(f"b.{d}"), F.lit(False)), 1.0).otherwise(score)
    out = joined.select("id_a", "id_b", F.round(score, 6).alias("score"))
    return out.select("*", F.when(F.col("score") >= config.auto, "merge").when(F.col("score") >= config.review, "review").otherwise("skip").alias("decision"))


def clusters(scored: DataFrame) -> DataFrame:
    """(id, canonical) over the pairs that merge."""
    return canonical_ids(scored.filter("decision = 'merge'").select(F.col("id_a").alias("a"), F.col("id_b").alias("b")))


def richest(records: DataFrame, clusters: DataFrame, signals: list[str]) -> DataFrame:
    """(canonical, survivor): the record of most signals of each cluster, the least id among equals."""
    filled = sum((F.when(F.col(s).isNotNull(), 1).otherwise(0) for s in signals), F.lit(0))
    best = records.join(clusters, "id").groupBy("canonical").agg(F.max(F.struct(filled.alias("n"), (-F.col("id")).alias("i"))).alias("b"))
    return best.select("canonical", (-F.col("b.i")).alias("survivor"))
