"""Overlapping and gapped time intervals: continuous periods and the gaps between them, by a sweep line.

Every interval becomes a plus event at its start and a minus event at its end. Events are first summed per (entity,
instant) with map-side combining, so copies and hot instants shrink before the shuffle. The prefix sum has two levels:
inside a bucket of time of an entity, and over the totals of an entity's buckets. So an entity that holds a third of all
rows is spread over its buckets, and no task sees more than one bucket's distinct instants or one entity's buckets.

Since a count of active intervals is never negative, it can fall to zero in a bucket only where the bucket's own prefix
sum has its minimum; only those instants are matched with the totals before them.

Defined results: null bounds are unbounded; an interval with both bounds null, or inverted, is ignored; touching
intervals are one period; an interval of zero length is a period of zero length; repeated rows change nothing; an
empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..runtime import computed

#: Stand-ins for unbounded ends, outside of all timestamps in microseconds.
LOWEST, HIGHEST = -(2**63) + 1, 2**63 - 1
_RANGE = r'^\s*[\[(]\s*"?\s*([^",\])]*?)\s*"?\s*,\s*"?\s*([^",\])]*?)\s*"?\s*[\])]\s*$'


def _micros(t: Column) -> Column:
    """Microseconds since 1970 of an ISO timestamp or date (UTC where it names no offset); null if unreadable."""
    zoned = F.when(t.rlike(r"[-+]\d{4}$"), F.regexp_replace(t, r"(\d{2})$", ":$1")).otherwise(t)
    return F.when(t.like("____-__-__%"), F.unix_micros(zoned.try_cast("timestamp")))


def with_range(df: DataFrame, keep: list, text: Column) -> DataFrame:
    """`keep`, lo and hi in microseconds since 1970 (null: unbounded) of the text of a range of timestamps; rows whose range is null, unreadable, empty, inverted or without any bound are dropped."""
    parts = computed(df, keep, _p=F.split(F.regexp_replace(text, _RANGE, "$1|$2"), r"\|"))
    kept = [c for c in parts.columns if c != "_p"]
    texts = computed(parts.filter(F.size("_p") == 2), kept, _a=F.get("_p", F.lit(0)), _b=F.get("_p", F.lit(1)))
    low, high = F.lower("_a").isin("", "-infinity"), F.lower("_b").isin("", "infinity", "+infinity")
    read = computed(texts, kept, lo=F.when(~low, _micros(F.col("_a"))), hi=F.when(~high, _micros(F.col("_b"))), _low=low, _high=high)
    ok = read.filter("(_low OR lo IS NOT NULL) AND (_high OR hi IS NOT NULL) AND NOT (_low AND _high) AND (_low OR _high OR lo <= hi)")
    return ok.select(*kept, "lo", "hi")


def _zero_points(df: DataFrame, keys: list[Column], lo: Column, hi: Column, bucket_us: int) -> tuple[DataFrame, list[str]]:
    """Instants at which an entity's count of active intervals falls to zero: k0, k1, ..., bucket b, t, the entity's next instant, its first instant."""
    names = [f"k{i}" for i in range(len(keys))]
    spans = df.select(*[k.alias(n) for k, n in zip(keys, names)], lo.alias("lo"), hi.alias("hi")).filter("NOT (lo IS NULL AND hi IS NULL) AND (lo IS NULL OR hi IS NULL OR lo <= hi)")
    ends = F.array(F.struct(F.coalesce("lo", F.lit(LOWEST)).alias("t"), F.lit(1).alias("d")), F.struct(F.coalesce("hi", F.lit(HIGHEST)).alias("t"), F.lit(-1).alias("d")))
    events = spans.select(*names, F.inline(ends))
    bucket = F.when(F.col("t").isin(LOWEST, HIGHEST), F.col("t")).otherwise(F.floor(F.col("t") / bucket_us))
    # the net of an instant suffices, for touching intervals are one; a point's instant stays with a net of zero
    summed = events.groupBy(*names, bucket.alias("b"), "t").agg(F.sum("d").alias("d"))
    inner = Window.partitionBy(*names, "b").orderBy("t")
    run = summed.select(*names, "b", "t", "d", F.sum("d").over(inner).alias("run"), F.lead("t").over(inner).alias("next"))
    totals = run.groupBy(*names, "b").agg(F.sum("d").alias("total"), F.min("run").alias("least"), F.min("t").alias("first"))
    order, entity = Window.partitionBy(*names).orderBy("b"), Window.partitionBy(*names)
    base = F.sum("total").over(order) - F.col("total")
    before = totals.select(*[F.col(n).alias(f"_{n}") for n in names], F.col("b").alias("_b"), base.alias("base"), "least", F.lead("first").over(order).alias("first_after"), F.min("first").over(entity).alias("first_of_all"))
    before = before.filter("base + least = 0")
    # null-safe throughout: an inferred "is not null" would make the two sides' exchanges differ and be computed twice;
    # run <= least instead of equality: an equi-join key would make the large side move once more
    on = [F.col(n).eqNullSafe(F.col(f"_{n}")) for n in [*names, "b"]] + [F.col("run") <= F.col("least")]
    zero = run.join(before, on).select(*names, "b", "t", F.coalesce("next", "first_after").alias("next"), "first_of_all")
    return zero, names


def gaps(df: DataFrame, keys: list[Column], lo: Column, hi: Column, bucket_us: int = 30 * 86_400_000_000) -> DataFrame:
    """Gaps of positive length: k0, k1, ... (the keys), gap_lo, gap_hi in microseconds."""
    zero, names = _zero_points(df, keys, lo, hi, bucket_us)
    return zero.filter("next IS NOT NULL AND next > t").select(*names, F.col("t").alias("gap_lo"), F.col("next").alias("gap_hi"))


def periods(df: DataFrame, keys: list[Column], lo: Column, hi: Column, bucket_us: int = 30 * 86_400_000_000) -> DataFrame:
    """Continuous periods: k0, k1, ..., lo, hi in microseconds (null: unbounded).

    A period ends at each zero point and began at the instant that follows the zero point before, in the same bucket or
    the last of an earlier one; an entity's first period begins at its first instant.
    """
    zero, names = _zero_points(df, keys, lo, hi, bucket_us)
    inner, order = Window.partitionBy(*names, "b").orderBy("t"), Window.partitionBy(*names).orderBy("b")
    rows = zero.select("*", F.lag("next").over(inner).alias("here"))
    last = rows.groupBy(*names, "b").agg(F.max("next").alias("n"))
    last = last.select(*[F.col(n).alias(f"_{n}") for n in names], F.col("b").alias("_b"), F.lag("n").over(order).alias("earlier"))
    rows = rows.join(last, [F.col(n).eqNullSafe(F.col(f"_{n}")) for n in [*names, "b"]])
    start = F.coalesce("here", "earlier", "first_of_all")
    return rows.select(*names, F.when(start != LOWEST, start).alias("lo"), F.when(F.col("t") != HIGHEST, F.col("t")).alias("hi"))
