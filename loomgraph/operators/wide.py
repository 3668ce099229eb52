"""Attribute-value rows into wide tables: one row per entity, one typed column per declared attribute.

Every (name, value) pair is read as the declared type, whatever type the row claims; the pairs are reduced per (entity,
attribute) with map-side combining before the first shuffle, the survivors (at most one per declared attribute) become a
map per entity, and the known keys of that map are projected into typed columns. Values that can't be read stay: the latest of
each attribute in the column `cast_failures` (attribute -> text), all of them, one a row, in the frame that `cast_failures()` gives.

Defined results: null ids and undeclared names give no cell; marks of absence are no value and no failure; of two
readable values at one time the later in row order of (array position, text) wins; an entity of which no pair
is readable still has a row, of nulls. Input columns other than those named are ignored; the names of result columns that
clash with the key get an underscore.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.typed_text import canonical, is_absent, trimmed
from ..runtime import bounded_rows, computed, unused_name

#: Spark type of each declared type's column.
SPARK_TYPES = {"integer": "decimal(38,0)", "float": "double", "boolean": "boolean", "datetime": "timestamp", "geo": "string", "uri": "string", "string": "string"}


def name_key(name: Column) -> Column:
    """An attribute name without letter case and word separators."""
    return F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]", "")


def _read_pairs(df: DataFrame, key: str, attributes: str, at: str, declared: list[tuple[str, str]]) -> DataFrame:
    """k, at, i, v, name, absent, text (canonical, null if it can't be read) of each pair."""
    kind = F.create_map(*[F.lit(x) for n, t in declared for x in ("".join(ch for ch in n.lower() if ch.isalnum()), f"{t}:{n}")])
    pairs = df.filter(F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(at).alias("at"), F.posexplode_outer(attributes).alias("i", "a"))
    pairs = computed(pairs, ["k", "at", "i"], d=F.element_at(kind, name_key(F.col("a.name"))), v=F.col("a.value"), w=trimmed(F.col("a.value")))
    pairs = computed(pairs, ["k", "at", "i", "v", "w"], t=F.substring_index("d", ":", 1), name=F.expr("substr(d, instr(d, ':') + 1)"), absent=is_absent(F.col("w")))
    return computed(pairs, ["k", "at", "i", "v", "name", "absent"], text=F.when(~F.col("absent"), canonical(F.col("w"), F.col("t"))))


def cast_failures(df: DataFrame, key: str, attributes: str, at: str, declared: list[tuple[str, str]]) -> DataFrame:
    """(key, name, value, at): every value of a declared attribute that can't be read as its type, one a row; nothing is gathered."""
    bad = _read_pairs(df, key, attributes, at, declared).filter("name IS NOT NULL AND text IS NULL AND NOT absent")
    return bad.select(F.col("k").alias(key), "name", F.col("v").alias("value"), F.col("at").alias(at))


def resolve_pairs(df: DataFrame, key: str, attributes: str, at: str, declared: list[tuple[str, str]]) -> DataFrame:
    """One row per (entity, declared attribute): `k`, `name`, `text` (canonical, null if none is readable), `failure`."""
    read = _read_pairs(df, key, attributes, at, declared)
    rank = lambda ok: F.when(ok, F.struct("at", "i", "text", "v"))
    return (
        read.groupBy("k", "name")
        .agg(
            F.max(rank(F.col("text").isNotNull())).alias("best"),
            F.max(rank(F.col("name").isNotNull() & F.col("text").isNull() & ~F.col("absent"))).alias("bad"),
        )
        .select("k", "name", F.col("best.text").alias("text"), F.col("bad.v").alias("failure"))
    )


def widen(df: DataFrame, key: str, attributes: str, at: str, declarations: DataFrame, max_attributes: int = 2000) -> DataFrame:
    """One row per entity. declarations: columns name and datatype, at most `max_attributes` rows (they become columns)."""
    declared = sorted({(r[0], r[1]) for r in bounded_rows(declarations.select("name", "datatype"), max_attributes, "the table of declarations") if r[0]})
    cells = resolve_pairs(df, key, attributes, at, declared)
    entry = lambda c: F.map_from_entries(F.collect_list(F.when(F.col(c).isNotNull() & F.col("name").isNotNull(), F.struct("name", c))))
    maps = cells.groupBy("k").agg(entry("text").alias("m"), entry("failure").alias("f"))
    taken, columns = [key], []
    for name, kind in declared:
        column = unused_name(taken, name)
        taken.append(column)
        text = F.element_at("m", F.lit(name))
        columns.append(text.cast(SPARK_TYPES.get(kind, "string")).alias(column))
    return maps.select(F.col("k").alias(key), *columns, F.col("f").alias(unused_name(taken, "cast_failures")))


def cells_of(wide: DataFrame, key: str, declared: list[tuple[str, str]]) -> DataFrame:
    """The filled cells of a wide table as (key, name, value) with each type's canonical text."""
    text = {"float": lambda c: F.format_string("%.2f", c), "datetime": lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")}
    taken, entries = [key], []
    for name, kind in sorted(declared):
        column = unused_name(taken, name)
        taken.append(column)
        c = F.col(f"`{column}`")
        entries.append(F.struct(F.lit(name).alias("name"), F.when(c.isNotNull(), text.get(kind, lambda c: c.cast("string"))(c)).alias("value")))
    return wide.select(key, F.inline(F.array(*entries))).filter("value IS NOT NULL")
