"""Rows into entities: screening, mapping with stubs, splits and constants, validation with a ledger of what was rejected."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.cleaning import cell_fault, role_of
from ..functions.text import synthetic_key, target_labels
from ..functions.typed_text import cleaned
from ..model import LABEL, TYPE, entity, safe_id, union
from ..runtime import computed


def screen_rows(df: DataFrame, key: str, attributes: list[str]) -> DataFrame:
    """Rows whose key can be a name (an empty one is left to others), with cells emptied that can't be what their names say, and `scrubbed`: which ones."""
    name = F.col(key)
    kept = df.filter(name.isNull() | (F.trim(name) == "") | cell_fault("name", name).isNull())
    faults = {a: cell_fault(r, F.col(a)) for a in attributes if (r := role_of(a, key)) and a != key}
    scrubbed = F.array_join(F.array_compact(F.array(*[F.when(f.isNotNull(), F.lit(a)) for a, f in sorted(faults.items())])), ",") if faults else F.lit("")
    return kept.select(*[F.when(faults[c].isNull(), F.col(c)).alias(c) if c in faults else F.col(c) for c in kept.columns], scrubbed.alias("scrubbed"))


@dataclass(frozen=True)
class EntitySpec:
    """One kind of entity in a row: its key columns (several make a composite key), label, attributes (name -> column, datatype) and edges to constants (predicate -> type, label)."""

    type_name: str
    keys: tuple[str, ...]
    label: str | None = None
    attributes: dict[str, tuple[str, str]] = field(default_factory=dict)
    constants: dict[str, tuple[str, str]] = field(default_factory=dict)


@dataclass(frozen=True)
class Link:
    """An edge from an entity of the row to another one of it (`to`: index), or to entities named in a cell (`column`, of type `target`), which get a stub."""

    subject: int
    predicate: str
    to: int | None = None
    column: str | None = None
    target: str | None = None
    split: bool = True


def _key(spec: EntitySpec, columns: list[str]) -> Column:
    """Joined key values; a row without any keeps its place under a key made of its filled cells. A composite key needs all of its parts."""
    filled = F.lit(True)
    for k in spec.keys:
        filled = filled & (F.trim(F.col(k).cast("string")) != "")
    own = F.concat_ws("_", *[safe_id(F.col(k)) for k in spec.keys])
    made = synthetic_key(spec.type_name, {c: F.col(c) for c in columns}) if len(spec.keys) == 1 else F.lit(None).cast("string")
    return F.when(F.coalesce(filled, F.lit(False)), own).otherwise(made)


def map_rows(df: DataFrame, entities: list[EntitySpec], links: list[Link], graph: str = "kg") -> tuple[DataFrame, DataFrame]:
    """(facts, rejects): quads as a set and (s, p, raw, dtype, reason) of the values that are not of their datatype. Rows that are all empty give nothing."""
    any_filled = F.coalesce(*[F.when(F.trim(F.col(c).cast("string")) != "", F.lit(True)) for c in df.columns], F.lit(False))
    rows = computed(df.filter(any_filled), df.columns, **{f"_k{i}": _key(e, df.columns) for i, e in enumerate(entities)})
    subject = lambda i: F.concat(F.lit(f"entities/{entities[i].type_name}/"), F.col(f"_k{i}"))
    quad = lambda d, s, p, o, kind, dtype=None: d.select(F.lit(graph).alias("g"), s.alias("s"), F.lit(p).alias("p") if isinstance(p, str) else p.alias("p"), o.alias("o"), F.lit(kind).alias("kind"), (F.lit(dtype).cast("string") if dtype is None or isinstance(dtype, str) else dtype).alias("dtype"))
    parts, rejects = [], []
    for i, e in enumerate(entities):
        own = rows.filter(F.col(f"_k{i}").isNotNull())
        parts.append(quad(own, subject(i), TYPE, F.lit(f"types/{e.type_name}"), "iri"))
        if e.label:
            parts.append(quad(own.filter(F.trim(F.col(e.label).cast("string")) != ""), subject(i), LABEL, F.trim(F.col(e.label).cast("string")), "literal", "string"))
        if e.attributes:
            cells = own.select(subject(i).alias("s"), F.inline(F.array(*[F.struct(F.lit(f"attrs/{n}").alias("p"), F.col(c).cast("string").alias("v"), F.lit(t).alias("t")) for n, (c, t) in e.attributes.items()])))
            checked = cleaned(cells.filter(F.trim("v") != ""), ["s", "p", F.col("v").alias("raw"), F.col("t").alias("dt")], F.col("v"), F.col("t"))
            parts.append(quad(checked.filter("outcome <> 'dropped'"), F.col("s"), F.col("p"), F.col("value"), "literal", F.col("dt")))
            rejects.append(checked.filter("outcome = 'dropped'").select("s", "p", "raw", F.col("dt").alias("dtype"), "reason"))
        for p, (t, label) in e.constants.items():
            node = F.concat(F.lit(f"entities/{t}/"), safe_id(F.lit(label)))
            parts += [quad(own, subject(i), f"onto/{p}", node, "iri"), quad(own.limit(1), node, TYPE, F.lit(f"types/{t}"), "iri"), quad(own.limit(1), node, LABEL, F.lit(label), "literal", "string")]
    for l in links:
        own = rows.filter(F.col(f"_k{l.subject}").isNotNull())
        if l.to is not None:
            parts.append(quad(own.filter(F.col(f"_k{l.to}").isNotNull()), subject(l.subject), f"onto/{l.predicate}", subject(l.to), "iri"))
            continue
        labels = target_labels(F.col(l.column)) if l.split else F.filter(F.array(F.trim(F.col(l.column))), lambda x: x != "")
        named = own.select(subject(l.subject).alias("s"), F.explode(labels).alias("label"))
        node = entity(l.target, F.col("label"))
        parts.append(quad(named, F.col("s"), f"onto/{l.predicate}", node, "iri"))
        stubs = named.select(node.alias("n"), "label").groupBy("n").agg(F.min("label").alias("label"))
        parts += [quad(stubs, F.col("n"), TYPE, F.lit(f"types/{l.target}"), "iri"), quad(stubs, F.col("n"), LABEL, F.col("label"), "literal", "string")]
    none = rows.limit(0).select(*[F.lit(None).cast("string").alias(c) for c in ("s", "p", "raw", "dtype", "reason")])
    return union(parts).distinct(), union(rejects) if rejects else none


def conservation(df: DataFrame, facts: DataFrame, entities: list[EntitySpec]) -> DataFrame:
    """(type_name, rows_in, entities, dropped): how many rows came in, how many entities of each kind came out, and how many rows had no key for it."""
    columns = df.columns
    keys = computed(df, [], **{f"_k{i}": _key(e, columns) for i, e in enumerate(entities)})
    counts = keys.agg(F.count("*").alias("rows_in"), *[F.count_if(F.col(f"_k{i}").isNull()).alias(f"d{i}") for i in range(len(entities))])
    rows = counts.select(F.inline(F.array(*[F.struct(F.lit(f"types/{e.type_name}").alias("o"), F.col("rows_in"), F.col(f"d{i}").alias("dropped")) for i, e in enumerate(entities)])))
    made = facts.filter(F.col("p") == TYPE).groupBy("o").agg(F.count_distinct("s").alias("entities"))
    return rows.join(made, "o", "left").select(F.substring_index("o", "/", -1).alias("type_name"), "rows_in", F.coalesce("entities", F.lit(0)).alias("entities"), "dropped")


def resolve_attributes(incoming: DataFrame, declared: DataFrame) -> DataFrame:
    """(name, action, resolved): each incoming (name, datatype) reuses the declared attribute of its key, takes part in it under another name, or is new; what is declared keeps its datatype."""
    from ..functions.cleaning import kept_datatype
    from ..functions.schema_text import attribute_key, without_idle_prefix

    k = lambda c: without_idle_prefix(attribute_key(F.col(c)))
    d = declared.select(F.col("name").alias("known"), F.col("datatype").alias("kind"), k("name").alias("k")).groupBy("k").agg(F.min_by(F.struct("known", "kind"), "known").alias("d"))
    both = incoming.select("name", "datatype", k("name").alias("k")).join(d, "k", "left")
    action = F.when(F.col("d").isNull(), "new").when(F.col("d.known") == F.col("name"), "reuse").otherwise("rename")
    return both.select("name", action.alias("action"), F.coalesce("d.known", "name").alias("resolved"), kept_datatype(F.col("d.kind"), F.col("datatype")).alias("datatype"))


def upsert_declarations(declared: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Declarations with those of `changes` in place of the ones of equal keys; a change with all other columns null takes a declaration back."""
    rest = [c for c in declared.columns if c not in keys]
    keep = F.lit(False)
    for c in rest:
        keep = keep | F.col(c).isNotNull()
    return declared.join(changes.select(*keys).distinct(), keys, "left_anti").select(*declared.columns).unionByName(changes.filter(keep).select(*declared.columns))


def source_lineage(df: DataFrame, key: Column, source: Column) -> DataFrame:
    """Rows with `lineage`: an id of the row within its source, the same whenever the row comes again, and `copy`, which numbers equal rows."""
    out = df.withColumn("lineage", F.substring(F.sha1(F.concat_ws("|", F.sha1(F.coalesce(source, F.lit(""))), key)), 1, 16))
    return out.withColumn("copy", F.row_number().over(Window.partitionBy("lineage").orderBy(*df.columns)))
