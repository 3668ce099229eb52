"""Rules, layers, contracts and plans around a schema, and small readings of a graph that other steps build on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..model import LABEL, SAME, TYPE, safe_id
from .linking import canonical_ids

#: Suffixes of attributes that only say something about another one.
COMPANION_SUFFIXES = ("source_url", "provenance", "verified_at")
#: Steps of a rule's life and those that may follow.
RULE_STEPS = {"suggested": ("confirmed", "rejected"), "confirmed": ("applied", "rejected"), "applied": (), "rejected": ()}


def migration_plan(attributes: DataFrame, type_name: str, name: str) -> DataFrame:
    """(type, name, action, new_name): a companion beside its base moves to the meta space, one whose base is gone is swept, all others stay."""
    pattern = f"^(.+)_({'|'.join(COMPANION_SUFFIXES)})$"
    a = attributes.select(F.col(type_name).alias("type"), F.col(name).alias("name")).distinct()
    base = a.select("type", F.col("name").alias("base"), F.lit(True).alias("there"))
    c = a.withColumn("base", F.when(F.col("name").rlike(pattern), F.regexp_extract("name", pattern, 1)))
    met = c.join(base, ["type", "base"], "left")
    action = F.when(F.col("base").isNull(), "keep").when(F.col("there"), "move").otherwise("sweep")
    return met.select("type", "name", action.alias("action"), F.when(action == "move", F.concat_ws("/", F.lit("attr_meta"), "base", F.regexp_extract("name", pattern, 2))).alias("new_name"))


def constrained(cells: DataFrame, allowed: DataFrame, required: DataFrame) -> DataFrame:
    """(entity, type, name, value, state) of extracted cells: those of allowed (type, name) are kept, others dropped; required ones that an entity lacks are missing."""
    state = cells.join(allowed.select("type", "name", F.lit(True).alias("_ok")), ["type", "name"], "left").withColumn("state", F.when(F.col("_ok"), "kept").otherwise("dropped")).drop("_ok")
    want = cells.select("entity", "type").distinct().join(required.select("type", "name"), "type")
    lack = want.join(cells.select("entity", "type", "name"), ["entity", "type", "name"], "left_anti").withColumn("value", F.lit(None).cast("string")).withColumn("state", F.lit("missing"))
    return state.select("entity", "type", "name", "value", "state").unionByName(lack.select("entity", "type", "name", "value", "state"))


def source_batches(df: DataFrame, source: str, order: list[str], size: int) -> DataFrame:
    """Rows with the number of their batch: batches hold rows of one source only, at most `size`."""
    return df.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(source).orderBy(*order)) - 1) / size).cast("int"))


def rule_states(events: DataFrame, rule: str, step: str, at: list[str]) -> DataFrame:
    """(rule, step, refused): where each rule's life has got to; a step that may not follow the one before, or comes first without a suggestion, is refused and changes nothing."""
    allowed = F.create_map(*[F.lit(x) for a, bs in RULE_STEPS.items() for x in (a, ",".join(bs))])
    log = events.groupBy(rule).agg(F.array_sort(F.collect_list(F.struct(*at, step))).alias("log"))  # a rule has few events
    start = F.struct(F.lit(None).cast("string").alias("now"), F.lit(0).alias("refused"))

    def go(acc: Column, e: Column) -> Column:
        fits = F.when(acc["now"].isNull(), e[step] == "suggested").otherwise(F.array_contains(F.split(F.element_at(allowed, acc["now"]), ","), e[step]))
        return F.struct(F.when(fits, e[step]).otherwise(acc["now"]).alias("now"), (acc["refused"] + F.when(fits, 0).otherwise(1)).alias("refused"))

    return log.select(rule, F.aggregate("log", start, go).alias("a")).select(rule, F.col("a.now").alias("step"), F.col("a.refused").alias("refused"))


def merged_identities(quads: DataFrame) -> DataFrame:
    """Facts with all names of one thing (sameAs in either direction) replaced by the least of them, in both places; the links themselves go."""
    links = quads.filter(F.col("p") == SAME).select(F.col("s").alias("a"), F.col("o").alias("b"))
    ids = canonical_ids(links)
    m1, m2 = ids.select(F.col("id").alias("_s"), F.col("canonical").alias("_ns")), ids.select(F.col("id").alias("_o"), F.col("canonical").alias("_no"))
    rest = quads.filter(F.col("p") != SAME)
    out = rest.join(m1, rest["s"] == m1["_s"], "left").join(m2, (rest["o"] == m2["_o"]) & (rest["kind"] == "iri"), "left")
    return out.select("g", F.coalesce("_ns", "s").alias("s"), "p", F.coalesce("_no", "o").alias("o"), "kind", "dtype").distinct()


def layered_parents(edges: DataFrame, rank: str) -> DataFrame:
    """(child, parent, layer): parents of each class from the first layer that says any."""
    best = edges.groupBy("child").agg(F.min(rank).alias("_r"))
    return edges.join(best, "child").filter(F.col(rank) == F.col("_r")).drop("_r")


def binding_attributes(quads: DataFrame, entities: DataFrame, predicates: list[str]) -> DataFrame:
    """(s, attributes): a map from predicate to least value of some predicates of some entities."""
    f = quads.join(entities.select("s").distinct(), "s", "left_semi").filter(F.col("p").isin(*predicates)).groupBy("s", "p").agg(F.min("o").alias("o"))
    return f.groupBy("s").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("p", "o")))).alias("attributes"))


def header_chunks(columns: list[str], spine: list[str], size: int) -> list[list[str]]:
    """Columns of a wide table in chunks of `size`, each with the spine in front; every column but the spine's in exactly one chunk."""
    rest = [c for c in columns if c not in spine]
    return [spine + rest[i : i + size] for i in range(0, len(rest), size)] or [list(spine)]


def record_chunks(df: DataFrame, order: list[str], tokens: Column, budget: int) -> DataFrame:
    """Rows with the chunk they are sent in: as many rows a chunk as the mean row's tokens let into the budget, a row beyond it alone in a chunk of its own."""
    sized = df.withColumn("_t", tokens)
    per = sized.filter(F.col("_t") <= budget).agg(F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.lit(1.0), F.avg("_t")))).alias("_per"))
    small = sized.filter(F.col("_t") <= budget).withColumn("_i", F.row_number().over(Window.partitionBy(F.pmod(F.xxhash64(order[0]), F.lit(16))).orderBy(*order)))
    small = small.crossJoin(per).withColumn("chunk", F.concat_ws("-", F.pmod(F.xxhash64(order[0]), F.lit(16)).cast("string"), F.floor((F.col("_i") - 1) / F.col("_per")).cast("string")))
    return small.drop("_i", "_per", "_t").unionByName(sized.filter(F.col("_t") > budget).drop("_t").withColumn("chunk", F.concat(F.lit("alone-"), F.col(order[0]).cast("string"))))


def independent_evidence(facts: DataFrame, pages: DataFrame, key: str, value: str, host: str) -> DataFrame:
    """(key, supporting, hosts): pages that hold a fact's value, without those of the host it was taken from; hosts are counted once."""
    met = facts.join(pages.select(key, F.col(host).alias("_host"), F.col("page")), key)
    holds = F.lower("page").contains(F.lower(F.trim(value))) & (F.length(F.trim(value)) >= 2)
    return met.groupBy(key).agg(F.count_if(holds & (F.col("_host") != F.col(host))).alias("supporting"), F.count_distinct(F.when(holds & (F.col("_host") != F.col(host)), F.col("_host"))).alias("hosts"))


def watch_query(keys: list[str], predicates: list[str]) -> str:
    """One query for the values of some entities' predicates: a union of a pattern a predicate over the entities."""
    values = " ".join(f"<{k}>" for k in keys)
    return "SELECT ?key ?value WHERE { VALUES ?key { " + values + " } " + " UNION ".join(f"{{ ?key <{p}> ?value }}" for p in predicates) + " }"


def contract_faults(entities: DataFrame) -> DataFrame:
    """(id, fault) of extracted entities (type_name, id, attributes): without a type or id, an attribute without a name, a name twice with two values."""
    a = entities.select("id", "type_name", "attributes")
    basic = a.select("id", F.explode(F.array_compact(F.array(F.when(F.coalesce(F.trim("type_name"), F.lit("")) == "", F.lit("no type")), F.when(F.coalesce(F.trim("id"), F.lit("")) == "", F.lit("no id")), F.when(F.exists(F.coalesce("attributes", F.array()), lambda x: F.coalesce(F.trim(x["name"]), F.lit("")) == ""), F.lit("unnamed attribute"))))).alias("fault"))
    names = F.transform(F.array_distinct(F.transform(F.coalesce("attributes", F.array()), lambda x: F.struct(x["name"].alias("n"), x["value"].alias("v")))), lambda x: x["n"])
    return basic.unionByName(a.filter(F.size(names) > F.size(F.array_distinct(names))).select("id", F.lit("two values").alias("fault")))


def spec_faults(specs: DataFrame) -> DataFrame:
    """(slug, fault) of entries (slug, url, style, cost, ttl_days) of a registry of interfaces."""
    faults = {"slug": ~F.col("slug").rlike("^[a-z0-9][a-z0-9-]*$"), "url": ~F.col("url").rlike(r"^https://[^\s/?#]+\.[a-z]{2,}(?:[/?#]\S*)?$"), "secret in url": F.col("url").rlike(r"(?i)[?&](?:api_?key|token|secret)="), "paging": ~F.col("style").isin("none", "page", "offset", "cursor", "next_link"), "cost": F.col("cost") < 0, "ttl": F.col("ttl_days") <= 0}
    return specs.select("slug", F.explode(F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(True)), F.lit(n)) for n, c in faults.items()]))).alias("fault"))


def boundary(rows: DataFrame, type_name: str, key: str, label: str, attributes: list[str], edge: str, target: str) -> DataFrame:
    """Rows as an extraction is expected to look: (type_name, id, attributes, relationship) with sorted attributes as JSON."""
    cells = F.filter(F.array(*[F.struct(F.lit(a).alias("name"), F.trim(F.col(a).cast("string")).alias("value")) for a in sorted(attributes)]), lambda x: x["value"].isNotNull() & (x["value"] != ""))
    t = F.trim(F.col(edge).cast("string"))
    return rows.select(F.lit(type_name).alias("type_name"), safe_id(F.col(key)).alias("id"), F.trim(F.col(label)).alias("label"), F.to_json(cells).alias("attributes"), F.when(t != "", F.concat_ws("|", F.lit(edge), F.lit(target), safe_id(t))).alias("relationship"))


def captured(stages: dict[str, DataFrame]) -> DataFrame:
    """(stage, rows, digest) of a pipeline's outputs: the digest doesn't depend on the order of rows or partitions."""
    out = None
    for name, df in stages.items():
        row = F.to_json(F.struct(*sorted(df.columns)))
        one = df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.conv(F.substring(F.md5(row), 1, 8), 16, 10).cast("long")), F.lit(0)).alias("digest")).select(F.lit(name).alias("stage"), "rows", "digest")
        out = one if out is None else out.unionByName(one)
    return out


def anchors_by_label(quads: DataFrame, text: str, geometry: str) -> DataFrame:
    """(s, label, geom) of entities whose label holds a text and that have a geometry."""
    labels = quads.filter((F.col("p") == LABEL) & F.lower("o").contains(text.lower())).select("s", F.col("o").alias("label"))
    return labels.join(quads.filter(F.col("p") == geometry).select("s", F.col("o").alias("geom")), "s")


def minted(cells: DataFrame, target: str) -> DataFrame:
    """Facts of found values that name things: an edge to a node for each distinct name, its type and its label."""
    node = F.concat(F.lit(f"entities/{target}/"), safe_id(F.col("label")))
    named = cells.select("s", "p", F.explode(F.array_distinct(F.filter(F.transform(F.split("value", r"\s*[;|]\s*"), lambda x: F.trim(x)), lambda x: x != ""))).alias("label"))
    edges = named.select("s", F.concat(F.lit("onto/"), "p").alias("p"), node.alias("o"))
    stubs = named.groupBy(node.alias("s")).agg(F.min("label").alias("o"))
    return edges.unionByName(stubs.select("s", F.lit(LABEL).alias("p"), "o")).unionByName(stubs.select("s", F.lit(TYPE).alias("p"), F.lit(f"types/{target}").alias("o"))).distinct()
