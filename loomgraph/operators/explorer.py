"""What a browser of the graph asks for: catalogues, panels, totals, pages of records, searches; and guards on queries and answers."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..model import LABEL, SUBCLASS, TYPE

#: Name spaces and predicates that are housekeeping.
INTERNAL_SPACES = ("rdf:", "rdfs:", "er/", "onto/norm/", "validity/", "suppression/", "attr_meta/")
INTERNAL_MARKS = ("onto/batch_id", "onto/ingested_at", "onto/source", "onto/coreSlot", "onto/aliasOf", "onto/lambda_refreshed_at")
#: Words that make a query an update.
MUTATIONS = ("INSERT", "DELETE", "DROP", "CLEAR", "LOAD", "CREATE", "COPY", "MOVE", "ADD")


def is_internal(p: Column, edge: Column) -> Column:
    """Whether a predicate is housekeeping. The marks are always literal-valued, so an edge that bears the name of one is none."""
    space = F.lit(False)
    for s in INTERNAL_SPACES:
        space = space | p.startswith(s)
    return p.isNull() | (p == "") | space | (p.isin(*INTERNAL_MARKS) & ~edge)


def visible(quads: DataFrame) -> DataFrame:
    return quads.filter(~is_internal(F.col("p"), F.col("kind") == "iri"))


def catalogue(ontology: DataFrame, quads: DataFrame) -> DataFrame:
    """(type, label, parent, n_children, entities) of every declared type and of those that only instances name."""
    declared = ontology.filter((F.col("p") == TYPE) & (F.col("o") == "rdfs:Class")).select(F.col("s").alias("type"))
    used = quads.filter(F.col("p") == TYPE).groupBy(F.col("o").alias("type")).agg(F.count_distinct("s").alias("entities"))
    label = ontology.filter(F.col("p") == LABEL).groupBy(F.col("s").alias("type")).agg(F.min("o").alias("label"))
    up = ontology.filter(F.col("p") == SUBCLASS)
    parent = up.groupBy(F.col("s").alias("type")).agg(F.min("o").alias("parent"))
    children = up.groupBy(F.col("o").alias("type")).agg(F.count_distinct("s").alias("n_children"))
    out = declared.distinct().join(used, "type", "full_outer").join(label, "type", "left").join(parent, "type", "left").join(children, "type", "left")
    return out.select("type", "label", "parent", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.coalesce("entities", F.lit(0)).alias("entities"))


def usage_panel(quads: DataFrame, samples: int = 3) -> DataFrame:
    """(type, entities, samples): how often each type is used, and the first labels of its entities. Ranks are taken where labels are, so no type is gathered."""
    typed = quads.filter(F.col("p") == TYPE).select("s", F.col("o").alias("type"))
    labels = quads.filter(F.col("p") == LABEL).groupBy("s").agg(F.min("o").alias("label"))
    rows = typed.distinct().join(labels, "s", "left")
    first = rows.filter("label IS NOT NULL").select("type", "label", F.row_number().over(Window.partitionBy("type").orderBy("label", "s")).alias("i")).filter(F.col("i") <= samples)
    listed = first.groupBy("type").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "label"))), lambda x: x["label"]), "|").alias("samples"))
    return rows.groupBy("type").agg(F.count("*").alias("entities")).join(listed, "type", "left")


def summary_panel(quads: DataFrame, type_name: str) -> DataFrame:
    """(p, kind, entities, coverage, sample, target) of one type's attributes and relationships."""
    of = quads.filter((F.col("p") == TYPE) & (F.col("o") == type_name)).select("s").distinct()
    facts = visible(quads).join(of, "s", "left_semi")
    targets = quads.filter(F.col("p") == TYPE).groupBy(F.col("s").alias("o")).agg(F.min("o").alias("target"))
    rows = facts.join(targets, "o", "left")
    per = rows.groupBy("p").agg(F.when(F.count_if(F.col("kind") == "iri") > 0, "relationship").otherwise("attribute").alias("kind"), F.count_distinct("s").alias("entities"), F.min(F.when(F.col("kind") == "literal", F.col("o"))).alias("sample"), F.min("target").alias("target"))
    return per.crossJoin(of.agg(F.count("*").alias("_of"))).select("p", "kind", "entities", F.round(F.col("entities") / F.col("_of") * 100, 1).alias("coverage"), "sample", "target")


def totals(stats: DataFrame, entities: DataFrame) -> DataFrame:
    """One row: types, entities, attributes, relationships, facts, from the rows of graph_statistics and of type_counts."""
    s = stats.agg(F.count_distinct(F.when(F.col("edges") == 0, F.struct("type", "p"))).alias("attributes"), F.count_distinct(F.when(F.col("edges") > 0, F.struct("type", "p"))).alias("relationships"), F.sum("facts").alias("facts"))
    return s.crossJoin(entities.agg(F.count("*").alias("types"), F.sum("entities").alias("entities")))


def records_page(quads: DataFrame, type_name: str, columns: list[str], after: str | None = None, size: int = 50, most: int = 200, most_columns: int = 24) -> tuple[DataFrame, DataFrame]:
    """(page, total): entities of a type in order of their id, after a cursor, one column a predicate (the least value of several); the cursor of the next page is the last id. Only the page's facts are pivoted."""
    of = quads.filter((F.col("p") == TYPE) & (F.col("o") == type_name)).select("s").distinct()
    page = of.filter(F.col("s") > after) if after is not None else of
    page = page.orderBy("s").limit(min(size, most))
    facts = quads.join(page, "s", "left_semi").filter(F.col("p").isin(LABEL, *columns[:most_columns]))
    wide = facts.groupBy("s").agg(*[F.min(F.when(F.col("p") == p, F.col("o"))).alias(p.rsplit("/", 1)[-1]) for p in columns[:most_columns]], F.min(F.when(F.col("p") == LABEL, F.col("o"))).alias("label"))
    return page.join(wide, "s", "left").withColumn("next_cursor", F.max("s").over(Window.partitionBy(F.lit(0)))), of.agg(F.count("*").alias("total"))


def search_names(names: DataFrame, column: str, text: str, limit: int = 20) -> DataFrame:
    """Names that hold a text, whatever the case: those that begin with it first, then shorter ones."""
    low = F.lower(column)
    return names.filter(low.contains(text.lower())).orderBy(~low.startswith(text.lower()), F.length(column), column).limit(limit)


def unbound_columns(df: DataFrame) -> DataFrame:
    """(variable): columns without any value, if there are rows at all."""
    counts = df.agg(F.count("*").alias("_n"), *[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns])
    return counts.select("_n", F.inline(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(f"`{c}`").alias("k")) for c in df.columns]))).filter("_n > 0 AND k = 0").select("variable")


def truncated(df: DataFrame, order: list[str], cap: int = 100) -> DataFrame:
    """The first `cap` rows in order with the count of all, and whether some are left out: a bounded answer that says so."""
    return df.orderBy(*order).limit(cap).crossJoin(df.agg(F.count("*").alias("of"))).withColumn("cut", F.col("of") > cap)


def query_fault(c: Column) -> Column:
    """Why a query's text is no reading query: empty, an update, unbalanced braces; null if it may run."""
    plain = F.regexp_replace(c, r"\"(?:[^\"\\]|\\.)*\"|<[^<>\s]*>|#[^\n]*", " ")
    word = F.upper(F.regexp_extract(plain, r"(?i)\b(" + "|".join(MUTATIONS) + r")\b", 1))
    braces = F.length(F.regexp_replace(plain, r"[^{]", "")) != F.length(F.regexp_replace(plain, r"[^}]", ""))
    return F.when(c.isNull() | (F.trim(c) == ""), "empty").when(word != "", F.concat(F.lit("update: "), word)).when(braces, "unbalanced braces")


def ordered_query(text: str) -> str:
    """A plain SELECT with an order over its variables, so that what a limit leaves repeats; queries that are ordered, grouped, limited, star or computed stay as they are."""
    if re.search(r"\b(?:ORDER|GROUP)\s+BY\b|\bHAVING\b|\bLIMIT\b|\bOFFSET\b", text, re.I):
        return text
    m = re.search(r"\bSELECT\s+(?:DISTINCT\s+|REDUCED\s+)?(.*?)\s*\b(?:WHERE|FROM)\b", text, re.I | re.S)
    if not m or "*" in m[1] or "(" in m[1] or not (names := re.findall(r"[?$](\w+)", m[1])):
        return text
    return text.rstrip().rstrip(".") + "\nORDER BY " + " ".join(f"?{n}" for n in names)


def results_of_json(c: Column, variables: list[str]) -> list[Column]:
    """Columns to explode a results document (head.vars, results.bindings) into rows of text: `b` is one binding; unbound variables are null."""
    bindings = F.from_json(F.get_json_object(c, "$.results.bindings"), "array<map<string,struct<type:string,value:string>>>")
    return [F.explode(bindings).alias("b"), *[F.lit(v).alias(f"_{v}") for v in variables]]


def reading_predicates(quads: DataFrame, leaf: str) -> DataFrame:
    """Predicates whose last part is `leaf`, whatever the case."""
    return quads.select("p").distinct().filter(F.lower(F.substring_index("p", "/", -1)) == leaf.lower())
