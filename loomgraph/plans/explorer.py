"""Panels, pages, guards, invariants and decisions, beside SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..model import classes
from ..operators import explorer as ex, profile, quality
from ..runtime import table
from ..sparql import Engine
from .graph import CLASS_TREE, engine, graph, ontology, virtual


def type_catalogue(spark: SparkSession, root: str) -> DataFrame:
    extra = graph(spark, root).filter("p = 'rdf:type' AND s = 'entities/Region/0'").withColumn("o", F.lit("types/Undeclared"))
    return ex.catalogue(ontology(spark), graph(spark, root).unionByName(extra))


def type_usage(spark: SparkSession, root: str) -> DataFrame:
    return ex.usage_panel(graph(spark, root))


def type_summary(spark: SparkSession, root: str) -> DataFrame:
    """Attributes and relationships of customers, some of which lack a segment; housekeeping stays out."""
    q = graph(spark, root)
    q = q.filter(~((F.col("p") == "attrs/segment") & F.col("s").endswith("7")))
    marks = q.filter("p = 'rdf:type' AND o = 'types/Customer'").select("g", "s", F.lit("onto/batch_id").alias("p"), F.lit("b1").alias("o"), F.lit("literal").alias("kind"), F.lit("string").alias("dtype"))
    return ex.summary_panel(q.unionByName(marks), "types/Customer")


def graph_totals(spark: SparkSession, root: str) -> DataFrame:
    return ex.totals(profile.table_statistics(virtual(spark, root)), profile.type_counts(graph(spark, root)))


def records_page(spark: SparkSession, root: str) -> DataFrame:
    """A page of orders after a cursor, with the next cursor and the total."""
    page, total = ex.records_page(graph(spark, root), "types/Order", ["attrs/total", "attrs/status", "onto/customer"], "entities/Order/1000", 40)
    return page.crossJoin(total.select(F.col("total").alias("of"))).select("s", "of", "status", "customer", "label", "next_cursor")


def name_search(spark: SparkSession, root: str) -> DataFrame:
    return ex.search_names(table(spark, root, "attribute_declarations").select("name"), "name", "pe").select("name")


def unbound_variables(spark: SparkSession, root: str) -> DataFrame:
    q = "SELECT ?n ?l ?area WHERE { ?n a <types/Nation> ; rdfs:label ?l OPTIONAL { ?n <attrs/area> ?area } }"
    return ex.unbound_columns(engine(spark, root).query(q))


def truncated_answer(spark: SparkSession, root: str) -> DataFrame:
    """The first hundred rows of an answer that says how many there are; the query gets an order of its own."""
    text = ex.ordered_query("SELECT ?c ?s WHERE { ?c <attrs/segment> ?s }")
    return ex.truncated(engine(spark, root).query(text), ["c", "s"], 100)


def query_guard(spark: SparkSession, root: str) -> DataFrame:
    """Which texts may run as reading queries."""
    g = table(spark, root, "gold_questions").select("question_no", "gold_sparql")
    n = F.col("question_no") % 5
    text = F.when(n == 0, F.concat("gold_sparql", F.lit(" ; DROP GRAPH <g>"))).when(n == 1, F.concat(F.lit("{"), "gold_sparql")).when(n == 2, F.concat("gold_sparql", F.lit(' # "delete" in a note'))).when(n == 3, " ").otherwise(F.col("gold_sparql"))
    return g.select("question_no", ex.query_fault(text).alias("fault")).filter("question_no % 5 < 4 OR fault IS NULL")


def internal_predicates(spark: SparkSession, root: str) -> DataFrame:
    rows = [(p, e) for p in ("rdf:type", "rdfs:label", "onto/source", "onto/nation", "attrs/total", "er/blockKey", "onto/norm/x", "onto/batch_id", "validity/from", "suppression/mark", "attr_meta/a", "") for e in (True, False)]
    return spark.createDataFrame(rows, "p string, edge boolean").select("p", "edge", ex.is_internal(F.col("p"), F.col("edge")).alias("internal"))


def results_json(spark: SparkSession, root: str) -> DataFrame:
    """A results document read into rows; a variable that a row does not bind is null."""
    c = table(spark, root, "nation")
    b = F.map_from_entries(F.array_compact(F.array(F.struct(F.lit("n").alias("k"), F.struct(F.lit("uri").alias("type"), F.concat(F.lit("n/"), "n_nationkey").alias("value")).alias("v")), F.when(F.col("n_nationkey") % 2 == 0, F.struct(F.lit("l").alias("k"), F.struct(F.lit("literal").alias("type"), F.col("n_name").alias("value")).alias("v"))))))
    doc = c.groupBy("n_regionkey").agg(F.to_json(F.struct(F.struct(F.array(F.lit("n"), F.lit("l")).alias("vars")).alias("head"), F.struct(F.collect_list(b).alias("bindings")).alias("results"))).alias("j"))
    rows = doc.select("n_regionkey", ex.results_of_json(F.col("j"), [])[0])
    return rows.select("n_regionkey", F.col("b")["n"]["value"].alias("n"), F.col("b")["l"]["value"].alias("l"))


def scope_predicates(spark: SparkSession, root: str) -> DataFrame:
    """Predicates of a leaf whatever its case, and how many entities have it."""
    q = graph(spark, root)
    p = ex.reading_predicates(q, "NATION").unionByName(ex.reading_predicates(q, "Status"))
    return q.join(F.broadcast(p.limit(100)), "p", "left_semi").groupBy("p").agg(F.count_distinct("s").alias("entities"))


def _flawed(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """A graph with flaws of each kind, and the declarations of its relationships."""
    q = graph(spark, root)
    at = lambda where, **new: q.filter(where).withColumns({k: F.lit(v) for k, v in new.items()})
    flaws = at("p = 'onto/nation' AND s LIKE 'entities/Customer/%5'", p="attrs/nation").unionByName(at("p = 'attrs/segment' AND s LIKE 'entities/Customer/%1'", p="onto/nation")).unionByName(at("p = 'onto/nation' AND s LIKE 'entities/Supplier/%2'", o="entities/Region/1")).unionByName(at("p = 'onto/nation' AND s LIKE 'entities/Supplier/%3'", o="entities/Nation/999"))
    kept = q.filter("NOT (p = 'rdf:type' AND s = 'entities/Nation/7') AND NOT (p = 'rdfs:label' AND s LIKE 'entities/Nation/%')")
    ranges = [("ontology", f"types/{t}/attrs/nation", "rdfs:range", r, "iri", None) for t, r in (("Customer", "types/Place"), ("Supplier", "types/Nation"), ("Supplier", "types/Order"))]
    return kept.unionByName(flaws), classes(spark, CLASS_TREE).unionByName(spark.createDataFrame(ranges, "g string, s string, p string, o string, kind string, dtype string"))


def invariant_attribute_edge(spark: SparkSession, root: str) -> DataFrame:
    return quality.edges_on_attributes(_flawed(spark, root)[0])


def invariant_wrong_target(spark: SparkSession, root: str) -> DataFrame:
    """Suppliers that point at a region, where a nation or an order is declared; customers may point at any place."""
    return quality.wrong_targets(*_flawed(spark, root))


def invariant_declared_literal(spark: SparkSession, root: str) -> DataFrame:
    return quality.literals_on_relationships(*_flawed(spark, root))


def audit_report(spark: SparkSession, root: str) -> DataFrame:
    return quality.audit(*_flawed(spark, root))


def failure_classes(spark: SparkSession, root: str) -> DataFrame:
    g = table(spark, root, "gold_questions")
    n = F.col("question_no") % 8
    answer = F.when(n == 0, "a|b").when(n == 1, "No results found.").when(n == 2, F.concat((F.col("full_result_count") / 4).cast("string"), F.lit(" rows"))).otherwise("fine")
    category = F.when(n == 3, "wrong_filter").when(n == 4, "uri_instead_of_value").otherwise("none")
    explanation = F.when(n == 5, "Case mismatch in names").otherwise("")
    f = quality.failure_class(F.col("full_result_count").cast("string"), answer, F.when(n != 6, F.col("gold_sparql")), category, explanation)
    return g.select(f.alias("f")).groupBy("f.layer", "f.kind").agg(F.count("*").alias("n"))


def _verdicts(spark: SparkSession, root: str) -> DataFrame:
    e = table(spark, root, "events")
    return e.select("user_id", F.col("event_type").alias("value"), F.concat(F.lit("p"), F.col("event_id") % 4).alias("provider"), F.col("event_id").alias("chain"), (F.col("event_id") % 100 / 100.0).alias("confidence"))


def best_verdicts(spark: SparkSession, root: str) -> DataFrame:
    """The best found value of each user, against what is there, and what a careful policy writes."""
    old = table(spark, root, "customer").filter("c_custkey % 3 > 0").select(F.col("c_custkey").alias("user_id"), F.when(F.col("c_custkey") % 3 == 1, "CLICK").otherwise("re-view it").alias("value"))
    return quality.write_set(quality.best_verdicts(_verdicts(spark, root), old, ["user_id"], 0.9), "verify")


def provider_tally(spark: SparkSession, root: str) -> DataFrame:
    """How often each provider of a chain is asked until a verdict comes, and how often it answers."""
    return quality.first_verdicts(_verdicts(spark, root), ["user_id"], 0.9)[1]


def chain_costs(spark: SparkSession, root: str) -> DataFrame:
    m = table(spark, root, "llm_models")
    return quality.chain_cost(m.select(F.col("model_id").alias("provider"), F.col("input_price").alias("price")), m.select(F.col("organization").alias("tier"), F.when(F.col("open_source"), F.concat("model_id", F.lit("?"))).otherwise(F.col("model_id")).alias("provider")))


def lookup_tiers(spark: SparkSession, root: str) -> DataFrame:
    d = table(spark, root, "attribute_declarations").groupBy("datatype").agg(F.sort_array(F.collect_list("name")).alias("names"))
    return d.select("datatype", quality.tier_of(F.col("names"), ["website", "phone"], ["location", "menu_url"]).alias("tier"))


def halt_reasons(spark: SparkSession, root: str) -> DataFrame:
    e = table(spark, root, "events")
    status = F.element_at(F.array(*[F.lit(x) for x in (200, 402, 401, 429, 500, 200)]), (F.col("event_id") % 6 + 1).cast("int"))
    return e.groupBy(quality.halt_reason(status, F.col("user_id") % 2 == 0, F.col("event_id") % 7 == 0, F.col("value"), 60.0).alias("reason")).agg(F.count("*").alias("n"))


def text_candidates(spark: SparkSession, root: str) -> DataFrame:
    """Columns whose values read as free text, by their shape and mean length alone."""
    d = profile.text_candidacy(table(spark, root, "documents").select("text", "source", "lang"), ["text", "source", "lang"])
    return d.unionByName(profile.text_candidacy(table(spark, root, "clinical_trials"), ["title", "condition", "sponsor", "nct_id"]))


def drift_history(spark: SparkSession, root: str) -> DataFrame:
    """Reports of three dates, each appended to those before, the newest two read first."""
    o = table(spark, root, "orders")
    log = None
    for day in ("1996-01-01", "1998-01-01", "2000-01-01"):
        one = o.filter(F.col("o_orderdate") < F.lit(day).cast("timestamp")).agg(F.count("*").alias("facts"), F.count_if(F.col("o_orderstatus") == "P").alias("quarantined")).withColumn("taken", F.lit(day))
        log = one if log is None else log.unionByName(one)
    return log.orderBy(F.desc("taken")).limit(2)


def declared_instances(spark: SparkSession, root: str) -> DataFrame:
    """A summary of types from their instances, where no schema is declared: predicates by type with datatype and target."""
    q = ex.visible(graph(spark, root))
    t = profile.primary_types(graph(spark, root))
    targets = t.select(F.col("s").alias("o"), F.col("type").alias("target"))
    return q.join(t, "s").join(targets, "o", "left").groupBy("type", "p").agg(F.coalesce(F.max("dtype"), F.max("target")).alias("range"))


def computed_key_join(spark: SparkSession, root: str) -> DataFrame:
    """Edges joined to declarations by a key made of the subject's type and the predicate."""
    q, onto = _flawed(spark, root)
    text = "SELECT ?d (COUNT(*) AS ?n) WHERE { ?s a ?t ; <onto/nation> ?o BIND(IRI(CONCAT(STR(?t), \"/attrs/nation\")) AS ?d) ?d <rdfs:range> ?r } GROUP BY ?d"
    return Engine(q.unionByName(onto)).query(text.replace("<rdfs:range>", "rdfs:range"))


QUERIES = {f.__name__: f for f in (type_catalogue, type_usage, type_summary, graph_totals, records_page, name_search, unbound_variables, truncated_answer, query_guard, internal_predicates, results_json, scope_predicates, invariant_attribute_edge, invariant_wrong_target, invariant_declared_literal, audit_report, failure_classes, best_verdicts, provider_tally, chain_costs, lookup_tiers, halt_reasons, text_candidates, drift_history, declared_instances, computed_key_join)}

_TREE = " UNION ALL ".join(f"SELECT '{c}' AS c, {repr(p) if p else 'NULL'} AS p" for c, p in CLASS_TREE)
_N = "(SELECT 'Customer' AS t, count(*) AS n FROM customer UNION ALL SELECT 'Supplier', count(*) FROM supplier UNION ALL SELECT 'Nation', count(*) FROM nation UNION ALL SELECT 'Region', count(*) FROM region UNION ALL SELECT 'Order', count(*) FROM orders)"
_SHAPES = lambda t, c: f"SELECT '{c}' AS name, CASE WHEN avg(CASE WHEN regexp_matches(v, '^\\d{{4}}-\\d{{1,2}}-\\d{{1,2}}') THEN 1 ELSE 0 END) > 0.8 OR avg(CASE WHEN TRY_CAST(v AS DOUBLE) IS NOT NULL THEN 1 ELSE 0 END) > 0.8 OR (avg(CASE WHEN regexp_matches(v, '^[A-Za-z0-9][A-Za-z0-9._/-]*$') THEN 1 ELSE 0 END) > 0.9 AND avg(length(v)) <= 24) THEN 'none' WHEN avg(CASE WHEN regexp_matches(v, '\\s') THEN 1 ELSE 0 END) > 0.5 AND avg(length(v)) > 25 THEN CASE WHEN avg(length(v)) >= 120 THEN 'free_text' ELSE 'ambiguous' END ELSE 'none' END AS candidacy FROM (SELECT trim({c}) AS v FROM {t} WHERE trim({c}) <> '')"
_WRONG = "SELECT 'entities/Supplier/' || s_suppkey AS s, 'onto/nation' AS p, 'entities/Region/1' AS o FROM supplier WHERE s_suppkey % 10 = 2"
_ATTR = "SELECT 'entities/Customer/' || c_custkey AS s, 'attrs/nation' AS p, 'entities/Nation/' || c_nationkey AS o FROM customer WHERE c_custkey % 10 = 5"
_LIT = "SELECT 'entities/Customer/' || c_custkey AS s, 'onto/nation' AS p, c_mktsegment AS o FROM customer WHERE c_custkey % 10 = 1"
_V = "(SELECT user_id, event_type AS value, 'p' || event_id % 4 AS provider, event_id AS chain, event_id % 100 / 100.0 AS confidence FROM events)"
ORACLE = {
    "type_catalogue": f"WITH t AS ({_TREE}), k AS (SELECT p, count(*) AS n FROM t WHERE p IS NOT NULL GROUP BY 1) SELECT 'types/' || t.c AS type, t.c AS label, 'types/' || t.p AS parent, coalesce(k.n, 0) AS n_children, coalesce(i.n, 0) AS entities FROM t LEFT JOIN k ON k.p = t.c LEFT JOIN {_N} i ON i.t = t.c UNION ALL SELECT 'types/Undeclared', NULL, NULL, 0, 1",
    "type_usage": "WITH x AS (SELECT 'Customer' AS t, c_name AS l FROM customer UNION ALL SELECT 'Supplier', s_name FROM supplier UNION ALL SELECT 'Nation', n_name FROM nation UNION ALL SELECT 'Region', r_name FROM region UNION ALL SELECT 'Order', NULL FROM orders), f AS (SELECT t, l FROM x WHERE l IS NOT NULL QUALIFY row_number() OVER (PARTITION BY t ORDER BY l) <= 3), s AS (SELECT t, string_agg(l, '|' ORDER BY l) AS samples FROM f GROUP BY 1) SELECT 'types/' || x.t AS type, count(*) AS entities, any_value(samples) AS samples FROM x LEFT JOIN s ON s.t = x.t GROUP BY 1",
    "type_summary": "SELECT unnest(['attrs/acctbal', 'attrs/segment', 'onto/nation']) AS p, unnest(['attribute', 'attribute', 'relationship']) AS kind, unnest([count(*), count(*) FILTER (c_custkey % 10 <> 7), count(*)]) AS entities, unnest([100.0, round(count(*) FILTER (c_custkey % 10 <> 7) / count(*) * 100, 1), 100.0]) AS coverage, unnest([min(CAST(c_acctbal AS VARCHAR)), min(c_mktsegment) FILTER (c_custkey % 10 <> 7), NULL]) AS sample, unnest([NULL, NULL, 'types/Nation']) AS target FROM customer",
    "graph_totals": "SELECT 7 AS attributes, 4 AS relationships, (SELECT count(*) FROM customer) * 3 + (SELECT count(*) FROM supplier) * 2 + (SELECT count(*) FROM nation) + (SELECT count(*) FROM orders) * 5 AS facts, 5 AS types, (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM region) + (SELECT count(*) FROM orders) AS entities",
    "records_page": "WITH p AS (SELECT 'entities/Order/' || o_orderkey AS s, * FROM orders WHERE 'entities/Order/' || o_orderkey > 'entities/Order/1000' ORDER BY s LIMIT 40) SELECT s, (SELECT count(*) FROM orders) AS of, o_orderstatus AS status, 'entities/Customer/' || o_custkey AS customer, CAST(NULL AS VARCHAR) AS label, max(s) OVER () AS next_cursor FROM p",
    "name_search": "SELECT name FROM attribute_declarations WHERE contains(lower(name), 'pe') ORDER BY NOT starts_with(lower(name), 'pe'), length(name), name LIMIT 20",
    "unbound_variables": "SELECT 'area' AS variable",
    "truncated_answer": "SELECT 'entities/Customer/' || c_custkey AS c, c_mktsegment AS s, (SELECT count(*) FROM customer) AS of, (SELECT count(*) FROM customer) > 100 AS cut FROM customer ORDER BY c, s LIMIT 100",
    "query_guard": "SELECT question_no, CASE question_no % 5 WHEN 0 THEN CASE WHEN gold_sparql IS NULL THEN 'empty' ELSE 'update: DROP' END WHEN 1 THEN CASE WHEN gold_sparql IS NULL THEN 'empty' ELSE 'unbalanced braces' END WHEN 2 THEN CASE WHEN gold_sparql IS NULL THEN 'empty' END WHEN 3 THEN 'empty' END AS fault FROM gold_questions WHERE question_no % 5 < 4 OR gold_sparql IS NOT NULL",
    "internal_predicates": "WITH p AS (SELECT unnest(['rdf:type', 'rdfs:label', 'onto/source', 'onto/nation', 'attrs/total', 'er/blockKey', 'onto/norm/x', 'onto/batch_id', 'validity/from', 'suppression/mark', 'attr_meta/a', '']) AS p) SELECT p, edge, CASE WHEN p IN ('onto/nation', 'attrs/total') THEN false WHEN p IN ('onto/source', 'onto/batch_id') THEN NOT edge ELSE true END AS internal FROM p, (SELECT unnest([true, false]) AS edge)",
    "results_json": "SELECT n_regionkey, 'n/' || n_nationkey AS n, CASE WHEN n_nationkey % 2 = 0 THEN n_name END AS l FROM nation",
    "scope_predicates": "SELECT 'onto/nation' AS p, (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) AS entities UNION ALL SELECT 'attrs/status', count(*) FROM orders",
    "invariant_attribute_edge": _ATTR,
    "invariant_wrong_target": _WRONG,
    "invariant_declared_literal": _LIT,
    "audit_report": f"SELECT 'edge_on_attribute' AS invariant, 'error' AS severity, count(*) AS violations, min(s || ' ' || p || ' ' || o) AS sample FROM ({_ATTR}) UNION ALL SELECT 'literal_on_relationship', 'error', count(*), min(s || ' ' || p || ' ' || o) FROM ({_LIT}) UNION ALL SELECT 'wrong_target', 'error', count(*), min(s || ' ' || p || ' ' || o) FROM ({_WRONG}) UNION ALL SELECT 'untyped_node', 'error', count(*), min(x) FROM (SELECT 'entities/Nation/7' AS x WHERE EXISTS (SELECT 1 FROM customer WHERE c_nationkey = 7) UNION SELECT 'entities/Nation/999' FROM supplier WHERE s_suppkey % 10 = 3) UNION ALL SELECT 'unlabelled_node', 'warn', count(*), min(x) FROM (SELECT 'entities/Nation/' || n_nationkey AS x FROM nation WHERE n_nationkey <> 7 UNION ALL SELECT 'entities/Order/' || o_orderkey FROM orders)",
    "failure_classes": """WITH c AS (SELECT question_no % 8 AS n, full_result_count AS k, gold_sparql AS q, CASE WHEN full_result_count > 0 THEN TRY_CAST(regexp_extract(CAST(full_result_count / 4 AS VARCHAR), '[0-9]+\\.?[0-9]*') AS DOUBLE) / full_result_count END AS ratio FROM gold_questions),
        f AS (SELECT CASE WHEN n = 0 THEN 'ingestion' WHEN n = 2 AND ratio > 0 AND ratio < 0.5 THEN 'ingestion' WHEN n = 5 THEN 'ingestion' WHEN n IN (1, 3, 4) THEN 'query' WHEN n = 6 OR q IS NULL OR length(trim(q)) < 20 THEN 'query' END AS layer, CASE WHEN n = 0 THEN 'pipe_splitting' WHEN n = 2 AND ratio > 0 AND ratio < 0.5 THEN 'missing_data' WHEN n = 5 THEN 'normalization' WHEN n = 3 THEN 'wrong_filter' WHEN n = 1 THEN 'empty_result' WHEN n = 4 THEN 'uri_instead_of_value' WHEN n = 6 OR q IS NULL OR length(trim(q)) < 20 THEN 'generation_failure' END AS kind FROM c)
        SELECT layer, kind, count(*) AS n FROM f GROUP BY 1, 2""",
    "best_verdicts": f"WITH b AS (SELECT * FROM {_V} WHERE confidence >= 0.9 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY confidence DESC, chain) = 1), o AS (SELECT c_custkey AS user_id, CASE WHEN c_custkey % 3 = 1 THEN 'click' ELSE 're-view it' END AS old FROM customer WHERE c_custkey % 3 > 0), a AS (SELECT user_id, value, CAST(confidence AS DOUBLE) AS confidence, CASE WHEN old IS NULL THEN 'fill' WHEN contains(old, value) OR contains(value, old) THEN 'verify' ELSE 'conflict' END AS action FROM b LEFT JOIN o USING (user_id)) SELECT *, action <> 'conflict' AS written FROM a",
    "provider_tally": f"WITH s AS (SELECT user_id, min(chain) FILTER (confidence >= 0.9) AS stop FROM {_V} GROUP BY 1) SELECT provider, count(*) AS asked, count(*) FILTER (confidence >= 0.9) AS answered FROM {_V} v JOIN s USING (user_id) WHERE stop IS NULL OR chain <= stop GROUP BY 1",
    "chain_costs": "SELECT organization AS tier, round(sum(CASE WHEN open_source THEN 0 ELSE input_price END), 4) AS cost, count(*) FILTER (NOT open_source AND input_price > 0) AS paid FROM llm_models GROUP BY 1",
    "lookup_tiers": "SELECT datatype, CASE WHEN bool_or(name IN ('website', 'phone')) THEN 'core' WHEN bool_and(name IN ('location', 'menu_url')) THEN 'lite' ELSE 'core' END AS tier FROM attribute_declarations GROUP BY 1",
    "halt_reasons": "SELECT CASE WHEN value > 60 THEN 'cost_ceiling' WHEN event_id % 6 = 1 THEN 'billing' WHEN event_id % 6 = 3 AND user_id % 2 = 0 THEN 'rate_limit' WHEN event_id % 6 = 2 THEN 'auth' WHEN event_id % 7 = 0 THEN 'timeout' WHEN event_id % 6 = 4 THEN 'error' END AS reason, count(*) AS n FROM events GROUP BY 1",
    "text_candidates": " UNION ALL ".join(_SHAPES(t, c) for t, c in (("documents", "text"), ("documents", "source"), ("documents", "lang"), ("clinical_trials", "title"), ("clinical_trials", "condition"), ("clinical_trials", "sponsor"), ("clinical_trials", "nct_id"))),
    "drift_history": "SELECT count(*) AS facts, count(*) FILTER (o_orderstatus = 'P') AS quarantined, '2000-01-01' AS taken FROM orders WHERE o_orderdate < TIMESTAMP '2000-01-01' UNION ALL SELECT count(*), count(*) FILTER (o_orderstatus = 'P'), '1998-01-01' FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01'",
    "declared_instances": "SELECT 'types/' || unnest(['Customer', 'Customer', 'Customer', 'Supplier', 'Supplier', 'Nation', 'Order', 'Order', 'Order', 'Order', 'Order']) AS type, unnest(['attrs/acctbal', 'attrs/segment', 'onto/nation', 'attrs/acctbal', 'onto/nation', 'onto/region', 'attrs/total', 'attrs/status', 'attrs/date', 'attrs/priority', 'onto/customer']) AS p, unnest(['float', 'string', 'types/Nation', 'float', 'types/Nation', 'types/Region', 'float', 'string', 'datetime', 'string', 'types/Customer']) AS range FROM (SELECT min(c_custkey) FROM customer)",
    "computed_key_join": "SELECT 'types/Customer/attrs/nation' AS d, count(*) + count(*) FILTER (c_custkey % 10 = 1) AS n FROM customer UNION ALL SELECT 'types/Supplier/attrs/nation', 2 * (count(*) + count(*) FILTER (s_suppkey % 10 IN (2, 3))) FROM supplier",
}
