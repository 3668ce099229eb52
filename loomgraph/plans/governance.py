"""Rules, layers, contracts and plans, beside SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..operators import facts, governance as gv, index
from ..runtime import shared_dir, table
from .graph import CLASS_TREE, engine, graph, ontology


def gazetteer_load(spark: SparkSession, root: str) -> DataFrame:
    """Places written and read as compressed, tab-separated text without a header."""
    path = f"{shared_dir(spark)}/places-{uuid.uuid4().hex}"
    table(spark, root, "spatial_anchors").filter("lon IS NOT NULL AND lat IS NOT NULL").select("anchor_id", "kind", "lat", "lon").write.option("sep", "\t").option("compression", "gzip").csv(path)
    return spark.read.schema("place bigint, kind string, lat double, lon double").option("sep", "\t").csv(path).groupBy("kind").agg(F.count("*").alias("n"), F.round(F.avg("lat"), 6).alias("lat"), F.round(F.avg("lon"), 6).alias("lon"))


def graph_list(spark: SparkSession, root: str) -> DataFrame:
    """Graphs with their entities and facts after one is made by copying and another is taken out."""
    q = graph(spark, root)
    both = q.unionByName(q.filter("s LIKE 'entities/Region/%'").withColumn("g", F.lit("regions"))).unionByName(q.filter("p = 'onto/region'").withColumn("g", F.lit("gone")))
    return both.filter("g <> 'gone'").groupBy("g").agg(F.count("*").alias("facts"), F.count_distinct("s").alias("entities"), F.count_distinct(F.when(F.col("p") == "rdf:type", F.col("o"))).alias("types"))


def typed_hits(spark: SparkSession, root: str) -> DataFrame:
    """Chunks found by a word, those about one type of entity only, by the type that lies in their attributes."""
    c = table(spark, root, "entity_semantic_chunk").filter(F.lower("chunk_text").contains("revenue"))
    return c.filter(F.lower(F.trim(F.get_json_object("attrs", "$.type"))) == "filing").select("chunk_id")


def migration_plan(spark: SparkSession, root: str) -> DataFrame:
    d = table(spark, root, "attribute_declarations").select("type_name", "name")
    more = d.filter("length(name) < 7").select("type_name", F.concat("name", F.lit("_verified_at"))).union(d.filter("length(name) > 15").select("type_name", F.concat(F.lit("lost_"), "name", F.lit("_provenance"))))
    return gv.migration_plan(d.union(more), "type_name", "name")


def taxonomy_names(spark: SparkSession, root: str) -> DataFrame:
    """Conditions of trials under the names of a taxonomy, by synonyms whatever their case."""
    t = table(spark, root, "clinical_trials").filter("condition IS NOT NULL")
    synonyms = t.select(F.lower(F.trim("condition")).alias("k")).distinct().withColumn("name", F.initcap("k"))
    return t.join(synonyms, F.lower(F.trim("condition")) == F.col("k")).groupBy("name").agg(F.count("*").alias("n"))


def extraction_constraint(spark: SparkSession, root: str) -> DataFrame:
    """Cells of shops by whether their attribute is allowed, and required ones that are missing."""
    s = table(spark, root, "coffee_shops").filter("id IS NOT NULL AND type_name IS NOT NULL").select(F.col("row_no").alias("entity"), F.col("type_name").alias("type"), F.explode("attributes").alias("a")).select("entity", "type", F.regexp_replace(F.lower("a.name"), "[^a-z]", "").alias("name"), F.col("a.value").alias("value"))
    allowed = spark.createDataFrame([("CoffeeShop", n) for n in ("rating", "name", "phone", "address")], "type string, name string")
    return gv.constrained(s, allowed, spark.createDataFrame([("CoffeeShop", "name")], "type string, name string")).groupBy("type", "state").agg(F.count("*").alias("n"))


def source_batches(spark: SparkSession, root: str) -> DataFrame:
    h = table(spark, root, "healthcare_providers").select("feed", "record_id")
    return gv.source_batches(h, "feed", ["record_id"], 100).groupBy("feed", "batch").agg(F.count("*").alias("n"), F.max("record_id").alias("last"))


def rule_states(spark: SparkSession, root: str) -> DataFrame:
    e = table(spark, root, "events").select((F.col("event_id") % 700).alias("rule"), F.when(F.col("event_type") == "signup", "suggested").when(F.col("event_type") == "click", "confirmed").when(F.col("event_type") == "purchase", "applied").otherwise("rejected").alias("step"), "event_id")
    return gv.rule_states(e, "rule", "step", ["event_id"]).groupBy("step").agg(F.count("*").alias("rules"), F.sum("refused").alias("refused"))


def merged_identities(spark: SparkSession, root: str) -> DataFrame:
    """Nations that are the same as the next one in their region: facts about one name for all."""
    n = table(spark, root, "nation")
    links = n.select(F.concat(F.lit("entities/Nation/"), "n_nationkey").alias("o"), F.concat(F.lit("entities/Nation/"), F.lag("n_nationkey").over(Window.partitionBy("n_regionkey").orderBy("n_nationkey"))).alias("s")).filter("s IS NOT NULL")
    q = graph(spark, root).filter("s LIKE 'entities/Nation/%' OR p = 'onto/nation'")
    q = q.unionByName(links.select(F.lit("kg").alias("g"), "s", F.lit("owl:sameAs").alias("p"), "o", F.lit("iri").alias("kind"), F.lit(None).cast("string").alias("dtype")))
    return gv.merged_identities(q).groupBy("p").agg(F.count("*").alias("n"), F.count_distinct("s").alias("subjects"), F.count_distinct("o").alias("objects"))


def indirect_types(spark: SparkSession, root: str) -> DataFrame:
    """A type named by VALUES or a filter counts all below it, as one named in a pattern does."""
    e = engine(spark, root).with_subclasses(ontology(spark))
    a = e.query("SELECT ?t (COUNT(?x) AS ?n) WHERE { VALUES ?t { <types/Party> <types/Place> } ?x a ?t } GROUP BY ?t")
    return a.unionByName(e.query("SELECT ?t (COUNT(?x) AS ?n) WHERE { ?x a ?t FILTER(?t = <types/Thing>) } GROUP BY ?t"))


def template_function(spark: SparkSession, root: str) -> DataFrame:
    """A function of an entity given as a query with a gap: how many customers a nation has and what they hold."""
    text = "SELECT (COUNT(?c) AS ?n) (SUM(?b) AS ?held) WHERE { ?c <onto/nation> <${entity}> ; <attrs/acctbal> ?b }"
    e = engine(spark, root)
    parts = [e.query(text.replace("${entity}", f"entities/Nation/{k}")).withColumn("entity", F.lit(f"entities/Nation/{k}")) for k in (1, 2)]
    return parts[0].unionByName(parts[1]).select("entity", "n", F.round("held", 2).alias("held"))


def layered_parents(spark: SparkSession, root: str) -> DataFrame:
    base = spark.createDataFrame([(c, p, 2) for c, p in CLASS_TREE if p], "child string, parent string, layer int")
    over = table(spark, root, "region").select(F.lit("Nation").alias("child"), F.col("r_name").alias("parent"), F.lit(1).alias("layer"))
    return gv.layered_parents(base.unionByName(over), "layer")


def binding_attributes(spark: SparkSession, root: str) -> DataFrame:
    q = graph(spark, root)
    b = gv.binding_attributes(q, q.filter("p = 'attrs/segment' AND o = 'BUILDING'"), ["attrs/segment", "rdfs:label", "attrs/none"])
    return b.select("s", F.col("attributes")["rdfs:label"].alias("label"), F.size("attributes").alias("n"))


def header_chunks(spark: SparkSession, root: str) -> DataFrame:
    chunks = gv.header_chunks(table(spark, root, "healthcare_providers").columns, ["record_id"], 4)
    return spark.createDataFrame([(i, c) for i, cs in enumerate(chunks) for c in cs], "chunk int, name string")


def record_chunks(spark: SparkSession, root: str) -> DataFrame:
    """Documents by chunks that fit a budget of tokens: none is lost, only long ones stand alone."""
    d = table(spark, root, "documents").filter("text IS NOT NULL").select("doc_id", F.ceil(F.length("text") / 4.0).alias("tokens"))
    return gv.record_chunks(d, ["doc_id"], F.col("tokens"), 2_000).groupBy(F.col("chunk").startswith("alone").alias("alone")).agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"))


def independent_evidence(spark: SparkSession, root: str) -> DataFrame:
    """Trials' conditions that stand in titles of other sponsors' rows of the same trial."""
    t = table(spark, root, "clinical_trials").filter("nct_id IS NOT NULL AND sponsor IS NOT NULL")
    own = t.groupBy("nct_id").agg(F.min_by("condition", "trial_row").alias("condition"), F.min_by("sponsor", "trial_row").alias("sponsor")).filter("condition IS NOT NULL")
    pages = t.filter("title IS NOT NULL").select("nct_id", "sponsor", F.col("title").alias("page"))
    return gv.independent_evidence(own, pages, "nct_id", "condition", "sponsor")


def watch_cells(spark: SparkSession, root: str) -> DataFrame:
    """The snapshot of a watch: cells put together into one query, values of each entity joined."""
    e = engine(spark, root).query(gv.watch_query(["entities/Nation/1", "entities/Customer/7", "entities/Nation/none"], ["rdfs:label", "attrs/segment", "onto/region"]))
    return facts.snapshot(e, "key", "value")


def contract_faults(spark: SparkSession, root: str) -> DataFrame:
    return gv.contract_faults(table(spark, root, "coffee_shops")).groupBy("fault").agg(F.count("*").alias("n"))


def spec_faults(spark: SparkSession, root: str) -> DataFrame:
    m = table(spark, root, "llm_models")
    k = F.col("open_source")
    s = m.select(F.when(k, F.upper("model_id")).otherwise(F.col("model_id")).alias("slug"), F.concat(F.when(F.col("input_price") > 3, "http").otherwise("https"), F.lit("://api.graph.org/v1"), F.when(F.col("modality") == "text", "?token=x").otherwise("")).alias("url"), F.when(F.col("output_price") > 9, "scroll").otherwise("page").alias("style"), (F.col("input_price") - 1).alias("cost"), F.col("context_length").alias("ttl_days"))
    return gv.spec_faults(s).groupBy("fault").agg(F.count("*").alias("n"))


def boundary_rows(spark: SparkSession, root: str) -> DataFrame:
    return gv.boundary(table(spark, root, "nation"), "Nation", "n_nationkey", "n_name", ["n_name", "n_regionkey"], "n_regionkey", "Region")


def captured_stages(spark: SparkSession, root: str) -> DataFrame:
    """A capture repeats whatever the order of rows; another row shows."""
    n = table(spark, root, "nation").select("n_nationkey", "n_name")
    c = gv.captured({"a": n, "b": n.orderBy(F.desc("n_name")).repartition(3), "c": n.filter("n_nationkey > 0"), "d": n.limit(0)})
    digest = c.filter("stage = 'a'").select(F.col("digest").alias("_a"))
    return c.crossJoin(digest).select("stage", "rows", (F.col("digest") == F.col("_a")).alias("same"))


def label_anchors(spark: SparkSession, root: str) -> DataFrame:
    q = graph(spark, root)
    placed = q.filter("p = 'rdfs:label' AND s LIKE 'entities/Nation/%'").withColumn("p", F.lit("attrs/geom")).withColumn("o", F.concat(F.lit("POINT("), F.length("o").cast("string"), F.lit(" 1)")))
    return gv.anchors_by_label(q.unionByName(placed.filter("s NOT LIKE '%5'")), "1", "attrs/geom")


def minted_nodes(spark: SparkSession, root: str) -> DataFrame:
    p = table(spark, root, "part").select(F.concat(F.lit("entities/Part/"), "p_partkey").alias("s"), F.lit("mark").alias("p"), F.concat_ws(" ; ", "p_brand", "p_type", "p_brand").alias("value"))
    return gv.minted(p, "Mark").groupBy("p").agg(F.count("*").alias("n"), F.count_distinct("o").alias("objects"))


def subset_entities(spark: SparkSession, root: str) -> DataFrame:
    """Entities that an answer names, in the order in which they come, each once."""
    rows = engine(spark, root).query("SELECT ?o ?c WHERE { ?o <onto/customer> ?c ; <attrs/total> ?t FILTER(?t > 440000) }")
    e = rows.select(F.posexplode(F.array("o", "c")).alias("i", "s"), F.col("o").alias("k"))
    return e.groupBy("s").agg(F.min(F.struct("k", "i")).alias("first")).orderBy("first").limit(50).select("s")


def removed_documents(spark: SparkSession, root: str) -> DataFrame:
    """The index without all chunks of some documents, by entity and attribute."""
    c = table(spark, root, "entity_semantic_chunk").select("entity_uri", "attr", "chunk_id")
    gone = c.filter("chunk_id % 10 = 3").select("entity_uri", "attr")
    return index.replace_documents(c, gone.withColumn("chunk_id", F.lit(None).cast("long")), ["entity_uri", "attr"]).filter("chunk_id IS NOT NULL").groupBy("attr").agg(F.count("*").alias("n"))


def derived_values(spark: SparkSession, root: str) -> DataFrame:
    """Stored sums of customers with those of one segment computed anew, each replaced as a whole."""
    o = table(spark, root, "orders")
    stored = o.filter("o_orderdate < '1998-01-01'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.round(F.sum("o_totalprice"), 2).alias("v"))
    again = o.join(table(spark, root, "customer").filter("c_mktsegment = 'BUILDING'"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("v"))
    return index.replace_documents(stored, again, ["c_custkey"])


QUERIES = {f.__name__: f for f in (gazetteer_load, graph_list, typed_hits, migration_plan, taxonomy_names, extraction_constraint, source_batches, rule_states, merged_identities, indirect_types, template_function, layered_parents, binding_attributes, header_chunks, record_chunks, independent_evidence, watch_cells, contract_faults, spec_faults, boundary_rows, captured_stages, label_anchors, minted_nodes, subset_entities, removed_documents, derived_values)}

_SAFE = lambda c: f"regexp_replace(trim({c}), '[^a-zA-Z0-9_-]', '_', 'g')"
_TREE = " UNION ALL ".join(f"SELECT '{c}' AS child, '{p}' AS parent, 2 AS layer" for c, p in CLASS_TREE if p and c != "Nation")
_M = lambda c: f"(SELECT min(m.n_nationkey) FROM nation m JOIN nation x ON x.n_regionkey = m.n_regionkey WHERE x.n_nationkey = {c})"
ORACLE = {
    "gazetteer_load": "SELECT kind, count(*) AS n, round(avg(lat), 6) AS lat, round(avg(lon), 6) AS lon FROM spatial_anchors WHERE lon IS NOT NULL AND lat IS NOT NULL GROUP BY 1",
    "graph_list": "SELECT 'kg' AS g, (SELECT count(*) FROM customer) * 5 + (SELECT count(*) FROM supplier) * 4 + (SELECT count(*) FROM nation) * 3 + (SELECT count(*) FROM region) * 2 + (SELECT count(*) FROM orders) * 6 AS facts, (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM region) + (SELECT count(*) FROM orders) AS entities, 5 AS types UNION ALL SELECT 'regions', 2 * count(*), count(*), 1 FROM region",
    "typed_hits": "SELECT chunk_id FROM entity_semantic_chunk WHERE contains(lower(chunk_text), 'revenue') AND json_extract_string(attrs, '$.type') = 'Filing'",
    "migration_plan": "SELECT type_name AS type, name, 'keep' AS action, NULL AS new_name FROM attribute_declarations UNION ALL SELECT type_name, name || '_verified_at', 'move', 'attr_meta/' || name || '/verified_at' FROM attribute_declarations WHERE length(name) < 7 UNION ALL SELECT type_name, 'lost_' || name || '_provenance', 'sweep', NULL FROM attribute_declarations WHERE length(name) > 15",
    "taxonomy_names": "SELECT array_to_string(list_transform(string_split(lower(trim(condition)), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS name, count(*) AS n FROM clinical_trials WHERE condition IS NOT NULL GROUP BY 1",
    "extraction_constraint": "WITH c AS (SELECT row_no, type_name AS type, regexp_replace(lower(a.name), '[^a-z]', '', 'g') AS name FROM (SELECT row_no, type_name, unnest(attributes) AS a FROM coffee_shops WHERE id IS NOT NULL AND type_name IS NOT NULL)) SELECT type, CASE WHEN type = 'CoffeeShop' AND name IN ('rating', 'name', 'phone', 'address') THEN 'kept' ELSE 'dropped' END AS state, count(*) AS n FROM c GROUP BY 1, 2 UNION ALL SELECT 'CoffeeShop', 'missing', count(*) FROM (SELECT row_no FROM c WHERE type = 'CoffeeShop' GROUP BY 1 HAVING bool_and(name IS DISTINCT FROM 'name'))",
    "source_batches": "WITH r AS (SELECT feed, record_id, (row_number() OVER (PARTITION BY feed ORDER BY record_id) - 1) // 100 AS batch FROM healthcare_providers) SELECT feed, CAST(batch AS INTEGER) AS batch, count(*) AS n, max(record_id) AS last FROM r GROUP BY 1, 2",
    "rule_states": """WITH RECURSIVE e AS (SELECT event_id % 700 AS rule, CASE event_type WHEN 'signup' THEN 'suggested' WHEN 'click' THEN 'confirmed' WHEN 'purchase' THEN 'applied' ELSE 'rejected' END AS step, row_number() OVER (PARTITION BY event_id % 700 ORDER BY event_id) AS i FROM events),
        w AS (SELECT DISTINCT rule, 0 AS i, CAST(NULL AS VARCHAR) AS now, 0 AS refused FROM e UNION ALL SELECT w.rule, e.i, CASE WHEN (now IS NULL AND step = 'suggested') OR (now = 'suggested' AND step IN ('confirmed', 'rejected')) OR (now = 'confirmed' AND step IN ('applied', 'rejected')) THEN step ELSE now END, refused + CASE WHEN (now IS NULL AND step = 'suggested') OR (now = 'suggested' AND step IN ('confirmed', 'rejected')) OR (now = 'confirmed' AND step IN ('applied', 'rejected')) THEN 0 ELSE 1 END FROM w JOIN e ON e.rule = w.rule AND e.i = w.i + 1),
        z AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY rule ORDER BY i DESC) = 1) SELECT now AS step, count(*) AS rules, sum(refused) AS refused FROM z GROUP BY 1""",
    "merged_identities": f"WITH q AS (SELECT 'rdf:type' AS p, 'N' || {_M('n.n_nationkey')} AS s, 't' AS o FROM nation n UNION SELECT 'rdfs:label', 'N' || {_M('n.n_nationkey')}, n_name FROM nation n UNION SELECT 'onto/region', 'N' || {_M('n.n_nationkey')}, 'R' || n_regionkey FROM nation n UNION SELECT 'onto/nation', 'C' || c_custkey, 'N' || {_M('c_nationkey')} FROM customer UNION SELECT 'onto/nation', 'S' || s_suppkey, 'N' || {_M('s_nationkey')} FROM supplier) SELECT p, count(*) AS n, count(DISTINCT s) AS subjects, count(DISTINCT o) AS objects FROM q GROUP BY 1",
    "indirect_types": "SELECT 'types/Party' AS t, (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) AS n UNION ALL SELECT 'types/Place', (SELECT count(*) FROM nation) + (SELECT count(*) FROM region) UNION ALL SELECT 'types/Thing', (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM region) + (SELECT count(*) FROM orders)",
    "template_function": "SELECT 'entities/Nation/' || k AS entity, count(*) AS n, round(sum(b), 2) AS held FROM (SELECT c_nationkey AS k, c_acctbal AS b FROM customer UNION ALL SELECT s_nationkey, s_acctbal FROM supplier) WHERE k IN (1, 2) GROUP BY k",
    "layered_parents": f"{_TREE} UNION ALL SELECT 'Nation', r_name, 1 FROM region",
    "binding_attributes": "SELECT 'entities/Customer/' || c_custkey AS s, c_name AS label, 2 AS n FROM customer WHERE c_mktsegment = 'BUILDING'",
    "header_chunks": "WITH c AS (SELECT column_name AS name, row_number() OVER () AS i FROM (DESCRIBE SELECT * EXCLUDE (record_id) FROM healthcare_providers)) SELECT CAST((i - 1) // 4 AS INTEGER) AS chunk, name FROM c UNION ALL SELECT DISTINCT CAST((i - 1) // 4 AS INTEGER), 'record_id' FROM c",
    "record_chunks": "SELECT ceil(length(text) / 4.0) > 2000 AS alone, count(*) AS n, CAST(sum(ceil(length(text) / 4.0)) AS BIGINT) AS tokens FROM documents WHERE text IS NOT NULL GROUP BY 1",
    "independent_evidence": "WITH t AS (SELECT * FROM clinical_trials WHERE nct_id IS NOT NULL AND sponsor IS NOT NULL), o AS (SELECT nct_id, arg_min(condition, trial_row) FILTER (condition IS NOT NULL OR true) AS condition, arg_min(sponsor, trial_row) AS sponsor FROM t GROUP BY 1), f AS (SELECT nct_id, (SELECT condition FROM t x WHERE x.nct_id = o.nct_id ORDER BY trial_row LIMIT 1) AS condition, sponsor FROM o) SELECT f.nct_id, count(*) FILTER (length(trim(f.condition)) >= 2 AND contains(lower(title), lower(trim(f.condition))) AND t.sponsor <> f.sponsor) AS supporting, count(DISTINCT t.sponsor) FILTER (length(trim(f.condition)) >= 2 AND contains(lower(title), lower(trim(f.condition))) AND t.sponsor <> f.sponsor) AS hosts FROM f JOIN t ON t.nct_id = f.nct_id WHERE f.condition IS NOT NULL AND title IS NOT NULL GROUP BY 1",
    "watch_cells": "SELECT 'entities/Nation/1' AS key, least(n_name, 'entities/Region/' || n_regionkey) || '|' || greatest(n_name, 'entities/Region/' || n_regionkey) AS value FROM nation WHERE n_nationkey = 1 UNION ALL SELECT 'entities/Customer/7', least(c_name, c_mktsegment) || '|' || greatest(c_name, c_mktsegment) FROM customer WHERE c_custkey = 7",
    "contract_faults": "WITH f AS (SELECT CASE WHEN coalesce(trim(type_name), '') = '' THEN 1 ELSE 0 END AS t, CASE WHEN coalesce(trim(id), '') = '' THEN 1 ELSE 0 END AS i, CASE WHEN len(list_filter(attributes, lambda x: coalesce(trim(x.name), '') = '')) > 0 THEN 1 ELSE 0 END AS u, CASE WHEN len(list_distinct(list_transform(attributes, lambda x: {'n': x.name, 'v': x.value}))) > len(list_distinct(list_transform(attributes, lambda x: {'n': x.name}))) THEN 1 ELSE 0 END AS d FROM coffee_shops) SELECT * FROM (SELECT 'no type' AS fault, sum(t) AS n FROM f UNION ALL SELECT 'no id', sum(i) FROM f UNION ALL SELECT 'unnamed attribute', sum(u) FROM f UNION ALL SELECT 'two values', sum(d) FROM f) WHERE n > 0",
    "spec_faults": "SELECT * FROM (SELECT 'slug' AS fault, count(*) FILTER (open_source) AS n FROM llm_models UNION ALL SELECT 'url', count(*) FILTER (input_price > 3) FROM llm_models UNION ALL SELECT 'secret in url', count(*) FILTER (modality = 'text') FROM llm_models UNION ALL SELECT 'paging', count(*) FILTER (output_price > 9) FROM llm_models UNION ALL SELECT 'cost', count(*) FILTER (input_price - 1 < 0) FROM llm_models UNION ALL SELECT 'ttl', count(*) FILTER (context_length IS NULL OR context_length <= 0) FROM llm_models) WHERE n > 0",
    "boundary_rows": "SELECT 'Nation' AS type_name, CAST(n_nationkey AS VARCHAR) AS id, n_name AS label, '[{\"name\":\"n_name\",\"value\":\"' || n_name || '\"},{\"name\":\"n_regionkey\",\"value\":\"' || n_regionkey || '\"}]' AS attributes, 'n_regionkey|Region|' || n_regionkey AS relationship FROM nation",
    "captured_stages": "SELECT unnest(['a', 'b', 'c', 'd']) AS stage, unnest([count(*), count(*), count(*) FILTER (n_nationkey > 0), 0]) AS rows, unnest([true, true, count(*) = count(*) FILTER (n_nationkey > 0), false]) AS same FROM nation",
    "label_anchors": "SELECT 'entities/Nation/' || n_nationkey AS s, n_name AS label, 'POINT(' || length(n_name) || ' 1)' AS geom FROM nation WHERE contains(n_name, '1') AND n_nationkey % 10 <> 5",
    "minted_nodes": f"WITH m AS (SELECT DISTINCT p_partkey, unnest([trim(p_brand), trim(p_type)]) AS v FROM part), n AS (SELECT DISTINCT {_SAFE('v')} AS k FROM m) SELECT 'onto/mark' AS p, count(*) AS n, count(DISTINCT {_SAFE('v')}) AS objects FROM m UNION ALL SELECT 'rdfs:label', count(*), count(*) FROM n UNION ALL SELECT 'rdf:type', count(*), 1 FROM n",
    "subset_entities": "WITH r AS (SELECT 'entities/Order/' || o_orderkey AS k, 'entities/Customer/' || o_custkey AS c FROM orders WHERE o_totalprice > 440000), e AS (SELECT k, 0 AS i, k AS s FROM r UNION ALL SELECT k, 1, c FROM r), f AS (SELECT s, min((k, i)) AS first FROM e GROUP BY 1) SELECT s FROM f ORDER BY first LIMIT 50",
    "removed_documents": "SELECT attr, count(*) AS n FROM entity_semantic_chunk c WHERE NOT EXISTS (SELECT 1 FROM entity_semantic_chunk x WHERE x.chunk_id % 10 = 3 AND x.entity_uri = c.entity_uri AND x.attr = c.attr) AND chunk_id IS NOT NULL GROUP BY 1",
    "derived_values": "WITH b AS (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_custkey IN (SELECT o_custkey FROM orders)) SELECT o_custkey AS c_custkey, round(sum(o_totalprice), 2) AS v FROM orders WHERE o_custkey IN (SELECT c_custkey FROM b) OR o_orderdate < TIMESTAMP '1998-01-01' GROUP BY 1",
}
