"""Schema text, chunk index, lineage and verification queries, beside SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import schema_text as st, text
from ..functions.names import pascal_case
from ..operators import facts, index, profile
from ..runtime import bounded_rows, table
from .graph import graph


def attribute_match(spark: SparkSession, root: str) -> DataFrame:
    """Spellings of attribute names and the declared name each stands for."""
    names = table(spark, root, "coffee_shops").select(F.explode("attributes.name").alias("spelling")).distinct()
    declared = [r[0] for r in bounded_rows(table(spark, root, "attribute_declarations").select("name"), 100_000, "the table of declarations")]
    return names.select("spelling", st.closest_name(declared)("spelling").alias("name")).filter("name IS NOT NULL")


def _column_names(spark: SparkSession, root: str) -> DataFrame:
    """(type_name, name): columns of the tables that describe things."""
    rows = [(t, c) for t in ("clinical_trials", "healthcare_providers", "spatial_anchors", "llm_models", "orders", "customer") for c in table(spark, root, t).columns]
    return spark.createDataFrame(rows, "type_name string, name string").unionByName(table(spark, root, "attribute_declarations").select("type_name", "name"))


def singular_names(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "known_terms").filter("term rlike '^[A-Za-z ]+$'").select("term_id", st.singular(F.col("term")).alias("singular"))


def camel_words(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "entity_spatiotemporal").select(F.regexp_extract("entity_uri", "/entities/([^/]+)/", 1).alias("t")).distinct().select("t", st.words_of_camel(F.col("t")).alias("words"))


def junk_types(spark: SparkSession, root: str) -> DataFrame:
    """Which names of columns and types, read as types, would be no types at all."""
    names = _column_names(spark, root).select(pascal_case(F.col("name")).alias("t")).union(table(spark, root, "coffee_shops").select("type_name")).union(_column_names(spark, root).select(F.concat(pascal_case(F.col("name")), F.lit("Mode"))))
    return names.filter("t IS NOT NULL").distinct().select("t", st.is_junk_type(F.col("t")).alias("junk"))


def question_tags(spark: SparkSession, root: str) -> DataFrame:
    """How many queries show each feature."""
    q = table(spark, root, "gold_questions").filter("gold_sparql IS NOT NULL").select(F.explode(st.pattern_tags(F.col("gold_sparql"))).alias("tag"))
    return q.groupBy("tag").agg(F.count("*").alias("n"))


def inferred_types(spark: SparkSession, root: str) -> DataFrame:
    """The datatype that all clean values of each attribute fit, list values one by one."""
    f = table(spark, root, "coffee_shops_facts").select("attribute", F.col("clean_value").alias("v"))
    more = table(spark, root, "entity_spatiotemporal").select(F.lit("entity").alias("attribute"), F.col("entity_uri").alias("v")).unionByName(table(spark, root, "orders").select(F.lit("ordered").alias("attribute"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("v")))
    more = more.unionByName(table(spark, root, "spatial_anchors").filter("lon IS NOT NULL").select(F.lit("place").alias("attribute"), F.concat(F.lit("POINT("), F.round("lon", 3).cast("string"), F.lit(" "), F.round("lat", 3).cast("string"), F.lit(")")).alias("v")))
    return st.inferred_datatype(f.unionByName(more).unionByName(table(spark, root, "customer").select(F.lit("key").alias("attribute"), F.concat(F.col("c_custkey").cast("string"), F.lit("^^xsd:integer")).alias("v"))), ["attribute"], F.col("v"))


def token_estimates(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "documents").select("doc_id", st.token_estimate(F.col("text")).alias("tokens"))


def urls(spark: SparkSession, root: str) -> DataFrame:
    """Addresses and bare hosts named in the documents' texts and in what their entities' notes would say."""
    d = table(spark, root, "documents")
    said = F.concat_ws(" ", "text", F.lit("See"), F.concat("entity_uri", F.lit(",")), F.concat(F.lit("or"), F.lit(" "), F.regexp_replace(F.coalesce("source", F.lit("none")), "[^a-z]", ""), F.lit(".example.org.")), F.lit("No host: readme.md, e.g. 3.5 or me@mail.com"))
    return d.select("doc_id", F.explode(text.urls_in(said, bare=True)).alias("url"))


def promotion_groups(spark: SparkSession, root: str) -> DataFrame:
    """Prefixes that three attributes or more of a type share, and what becomes of them: a new type needs an attribute to point at it by, and no name of a property."""
    d = _column_names(spark, root).select("type_name", st.attribute_key(F.col("name")).alias("k")).filter("contains(k, '_')")
    d = d.select("type_name", F.substring_index("k", "_", 1).alias("prefix"), F.expr("substr(k, instr(k, '_') + 1)").alias("leaf"))
    g = d.groupBy("type_name", "prefix").agg(F.count("*").alias("n"), F.bool_or(F.col("leaf").isin(*st.IDENTITY_LEAVES)).alias("identity")).filter("n >= 3")
    return g.select("type_name", "prefix", "n", F.when(st.is_junk_type(F.initcap("prefix")), "rejected").when(F.col("identity"), "promoted").otherwise("held").alias("state"))


def cite_or_abstain(spark: SparkSession, root: str) -> DataFrame:
    """Facts with a value that another fact of the same entity supports."""
    f = table(spark, root, "coffee_shops_facts").filter("clean_value IS NOT NULL").select("fact_id", "entity_id", "attribute", "clean_value")
    support = f.groupBy("entity_id", "attribute", "clean_value").agg(F.count("*").alias("n")).filter("n >= 2")
    return f.join(support, ["entity_id", "attribute", "clean_value"], "left_semi").select("fact_id")


def surface_forms(spark: SparkSession, root: str) -> DataFrame:
    """Values that cleaning changed, with what they were."""
    return table(spark, root, "coffee_shops_facts").filter("clean_value IS NOT NULL AND raw_value <> clean_value").select("fact_id", "raw_value", "clean_value")


def chunk_upsert(spark: SparkSession, root: str) -> DataFrame:
    c = table(spark, root, "entity_semantic_chunk").filter("chunk_id IS NOT NULL").select("entity_uri", "attr", "chunk_ix", "content_hash")
    new = c.filter("chunk_ix = 0").withColumn("content_hash", F.lit("new"))
    return index.replace_documents(c, new, ["entity_uri", "attr"]).groupBy("content_hash").agg(F.count("*").alias("n")).filter("content_hash = 'new'")


def index_reconcile(spark: SparkSession, root: str) -> DataFrame:
    d = table(spark, root, "documents").select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("h"))
    indexed = d.filter("doc_id % 7 <> 0").withColumn("h", F.when(F.col("doc_id") % 5 == 0, "old").otherwise(F.col("h")))
    return index.reconcile(indexed, d.filter("doc_id % 3 <> 0"), ["doc_id"], "h").groupBy("action").agg(F.count("*").alias("n"))


def pending_embeddings(spark: SparkSession, root: str) -> DataFrame:
    return index.pending(table(spark, root, "entity_semantic_chunk"), "embedding", "attempt_count", ["chunk_id"], 50).select("chunk_id", "attempt_count")


def chunk_cap(spark: SparkSession, root: str) -> DataFrame:
    c = table(spark, root, "entity_semantic_chunk").select("entity_uri", "attr", "chunk_ix", "chunk_id")
    return index.capped(c, ["entity_uri"], ["attr", "chunk_ix", "chunk_id"], 2).groupBy("entity_uri").agg(F.count("*").alias("n"))


def one_hop(spark: SparkSession, root: str) -> DataFrame:
    e = profile.type_edges(graph(spark, root)).select("source", "target")
    return index.expand_neighbours(spark.createDataFrame([("types/Nation",)], "node string"), e, 10)


def overlap_rank(spark: SparkSession, root: str) -> DataFrame:
    """Models ranked by the share of asked words in their name, organisation and modality."""
    m = table(spark, root, "llm_models")
    words = text.tokens(F.concat_ws(" ", "display_name", "organization", "modality"))
    asked = ["labs", "image", "audio", "text"]
    return m.select("model_id", F.round(F.size(F.array_intersect(F.array(*[F.lit(a) for a in asked]), words)) / float(len(asked)), 4).alias("score")).orderBy(F.desc("score"), "model_id").limit(8)


def arbitration(spark: SparkSession, root: str) -> DataFrame:
    """The cheapest of the models that are long enough, by organisation, open ones first."""
    m = table(spark, root, "llm_models").filter("context_length >= 4096")
    best = F.min(F.struct((~F.col("open_source")).alias("closed"), "input_price", "model_id"))
    return m.groupBy("organization").agg(best.alias("b")).select("organization", "b.model_id", "b.input_price")


def modality_rows(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "llm_models").select("model_id", F.explode(text.split_list(F.col("modality"), ["|", ","])).alias("modality"))


def merge_and_split(spark: SparkSession, root: str) -> DataFrame:
    """Facts about two nations after one is merged into the other, and after the merge is undone from its lineage; a fact that both had stays the winner's."""
    q = graph(spark, root).filter("p IN ('onto/nation', 'onto/region', 'rdfs:label')")
    shared = q.filter("s = 'entities/Nation/2' AND p = 'rdfs:label'")
    q = q.unionByName(shared.withColumn("s", F.lit("entities/Nation/1")))
    merged, lineage = facts.merge_entities(q, "entities/Nation/2", "entities/Nation/1", "m1")
    late = merged.unionByName(merged.filter("s = 'entities/Nation/1' AND p = 'rdfs:label'").withColumn("o", F.lit("later")).distinct())
    both = merged.withColumn("stage", F.lit("merged")).unionByName(facts.split_entity(late, lineage, "m1").withColumn("stage", F.lit("split")))
    return both.filter("s IN ('entities/Nation/1', 'entities/Nation/2') OR o IN ('entities/Nation/1', 'entities/Nation/2')").select("stage", "s", "p", "o")


def verification_metrics(spark: SparkSession, root: str) -> DataFrame:
    """Accuracy over all gold facts and the share of wrong among those called supported."""
    f = table(spark, root, "coffee_shops_facts").select("fact_id", (F.col("outcome") == "passed").alias("gold"), F.when(F.col("fact_id") % 9 != 0, F.col("raw_value") == F.col("clean_value")).alias("said"))
    return f.agg(F.round(F.count_if(F.col("said").eqNullSafe(F.col("gold"))) / F.count("*"), 6).alias("accuracy"), F.round(F.count_if(F.col("said") & ~F.col("gold")) / F.count_if(F.col("said")), 6).alias("false_supported"))


def dataset_summary(spark: SparkSession, root: str) -> DataFrame:
    o = table(spark, root, "orders")
    return o.agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean"), F.round(F.stddev_samp("o_totalprice"), 4).alias("sd"), F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high"))


def balanced_examples(spark: SparkSession, root: str) -> DataFrame:
    """At most five examples a source."""
    q = table(spark, root, "gold_questions").filter("kg_id IS NOT NULL AND question IS NOT NULL").select("kg_id", "question_no")
    return index.capped(q, ["kg_id"], ["question_no"], 5)


def request_families(spark: SparkSession, root: str) -> DataFrame:
    e = F.col("event_type")
    path = F.when(e == "click", F.concat(F.lit("/graphs/t1/kgs/kg"), F.col("user_id") % 3, F.lit("/types"))).when(e == "view", F.concat(F.lit("/graphs/t1/explore/kgs/kg"), F.col("user_id") % 2)).when(e == "purchase", "/graphs/t2/schedules/7").when(e == "signup", "/health").otherwise("/graphs/t3/odd/ask")
    return table(spark, root, "events").select(st.route_family(path).alias("f")).groupBy("f.kg_name", "f.family").agg(F.count("*").alias("n"))


def ttl_cache(spark: SparkSession, root: str) -> DataFrame:
    """Derived values still fresh at the end of the log: the latest a user, younger than two days, with no error after it."""
    e = table(spark, root, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    latest = e.filter("event_type = 'purchase'").groupBy("user_id").agg(F.max("ts").alias("at"))
    errors = e.filter("event_type = 'error'").groupBy("user_id").agg(F.max("ts").alias("err"))
    out = latest.join(errors, "user_id", "left").filter((F.col("at") >= F.lit("2024-01-28").cast("timestamp")) & (F.col("err").isNull() | (F.col("err") <= F.col("at"))))
    return out.select("user_id")


QUERIES = {f.__name__: f for f in (attribute_match, singular_names, camel_words, junk_types, question_tags, inferred_types, token_estimates, urls, promotion_groups, cite_or_abstain, surface_forms, chunk_upsert, index_reconcile, pending_embeddings, chunk_cap, one_hop, overlap_rank, arbitration, modality_rows, merge_and_split, verification_metrics, dataset_summary, balanced_examples, request_families, ttl_cache)}

_COLUMNS = " UNION ALL ".join(f"SELECT '{t}' AS type_name, column_name AS name FROM (DESCRIBE SELECT * FROM {t})" for t in ("clinical_trials", "healthcare_providers", "spatial_anchors", "llm_models", "orders", "customer")) + " UNION ALL SELECT type_name, name FROM attribute_declarations"
_LIST = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
_PASCAL = "array_to_string(list_transform(list_filter(string_split(lower(regexp_replace(name, '[^a-zA-Z0-9]', '_', 'g')), '_'), lambda x: x <> ''), lambda x: upper(x[1]) || x[2:]), '')"
_TAGS = " UNION ALL ".join(f"SELECT '{n}' AS tag, count(*) AS n FROM q WHERE regexp_matches(q, '{p}')" for n, p in st.QUERY_TAGS.items())
_JUNK = f"""SELECT t, (len(list_filter(w, lambda x: NOT list_contains({_LIST(st.PROPERTY_WORDS)}, x))) = 0 OR len(list_filter(w, lambda x: NOT list_contains({_LIST(st.PROPERTY_WORDS)}, x) AND NOT (suffix(x, 's') AND list_contains({_LIST(st.PROPERTY_WORDS)}, x[:-2])))) = 0
    OR len(list_filter({_LIST(st.PROPERTY_ENDS)}, lambda e: suffix(lower(t), e) AND length(t) > length(e) AND len(list_filter(w, lambda x: x <> e AND x <> rtrim(e, 's'))) > 0 AND len(list_filter(w, lambda x: x <> e AND x <> rtrim(e, 's') AND NOT list_contains({_LIST(st.PROPERTY_WORDS)}, x))) = 0)) > 0) AS junk
    FROM (SELECT t, list_filter(string_split(lower(regexp_replace(regexp_replace(t, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[^a-zA-Z0-9]+', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM n)"""
_M = "(SELECT 'entities/Customer/' || c_custkey AS s, 'onto/nation' AS p, 'entities/Nation/' || c_nationkey AS o FROM customer WHERE c_nationkey IN (1, 2) UNION SELECT 'entities/Supplier/' || s_suppkey, 'onto/nation', 'entities/Nation/' || s_nationkey FROM supplier WHERE s_nationkey IN (1, 2) UNION SELECT 'entities/Nation/' || n_nationkey, 'onto/region', 'entities/Region/' || n_regionkey FROM nation WHERE n_nationkey IN (1, 2) UNION SELECT 'entities/Nation/' || n_nationkey, 'rdfs:label', n_name FROM nation WHERE n_nationkey IN (1, 2) UNION SELECT 'entities/Nation/1', 'rdfs:label', n_name FROM nation WHERE n_nationkey = 2)"
ORACLE = {
    "attribute_match": "WITH n AS (SELECT DISTINCT unnest(attributes).name AS spelling FROM coffee_shops) SELECT spelling, name FROM n JOIN attribute_declarations ON regexp_replace(lower(spelling), '[^a-z0-9]', '', 'g') = replace(name, '_', '')",
    "singular_names": "SELECT term_id, CASE WHEN length(term) > 3 AND suffix(lower(term), 'ies') THEN lower(term)[:-4] || 'y' WHEN length(term) > 4 AND regexp_matches(lower(term), '(ches|shes|sses|xes|zes)$') THEN lower(term)[:-3] WHEN length(term) > 1 AND suffix(lower(term), 's') AND NOT suffix(lower(term), 'ss') THEN lower(term)[:-2] ELSE lower(term) END AS singular FROM known_terms WHERE regexp_matches(term, '^[A-Za-z ]+$')",
    "camel_words": "SELECT DISTINCT t, lower(regexp_replace(t, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')) AS words FROM (SELECT regexp_extract(entity_uri, '/entities/([^/]+)/', 1) AS t FROM entity_spatiotemporal)",
    "junk_types": f"WITH c AS ({_COLUMNS}), n AS (SELECT {_PASCAL} AS t FROM c UNION SELECT type_name FROM coffee_shops WHERE type_name IS NOT NULL UNION SELECT {_PASCAL} || 'Mode' FROM c) {_JUNK}",
    "question_tags": f"""WITH q AS (SELECT gold_sparql AS q FROM gold_questions WHERE gold_sparql IS NOT NULL) SELECT * FROM ({_TAGS} UNION ALL SELECT 'join', count(*) FROM q WHERE len(list_distinct(regexp_extract_all(q, '\\?\\w+\\s+<'))) >= 2
        UNION ALL SELECT 'multi_hop', count(*) FROM q WHERE len(regexp_extract_all(q, '\\.\\s*(?:\\n|$|\\}})')) + len(string_split(q, ' . ')) - 1 >= 3) WHERE n > 0""",
    "inferred_types": """WITH v AS (SELECT attribute, trim(clean_value) AS v FROM coffee_shops_facts), k AS (SELECT attribute, count(v) FILTER (v <> '') AS n, bool_and(TRY_CAST(v AS HUGEINT) IS NOT NULL AND NOT contains(v, '.')) FILTER (v <> '') AS i, bool_and(TRY_CAST(v AS DOUBLE) IS NOT NULL) FILTER (v <> '') AS f FROM v GROUP BY 1)
        SELECT attribute, CASE WHEN n = 0 THEN 'string' WHEN i THEN 'integer' WHEN f THEN 'float' ELSE 'string' END AS datatype FROM k UNION ALL SELECT 'entity', CASE WHEN count(DISTINCT regexp_extract(entity_uri, '/entities/([^/]+)/', 1)) = 1 THEN min(regexp_extract(entity_uri, '/entities/([^/]+)/', 1)) ELSE 'string' END FROM entity_spatiotemporal UNION ALL SELECT 'ordered', 'datetime' FROM (SELECT min(o_orderdate) FROM orders) UNION ALL SELECT 'place', 'geo' FROM (SELECT min(lon) FROM spatial_anchors) UNION ALL SELECT 'key', 'integer' FROM (SELECT min(c_custkey) FROM customer)""",
    "token_estimates": "SELECT doc_id, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens FROM documents",
    "urls": "SELECT doc_id, url FROM (SELECT doc_id, unnest([entity_uri, 'https://' || regexp_replace(coalesce(source, 'none'), '[^a-z]', '', 'g') || '.example.org']) AS url FROM documents) WHERE url IS NOT NULL",
    "promotion_groups": f"""WITH c AS ({_COLUMNS}), g AS (SELECT type_name, string_split(lower(name), '_')[1] AS prefix, count(*) AS n, bool_or(substr(lower(name), instr(name, '_') + 1) IN (SELECT unnest({_LIST(st.IDENTITY_LEAVES)}))) AS identity FROM c WHERE contains(name, '_') GROUP BY 1, 2 HAVING count(*) >= 3)
        SELECT type_name, prefix, n, CASE WHEN list_contains({_LIST(st.PROPERTY_WORDS)}, prefix) THEN 'rejected' WHEN identity THEN 'promoted' ELSE 'held' END AS state FROM g""",
    "cite_or_abstain": "SELECT fact_id FROM coffee_shops_facts WHERE clean_value IS NOT NULL AND entity_id IS NOT NULL AND attribute IS NOT NULL QUALIFY count(*) OVER (PARTITION BY entity_id, attribute, clean_value) >= 2",
    "surface_forms": "SELECT fact_id, raw_value, clean_value FROM coffee_shops_facts WHERE clean_value IS NOT NULL AND raw_value <> clean_value",
    "chunk_upsert": "SELECT 'new' AS content_hash, count(*) AS n FROM entity_semantic_chunk WHERE chunk_ix = 0 AND chunk_id IS NOT NULL",
    "index_reconcile": "WITH x AS (SELECT CASE WHEN doc_id % 7 = 0 AND doc_id % 3 <> 0 THEN 'missing' WHEN doc_id % 7 <> 0 AND doc_id % 3 = 0 THEN 'ghost' WHEN doc_id % 7 <> 0 AND doc_id % 3 <> 0 AND doc_id % 5 = 0 THEN 'stale' END AS action FROM documents) SELECT action, count(*) AS n FROM x WHERE action IS NOT NULL GROUP BY 1",
    "pending_embeddings": "SELECT chunk_id, attempt_count FROM entity_semantic_chunk WHERE embedding IS NULL AND coalesce(attempt_count, 0) < 5 ORDER BY chunk_id LIMIT 50",
    "chunk_cap": "SELECT entity_uri, least(count(*), 2) AS n FROM entity_semantic_chunk GROUP BY 1",
    "one_hop": "SELECT 'types/Nation' AS node, 0 AS hop UNION SELECT 'types/Customer', 1 FROM customer JOIN nation ON c_nationkey = n_nationkey UNION SELECT 'types/Supplier', 1 FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION SELECT 'types/Region', 1 FROM nation JOIN region ON n_regionkey = r_regionkey",
    "overlap_rank": "WITH w AS (SELECT model_id, list_distinct(regexp_extract_all(lower(concat_ws(' ', display_name, organization, modality)), '[a-z0-9]+')) AS t FROM llm_models) SELECT model_id, round(len(list_intersect(t, ['labs', 'image', 'audio', 'text'])) / 4.0, 4) AS score FROM w ORDER BY score DESC, model_id LIMIT 8",
    "arbitration": "SELECT organization, model_id, input_price FROM llm_models WHERE context_length >= 4096 QUALIFY row_number() OVER (PARTITION BY organization ORDER BY NOT open_source, input_price, model_id) = 1",
    "modality_rows": "SELECT model_id, trim(unnest(string_split(replace(modality, '|', ','), ','))) AS modality FROM llm_models",
    "merge_and_split": f"""WITH q AS {_M}, m AS (SELECT DISTINCT replace(s || '|', 'Nation/2|', 'Nation/1|') AS s, p, CASE WHEN p = 'rdfs:label' THEN o || '|' ELSE replace(o || '|', 'Nation/2|', 'Nation/1|') END AS o FROM q)
        SELECT 'merged' AS stage, rtrim(s, '|') AS s, p, rtrim(o, '|') AS o FROM m UNION ALL SELECT 'split', s, p, o FROM q UNION ALL SELECT 'split', 'entities/Nation/1', 'rdfs:label', 'later'""",
    "verification_metrics": "WITH f AS (SELECT outcome = 'passed' AS gold, CASE WHEN fact_id % 9 <> 0 THEN raw_value = clean_value END AS said FROM coffee_shops_facts) SELECT round(count(*) FILTER (said IS NOT DISTINCT FROM gold) / count(*), 6) AS accuracy, round(count(*) FILTER (said AND NOT gold) / count(*) FILTER (said), 6) AS false_supported FROM f",
    "dataset_summary": "SELECT count(*) AS n, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS sd, min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders",
    "balanced_examples": "SELECT kg_id, question_no FROM gold_questions WHERE kg_id IS NOT NULL AND question IS NOT NULL QUALIFY row_number() OVER (PARTITION BY kg_id ORDER BY question_no) <= 5",
    "request_families": "SELECT CASE event_type WHEN 'click' THEN 'kg' || user_id % 3 WHEN 'view' THEN 'kg' || user_id % 2 WHEN 'signup' THEN NULL ELSE '' END AS kg_name, CASE event_type WHEN 'click' THEN 'kgs' WHEN 'view' THEN 'explore' WHEN 'purchase' THEN 'jobs' WHEN 'signup' THEN NULL ELSE 'other' END AS family, count(*) AS n FROM events GROUP BY 1, 2",
    "ttl_cache": "WITH a AS (SELECT user_id, max(ts) FILTER (event_type = 'purchase') AS got, max(ts) FILTER (event_type = 'error') AS err FROM events GROUP BY 1) SELECT user_id FROM a WHERE got >= TIMESTAMP '2024-01-28' AND (err IS NULL OR err <= got)",
}
