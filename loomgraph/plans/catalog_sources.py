"""Sources, streams, catalogue operators and evaluation measures, beside SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..model import EntityMap
from ..operators import catalog, search
from ..runtime import shared_dir, table
from ..sources import files
from ..streaming import usage
from .graph import CLASS_TREE, engine, graph


def csv_ingest(spark: SparkSession, root: str) -> DataFrame:
    """Nations written as CSV, read back through a mapping, counted by predicate."""
    path = f"{shared_dir(spark)}/csv-{uuid.uuid4().hex}"
    files.write_csv(table(spark, root, "nation"), path)
    quads = files.ingest_csv(spark, path, EntityMap("Nation", "n_nationkey", "n_name", {"name": ("n_name", "string")}, {"region": ("Region", "n_regionkey")}))
    return quads.groupBy("p").agg(F.count("*").alias("n"), F.count_distinct("o").alias("objects"))


def json_records(spark: SparkSession, root: str) -> DataFrame:
    n = table(spark, root, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list(F.struct("n_nationkey", F.struct(F.col("n_name").alias("text")).alias("name")))).alias("items"))
    pages = n.select(F.to_json(F.struct(F.struct("items").alias("result"))).alias("page"))
    out = files.json_records(pages, "page", "$.result.items", {"id": "$.n_nationkey", "name": "$.name.text"})
    return out.select(F.col("id").cast("int").alias("id"), "name")


def byte_batches(spark: SparkSession, root: str) -> DataFrame:
    d = table(spark, root, "documents").filter("text IS NOT NULL").select("source", "doc_id", "text")
    b = files.byte_batches(d, ["source"], ["doc_id"], F.col("text"), 20_000)
    return b.groupBy("source", "batch").agg(F.count("*").alias("n_docs"), F.sum(F.octet_length("text")).alias("n_bytes"))


def html_reduction(spark: SparkSession, root: str) -> DataFrame:
    d = table(spark, root, "documents").filter("text IS NOT NULL")
    page = F.concat(F.lit("<html><head><title>T "), F.col("doc_id").cast("string"), F.lit("</title><style>x{}</style></head><body><table><tr><td>id</td><td>"), F.col("doc_id").cast("string"), F.lit("</td></tr></table><dl><dt>lang</dt><dd>"), F.coalesce("lang", F.lit("")), F.lit("</dd></dl><script>no</script></body></html>"))
    return d.select("doc_id", files.html_text()(page).alias("h")).select("doc_id", "h.title", "h.text")


def stream_usage(spark: SparkSession, root: str) -> DataFrame:
    """Daily requests by type through a stream, as a table of upserts in the shared folder."""
    path = f"{shared_dir(spark)}/usage-{uuid.uuid4().hex}"
    q = usage.additive_upserts(usage.event_stream(spark, f"{root}/events.parquet"), [F.to_date("ts").alias("day"), F.col("event_type")], {"requests": F.count("*")}, path, f"{path}-ck")
    q.awaitTermination()
    return usage.Versions(spark, path).read()


def registered_function(spark: SparkSession, root: str) -> DataFrame:
    e = engine(spark, root)
    e.register("INITIAL", lambda c: F.upper(F.substring(c, 1, 1)))
    return e.query("SELECT ?i (COUNT(?x) AS ?n) WHERE { ?x a <types/Nation> ; rdfs:label ?l BIND(INITIAL(?l) AS ?i) } GROUP BY ?i")


def label_hydration(spark: SparkSession, root: str) -> DataFrame:
    q = graph(spark, root)
    o = q.filter("p = 'onto/customer'").select("o").distinct()
    known = q.filter("p = 'rdfs:label' AND s LIKE 'entities/Customer/%' AND o LIKE '%7'")
    return catalog.labels_of(o, "o", known)


def undirected_edges(spark: SparkSession, root: str) -> DataFrame:
    from ..operators.linking import undirected

    o = table(spark, root, "orders").select((F.col("o_custkey") % 50).alias("a"), (F.col("o_orderkey") % 50).alias("b"))
    return undirected(o.unionByName(o.select(F.col("b").alias("a"), F.col("a").alias("b"))))


def layer_shadowing(spark: SparkSession, root: str) -> DataFrame:
    d = table(spark, root, "attribute_declarations").select("name", "datatype")
    both = d.withColumn("layer", F.lit(1)).unionByName(d.filter("datatype = 'integer'").select("name", F.lit("float").alias("datatype"), F.lit(0).alias("layer")))
    return catalog.shadowed(both, "name", "layer").select("name", "datatype", "layer")


def inherited_settings(spark: SparkSession, root: str) -> DataFrame:
    tree = spark.createDataFrame([(c, p) for c, p in CLASS_TREE if p], "src string, dst string")
    settings = spark.createDataFrame([("Thing", "open"), ("Party", "pii"), ("Supplier", "secret")], "class string, tag string")
    return catalog.inherited(settings, tree, "class", "tag")


def consolidated_rows(spark: SparkSession, root: str) -> DataFrame:
    return catalog.consolidate(table(spark, root, "clinical_trials"), "nct_id", ["condition", "phase", "status"])


def deduplicated_rows(spark: SparkSession, root: str) -> DataFrame:
    h = table(spark, root, "healthcare_providers")
    key = F.when(F.trim(F.col("full_name")) != "", F.concat_ws("|", F.lower(F.trim("full_name")), F.coalesce(F.lower(F.trim("city")), F.col("phone"), F.lit(""))))
    return catalog.deduplicated(h, key, ["record_id"]).select("record_id")


def redacted(spark: SparkSession, root: str) -> DataFrame:
    return catalog.redact(table(spark, root, "healthcare_providers").select("record_id", "full_name", "phone", "npi"), {"phone": "pii", "npi": "secret"})


def majority_votes(spark: SparkSession, root: str) -> DataFrame:
    e = table(spark, root, "events").select((F.col("event_id") % 200).alias("item"), (F.col("value") > 10).alias("vote"))
    return catalog.majority(e, "item", "vote")


def accuracy_interval(spark: SparkSession, root: str) -> DataFrame:
    g = table(spark, root, "gold_questions").filter("tier IS NOT NULL").groupBy("tier").agg(F.count_if(F.col("tier") == F.col("tier_llm_label")).alias("hits"), F.count("*").alias("n"))
    low, high = catalog.wilson(F.col("hits"), F.col("n"))
    return g.select("tier", "n", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


def numeric_judge(spark: SparkSession, root: str) -> DataFrame:
    """Customers whose balance agrees with a rounded claim within two percent."""
    c = table(spark, root, "customer")
    return c.filter(catalog.within_tolerance(F.round(F.col("c_acctbal"), -2), F.col("c_acctbal"), 0.02)).select("c_custkey")


def scoped_fetch(spark: SparkSession, root: str) -> DataFrame:
    q = graph(spark, root)
    wanted = spark.createDataFrame([("entities/Nation/1",), ("entities/Supplier/3",)], "s string")
    return q.join(F.broadcast(wanted), "s", "left_semi").select("s", "p", "o")


def sampled_rows(spark: SparkSession, root: str) -> DataFrame:
    """A sample that repeats, and how many rows there are in all."""
    c = table(spark, root, "customer")
    return search.hash_sample(c, "c_custkey", 20, 3).select("c_custkey").crossJoin(c.agg(F.count("*").alias("total")))


def pooled_values(spark: SparkSession, root: str) -> DataFrame:
    """Three ordered draws of twenty, without repeats."""
    v = table(spark, root, "part").select("p_name").distinct()
    draws = [v.orderBy("p_name").limit(20), v.orderBy(F.desc("p_name")).limit(20), v.orderBy("p_name").offset(50).limit(20)]
    return draws[0].union(draws[1]).union(draws[2]).distinct()


def density_rank(spark: SparkSession, root: str) -> DataFrame:
    """The rows with most filled cells."""
    t = table(spark, root, "clinical_trials")
    filled = sum((F.when(F.col(c).isNotNull(), 1).otherwise(0) for c in ("title", "condition", "sponsor", "phase", "status", "enrollment", "start_year")), F.lit(0))
    return t.select("trial_row", filled.alias("filled")).orderBy(F.desc("filled"), "trial_row").limit(25)


def bounded_scope(spark: SparkSession, root: str) -> DataFrame:
    """The facts of the first ten customers in order of id: the limit comes before the facts are fetched."""
    q = graph(spark, root)
    ids = q.filter("p = 'rdf:type' AND o = 'types/Customer'").select("s").distinct().orderBy("s").limit(10)
    return q.join(ids, "s", "left_semi").select("s", "p", "o")


def isolation_check(spark: SparkSession, root: str) -> DataFrame:
    """Facts of one tenant about entities that another tenant recorded first."""
    e = table(spark, root, "entity_spatiotemporal").select("entity_uri", "tenant_id", "recorded_at", "fact_id")
    owner = e.groupBy("entity_uri").agg(F.min_by("tenant_id", F.struct("recorded_at", "fact_id")).alias("owner"))
    return e.join(owner, "entity_uri").filter("tenant_id <> owner").groupBy("tenant_id").agg(F.count("*").alias("foreign_facts"))


def companion_leaves(spark: SparkSession, root: str) -> DataFrame:
    """Attribute names that extend another name of the same type by a suffix."""
    d = table(spark, root, "attribute_declarations").select("name")
    names = d.union(d.filter("length(name) < 8").select(F.concat("name", F.lit("_source"))))
    base = names.select(F.col("name").alias("b"))
    return names.join(base, F.expr("b = regexp_extract(name, '^(.*)_[^_]+$', 1)"), "left_semi")


QUERIES = {f.__name__: f for f in (csv_ingest, json_records, byte_batches, html_reduction, stream_usage, registered_function, label_hydration, undirected_edges, layer_shadowing, inherited_settings, consolidated_rows, deduplicated_rows, redacted, majority_votes, accuracy_interval, numeric_judge, scoped_fetch, sampled_rows, pooled_values, density_rank, bounded_scope, isolation_check, companion_leaves)}

_MODE = lambda c: f"(SELECT v FROM (SELECT trim({c}) AS v, count(*) AS n FROM clinical_trials t WHERE t.nct_id IS NOT DISTINCT FROM k.nct_id AND trim({c}) <> '' GROUP BY 1) ORDER BY n DESC, v LIMIT 1) AS {c}"
_COUNTED = lambda c: f"m_{c} AS (SELECT nct_id, trim({c}) AS {c} FROM clinical_trials WHERE trim({c}) <> '' AND nct_id IS NOT NULL GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY nct_id ORDER BY count(*) DESC, trim({c})) = 1)"
ORACLE = {
    "csv_ingest": "SELECT 'rdf:type' AS p, count(*) AS n, 1 AS objects FROM nation UNION ALL SELECT 'rdfs:label', count(*), count(DISTINCT n_name) FROM nation UNION ALL SELECT 'attrs/name', count(*), count(DISTINCT n_name) FROM nation UNION ALL SELECT 'onto/region', count(*), count(DISTINCT n_regionkey) FROM nation",
    "json_records": "SELECT n_nationkey AS id, n_name AS name FROM nation",
    "byte_batches": """WITH RECURSIVE d AS (SELECT coalesce(source, '') AS source, strlen(text) AS n, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents WHERE text IS NOT NULL),
        b AS (SELECT source, i, n AS held, 0 AS batch, n FROM d WHERE i = 1 UNION ALL SELECT d.source, d.i, CASE WHEN b.held + d.n > 20000 THEN d.n ELSE b.held + d.n END, b.batch + CASE WHEN b.held + d.n > 20000 THEN 1 ELSE 0 END, d.n FROM b JOIN d ON d.source = b.source AND d.i = b.i + 1)
        SELECT nullif(source, '') AS source, batch, count(*) AS n_docs, sum(n) AS n_bytes FROM b GROUP BY 1, 2""",
    "html_reduction": "SELECT doc_id, 'T ' || doc_id AS title, 'id | ' || doc_id || chr(10) || rtrim('lang: ' || coalesce(lang, '')) AS text FROM documents WHERE text IS NOT NULL",
    "stream_usage": "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS requests FROM events GROUP BY 1, 2",
    "registered_function": "SELECT upper(n_name[1]) AS i, count(*) AS n FROM nation GROUP BY 1",
    "label_hydration": "SELECT DISTINCT 'entities/Customer/' || o_custkey AS o, CASE WHEN suffix(c_name, '7') THEN c_name ELSE CAST(o_custkey AS VARCHAR) END AS label FROM orders LEFT JOIN customer ON c_custkey = o_custkey",
    "undirected_edges": "SELECT DISTINCT least(o_custkey % 50, o_orderkey % 50) AS a, greatest(o_custkey % 50, o_orderkey % 50) AS b FROM orders WHERE o_custkey % 50 <> o_orderkey % 50",
    "layer_shadowing": "SELECT name, CASE WHEN datatype = 'integer' THEN 'float' ELSE datatype END AS datatype, CASE WHEN datatype = 'integer' THEN 0 ELSE 1 END AS layer FROM attribute_declarations",
    "inherited_settings": "WITH RECURSIVE t AS (" + " UNION ALL ".join(f"SELECT '{c}' AS c, {repr(p) if p else 'NULL'} AS p" for c, p in CLASS_TREE) + "), s AS (SELECT unnest(['Thing', 'Party', 'Supplier']) AS c, unnest(['open', 'pii', 'secret']) AS tag), up AS (SELECT c, c AS a, 0 AS d FROM t UNION ALL SELECT up.c, t.p, d + 1 FROM up JOIN t ON up.a = t.c WHERE t.p IS NOT NULL) SELECT up.c AS class, arg_min(tag, d) AS tag FROM up JOIN s ON s.c = up.a GROUP BY 1",
    "consolidated_rows": f"WITH {_COUNTED('condition')}, {_COUNTED('phase')}, {_COUNTED('status')} SELECT k.nct_id, m_condition.condition, m_phase.phase, m_status.status FROM (SELECT DISTINCT nct_id FROM clinical_trials) k LEFT JOIN m_condition ON k.nct_id = m_condition.nct_id LEFT JOIN m_phase ON k.nct_id = m_phase.nct_id LEFT JOIN m_status ON k.nct_id = m_status.nct_id",
    "deduplicated_rows": "SELECT record_id FROM healthcare_providers QUALIFY full_name IS NULL OR trim(full_name) = '' OR row_number() OVER (PARTITION BY lower(trim(full_name)), coalesce(lower(trim(city)), phone, '') ORDER BY record_id) = 1",
    "redacted": "SELECT record_id, full_name, CASE WHEN phone IS NOT NULL THEN '***' END AS phone FROM healthcare_providers",
    "majority_votes": "SELECT event_id % 200 AS item, count(*) FILTER (value > 10) * 2 > count(*) AS accepted, count(*) AS n_votes FROM events GROUP BY 1",
    "accuracy_interval": "WITH g AS (SELECT tier, count(*) FILTER (tier = tier_llm_label) AS h, count(*) AS n FROM gold_questions WHERE tier IS NOT NULL GROUP BY 1), p AS (SELECT *, h / n AS p FROM g) SELECT tier, n, round((p + 1.96 * 1.96 / (2 * n) - 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n), 6) AS low, round((p + 1.96 * 1.96 / (2 * n) + 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n), 6) AS high FROM p",
    "numeric_judge": "SELECT c_custkey FROM customer WHERE CASE WHEN c_acctbal = 0 THEN round(c_acctbal, -2) = 0 ELSE abs(round(c_acctbal, -2) - c_acctbal) <= 0.02 * abs(c_acctbal) END",
    "scoped_fetch": "SELECT 'entities/Nation/1' AS s, unnest(['rdf:type', 'rdfs:label', 'onto/region']) AS p, unnest(['types/Nation', n_name, 'entities/Region/' || n_regionkey]) AS o FROM nation WHERE n_nationkey = 1 UNION ALL SELECT 'entities/Supplier/3', unnest(['rdf:type', 'rdfs:label', 'attrs/acctbal', 'onto/nation']), unnest(['types/Supplier', s_name, CAST(s_acctbal AS VARCHAR), 'entities/Nation/' || s_nationkey]) FROM supplier WHERE s_suppkey = 3",
    "sampled_rows": "SELECT c_custkey, (SELECT count(*) FROM customer) AS total FROM customer ORDER BY md5(c_custkey || '|3'), c_custkey LIMIT 20",
    "pooled_values": "WITH v AS (SELECT DISTINCT p_name FROM part) SELECT p_name FROM (SELECT p_name FROM v ORDER BY p_name LIMIT 20) UNION SELECT p_name FROM (SELECT p_name FROM v ORDER BY p_name DESC LIMIT 20) UNION SELECT p_name FROM (SELECT p_name FROM v ORDER BY p_name LIMIT 20 OFFSET 50)",
    "density_rank": "SELECT trial_row, (title IS NOT NULL)::INT + (condition IS NOT NULL)::INT + (sponsor IS NOT NULL)::INT + (phase IS NOT NULL)::INT + (status IS NOT NULL)::INT + (enrollment IS NOT NULL)::INT + (start_year IS NOT NULL)::INT AS filled FROM clinical_trials ORDER BY filled DESC, trial_row LIMIT 25",
    "bounded_scope": "WITH c AS (SELECT *, 'entities/Customer/' || c_custkey AS s FROM customer ORDER BY 'entities/Customer/' || c_custkey LIMIT 10) SELECT s, unnest(['rdf:type', 'rdfs:label', 'attrs/acctbal', 'attrs/segment', 'onto/nation']) AS p, unnest(['types/Customer', c_name, CAST(c_acctbal AS VARCHAR), c_mktsegment, 'entities/Nation/' || c_nationkey]) AS o FROM c",
    "isolation_check": "WITH o AS (SELECT entity_uri, tenant_id AS owner FROM entity_spatiotemporal QUALIFY row_number() OVER (PARTITION BY entity_uri ORDER BY recorded_at, fact_id) = 1) SELECT tenant_id, count(*) AS foreign_facts FROM entity_spatiotemporal JOIN o USING (entity_uri) WHERE tenant_id <> owner GROUP BY 1",
    "companion_leaves": "WITH n AS (SELECT name FROM attribute_declarations UNION ALL SELECT name || '_source' FROM attribute_declarations WHERE length(name) < 8) SELECT name FROM n WHERE regexp_extract(name, '^(.*)_[^_]+$', 1) IN (SELECT name FROM n)",
}
