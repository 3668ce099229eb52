"""Statistics and profiles, beside SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import profile
from ..runtime import table
from .graph import graph, virtual

_ORDERS = ["o_orderstatus", "o_orderpriority", "o_custkey", "o_totalprice", "o_orderdate"]


def column_profile(spark: SparkSession, root: str) -> DataFrame:
    p = profile.column_profile(table(spark, root, "orders"), _ORDERS)
    return p.select("name", "rows", "distinct", F.round("completeness", 6).alias("completeness"), F.round("uniqueness", 6).alias("uniqueness"), "shape", "is_key", "incomplete", "repeats")


def functional_deps(spark: SparkSession, root: str) -> DataFrame:
    p = table(spark, root, "part").select("p_brand", "p_type", "p_size", F.substring("p_brand", 1, 7).alias("maker"))
    return profile.functional_dependencies(p, ["p_brand", "p_type", "p_size", "maker"])


def type_counts(spark: SparkSession, root: str) -> DataFrame:
    return profile.type_counts(graph(spark, root))


def primary_type_counts(spark: SparkSession, root: str) -> DataFrame:
    q = graph(spark, root)
    extra = q.filter((F.col("p") == "rdf:type") & (F.col("o") == "types/Supplier")).withColumn("o", F.lit("types/Vendor"))
    return profile.primary_types(q.unionByName(extra)).groupBy("type").agg(F.count("*").alias("entities"))


def kg_stats(spark: SparkSession, root: str) -> DataFrame:
    return profile.table_statistics(virtual(spark, root))


def type_edges(spark: SparkSession, root: str) -> DataFrame:
    return profile.table_edges(virtual(spark, root))


def drift_floor(spark: SparkSession, root: str) -> DataFrame:
    q = graph(spark, root)
    rare = q.filter((F.col("p") == "attrs/acctbal") & (F.col("o").try_cast("double") > 9000)).withColumn("p", F.lit("attrs/rare"))
    return profile.drift_split(profile.graph_statistics(q.unionByName(rare)), ["attrs/status"])


def enum_discovery(spark: SparkSession, root: str) -> DataFrame:
    return profile.enum_values(graph(spark, root).filter(F.col("p").isin("attrs/segment", "attrs/status", "attrs/priority", "attrs/acctbal")))


def content_hashes(spark: SparkSession, root: str) -> DataFrame:
    return profile.content_hash(table(spark, root, "nation"), ["n_regionkey"], "n_name")


def clean_ledger(spark: SparkSession, root: str) -> DataFrame:
    f = table(spark, root, "coffee_shops_facts")
    return f.groupBy("attribute").agg(F.count("*").alias("total"), *[F.count_if(F.col("outcome") == o).alias(o) for o in ("passed", "transformed", "dropped")])


def ontology_fingerprint(spark: SparkSession, root: str) -> DataFrame:
    d = table(spark, root, "attribute_declarations").select(F.concat_ws("|", "type_name", "name", "datatype").alias("line"))
    return d.agg(F.substring(F.sha2(F.array_join(F.array_sort(F.collect_set("line")), "\n"), 256), 1, 16).alias("version"))


def usage_daily(spark: SparkSession, root: str) -> DataFrame:
    e = table(spark, root, "events")
    return e.groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("requests"), F.round(F.sum("value"), 4).alias("total"), F.count_distinct("user_id").alias("users"))


def usage_report(spark: SparkSession, root: str) -> DataFrame:
    """A zero-filled series of days with average value and the share of errors."""
    e = table(spark, root, "events")
    days = e.agg(F.to_date(F.min("ts")).alias("a"), F.to_date(F.max("ts")).alias("b")).select(F.explode(F.sequence("a", "b")).alias("day"))
    per = e.filter("event_type = 'error'").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.avg("value").alias("v"))
    return days.join(per, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("errors"), F.round(F.coalesce("v", F.lit(0.0)), 1).alias("mean_value"))


def usage_top(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "events").groupBy("user_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "user_id").limit(6)


def dedupe_union(spark: SparkSession, root: str) -> DataFrame:
    """One row per shop id with its distinct attribute values."""
    s = table(spark, root, "coffee_shops").filter("id IS NOT NULL").select("id", F.explode_outer("attributes").alias("a"))
    return s.groupBy("id").agg(F.count_distinct(F.concat_ws("=", "a.name", "a.value")).alias("n_values"), F.count("a").alias("n_pairs"))


QUERIES = {f.__name__: f for f in (column_profile, functional_deps, type_counts, primary_type_counts, kg_stats, type_edges, drift_floor, enum_discovery, content_hashes, clean_ledger, ontology_fingerprint, usage_daily, usage_report, usage_top, dedupe_union)}

_STATS = """
SELECT 'types/Customer' AS type, 'attrs/acctbal' AS p, count(*) AS entities, count(*) AS facts, 0 AS edges, 100.0 AS coverage FROM customer
UNION ALL SELECT 'types/Customer', 'attrs/segment', count(*), count(*), 0, 100.0 FROM customer
UNION ALL SELECT 'types/Customer', 'onto/nation', count(*), count(*), count(*), 100.0 FROM customer
UNION ALL SELECT 'types/Supplier', 'attrs/acctbal', count(*), count(*), 0, 100.0 FROM supplier
UNION ALL SELECT 'types/Supplier', 'onto/nation', count(*), count(*), count(*), 100.0 FROM supplier
UNION ALL SELECT 'types/Nation', 'onto/region', count(*), count(*), count(*), 100.0 FROM nation
UNION ALL SELECT 'types/Order', a, count(*), count(*), 0, 100.0 FROM orders, (SELECT unnest(['attrs/total', 'attrs/status', 'attrs/date', 'attrs/priority']) AS a) GROUP BY a
UNION ALL SELECT 'types/Order', 'onto/customer', count(*), count(*), count(*), 100.0 FROM orders"""
_PROFILE = lambda c, shape, code: f"SELECT '{c}' AS name, count(*) AS rows, count(DISTINCT {c}) AS \"distinct\", round(count({c}) / count(*), 6) AS completeness, round(count(DISTINCT {c}) / count({c}), 6) AS uniqueness, '{shape}' AS shape, count({c}) / count(*) > 0.99 AND count(DISTINCT {c}) / count({c}) > 0.99 AS is_key, count({c}) / count(*) < 0.98 AS incomplete, count(DISTINCT {c}) > 1 AND count(DISTINCT {c}) / count(*) < 0.5 AND count({c}) > count(DISTINCT {c}) AS repeats FROM orders"
_FD = " UNION ALL ".join(
    f"SELECT '{a}' AS determinant, '{b}' AS dependent FROM (SELECT {a} AS x, count(DISTINCT {b}) AS k, count(*) AS n FROM p GROUP BY 1) HAVING max(k) = 1 AND count(*) > 1 AND count(*) < 0.95 * sum(n) AND (SELECT count(DISTINCT {b}) FROM p) > 1 AND (SELECT count(DISTINCT {a}) FROM p) <= 400 AND (SELECT count(DISTINCT {b}) FROM p) <= 400"
    for a in ("p_brand", "p_type", "p_size", "maker") for b in ("p_brand", "p_type", "p_size", "maker") if a != b
)
ORACLE = {
    "column_profile": " UNION ALL ".join(_PROFILE(c, s, 0) for c, s in (("o_orderstatus", "code"), ("o_orderpriority", "label"), ("o_custkey", "number"), ("o_totalprice", "number"), ("o_orderdate", "date"))),
    "functional_deps": f"WITH p AS (SELECT p_brand, p_type, p_size, substr(p_brand, 1, 7) AS maker FROM part) {_FD}",
    "type_counts": "SELECT 'types/Customer' AS type, count(*) AS entities FROM customer UNION ALL SELECT 'types/Supplier', count(*) FROM supplier UNION ALL SELECT 'types/Nation', count(*) FROM nation UNION ALL SELECT 'types/Region', count(*) FROM region UNION ALL SELECT 'types/Order', count(*) FROM orders",
    "primary_type_counts": "SELECT 'types/Customer' AS type, count(*) AS entities FROM customer UNION ALL SELECT 'types/Supplier', count(*) FROM supplier UNION ALL SELECT 'types/Nation', count(*) FROM nation UNION ALL SELECT 'types/Region', count(*) FROM region UNION ALL SELECT 'types/Order', count(*) FROM orders",
    "kg_stats": _STATS,
    "type_edges": "SELECT 'types/Customer' AS source, 'onto/nation' AS p, 'types/Nation' AS target, count(*) AS n FROM customer UNION ALL SELECT 'types/Supplier', 'onto/nation', 'types/Nation', count(*) FROM supplier UNION ALL SELECT 'types/Nation', 'onto/region', 'types/Region', count(*) FROM nation UNION ALL SELECT 'types/Order', 'onto/customer', 'types/Customer', count(*) FROM orders",
    "drift_floor": f"WITH s AS ({_STATS} UNION ALL SELECT 'types/Customer', 'attrs/rare', count(*) FILTER (c_acctbal > 9000), 0, 0, round(count(*) FILTER (c_acctbal > 9000) / count(*) * 100, 1) FROM customer UNION ALL SELECT 'types/Supplier', 'attrs/rare', count(*) FILTER (s_acctbal > 9000), 0, 0, round(count(*) FILTER (s_acctbal > 9000) / count(*) * 100, 1) FROM supplier) SELECT type, p, CASE WHEN p = 'attrs/status' OR (coverage >= 20 AND entities >= 5) THEN 'declared' ELSE 'quarantined' END AS state FROM s WHERE entities > 0",
    "enum_discovery": """WITH v AS (SELECT 'attrs/segment' AS p, c_mktsegment AS o FROM customer UNION ALL SELECT 'attrs/status', o_orderstatus FROM orders UNION ALL SELECT 'attrs/priority', o_orderpriority FROM orders)
        SELECT p, count(DISTINCT o) AS n_values, CASE WHEN count(DISTINCT o) <= 25 THEN string_agg(DISTINCT o, '|' ORDER BY o) END AS listed FROM v GROUP BY p
        UNION ALL SELECT 'attrs/acctbal', (SELECT count(*) FROM (SELECT c_acctbal FROM customer UNION SELECT s_acctbal FROM supplier)), NULL""",
    "content_hashes": "SELECT n_regionkey, sha256(string_agg(DISTINCT trim(n_name), chr(10) || chr(10) ORDER BY trim(n_name))) AS hash FROM nation GROUP BY 1",
    "clean_ledger": "SELECT attribute, count(*) AS total, count(*) FILTER (outcome = 'passed') AS passed, count(*) FILTER (outcome = 'transformed') AS transformed, count(*) FILTER (outcome = 'dropped') AS dropped FROM coffee_shops_facts GROUP BY 1",
    "ontology_fingerprint": "SELECT substr(sha256(string_agg(DISTINCT line, chr(10) ORDER BY line)), 1, 16) AS version FROM (SELECT type_name || '|' || name || '|' || datatype AS line FROM attribute_declarations)",
    "usage_daily": "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS requests, round(sum(value), 4) AS total, count(DISTINCT user_id) AS users FROM events GROUP BY 1, 2",
    "usage_report": "WITH d AS (SELECT CAST(unnest(generate_series(min(ts)::DATE, max(ts)::DATE, INTERVAL 1 DAY)) AS DATE) AS day FROM events), e AS (SELECT ts::DATE AS day, count(*) AS n, avg(value) AS v FROM events WHERE event_type = 'error' GROUP BY 1) SELECT day, coalesce(n, 0) AS errors, round(coalesce(v, 0), 1) AS mean_value FROM d LEFT JOIN e USING (day)",
    "usage_top": "SELECT user_id, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, user_id LIMIT 6",
    "dedupe_union": "SELECT id, count(DISTINCT CASE WHEN a IS NOT NULL THEN concat_ws('=', a.name, a.value) ELSE '' END) AS n_values, count(a) AS n_pairs FROM (SELECT id, unnest(CASE WHEN len(attributes) > 0 THEN attributes ELSE [NULL] END) AS a FROM coffee_shops WHERE id IS NOT NULL) GROUP BY id",
}
