"""Facts over time, mutations and snapshots, beside SQL. Events serve as a change log, orders as dated facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import facts
from ..runtime import table
from ..model import quads_of
from .graph import NATION, graph


def _log(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "events").select("event_id", "ts", "user_id", "event_type", "value")


def current_facts(spark: SparkSession, root: str) -> DataFrame:
    o = table(spark, root, "orders").select("o_orderkey", "o_custkey")
    return facts.current_facts(o, table(spark, root, "orders").filter("o_orderstatus = 'F'"), ["o_orderkey"])


def fact_history(spark: SparkSession, root: str) -> DataFrame:
    o = table(spark, root, "orders")
    closed = o.filter("o_orderstatus = 'F'").select("o_orderkey", F.date_add(F.to_date("o_orderdate"), 30).alias("valid_to"))
    return facts.fact_history(o.select("o_orderkey", F.to_date("o_orderdate").alias("valid_from")), closed, ["o_orderkey"])


def value_changes(spark: SparkSession, root: str) -> DataFrame:
    return facts.value_changes(_log(spark, root), ["user_id"], "event_type", "ts", "event_id")


def value_history_since(spark: SparkSession, root: str) -> DataFrame:
    return facts.value_changes(_log(spark, root), ["user_id"], "event_type", "ts", "event_id").filter(F.col("changed_at") > F.lit("2024-01-20").cast("timestamp")).orderBy("changed_at", "user_id", "old", "new").limit(100)


def recorded_changes(spark: SparkSession, root: str) -> DataFrame:
    c = table(spark, root, "customer").select("c_custkey", "c_mktsegment")
    new = c.withColumn("c_mktsegment", F.when(F.col("c_custkey") % 7 == 0, "OTHER").otherwise(F.col("c_mktsegment")))
    return facts.recorded_changes(new, c.filter("c_custkey % 2 = 0"), ["c_custkey"], "c_mktsegment")


def conflict_winner(spark: SparkSession, root: str) -> DataFrame:
    names = F.array(*[F.lit(x) for x in ("user_assertion", "source_of_truth", "machine_reverification", "authoritative", "supplementary", "rumour")])
    e = table(spark, root, "events").select("user_id", "event_type", F.element_at(names, (F.col("event_id") % 6 + 1).cast("int")).alias("authority"), F.lit(None).cast("double").alias("confidence"), "ts")
    return facts.resolve_conflicts(e, ["user_id"], "event_type", "authority", "confidence", "ts")


def scd_intervals(spark: SparkSession, root: str) -> DataFrame:
    return facts.supersede(_log(spark, root), ["user_id"], "event_type", "ts", "event_id").select("user_id", "event_type", "valid_from", "valid_to")


def suppression_filter(spark: SparkSession, root: str) -> DataFrame:
    o = table(spark, root, "orders").select("o_orderkey", "o_custkey")
    return facts.without_suppressed(o, o.filter("o_orderkey % 11 = 0"), o.filter("o_custkey % 5 = 0"), ["o_orderkey"], "o_custkey")


def rewrite_subject(spark: SparkSession, root: str) -> DataFrame:
    q = graph(spark, root).filter(F.col("p").isin("onto/nation", "onto/region", "rdfs:label"))
    mapping = table(spark, root, "nation").filter("n_nationkey % 5 = 1").select(F.concat(F.lit("entities/Nation/"), "n_nationkey").alias("old"), F.concat(F.lit("entities/Nation/"), F.col("n_nationkey") - 1).alias("new"))
    return facts.rename_subjects(q, mapping).groupBy("p").agg(F.count("*").alias("n"), F.count_distinct("s").alias("subjects"), F.count_distinct("o").alias("objects"))


def rewrite_predicate(spark: SparkSession, root: str) -> DataFrame:
    q = facts.rename_predicates(graph(spark, root), {"attrs/segment": "attrs/market", "attrs/market": "attrs/sector"})
    return q.groupBy("p").agg(F.count("*").alias("n"))


def graph_delta(spark: SparkSession, root: str) -> DataFrame:
    n = table(spark, root, "nation")
    before = quads_of(n.filter("n_nationkey < 20"), NATION)
    after = quads_of(n.filter("n_nationkey >= 2").withColumn("n_regionkey", F.when(F.col("n_nationkey") == 5, 0).otherwise(F.col("n_regionkey"))), NATION)
    return facts.delta(before, after)


def delete_triples(spark: SparkSession, root: str) -> DataFrame:
    q = graph(spark, root).filter("p = 'onto/nation'").select("s", "p", "o")
    gone = q.filter(F.col("o") == "entities/Nation/3")
    return q.join(gone, ["s", "p", "o"], "left_anti")


def watch_snapshot(spark: SparkSession, root: str) -> DataFrame:
    return facts.snapshot(table(spark, root, "nation"), "n_regionkey", "n_name")


def watch_diff(spark: SparkSession, root: str) -> DataFrame:
    o = table(spark, root, "orders")
    at = lambda t: facts.snapshot(o.filter(F.col("o_orderdate") < F.lit(t).cast("timestamp")).select("o_custkey", "o_orderpriority").distinct(), "o_custkey", "o_orderpriority")
    return facts.snapshot_diff(at("1996-01-01"), at("1996-03-01"))


def as_of(spark: SparkSession, root: str) -> DataFrame:
    o = table(spark, root, "orders").select("o_orderkey", F.col("o_orderdate").alias("lo"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate") + F.expr("INTERVAL 60 DAYS")).alias("hi"))
    return facts.as_of(o, F.lit("1997-06-01").cast("timestamp"), F.col("lo"), F.col("hi")).select("o_orderkey")


def interval_overlap(spark: SparkSession, root: str) -> DataFrame:
    o = table(spark, root, "orders").select("o_orderkey", F.col("o_orderdate").alias("lo"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate") + F.expr("INTERVAL 60 DAYS")).alias("hi"))
    return facts.overlapping(o, F.lit("1997-06-01").cast("timestamp"), F.lit("1997-07-01").cast("timestamp"), F.col("lo"), F.col("hi")).select("o_orderkey")


def due_schedules(spark: SparkSession, root: str) -> DataFrame:
    """Users whose hourly watch is due at the end of the log, the longest overdue first, with their next run past it."""
    e = table(spark, root, "events")
    end = F.lit("2024-01-30 00:00:00").cast("timestamp")
    last = e.groupBy("user_id").agg(F.max("ts").alias("last"))
    due = last.filter(F.col("last") + F.expr("INTERVAL 1 HOUR") <= end)
    hours = F.floor((F.unix_timestamp(end) - F.unix_timestamp("last")) / 3600) + 1
    return due.orderBy("last", "user_id").limit(20).select("user_id", "last", F.timestamp_seconds(F.unix_timestamp("last") + hours * 3600).alias("next_run"))


QUERIES = {f.__name__: f for f in (current_facts, fact_history, value_changes, value_history_since, recorded_changes, conflict_winner, scd_intervals, suppression_filter, rewrite_subject, rewrite_predicate, graph_delta, delete_triples, watch_snapshot, watch_diff, as_of, interval_overlap, due_schedules)}

_CHANGES = "SELECT user_id, lag(event_type) OVER w AS old, event_type AS new, ts AS changed_at FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"
_LIFE = "SELECT o_orderkey, o_orderdate AS lo, CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 60 DAY END AS hi FROM orders"
_N = "'entities/Nation/' || "
_SNAP = lambda t: f"SELECT o_custkey AS key, string_agg(o_orderpriority, '|' ORDER BY o_orderpriority) AS value FROM (SELECT DISTINCT o_custkey, o_orderpriority FROM orders WHERE o_orderdate < TIMESTAMP '{t}') GROUP BY 1"
_NQ = lambda where, region="n_regionkey": f"SELECT {_N} n_nationkey AS s, 'rdf:type' AS p, 'types/Nation' AS o FROM nation WHERE {where} UNION SELECT {_N} n_nationkey, 'rdfs:label', n_name FROM nation WHERE {where} UNION SELECT {_N} n_nationkey, 'onto/region', 'entities/Region/' || {region} FROM nation WHERE {where}"
_M = "CASE WHEN k % 5 = 1 THEN k - 1 ELSE k END"
ORACLE = {
    "current_facts": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus <> 'F'",
    "fact_history": "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS valid_from, CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderdate AS DATE) + 30 END AS valid_to FROM orders",
    "value_changes": f"SELECT * FROM ({_CHANGES}) WHERE old IS NOT NULL AND old <> new",
    "value_history_since": f"SELECT * FROM ({_CHANGES}) WHERE old IS NOT NULL AND old <> new AND changed_at > TIMESTAMP '2024-01-20' ORDER BY changed_at, user_id, old, new LIMIT 100",
    "recorded_changes": "SELECT c_custkey, c_mktsegment AS old, 'OTHER' AS new FROM customer WHERE c_custkey % 14 = 0",
    "conflict_winner": """WITH c AS (SELECT user_id, event_type, ts, event_id % 6 AS a, CASE event_id % 6 WHEN 0 THEN 0.99 WHEN 1 THEN 0.95 WHEN 2 THEN 0.9 WHEN 3 THEN 0.85 WHEN 4 THEN 0.6 ELSE 0.5 END AS conf, CASE event_id % 6 WHEN 5 THEN 9 ELSE event_id % 6 END AS r FROM events),
        x AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY r, conf DESC, ts DESC, event_type DESC) AS n, count(*) OVER (PARTITION BY user_id) AS k FROM c)
        SELECT x.user_id, event_type AS winner, r AS authority_rank, conf AS confidence, (SELECT count(DISTINCT event_type) > 1 FROM c WHERE c.user_id = x.user_id) AS contested FROM x WHERE n = 1""",
    "scd_intervals": "WITH s AS (SELECT *, lag(event_type) OVER w AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT user_id, event_type, ts AS valid_from, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS valid_to FROM s WHERE b IS NULL OR b <> event_type",
    "suppression_filter": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 11 <> 0 AND o_custkey % 5 <> 0",
    "rewrite_subject": f"""WITH q AS (SELECT 'onto/nation' AS p, 'C' || c_custkey AS s, 'N' || {_M.replace('k', 'c_nationkey')} AS o FROM customer UNION SELECT 'onto/nation', 'S' || s_suppkey, 'N' || {_M.replace('k', 's_nationkey')} FROM supplier
        UNION SELECT 'onto/region', 'N' || {_M.replace('k', 'n_nationkey')}, 'R' || n_regionkey FROM nation UNION SELECT 'rdfs:label', 'C' || c_custkey, c_name FROM customer UNION SELECT 'rdfs:label', 'S' || s_suppkey, s_name FROM supplier
        UNION SELECT 'rdfs:label', 'N' || {_M.replace('k', 'n_nationkey')}, n_name FROM nation UNION SELECT 'rdfs:label', 'R' || r_regionkey, r_name FROM region)
        SELECT p, count(*) AS n, count(DISTINCT s) AS subjects, count(DISTINCT o) AS objects FROM q GROUP BY p""",
    "rewrite_predicate": "SELECT p, count(*) AS n FROM (SELECT unnest(['rdf:type', 'rdfs:label', 'attrs/acctbal', 'attrs/sector', 'onto/nation']) AS p FROM customer UNION ALL SELECT unnest(['rdf:type', 'rdfs:label', 'attrs/acctbal', 'onto/nation']) FROM supplier UNION ALL SELECT unnest(['rdf:type', 'rdfs:label', 'onto/region']) FROM nation UNION ALL SELECT unnest(['rdf:type', 'rdfs:label']) FROM region UNION ALL SELECT unnest(['rdf:type', 'attrs/total', 'attrs/status', 'attrs/date', 'attrs/priority', 'onto/customer']) FROM orders) GROUP BY p",
    "graph_delta": f"WITH b AS ({_NQ('n_nationkey < 20')}), a AS ({_NQ('n_nationkey >= 2', 'CASE WHEN n_nationkey = 5 THEN 0 ELSE n_regionkey END')}), d AS (SELECT *, 'added' AS change FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'removed' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)) SELECT s, p, o, change, sha1(s || '|' || p || '|' || o) AS fact_id FROM d",
    "delete_triples": f"SELECT 'entities/Customer/' || c_custkey AS s, 'onto/nation' AS p, {_N} c_nationkey AS o FROM customer WHERE c_nationkey <> 3 UNION ALL SELECT 'entities/Supplier/' || s_suppkey, 'onto/nation', {_N} s_nationkey FROM supplier WHERE s_nationkey <> 3",
    "watch_snapshot": "SELECT n_regionkey AS key, string_agg(n_name, '|' ORDER BY n_name) AS value FROM nation GROUP BY 1",
    "watch_diff": f"WITH a AS ({_SNAP('1996-01-01')}), b AS ({_SNAP('1996-03-01')}) SELECT b.key, CASE WHEN a.key IS NULL THEN 'added' ELSE 'changed' END AS change, a.value AS old, b.value AS new FROM b LEFT JOIN a ON a.key = b.key WHERE a.key IS NULL OR a.value <> b.value",
    "as_of": f"SELECT o_orderkey FROM ({_LIFE}) WHERE lo <= TIMESTAMP '1997-06-01' AND (hi IS NULL OR TIMESTAMP '1997-06-01' < hi)",
    "interval_overlap": f"SELECT o_orderkey FROM ({_LIFE}) WHERE lo < TIMESTAMP '1997-07-01' AND (hi IS NULL OR TIMESTAMP '1997-06-01' < hi)",
    "due_schedules": "SELECT user_id, last, to_timestamp(floor(epoch(last)) + (floor((epoch(TIMESTAMP '2024-01-30') - floor(epoch(last))) / 3600) + 1) * 3600) AT TIME ZONE 'UTC' AS next_run FROM (SELECT user_id, max(ts) AS last FROM events GROUP BY 1) WHERE last + INTERVAL 1 HOUR <= TIMESTAMP '2024-01-30' ORDER BY last, user_id LIMIT 20",
}
