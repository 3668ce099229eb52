"""Updates, validity, provenance, runs and logs, beside SQL on before and after."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import ingest, records
from ..runtime import shared_dir, table
from ..sources.store import GraphStore
from ..sparql.update import update
from .graph import graph

_COLS = ["s", "p", "o"]


def _nations(spark: SparkSession, root: str) -> DataFrame:
    return graph(spark, root).filter("s LIKE 'entities/Nation/%' OR s LIKE 'entities/Region/%'")


def update_insert_data(spark: SparkSession, root: str) -> DataFrame:
    """Facts that are there already are not inserted again; another graph takes its own."""
    q = _nations(spark, root)
    text = 'INSERT DATA { <entities/Region/0> rdfs:label "AFRICA" ; <attrs/area> 30.4 . <entities/Region/9> a <types/Region> ; rdfs:label "ATLANTIS" . GRAPH <side> { <entities/Region/9> <onto/near> <entities/Region/0> } }'
    return update(q, text).filter("s LIKE 'entities/Region/%'").select("g", *_COLS, "dtype")


def update_delete_data(spark: SparkSession, root: str) -> DataFrame:
    text = 'DELETE DATA { <entities/Nation/1> <onto/region> <entities/Region/1> . <entities/Nation/2> rdfs:label "not there" } ; DELETE DATA { <entities/Region/2> a <types/Region> }'
    return update(_nations(spark, root), text).filter("p <> 'rdfs:label'").select(*_COLS)


def update_delete_where(spark: SparkSession, root: str) -> DataFrame:
    return update(_nations(spark, root), "DELETE WHERE { ?n <onto/region> <entities/Region/3> ; rdfs:label ?l }").filter("p IN ('onto/region', 'rdfs:label') AND s LIKE 'entities/Nation/%'").select(*_COLS)


def update_modify(spark: SparkSession, root: str) -> DataFrame:
    """Regions renamed and nations re-pointed in one update, both from the graph as it was."""
    text = 'DELETE { ?n <onto/region> ?r . ?r rdfs:label ?l } INSERT { ?n <onto/continent> ?r . ?r rdfs:label ?new } WHERE { ?n <onto/region> ?r . ?r rdfs:label ?l BIND(CONCAT("The ", ?l) AS ?new) FILTER(STRSTARTS(?l, "A")) }'
    return update(_nations(spark, root), text).filter("p LIKE 'onto/%' OR s LIKE 'entities/Region/%'").select(*_COLS)


def graph_store(spark: SparkSession, root: str) -> DataFrame:
    """A written graph with an update: facts of each version by predicate."""
    store = GraphStore(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")
    store.write(_nations(spark, root))
    store.update('INSERT DATA { <entities/Region/9> rdfs:label "ATLANTIS" } ; DELETE WHERE { ?n <onto/region> <entities/Region/1> }')
    both = [store.read(v).groupBy("p").agg(F.count("*").alias("n")).withColumn("version", F.lit(v)) for v in store.versions()]
    return both[0].unionByName(both[1])


def insert_receipts(spark: SparkSession, root: str) -> DataFrame:
    o = table(spark, root, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    _, receipt = records.insert_facts(o.filter("o_orderstatus <> 'P'"), o.filter("o_custkey % 3 = 0").unionByName(o.filter("o_custkey % 6 = 0")), ["o_orderkey"])
    return receipt


def delete_pairs(spark: SparkSession, root: str) -> DataFrame:
    q = _nations(spark, root)
    pairs = spark.createDataFrame([("entities/Nation/1", "rdfs:label"), ("entities/Nation/2", "onto/region"), ("entities/Region/1", "rdf:type")], "s string, p string")
    return records.without_pairs(q, pairs).select(*_COLS)


def interval_changes(spark: SparkSession, root: str) -> DataFrame:
    """Validity of users' subscriptions: a signup opens, an error closes, a purchase reopens."""
    e = table(spark, root, "events").filter("event_type IN ('signup', 'error', 'purchase')")
    changes = e.select(F.col("user_id").cast("string").alias("fact_id"), F.when(F.col("event_type") == "signup", "open").when(F.col("event_type") == "error", "close").otherwise("reopen").alias("action"), F.col("ts").cast("timestamp").alias("at"))
    before = table(spark, root, "customer").filter("c_custkey <= 5").select(F.col("c_custkey").cast("string").alias("fact_id"), F.lit("2020-01-01").cast("timestamp").alias("valid_from"), F.lit("2021-01-01").cast("timestamp").alias("valid_to"))
    return records.set_intervals(before, changes)


def fact_provenance(spark: SparkSession, root: str) -> DataFrame:
    e = table(spark, root, "events")
    level = F.element_at(F.array(F.lit("user_assertion"), F.lit("authoritative"), F.lit("hearsay")), (F.col("event_id") % 3 + 1).cast("int"))
    p = records.with_provenance(e.select("event_id", "user_id", "ts"), F.concat(F.lit("feed-"), F.col("user_id") % 4), level, F.when(F.col("event_id") % 5 == 0, 0.42), F.col("ts"))
    return p.groupBy("source", "authority").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("confidence"))


def current_claims(spark: SparkSession, root: str) -> DataFrame:
    """Orders that are not closed, with the best of the sources that report them."""
    o = table(spark, root, "orders").select(F.col("o_orderkey").alias("fact_id"), "o_custkey")
    closed = table(spark, root, "orders").select(F.col("o_orderkey").alias("fact_id"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("valid_to"))
    li = table(spark, root, "lineitem").select(F.col("l_orderkey").alias("fact_id"), F.concat(F.lit("s"), "l_suppkey").alias("source"), F.lit("supplementary").alias("authority"), F.col("l_discount").alias("confidence"), F.col("l_shipdate").alias("recorded_at"))
    return records.existing_claims(o, closed, li, ["o_custkey"]).select("fact_id", "confidence", "recorded_at")


def corrected_claims(spark: SparkSession, root: str) -> DataFrame:
    c = table(spark, root, "customer")
    level = F.element_at(F.array(F.lit("user_assertion"), F.lit("source_of_truth"), F.lit("supplementary")), (F.col("c_custkey") % 3 + 1).cast("int"))
    claims = c.filter("c_custkey % 5 <> 0").select("c_custkey", "c_mktsegment", level.alias("authority"))
    said = c.filter("c_custkey % 2 = 0").select("c_custkey", F.when(F.col("c_custkey") % 4 == 0, "OTHER").otherwise(F.col("c_mktsegment")).alias("c_mktsegment"))
    return records.corrections(claims, said, ["c_custkey"], "c_mktsegment", "machine_reverification")


def recency_policy(spark: SparkSession, root: str) -> DataFrame:
    a = table(spark, root, "attribute_declarations")
    shop = lambda *names: [("CoffeeShop", n) for n in names]
    return a.select("name", records.recency_decides(F.col("type_name"), F.col("name"), multivalued=shop("phone", "address", "website"), single=shop("phone")).alias("later_wins"), records.recency_decides(F.col("type_name"), F.col("name"), single=shop("rating"), default_multivalued=True).alias("by_default_several"))


def cited_answers(spark: SparkSession, root: str) -> DataFrame:
    n = table(spark, root, "nation").select(F.col("n_nationkey").alias("k"))
    p = table(spark, root, "supplier").select(F.col("s_nationkey").alias("k"), F.concat(F.lit("s"), F.col("s_suppkey") % 7).alias("source"), F.col("s_acctbal").alias("confidence"), F.lit(0).alias("recorded_at")).filter("k % 4 <> 0")
    return records.citations(n, p, ["k"])


def display_companions(spark: SparkSession, root: str) -> DataFrame:
    f = table(spark, root, "coffee_shops_facts").select(F.col("entity_id").alias("s"), F.concat(F.lit("attrs/"), "attribute").alias("p"), "raw_value", "clean_value", "outcome", "checked_at").filter("s IS NOT NULL AND attribute IS NOT NULL")
    c = records.companions(f, "p", {"surface": F.when(F.col("raw_value") != F.col("clean_value"), F.col("raw_value")), "verdict": F.when(F.col("outcome") == "passed", "supported"), "verified_at": F.date_format("checked_at", "yyyy-MM-dd'T'HH:mm:ss")})
    return c.groupBy("p").agg(F.count("*").alias("n"), F.min("o").alias("low"))


def event_log(spark: SparkSession, root: str) -> DataFrame:
    """Governance events numbered on after those that are there."""
    e = table(spark, root, "events").select("event_id", F.col("event_type").alias("kind"), F.to_date("ts").alias("day"))
    log = e.filter("event_id < 50").select((F.col("event_id") + 1).cast("long").alias("n"), "day", "event_id", "kind")
    return records.append_events(log, e.filter("event_id >= 50 AND kind <> 'view'"), ["day", "event_id"])


def error_streaks(spark: SparkSession, root: str) -> DataFrame:
    """Runs of errors that would stop a run: two or more in a row of one user."""
    return records.streaks(table(spark, root, "events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"], F.col("event_type") == "error", 2)


def run_manifests(spark: SparkSession, root: str) -> DataFrame:
    e = table(spark, root, "events").select((F.col("user_id") % 20).alias("run"), (F.col("event_id") % 30).alias("item"), F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "view", "open").otherwise("done").alias("state"), F.struct("ts", "event_id").alias("at"), "value")
    return records.run_manifest(e, "run", "state", F.col("at"), F.col("value"), 9_000.0)


PROVIDER = [
    ingest.EntitySpec("Provider", ("record_id",), "full_name", {"npi": ("npi", "string"), "accepting": ("accepting_new_patients", "boolean"), "seen": ("ingested_at", "datetime")}, {"registry": ("Registry", "Providers")}),
    ingest.EntitySpec("City", ("city", "state"), "city"),
]
PROVIDER_LINKS = [ingest.Link(0, "in", to=1), ingest.Link(0, "hospital", column="hospital_affiliation", target="Hospital", split=False), ingest.Link(0, "specialty", column="specialty", target="Specialty")]
TRIAL = [ingest.EntitySpec("Trial", ("nct_id",), "title", {"enrollment": ("enrollment", "integer"), "phase": ("phase", "float"), "start": ("start_year", "integer")})]


def _provider_facts(spark: SparkSession, root: str) -> DataFrame:
    return ingest.map_rows(table(spark, root, "healthcare_providers"), PROVIDER, PROVIDER_LINKS)[0]


def mapped_rows(spark: SparkSession, root: str) -> DataFrame:
    """Provider rows as entities of their own, cities by a composite key, hospitals and specialties as stubs, a constant: facts by predicate and kind of subject."""
    q = _provider_facts(spark, root).filter("p <> 'onto/specialty' AND s NOT LIKE 'entities/Specialty/%'")
    return q.groupBy(F.regexp_extract("s", "entities/([^/]+)/", 1).alias("kind"), "p").agg(F.count("*").alias("n"), F.count_distinct("s").alias("subjects"))


def mapped_splits(spark: SparkSession, root: str) -> DataFrame:
    """Relationship cells with several names between bars become several edges and stubs; a list between commas only if all names are short."""
    h = table(spark, root, "healthcare_providers").select("record_id", F.regexp_replace("specialty", r"\s*[|]+\s*", "|").alias("specialty")).filter("specialty LIKE '%|%'")
    q = ingest.map_rows(h, [ingest.EntitySpec("Provider", ("record_id",))], [ingest.Link(0, "specialty", column="specialty", target="Specialty")])[0]
    return q.filter("p = 'onto/specialty'").groupBy("o").agg(F.count("*").alias("n"))


def rejected_values(spark: SparkSession, root: str) -> DataFrame:
    """Values of trials that are not of their datatype (phases are no numbers), with the reason."""
    _, bad = ingest.map_rows(table(spark, root, "clinical_trials"), TRIAL, [])
    return bad.groupBy("p", "dtype", "reason", "raw").agg(F.count("*").alias("n"))


def keyless_rows(spark: SparkSession, root: str) -> DataFrame:
    """Rows without a key keep a place of their own: entities by whether their key was made."""
    t = table(spark, root, "clinical_trials").withColumn("nct_id", F.when(F.col("trial_row") % 4 != 0, F.col("nct_id")))
    q, _ = ingest.map_rows(t, TRIAL, [])
    return q.filter("p = 'rdf:type'").groupBy(F.col("s").rlike("^entities/Trial/[0-9a-f]{16}$").alias("made")).agg(F.count("*").alias("n"))


def row_conservation(spark: SparkSession, root: str) -> DataFrame:
    h = table(spark, root, "healthcare_providers")
    return ingest.conservation(h, _provider_facts(spark, root), PROVIDER)


def attribute_decisions(spark: SparkSession, root: str) -> DataFrame:
    """What becomes of incoming attributes beside the declared ones."""
    names = table(spark, root, "attribute_declarations").select(F.explode(F.array(F.col("name"), F.concat(F.lit("Total "), F.replace("name", F.lit("_"), F.lit("-"))), F.concat("name", F.lit("_extra")))).alias("name"), F.lit("integer").alias("datatype"))
    return ingest.resolve_attributes(names, table(spark, root, "attribute_declarations"))


def declaration_upserts(spark: SparkSession, root: str) -> DataFrame:
    d = table(spark, root, "attribute_declarations")
    changes = d.filter("datatype = 'float'").withColumn("datatype", F.lit("integer")).unionByName(d.filter("datatype = 'geo'").select("type_name", "name", F.lit(None).cast("string").alias("datatype"), F.lit(None).cast("string").alias("uri"))).unionByName(d.limit(1).select("type_name", F.lit("newcomer").alias("name"), F.lit("string").alias("datatype"), F.lit("u").alias("uri")))
    return ingest.upsert_declarations(d, changes, ["type_name", "name"]).select("name", "datatype")


def row_lineage(spark: SparkSession, root: str) -> DataFrame:
    """Rows of a feed that come again bear the lineage of the first."""
    h = table(spark, root, "healthcare_providers").select("feed", "full_name", "city", "record_id")
    out = ingest.source_lineage(h, F.concat_ws("|", "full_name", "city"), F.col("feed"))
    return out.groupBy("lineage").agg(F.max("copy").alias("copies"))


QUERIES = {f.__name__: f for f in (update_insert_data, update_delete_data, update_delete_where, update_modify, graph_store, insert_receipts, delete_pairs, interval_changes, fact_provenance, current_claims, corrected_claims, recency_policy, cited_answers, display_companions, event_log, error_streaks, run_manifests, mapped_rows, mapped_splits, rejected_values, keyless_rows, row_conservation, attribute_decisions, declaration_upserts, row_lineage)}

_Q = "(SELECT 'entities/Nation/' || n_nationkey AS s, 'rdf:type' AS p, 'types/Nation' AS o FROM nation UNION ALL SELECT 'entities/Nation/' || n_nationkey, 'rdfs:label', n_name FROM nation UNION ALL SELECT 'entities/Nation/' || n_nationkey, 'onto/region', 'entities/Region/' || n_regionkey FROM nation UNION ALL SELECT 'entities/Region/' || r_regionkey, 'rdf:type', 'types/Region' FROM region UNION ALL SELECT 'entities/Region/' || r_regionkey, 'rdfs:label', r_name FROM region)"
_SAFE = lambda c: f"coalesce(nullif(substr(regexp_replace(trim({c}), '[^a-zA-Z0-9_-]', '_', 'g'), 1, 200), ''), 'unknown')"
ORACLE = {
    "update_insert_data": f"SELECT 'kg' AS g, s, p, o, CASE WHEN p = 'rdfs:label' THEN 'string' END AS dtype FROM {_Q} WHERE s LIKE 'entities/Region/%' UNION SELECT 'kg', 'entities/Region/0', 'rdfs:label', 'AFRICA', 'string' UNION SELECT 'kg', 'entities/Region/0', 'attrs/area', '30.4', 'float' UNION SELECT 'kg', 'entities/Region/9', 'rdf:type', 'types/Region', NULL UNION SELECT 'kg', 'entities/Region/9', 'rdfs:label', 'ATLANTIS', 'string' UNION SELECT 'side', 'entities/Region/9', 'onto/near', 'entities/Region/0', NULL",
    "update_delete_data": f"SELECT s, p, o FROM {_Q} WHERE p <> 'rdfs:label' AND NOT (s = 'entities/Nation/1' AND p = 'onto/region' AND o = 'entities/Region/1') AND NOT (s = 'entities/Region/2')",
    "update_delete_where": f"SELECT s, p, o FROM {_Q} WHERE p IN ('onto/region', 'rdfs:label') AND s LIKE 'entities/Nation/%' AND s NOT IN (SELECT 'entities/Nation/' || n_nationkey FROM nation WHERE n_regionkey = 3)",
    "update_modify": f"SELECT s, CASE WHEN p = 'onto/region' AND o IN (SELECT 'entities/Region/' || r_regionkey FROM region WHERE starts_with(r_name, 'A')) THEN 'onto/continent' ELSE p END AS p, CASE WHEN p = 'rdfs:label' AND starts_with(o, 'A') AND s IN (SELECT 'entities/Region/' || n_regionkey FROM nation) THEN 'The ' || o ELSE o END AS o FROM {_Q} WHERE p LIKE 'onto/%' OR s LIKE 'entities/Region/%'",
    "graph_store": f"SELECT p, count(*) AS n, 1 AS version FROM {_Q} GROUP BY 1 UNION ALL SELECT p, count(*) + CASE WHEN p = 'rdfs:label' THEN 1 ELSE 0 END, 2 FROM {_Q} WHERE NOT (p = 'onto/region' AND o = 'entities/Region/1') GROUP BY 1",
    "insert_receipts": "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'added' ELSE 'known' END AS receipt FROM orders WHERE o_custkey % 3 = 0",
    "delete_pairs": f"SELECT s, p, o FROM {_Q} WHERE (s, p) NOT IN (('entities/Nation/1', 'rdfs:label'), ('entities/Nation/2', 'onto/region'), ('entities/Region/1', 'rdf:type'))",
    "interval_changes": "WITH e AS (SELECT CAST(user_id AS VARCHAR) AS fact_id, min(ts) FILTER (event_type <> 'error') AS f, arg_max(event_type, ts) AS l, max(ts) AS until FROM events WHERE event_type IN ('signup', 'error', 'purchase') GROUP BY 1), b AS (SELECT CAST(c_custkey AS VARCHAR) AS fact_id FROM customer WHERE c_custkey <= 5) SELECT coalesce(b.fact_id, e.fact_id) AS fact_id, CASE WHEN b.fact_id IS NOT NULL THEN TIMESTAMP '2020-01-01' ELSE f END AS valid_from, CASE WHEN l = 'error' THEN until WHEN l = 'purchase' THEN NULL WHEN b.fact_id IS NOT NULL THEN TIMESTAMP '2021-01-01' END AS valid_to FROM e FULL JOIN b ON b.fact_id = e.fact_id",
    "fact_provenance": "SELECT 'feed-' || user_id % 4 AS source, CASE event_id % 3 WHEN 0 THEN 'user_assertion' WHEN 1 THEN 'authoritative' ELSE 'hearsay' END AS authority, count(*) AS n, round(avg(CASE WHEN event_id % 5 = 0 THEN 0.42 WHEN event_id % 3 = 0 THEN 0.99 WHEN event_id % 3 = 1 THEN 0.85 ELSE 0.5 END), 6) AS confidence FROM events GROUP BY 1, 2",
    "current_claims": "WITH b AS (SELECT l_orderkey, l_discount, l_shipdate FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_discount DESC, l_shipdate DESC) = 1) SELECT o_orderkey AS fact_id, l_discount AS confidence, l_shipdate AS recorded_at FROM orders LEFT JOIN b ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'F'",
    "corrected_claims": """WITH c AS (SELECT c_custkey AS k, c_mktsegment AS v, c_custkey % 3 AS a FROM customer WHERE c_custkey % 5 <> 0), n AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 4 = 0 THEN 'OTHER' ELSE c_mktsegment END AS v FROM customer WHERE c_custkey % 2 = 0),
        x AS (SELECT coalesce(c.k, n.k) AS k, c.v AS old, n.v AS new, a, CASE WHEN n.k IS NULL THEN 'kept' WHEN c.k IS NULL THEN 'added' WHEN c.v = n.v THEN 'confirmed' WHEN a < 2 THEN 'refused' ELSE 'superseded' END AS action FROM c FULL JOIN n ON c.k = n.k)
        SELECT k AS c_custkey, CASE WHEN action IN ('kept', 'refused') THEN old ELSE new END AS c_mktsegment, CASE WHEN action IN ('kept', 'refused') THEN CASE a WHEN 0 THEN 'user_assertion' WHEN 1 THEN 'source_of_truth' ELSE 'supplementary' END ELSE 'machine_reverification' END AS authority, action FROM x""",
    "recency_policy": "SELECT name, name NOT IN ('address', 'website') AS later_wins, name = 'rating' AS by_default_several FROM attribute_declarations",
    "cited_answers": "WITH p AS (SELECT s_nationkey AS k, arg_max('s' || s_suppkey % 7, (s_acctbal, 's' || s_suppkey % 7)) AS source, count(DISTINCT s_suppkey % 7) AS n FROM supplier WHERE s_nationkey % 4 <> 0 GROUP BY 1) SELECT n_nationkey AS k, source, coalesce(n, 0) AS n_sources, CASE WHEN n IS NULL THEN 'no source' END AS caveat FROM nation LEFT JOIN p ON k = n_nationkey",
    "display_companions": "WITH f AS (SELECT *, 'attrs/' || attribute AS p FROM coffee_shops_facts WHERE entity_id IS NOT NULL AND attribute IS NOT NULL), c AS (SELECT p || '~surface' AS p, raw_value AS o FROM f WHERE raw_value <> clean_value UNION ALL SELECT p || '~verdict', 'supported' FROM f WHERE outcome = 'passed' UNION ALL SELECT p || '~verified_at', strftime(checked_at, '%Y-%m-%dT%H:%M:%S') FROM f WHERE checked_at IS NOT NULL) SELECT p, count(*) AS n, min(o) AS low FROM c GROUP BY 1",
    "event_log": "SELECT CAST(event_id + 1 AS BIGINT) AS n, CAST(ts AS DATE) AS day, event_id, event_type AS kind FROM events WHERE event_id < 50 UNION ALL SELECT 50 + row_number() OVER (ORDER BY CAST(ts AS DATE), event_id), CAST(ts AS DATE), event_id, event_type FROM events WHERE event_id >= 50 AND event_type <> 'view'",
    "error_streaks": "WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events), h AS (SELECT *, n - row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM r WHERE event_type = 'error') SELECT user_id, count(*) AS length, min(ts) AS first, max(ts) AS last FROM h GROUP BY user_id, g HAVING count(*) >= 2",
    "run_manifests": """WITH e AS (SELECT user_id % 20 AS run, event_id % 30 AS item, CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'open' ELSE 'done' END AS state, ts, event_id, value FROM events), i AS (SELECT run, item, arg_max(state, (ts, event_id)) AS state, count(*) FILTER (state = 'failed') AS f, count(*) AS a, sum(value) AS c FROM e GROUP BY 1, 2),
        r AS (SELECT run, count(*) AS n_items, count(*) FILTER (state = 'done') AS done, count(*) FILTER (state = 'failed' AND f >= 3) AS dropped, sum(a) AS attempts, round(sum(c), 2) AS spend FROM i GROUP BY 1)
        SELECT *, round(done / n_items, 4) AS coverage, CASE WHEN spend > 9000 THEN 'halted' WHEN n_items - done - dropped > 0 THEN 'running' WHEN dropped > 0 THEN 'partial' ELSE 'complete' END AS status FROM r""",
    "mapped_rows": f"""WITH h AS (SELECT * FROM healthcare_providers), q AS (SELECT 'Provider' AS kind, 'rdf:type' AS p, CAST(record_id AS VARCHAR) AS s, 't' AS o FROM h UNION SELECT 'Provider', 'rdfs:label', CAST(record_id AS VARCHAR), full_name FROM h WHERE trim(full_name) <> '' UNION SELECT 'Provider', 'attrs/npi', CAST(record_id AS VARCHAR), npi FROM h WHERE trim(npi) <> '' UNION SELECT 'Provider', 'attrs/accepting', CAST(record_id AS VARCHAR), '' FROM h WHERE accepting_new_patients IS NOT NULL UNION SELECT 'Provider', 'attrs/seen', CAST(record_id AS VARCHAR), '' FROM h WHERE ingested_at IS NOT NULL
        UNION SELECT 'Provider', 'onto/registry', CAST(record_id AS VARCHAR), 'r' FROM h UNION SELECT 'Registry', 'rdf:type', 'r', '' UNION SELECT 'Registry', 'rdfs:label', 'r', '' UNION SELECT 'City', 'rdf:type', {_SAFE('city')} || '_' || {_SAFE('state')}, '' FROM h WHERE trim(city) <> '' AND trim(state) <> '' UNION SELECT 'City', 'rdfs:label', {_SAFE('city')} || '_' || {_SAFE('state')}, trim(city) FROM h WHERE trim(city) <> '' AND trim(state) <> ''
        UNION SELECT 'Provider', 'onto/in', CAST(record_id AS VARCHAR), {_SAFE('city')} || '_' || {_SAFE('state')} FROM h WHERE trim(city) <> '' AND trim(state) <> '' UNION SELECT 'Provider', 'onto/hospital', CAST(record_id AS VARCHAR), {_SAFE('hospital_affiliation')} FROM h WHERE trim(hospital_affiliation) <> '' UNION SELECT 'Hospital', 'rdf:type', {_SAFE('hospital_affiliation')}, '' FROM h WHERE trim(hospital_affiliation) <> '' UNION SELECT 'Hospital', 'rdfs:label', {_SAFE('hospital_affiliation')}, '' FROM h WHERE trim(hospital_affiliation) <> '')
        SELECT kind, p, count(*) AS n, count(DISTINCT s) AS subjects FROM q GROUP BY 1, 2""",
    "mapped_splits": f"WITH h AS (SELECT record_id, unnest(string_split(regexp_replace(specialty, '\\s*[|]+\\s*', '|', 'g'), '|')) AS v FROM healthcare_providers WHERE contains(specialty, '|')) SELECT 'entities/Specialty/' || {_SAFE('v')} AS o, count(DISTINCT record_id) AS n FROM h WHERE trim(v) <> '' GROUP BY 1",
    "rejected_values": "SELECT 'attrs/phase' AS p, 'float' AS dtype, 'not float' AS reason, phase AS raw, count(*) AS n FROM clinical_trials WHERE trim(phase) <> '' AND NOT regexp_matches(trim(phase), '^[-+]?[0-9.]+$') GROUP BY phase",
    "keyless_rows": "SELECT true AS made, count(DISTINCT trial_row) AS n FROM clinical_trials WHERE trial_row % 4 = 0 OR trim(coalesce(nct_id, '')) = '' UNION ALL SELECT false, count(DISTINCT trim(nct_id)) FROM clinical_trials WHERE trial_row % 4 <> 0 AND trim(nct_id) <> ''",
    "row_conservation": f"SELECT 'Provider' AS type_name, count(*) AS rows_in, count(DISTINCT record_id) AS entities, 0 AS dropped FROM healthcare_providers UNION ALL SELECT 'City', count(*), count(DISTINCT {_SAFE('city')} || '_' || {_SAFE('state')}) FILTER (trim(city) <> '' AND trim(state) <> ''), count(*) FILTER (coalesce(trim(city), '') = '' OR coalesce(trim(state), '') = '') FROM healthcare_providers",
    "attribute_decisions": "WITH n AS (SELECT name AS d, datatype AS t, unnest([name, 'Total ' || replace(name, '_', '-'), name || '_extra']) AS name FROM attribute_declarations) SELECT name, CASE WHEN name = d THEN 'reuse' WHEN starts_with(name, 'Total ') THEN 'rename' ELSE 'new' END AS action, CASE WHEN starts_with(name, 'Total ') THEN d ELSE name END AS resolved, CASE WHEN suffix(name, '_extra') OR t = 'string' THEN 'integer' ELSE t END AS datatype FROM n",
    "declaration_upserts": "SELECT name, CASE WHEN datatype = 'float' THEN 'integer' ELSE datatype END AS datatype FROM attribute_declarations WHERE datatype <> 'geo' UNION ALL SELECT 'newcomer', 'string'",
    "row_lineage": "SELECT substr(sha1(concat_ws('|', sha1(coalesce(feed, '')), concat_ws('|', full_name, city))), 1, 16) AS lineage, count(*) AS copies FROM healthcare_providers GROUP BY 1",
}
