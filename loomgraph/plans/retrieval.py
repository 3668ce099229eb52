"""Streams, pages, retrieval of types and examples, matching look-ups, places, beside SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text
from ..functions.text import cosine
from ..operators import facts, index, retrieval as rt
from ..runtime import shared_dir, table
from ..sources.pages import Paging, pages
from ..streaming import usage
from .graph import CLASS_TREE
from .search_geo_matching import _ER, _VECTOR, _records


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _arrive(spark: SparkSession, root: str, folder: str, part: int, parts: int = 3) -> None:
    """One more file of the event log, later than those before."""
    e = table(spark, root, "events")
    e.filter(F.floor(F.col("event_id") * parts / (e.count() or 1)) == part).coalesce(1).write.parquet(f"{folder}/part{part}")


def stream_upserts(spark: SparkSession, root: str) -> DataFrame:
    """Daily requests and values by type through a stream of several files, added to what earlier batches left."""
    folder = _folder(spark, "upserts")
    for k in range(3):
        _arrive(spark, root, folder, k)
    q = usage.additive_upserts(usage.event_stream(spark, folder), [F.to_date("ts").alias("day"), F.col("event_type")], {"requests": F.count("*"), "total": F.round(F.sum("value"), 4)}, f"{folder}-out", f"{folder}-ck")
    q.awaitTermination()
    return usage.Versions(spark, f"{folder}-out").read().select("day", "event_type", "requests", F.round("total", 2).alias("total"))


def stream_ingest(spark: SparkSession, root: str) -> DataFrame:
    """Facts of events through a stream that is stopped after its first files and goes on from its checkpoint; nothing is written twice."""
    folder = _folder(spark, "ingest")
    fact = lambda b: b.select(F.concat(F.lit("entities/Event/"), "event_id").alias("s"), F.inline(F.array(F.struct(F.lit("rdf:type").alias("p"), F.lit("types/Event").alias("o")), F.struct(F.lit("attrs/value").alias("p"), F.col("value").cast("string").alias("o")))))
    for files in ((0, 1), (2,), ()):
        for k in files:
            _arrive(spark, root, folder, k)
        usage.resumable_ingest(usage.event_stream(spark, folder), fact, f"{folder}-out", f"{folder}-ck").awaitTermination()
    return spark.read.parquet(f"{folder}-out").groupBy("p").agg(F.count("*").alias("n"), F.count_distinct("s").alias("subjects"), F.count_distinct("batch").alias("batches"))


def stream_watch(spark: SparkSession, root: str) -> DataFrame:
    """What changed between the snapshots of two batches, with a restart between them: event types of each user."""
    folder = _folder(spark, "watch")
    out = f"{folder}-said"
    snap = lambda b: facts.snapshot(b.select("user_id", "event_type").distinct(), "user_id", "event_type")
    tell = lambda d, n: d.write.mode("overwrite").parquet(f"{out}/batch={n}")
    for k in range(2):  # the second run goes on from the checkpoint and the snapshot of the first
        _arrive(spark, root, folder, k, 60)
        usage.watch(usage.event_stream(spark, folder), snap, tell, f"{folder}-snap", f"{folder}-ck").awaitTermination()
    return spark.read.parquet(out).select("key", "change", "old", "new")


def api_pages(spark: SparkSession, root: str) -> DataFrame:
    """Nations through an interface of pages, by number, by offset and by cursor: rows of each page."""
    rows = [r[0] for r in table(spark, root, "nation").select("n_nationkey").orderBy("n_nationkey").collect()]

    def fetch(p: dict) -> tuple[list, dict]:
        if "page" in p:
            return rows[(p["page"] - 1) * p["limit"] : p["page"] * p["limit"]], {}
        at = p.get("offset", int(p.get("cursor", 0)))
        return rows[at : at + 10], {"next": str(at + 10) if at + 10 < len(rows) else None}

    got = [(style, i, len(r), min(r)) for style in ("page", "offset", "cursor", "none") for i, r in enumerate(pages(fetch, Paging(style, 10, max_rows=22)))]
    return spark.createDataFrame(got, "style string, page int, n int, first int")


def overlapping_chunks(spark: SparkSession, root: str) -> DataFrame:
    """Texts cut at ends of sentences into chunks that overlap: how many, and whether any text is lost."""
    d = table(spark, root, "documents").filter("text IS NOT NULL").select("doc_id", F.col("text"), F.explode(text.overlapping_chunks(3000, 200)("text")).alias("c"))
    return d.groupBy("doc_id").agg(F.max(F.length("c.chunk") <= 3000).alias("fits"), F.max(F.col("c.start") + F.length("c.chunk")).alias("covered"), F.bool_and(F.expr("substr(text, c.start + 1, length(c.chunk)) = c.chunk")).alias("exact"))


def question_types(spark: SparkSession, root: str) -> DataFrame:
    """Types that questions mention."""
    q = table(spark, root, "gold_questions").select(F.explode(rt.named_types(F.coalesce("question", F.lit("")), ["Storm", "Company", "Trial", "Farm", "Provider", "Patent", "CoffeeShop"])).alias("type"))
    return q.groupBy("type").agg(F.count("*").alias("n"))


def example_retrieval(spark: SparkSession, root: str) -> DataFrame:
    e = table(spark, root, "embeddings")
    q = F.array(*[F.lit(float(x)) for x in _VECTOR])
    scored = e.select("vec_id", (F.col("label") % 4).alias("kg"), (F.col("label") % 3).alias("tag"), (cosine(F.col("embedding"), q) + 0.4).alias("score"))
    return rt.few_examples(scored, "vec_id", "kg", "tag", 1).select("vec_id", F.round("score", 6).alias("score"))


def attribute_cut(spark: SparkSession, root: str) -> DataFrame:
    """Customers as attributes of their nation: nations with more than forty keep their ten best."""
    c = table(spark, root, "customer").select("c_nationkey", F.col("c_name").alias("name"), "c_acctbal")
    return rt.top_attributes(c, "c_nationkey", "c_acctbal", 40, 10).groupBy("c_nationkey").agg(F.count("*").alias("n"), F.min("c_acctbal").alias("least"))


def catalogue_layers(spark: SparkSession, root: str) -> DataFrame:
    m = table(spark, root, "llm_models").select("model_id", "input_price", F.when(F.col("open_source"), F.lit("2024-01-01")).alias("checked"))
    over = m.filter("input_price > 3").select("model_id", (F.col("input_price") * 2).alias("input_price"), F.lit("2025-06-01").alias("checked"))
    return rt.merged_layers(m, over, "model_id", "checked", F.lit("2025-01-01"))


def stale_types(spark: SparkSession, root: str) -> DataFrame:
    d = table(spark, root, "attribute_declarations").select("name", "datatype")
    old = d.filter("datatype <> 'geo'").select("name", F.md5(F.when(F.col("datatype") == "uri", "other").otherwise(F.col("datatype"))).alias("hash")).unionByName(spark.createDataFrame([("gone", "x")], "name string, hash string"))
    return rt.changed_embeddings(d, old, "name", "datatype")


def type_verdicts(spark: SparkSession, root: str) -> DataFrame:
    e = table(spark, root, "embeddings")
    q = F.array(*[F.lit(float(x)) for x in _VECTOR])
    pairs = e.select(F.col("vec_id").alias("proposed"), (F.col("label") % 5).alias("existing"), (cosine(F.col("embedding"), q) * 2 + 0.7).alias("score"))
    cache = e.filter("vec_id % 10 = 0").select(F.col("vec_id").alias("proposed"), (F.col("label") % 5).alias("existing"), F.lit("subtype").alias("verdict"))
    return rt.type_cascade(pairs, cache).groupBy("verdict", "by").agg(F.count("*").alias("n"))


def match_signals(spark: SparkSession, root: str) -> DataFrame:
    """Signals of guests from attributes whose names only hint at what they hold."""
    k, s = F.col("c_custkey"), lambda x: x.cast("string")
    cells = table(spark, root, "customer").select("c_custkey", F.inline(F.array(*[F.struct(F.lit(n).alias("name"), v.alias("value")) for n, v in (
        ("guest_first_name", F.when(k % 3 > 0, F.concat(F.lit("Ann"), s(k)))), ("guest_last_name", F.when(k % 3 == 1, F.lit("Lee"))), ("display_name", F.when(k % 2 == 0, F.col("c_name"))), ("work_email", F.concat(F.lit("A"), s(k), F.lit("@x.example"))), ("private_e_mail", F.when(k % 5 == 0, F.concat(F.lit("a"), s(k), F.lit("@x.example"))).otherwise(F.concat(F.lit("b"), s(k), F.lit("@y.example")))), ("mobile", F.when(k % 4 == 0, F.lit(" "))), ("home_phone", s(k)), ("birth_date", F.lit(None).cast("string")))])))
    return rt.signals(cells, "c_custkey").select("c_custkey", "name", F.array_join("emails", "|").alias("emails"), "phone", "dob")


def match_candidates(spark: SparkSession, root: str) -> DataFrame:
    """The known records that an incoming one must be compared with, most shared keys first."""
    r = _records(spark, root)
    return rt.candidates(r.filter("id % 2 = 1"), r.filter("id % 2 = 0"), 2)


def class_configs(spark: SparkSession, root: str) -> DataFrame:
    """The matching configuration of each entity: that of its deepest class that has one."""
    tree = spark.createDataFrame([(c, p) for c, p in CLASS_TREE if p], "src string, dst string")
    configs = spark.createDataFrame([("Thing", "default"), ("Party", "party"), ("Customer", "guest")], "type string, config string")
    c = table(spark, root, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("s"), F.explode(F.when(F.col("c_custkey") % 2 == 0, F.array(F.lit("Customer"), F.lit("Place"))).otherwise(F.array(F.lit("Supplier"), F.lit("Order")))).alias("type"))
    return rt.deepest_config(c.unionByName(table(spark, root, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("s"), F.lit("Order").alias("type"))), tree, configs).groupBy("type", "config").agg(F.count("*").alias("n"))


def geocoded_places(spark: SparkSession, root: str) -> DataFrame:
    """Cities as typed, with or without a state, at the place of that name where most providers are."""
    h = table(spark, root, "healthcare_providers").filter("city IS NOT NULL")
    g = h.filter("state IS NOT NULL").groupBy(rt.fold_place(F.col("city")).alias("name"), F.col("state").alias("qualifier")).agg(F.count("*").alias("population"))
    g = g.select(F.concat_ws("/", "name", "qualifier").alias("place"), "name", "qualifier", "population", F.length("name").cast("double").alias("lon"), F.col("population").cast("double").alias("lat"))
    asked = h.select("record_id", F.when(F.col("record_id") % 2 == 0, F.concat_ws(", ", "city", "state")).otherwise(F.concat(F.lit(" "), F.upper("city"), F.lit("."))).alias("t"))
    return rt.geocode(asked, "record_id", "t", g)


def spatial_intents(spark: SparkSession, root: str) -> DataFrame:
    n = table(spark, root, "nation")
    k = F.col("n_nationkey")
    t = F.when(k % 4 == 0, F.concat(F.lit("Which shops lie within "), k.cast("string"), F.lit(".5 km of "), "n_name", F.lit("?"))).when(k % 4 == 1, F.concat(F.lit("Clinics near "), "n_name", F.lit("!"))).when(k % 4 == 2, F.concat(F.lit("Within 3 miles of "), "n_name")).otherwise(F.concat(F.lit("How many shops are in "), "n_name"))
    return n.select("n_nationkey", rt.spatial_intent(t).alias("i")).select("n_nationkey", "i.kind", F.round("i.metres", 3).alias("metres"), "i.place")


def spatial_upserts(spark: SparkSession, root: str) -> DataFrame:
    """The place of each entity after late facts replace earlier ones, one entity is renamed and another taken out."""
    e = table(spark, root, "entity_spatiotemporal").filter("entity_uri IS NOT NULL").select("entity_uri", "fact_id", "geom")
    latest = e.groupBy("entity_uri").agg(F.max("fact_id").alias("last"))
    late = e.join(latest, "entity_uri").filter("fact_id = last AND fact_id % 3 = 0").select("entity_uri", "fact_id", "geom")
    out = index.replace_documents(e.filter("fact_id % 3 <> 0"), late, ["entity_uri"])
    return out.groupBy((F.col("fact_id") % 3 == 0).alias("replaced")).agg(F.count("*").alias("facts"), F.count_distinct("entity_uri").alias("entities"))


QUERIES = {f.__name__: f for f in (stream_upserts, stream_ingest, stream_watch, api_pages, overlapping_chunks, question_types, example_retrieval, attribute_cut, catalogue_layers, stale_types, type_verdicts, match_signals, match_candidates, class_configs, geocoded_places, spatial_intents, spatial_upserts)}

_V = "[" + ", ".join(f"{x}::DOUBLE" for x in _VECTOR) + "]"
_S = "(SELECT vec_id, label, list_cosine_similarity(embedding::DOUBLE[], " + _V + ") AS c FROM embeddings)"
_FOLD = lambda c: f"trim(regexp_replace(regexp_replace(strip_accents(lower({c})), '[^\\p{{L}}\\p{{N}} ]', ' ', 'g'), ' +', ' ', 'g'))"
_TYPES = ["Storm", "Company", "Trial", "Farm", "Provider", "Patent", "CoffeeShop"]
_SING = lambda w: f"CASE WHEN length({w}) > 3 AND suffix({w}, 'ies') THEN {w}[:-4] || 'y' WHEN length({w}) > 4 AND regexp_matches({w}, '(ches|shes|sses|xes|zes)$') THEN {w}[:-3] WHEN length({w}) > 1 AND suffix({w}, 's') AND NOT suffix({w}, 'ss') THEN {w}[:-2] ELSE {w} END"
_TREE = " UNION ALL ".join(f"SELECT '{c}' AS c, {repr(p) if p else 'NULL'} AS p" for c, p in CLASS_TREE)
_SIDE = lambda k: f"(SELECT user_id AS key, string_agg(DISTINCT event_type, '|' ORDER BY event_type) AS value FROM events WHERE floor(event_id * 60 / (SELECT count(*) FROM events)) = {k} GROUP BY 1)"
ORACLE = {
    "stream_upserts": "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS requests, round(sum(value), 2) AS total FROM events GROUP BY 1, 2",
    "stream_ingest": "SELECT unnest(['rdf:type', 'attrs/value']) AS p, unnest([count(*), count(*)]) AS n, unnest([count(*), count(*)]) AS subjects, 3 AS batches FROM events",
    "stream_watch": f"SELECT b.key, CASE WHEN a.key IS NULL THEN 'added' ELSE 'changed' END AS change, a.value AS old, b.value AS new FROM {_SIDE(1)} b LEFT JOIN {_SIDE(0)} a ON a.key = b.key WHERE a.key IS NULL OR a.value <> b.value",
    "api_pages": "SELECT unnest(['page', 'page', 'page', 'offset', 'offset', 'offset', 'cursor', 'cursor', 'cursor', 'none']) AS style, unnest([0, 1, 2, 0, 1, 2, 0, 1, 2, 0]) AS page, unnest([10, 10, 2, 10, 10, 2, 10, 10, 2, 10]) AS n, unnest([0, 10, 20, 0, 10, 20, 0, 10, 20, 0]) + min(n_nationkey) AS first FROM nation",
    "overlapping_chunks": "SELECT doc_id, true AS fits, length(text) AS covered, true AS exact FROM documents WHERE text IS NOT NULL AND text <> ''",
    "question_types": f"WITH q AS (SELECT lower(coalesce(question, '')) AS q FROM gold_questions), w AS (SELECT q, list_transform(regexp_extract_all(q, '[a-z0-9]+'), lambda w: {_SING('w')}) AS w FROM q) SELECT t AS type, count(*) AS n FROM (SELECT unnest({_TYPES}) AS t, w, q FROM w) WHERE list_contains(w, {_SING('lower(t)')}) OR contains(q, lower(t)) GROUP BY 1",
    "example_retrieval": f"WITH t AS (SELECT vec_id, label % 4 AS kg, label % 3 AS tag, c + 0.4 AS s FROM {_S} ORDER BY s DESC, vec_id LIMIT 10), k AS (SELECT vec_id, tag, CASE WHEN kg = 1 THEN s * 0.9 ELSE s END AS s FROM t WHERE s < 0.9 AND (kg <> 1 OR s < 0.75)), r AS (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY s DESC, vec_id) AS turn FROM k) SELECT vec_id, round(s, 6) AS score FROM r ORDER BY turn, s DESC, vec_id LIMIT 3",
    "attribute_cut": "WITH r AS (SELECT *, count(*) OVER (PARTITION BY c_nationkey) AS k, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_name) AS i FROM customer) SELECT c_nationkey, count(*) AS n, min(c_acctbal) AS least FROM r WHERE k <= 40 OR i <= 10 GROUP BY 1",
    "catalogue_layers": "SELECT model_id, CASE WHEN input_price > 3 THEN input_price * 2 ELSE input_price END AS input_price, CASE WHEN input_price > 3 THEN '2025-06-01' WHEN open_source THEN '2024-01-01' END AS checked, CASE WHEN input_price > 3 THEN 'overlay' ELSE 'base' END AS layer, NOT coalesce(input_price > 3, false) AS stale FROM llm_models",
    "stale_types": "SELECT name, CASE datatype WHEN 'geo' THEN 'new' WHEN 'uri' THEN 'changed' ELSE 'keep' END AS action FROM attribute_declarations UNION ALL SELECT 'gone', 'drop'",
    "type_verdicts": f"SELECT CASE WHEN vec_id % 10 = 0 THEN 'subtype' WHEN c * 2 + 0.7 >= 0.92 THEN 'same' WHEN c * 2 + 0.7 < 0.55 THEN 'different' ELSE 'undecided' END AS verdict, CASE WHEN vec_id % 10 = 0 THEN 'cache' WHEN c * 2 + 0.7 >= 0.92 OR c * 2 + 0.7 < 0.55 THEN 'similarity' ELSE 'judge' END AS by, count(*) AS n FROM {_S} GROUP BY 1, 2",
    "match_signals": "SELECT c_custkey, CASE c_custkey % 3 WHEN 1 THEN 'Ann' || c_custkey || ' Lee' WHEN 2 THEN 'Ann' || c_custkey ELSE CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE CAST(c_custkey AS VARCHAR) END END AS name, CASE WHEN c_custkey % 5 = 0 THEN 'a' || c_custkey || '@x.example' ELSE 'a' || c_custkey || '@x.example|b' || c_custkey || '@y.example' END AS emails, CAST(c_custkey AS VARCHAR) AS phone, CAST(NULL AS VARCHAR) AS dob FROM customer",
    "match_candidates": f"{_ER} SELECT a.id, b.id AS candidate, count(*) AS shared FROM keys a JOIN keys b ON a.key = b.key WHERE a.id % 2 = 1 AND b.id % 2 = 0 GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY count(*) DESC, b.id) <= 2",
    "class_configs": "SELECT 'Customer' AS type, 'guest' AS config, count(*) AS n FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT 'Party', 'party', count(*) FROM customer WHERE c_custkey % 2 = 1 UNION ALL SELECT 'Thing', 'default', count(*) FROM orders",
    "geocoded_places": f"WITH h AS (SELECT *, {_FOLD('city')} AS n FROM healthcare_providers WHERE city IS NOT NULL), g AS (SELECT n, state, count(*) AS k FROM h WHERE state IS NOT NULL GROUP BY 1, 2), m AS (SELECT record_id, g.n || '/' || g.state AS place, CAST(length(g.n) AS DOUBLE) AS lon, CAST(k AS DOUBLE) AS lat FROM h JOIN g ON g.n = h.n AND (record_id % 2 = 1 OR h.state IS NULL OR lower(h.state) = lower(g.state))) SELECT record_id, place, lon, lat FROM m QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY lat DESC, place DESC) = 1",
    "spatial_intents": "SELECT n_nationkey, CASE n_nationkey % 4 WHEN 1 THEN 'near' WHEN 3 THEN NULL ELSE 'radius' END AS kind, CASE n_nationkey % 4 WHEN 0 THEN (n_nationkey + 0.5) * 1000 WHEN 2 THEN round(3 * 1609.344, 3) END AS metres, CASE WHEN n_nationkey % 4 < 3 THEN n_name END AS place FROM nation",
    "spatial_upserts": "WITH e AS (SELECT entity_uri, fact_id, max(fact_id) OVER (PARTITION BY entity_uri) AS last FROM entity_spatiotemporal WHERE entity_uri IS NOT NULL) SELECT false AS replaced, count(*) AS facts, count(DISTINCT entity_uri) AS entities FROM e WHERE fact_id % 3 <> 0 AND last % 3 <> 0 UNION ALL SELECT true, count(*), count(DISTINCT entity_uri) FROM e WHERE fact_id = last AND last % 3 = 0",
}
