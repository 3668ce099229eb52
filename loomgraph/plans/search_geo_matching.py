"""Ranking, spatial filters, record matching and quality measures, beside SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import names
from ..functions.geometry import with_point
from ..operators import matching, search
from ..runtime import table
from .graph import graph
from .packed_wide_spatial_interval import POINTS_SQL

_QUERY = ["treasury", "deposit", "reports"]
_WORDS = ["futures", "bond", "revenue", "courtroom"]
_VECTOR = [((i * 37) % 11 - 5) / 5 for i in range(64)]


def lexical_rank(spark: SparkSession, root: str) -> DataFrame:
    return search.lexical_rank(table(spark, root, "documents"), "doc_id", "text", _QUERY).select("doc_id", F.round("score", 9).alias("score"))


def vector_topk(spark: SparkSession, root: str) -> DataFrame:
    return search.vector_rank(table(spark, root, "embeddings"), "vec_id", "embedding", _VECTOR, 20).select("vec_id", F.round("score", 6).alias("score"))


def hybrid_rrf(spark: SparkSession, root: str) -> DataFrame:
    """Entities by chunks found by words or by vectors of one model; an entity counts by its best chunk."""
    c = table(spark, root, "entity_semantic_chunk")
    legs = [search.lexical_rank(c, "chunk_id", "chunk_text", _WORDS), search.vector_rank(c.filter("embed_model = 'stub-embed-a'"), "chunk_id", "embedding", _VECTOR)]
    fused = search.reciprocal_rank_fusion(legs, "chunk_id", c.select("chunk_id", F.col("entity_uri").alias("entity")))
    return fused.select(F.col("chunk_id").alias("entity"), F.round("score", 9).alias("score"))


def best_chunk(spark: SparkSession, root: str) -> DataFrame:
    d = table(spark, root, "documents").filter("entity_uri IS NOT NULL").select("entity_uri", "doc_id", "n_chars")
    return search.best_per_group(d, ["entity_uri"], [F.desc_nulls_last("n_chars"), "doc_id"])


def keyset_page(spark: SparkSession, root: str) -> DataFrame:
    return search.keyset_page(table(spark, root, "orders").select("o_custkey", "o_orderkey"), ["o_custkey", "o_orderkey"], (100, 50), 25)


def geo_radius(spark: SparkSession, root: str) -> DataFrame:
    """Customers within 1500 km of a place, by haversine after a bounding box that reaches the scan's columns."""
    p = _placed(spark, root)
    a = F.radians(F.lit(20.0))
    b = F.radians("lat")
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin((F.radians("lon") - F.radians(F.lit(10.0))) / 2), 2)
    return p.withColumn("m", 2 * 6_371_008.8 * F.asin(F.least(F.lit(1.0), F.sqrt(h)))).filter("lat BETWEEN 6 AND 34 AND m <= 1500000").select("c_custkey", F.round("m", 3).alias("metres"))


def geo_bbox(spark: SparkSession, root: str) -> DataFrame:
    return _placed(spark, root).filter("lon BETWEEN -50 AND 20 AND lat BETWEEN -10 AND 40").select("c_custkey")


def geo_polygon(spark: SparkSession, root: str) -> DataFrame:
    """Even-odd rule over a constant ring, unrolled into the plan."""
    ring = [(-60.0, -20.0), (40.0, -30.0), (60.0, 50.0), (0.0, 10.0), (-50.0, 60.0), (-60.0, -20.0)]
    inside = F.lit(False)
    for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
        crosses = ((F.lit(y1) > F.col("lat")) != (F.lit(y2) > F.col("lat"))) & (F.col("lon") < (x2 - x1) * (F.col("lat") - y1) / (y2 - y1) + x1)
        inside = inside != crosses
    return _placed(spark, root).filter(inside).select("c_custkey")


def _placed(spark: SparkSession, root: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, root, "customer").select("c_custkey", ((k * 37 % 36000) / 100 - 180).alias("lon"), ((k * 53 % 17000) / 100 - 85).alias("lat"))


def geo_facts(spark: SparkSession, root: str) -> DataFrame:
    """Readable points by type of entity, and whether times stand beside them."""
    p = with_point(table(spark, root, "entity_spatiotemporal"), ["fact_id", F.regexp_extract("entity_uri", "/entities/([^/]+)/", 1).alias("type"), "valid_time"], F.col("geom"))
    return p.groupBy("type").agg(F.count("*").alias("n_points"), F.bool_or(F.col("valid_time").isNotNull()).alias("temporal"), F.round(F.min("lat"), 4).alias("south"), F.round(F.max("lat"), 4).alias("north"))


def _records(spark: SparkSession, root: str) -> DataFrame:
    """Customers twice, the second copy perturbed by arithmetic on the key."""
    k = F.col("c_custkey")
    word = lambda n: F.translate(F.substring(F.md5(F.concat(F.lit(n), k.cast("string"))), 1, 8), "0123456789", "ghijklmnop")
    c = table(spark, root, "customer").select(k.alias("k"), word("a").alias("w1"), word("b").alias("w2"), (k % 10_000_000_000).alias("n"))
    phone = F.concat(F.lit("2"), F.lpad(F.col("n").cast("string"), 9, "0"))
    first = c.select((F.col("k") * 2).alias("id"), F.concat_ws(" ", "w1", "w2").alias("name"), phone.alias("phone"), F.concat(F.lit("u"), F.col("k").cast("string"), F.lit("@corp.example")).alias("email"))
    second = c.select((F.col("k") * 2 + 1).alias("id"), F.when(F.col("k") % 3 == 0, F.concat(F.lit("Dr. "), F.upper("w1"), F.lit(" "), F.col("w2"))).otherwise(F.concat_ws(" ", "w2", "w1")).alias("name"), F.when(F.col("k") % 2 == 0, phone).alias("phone"), F.when(F.col("k") % 4 == 1, F.concat(F.lit("U"), F.col("k").cast("string"), F.lit("+x@corp.example"))).when(F.col("k") % 4 == 3, F.concat(F.lit("u"), F.col("k").cast("string"), F.lit("@home.example"))).alias("email"))
    both = first.unionByName(second)
    return both.select("id", names.name_key(F.col("name")).alias("name"), names.phone_key(F.col("phone")).alias("phone"), names.email_key(F.col("email")).alias("email"), F.lit(None).cast("string").alias("address"), F.lit(None).cast("string").alias("dob"))


def er_block_pairs(spark: SparkSession, root: str) -> DataFrame:
    """Every candidate pair."""
    return matching.candidate_pairs(_records(spark, root))


def er_scores(spark: SparkSession, root: str) -> DataFrame:
    """Score and decision of every candidate pair."""
    r = _records(spark, root)
    return matching.score_pairs(matching.candidate_pairs(r), r, matching.CUSTOMER)


def er_clusters(spark: SparkSession, root: str) -> DataFrame:
    r = _records(spark, root)
    return matching.clusters(matching.score_pairs(matching.candidate_pairs(r), r, matching.CUSTOMER))


def er_survivors(spark: SparkSession, root: str) -> DataFrame:
    r = _records(spark, root)
    return matching.richest(r, matching.clusters(matching.score_pairs(matching.candidate_pairs(r), r, matching.CUSTOMER)), ["name", "phone", "email"])


def list_explode(spark: SparkSession, root: str) -> DataFrame:
    """A packed literal becomes one edge per value to a node of that value."""
    p = table(spark, root, "part").select("p_partkey", F.explode(F.split(F.concat_ws("|", "p_brand", "p_type"), r"\|")).alias("v"))
    return p.select("p_partkey", F.concat(F.lit("entities/Tag/"), F.regexp_replace("v", "[^a-zA-Z0-9_-]", "_")).alias("node"))


def promote_to_node(spark: SparkSession, root: str) -> DataFrame:
    """Value-keyed nodes of a literal attribute: label, name and one edge from each owner."""
    q = graph(spark, root).filter("p = 'attrs/segment'")
    node = F.concat(F.lit("entities/Segment/"), F.regexp_replace("o", "[^a-zA-Z0-9_-]", "_"))
    edges = q.select("s", F.lit("onto/segment").alias("p"), node.alias("o"))
    labels = q.select(node.alias("s"), F.lit("rdfs:label").alias("p"), "o").distinct()
    return edges.unionByName(labels)


def invariant_dangling(spark: SparkSession, root: str) -> DataFrame:
    """Edges whose target has no type, by predicate, after some nations are removed."""
    q = graph(spark, root)
    typed = q.filter("p = 'rdf:type' AND NOT (o = 'types/Nation' AND s IN ('entities/Nation/1', 'entities/Nation/7'))").select(F.col("s").alias("o"))
    return q.filter("kind = 'iri' AND p <> 'rdf:type'").join(typed, "o", "left_anti").groupBy("p").agg(F.count("*").alias("n"))


def invariant_literal_edge(spark: SparkSession, root: str) -> DataFrame:
    """Facts on relationship predicates with a literal object."""
    q = graph(spark, root)
    bad = q.filter("p = 'attrs/segment'").withColumn("p", F.lit("onto/segment"))
    return q.unionByName(bad).filter("p LIKE 'onto/%' AND kind = 'literal'").groupBy("p").agg(F.count("*").alias("n"))


def find_metrics(spark: SparkSession, root: str) -> DataFrame:
    """Precision, coverage, shares of duplicates, of made-up and of off-type rows of a found list against a gold list."""
    o = table(spark, root, "orders")
    gold = o.filter("o_orderpriority LIKE '1%'").select("o_custkey").distinct()
    known = table(spark, root, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_acctbal").alias("balance"))
    rows = o.filter("o_totalprice > 300000").select(F.when(F.col("o_orderkey") % 10 == 0, -F.col("o_orderkey")).otherwise(F.col("o_custkey")).alias("o_custkey"))
    member = rows.join(gold.withColumn("ok", F.lit(1)), "o_custkey", "left").join(known, "o_custkey", "left")
    kind = F.when(F.col("balance").isNull(), "made_up").when(F.col("balance") < 0, "off_type").when(F.col("ok").isNotNull(), "right").otherwise("wrong")
    m = member.withColumn("kind", kind).agg(F.count("*").alias("n"), *[F.count_if(F.col("kind") == k).alias(k) for k in ("right", "made_up", "off_type")], F.count_distinct("o_custkey").alias("keys"), F.count_distinct(F.when(F.col("kind") == "right", F.col("o_custkey"))).alias("found"))
    share = lambda c: F.round(F.col(c) / F.col("n"), 6)
    return m.crossJoin(gold.agg(F.count("*").alias("gold"))).select(share("right").alias("precision"), F.round(F.col("found") / F.col("gold"), 6).alias("coverage"), F.round((F.col("n") - F.col("keys")) / F.col("n"), 6).alias("duplicates"), share("made_up").alias("made_up"), share("off_type").alias("off_type"))


def evidence_verdict(spark: SparkSession, root: str) -> DataFrame:
    """Verdict of each question by independent sources, confidence growing with their number."""
    e = table(spark, root, "events").select((F.col("event_id") % 97).alias("claim"), F.col("user_id").alias("host"), (F.col("value") > 20).alias("supports"))
    n = e.groupBy("claim").agg(F.count_distinct(F.when(F.col("supports"), F.col("host"))).alias("up"), F.count_distinct(F.when(~F.col("supports"), F.col("host"))).alias("down"))
    confidence = lambda k: F.round(F.least(F.lit(0.9), 0.5 + 0.2 * (F.col(k) - 1)), 4)
    return n.select("claim", F.when(F.col("up") > 0, "supported").when(F.col("down") > 0, "refuted").otherwise("unknown").alias("verdict"), F.when(F.col("up") > 0, confidence("up")).when(F.col("down") > 0, confidence("down")).otherwise(0.0).alias("confidence"))


def membership_rule(spark: SparkSession, root: str) -> DataFrame:
    from ..operators.rules import rule_column

    rule = {"all": [{"any": [{"field": "p_brand", "in": ["Brand#11", "Brand#23"]}, {"field": "p_type", "contains": "steel"}]}, {"not": {"field": "p_name", "regex": "^a"}}, {"field": "p_name", "nonempty": True}]}
    return table(spark, root, "part").filter(rule_column(rule)).select("p_partkey")


def key_join(spark: SparkSession, root: str) -> DataFrame:
    """Incoming rows matched to existing entities by key where the key has one owner; others are to be minted."""
    existing = table(spark, root, "supplier").select(F.col("s_nationkey").alias("k"), "s_suppkey")
    one = existing.groupBy("k").agg(F.count("*").alias("n"), F.min("s_suppkey").alias("owner")).filter("n = 1")
    return table(spark, root, "nation").join(one, F.col("n_nationkey") == F.col("k"), "left").select("n_nationkey", F.when(F.col("owner").isNotNull(), "match").otherwise("mint").alias("action"), "owner")


QUERIES = {f.__name__: f for f in (lexical_rank, vector_topk, hybrid_rrf, best_chunk, keyset_page, geo_radius, geo_bbox, geo_polygon, geo_facts, er_block_pairs, er_scores, er_clusters, er_survivors, list_explode, promote_to_node, invariant_dangling, invariant_literal_edge, find_metrics, evidence_verdict, membership_rule, key_join)}

_TOK = "regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')"
_Q = "['deposit', 'reports', 'treasury']"
_V = "[" + ", ".join(f"{x}::DOUBLE" for x in _VECTOR) + "]"
_VR = "[" + ", ".join(f"{x}::DOUBLE" for x in _VECTOR[::-1]) + "]"
_PLACED = "SELECT c_custkey, (c_custkey * 37 % 36000) / 100 - 180 AS lon, (c_custkey * 53 % 17000) / 100 - 85 AS lat FROM customer"
_RING = [(-60.0, -20.0), (40.0, -30.0), (60.0, 50.0), (0.0, 10.0), (-50.0, 60.0), (-60.0, -20.0)]
_CROSS = " + ".join(f"CAST(({y1} > lat) <> ({y2} > lat) AND lon < ({x2} - ({x1})) * (lat - ({y1})) / ({y2} - ({y1})) + ({x1}) AS INTEGER)" for (x1, y1), (x2, y2) in zip(_RING, _RING[1:]))
_CTOK = _TOK.replace("text", "chunk_text")
_ER = f"""WITH RECURSIVE c AS (SELECT c_custkey AS k, translate(substr(md5('a' || c_custkey), 1, 8), '0123456789', 'ghijklmnop') AS w1, translate(substr(md5('b' || c_custkey), 1, 8), '0123456789', 'ghijklmnop') AS w2, '+12' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS ph FROM customer),
    r AS (SELECT k * 2 AS id, list_sort([w1, w2]) AS w, ph AS phone, 'u' || k || '@corp.example' AS email FROM c UNION ALL SELECT k * 2 + 1, list_sort([w1, w2]), CASE WHEN k % 2 = 0 THEN ph END, CASE k % 4 WHEN 1 THEN 'u' || k || '@corp.example' WHEN 3 THEN 'u' || k || '@home.example' END FROM c),
    coded AS (SELECT *, regexp_replace(translate(substr(w[2], 2), 'bfpvcgjkqsxzdtlmnr', '111122222222334556'), '[^1-6]', '', 'g') AS d FROM r),
    sound AS (SELECT *, substr(upper(w[2][1]) || regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(d, '1+', '1', 'g'), '2+', '2', 'g'), '3+', '3', 'g'), '4+', '4', 'g'), '5+', '5', 'g'), '6+', '6', 'g') || '000', 1, 4) AS code FROM coded),
    keys AS (SELECT id, 'm' || split_part(email, '@', 1) AS key FROM r WHERE email IS NOT NULL UNION SELECT id, 'p' || substr(w[2], 1, 3) || right(phone, 4) FROM r WHERE phone IS NOT NULL UNION SELECT id, 's' || code || w[1][1] FROM sound),
    pairs AS (SELECT DISTINCT a.id AS id_a, b.id AS id_b FROM keys a JOIN keys b ON a.key = b.key AND a.id < b.id),
    parts AS (SELECT id_a, id_b, a.email IS NOT NULL AND b.email IS NOT NULL AS he, a.phone IS NOT NULL AND b.phone IS NOT NULL AS hp, CASE WHEN a.email = b.email THEN 1.0 WHEN split_part(a.email, '@', 1) = split_part(b.email, '@', 1) THEN 0.6 ELSE 0.0 END AS e, CASE WHEN a.phone = b.phone THEN 1.0 ELSE 0.0 END AS p,
        CASE WHEN len(list_filter(a.w, lambda x: NOT list_contains(b.w, x))) = 0 THEN 1.0 ELSE 1.0 - levenshtein(array_to_string(a.w, ' '), array_to_string(b.w, ' ')) / greatest(length(array_to_string(a.w, ' ')), length(array_to_string(b.w, ' '))) END AS n, a.w[2] = b.w[2] AS same_last, coalesce(a.email = b.email, false) AS same_email, coalesce(a.phone = b.phone, false) AS same_phone FROM pairs JOIN r a ON a.id = id_a JOIN r b ON b.id = id_b),
    scored AS (SELECT *, (CASE WHEN he THEN 0.5 * e ELSE 0 END + CASE WHEN hp THEN 0.25 * p ELSE 0 END + 0.2 * n) / (CASE WHEN he THEN 0.5 ELSE 0 END + CASE WHEN hp THEN 0.25 ELSE 0 END + 0.2) AS raw FROM parts),
    final AS (SELECT id_a, id_b, round(CAST(CASE WHEN same_email THEN 1.0 WHEN same_phone AND (n >= 0.85 OR same_last) THEN greatest(raw, 0.92) ELSE raw END AS DOUBLE), 6) AS score FROM scored),
    decided AS (SELECT *, CASE WHEN score >= 0.9 THEN 'merge' WHEN score >= 0.7 THEN 'review' ELSE 'skip' END AS decision FROM final)"""
_REACH = "linked AS (SELECT id_a AS a, id_b AS b FROM decided WHERE decision = 'merge' UNION SELECT id_b, id_a FROM decided WHERE decision = 'merge' UNION SELECT id_a, id_a FROM decided WHERE decision = 'merge' UNION SELECT id_b, id_b FROM decided WHERE decision = 'merge'), reach AS (SELECT a, b FROM linked UNION SELECT x.a, y.b FROM reach x JOIN linked y ON x.b = y.a)"
ORACLE = {
    "geo_facts": rf"""WITH {POINTS_SQL} SELECT regexp_extract(entity_uri, '/entities/([^/]+)/', 1) AS type, count(*) AS n_points, bool_or(valid_time IS NOT NULL) AS temporal, round(min(lat), 4) AS south, round(max(lat), 4) AS north FROM points GROUP BY 1""",
    "lexical_rank": f"WITH t AS (SELECT doc_id, len({_TOK}) AS n, list_filter({_TOK}, lambda w: list_contains({_Q}, w)) AS h FROM documents) SELECT doc_id, round(len(list_distinct(h)) / 3.0 * len(h) / (n + 10.0), 9) AS score FROM t WHERE len(h) > 0 ORDER BY len(list_distinct(h)) / 3.0 * len(h) / (n + 10.0) DESC, doc_id LIMIT 50",
    "vector_topk": f"SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], {_V}), 6) AS score FROM embeddings ORDER BY list_cosine_similarity(embedding::DOUBLE[], {_V}) DESC, vec_id LIMIT 20",
    "hybrid_rrf": f"""WITH t AS (SELECT chunk_id, len({_CTOK}) AS n, list_filter({_CTOK}, lambda w: list_contains({sorted(_WORDS)}, w)) AS h FROM entity_semantic_chunk),
        a AS (SELECT chunk_id, row_number() OVER (ORDER BY len(list_distinct(h)) / 4.0 * len(h) / (n + 10.0) DESC, chunk_id) AS r FROM t WHERE len(h) > 0),
        v AS (SELECT chunk_id, CASE WHEN len(embedding) = 64 AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0 AND NOT isnan(list_cosine_similarity(embedding::DOUBLE[], {_V})) THEN list_cosine_similarity(embedding::DOUBLE[], {_V}) ELSE 0 END AS c FROM entity_semantic_chunk WHERE embed_model = 'stub-embed-a'),
        b AS (SELECT chunk_id, row_number() OVER (ORDER BY c DESC, chunk_id) AS r FROM v),
        u AS (SELECT chunk_id, sum(1.0 / (60 + r)) AS score FROM (SELECT * FROM a WHERE r <= 50 UNION ALL SELECT * FROM b WHERE r <= 50) GROUP BY 1)
        SELECT entity_uri AS entity, round(max(score), 9) AS score FROM u JOIN entity_semantic_chunk USING (chunk_id) GROUP BY 1 ORDER BY max(score) DESC, entity LIMIT 10""",
    "best_chunk": "SELECT entity_uri, doc_id, n_chars FROM documents WHERE entity_uri IS NOT NULL QUALIFY row_number() OVER (PARTITION BY entity_uri ORDER BY n_chars DESC NULLS LAST, doc_id) = 1",
    "keyset_page": "SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey > 100 OR (o_custkey = 100 AND o_orderkey > 50) ORDER BY 1, 2 LIMIT 25",
    "geo_radius": f"SELECT c_custkey, round(m, 3) AS metres FROM (SELECT c_custkey, 2 * 6371008.8 * asin(least(1.0, sqrt(pow(sin((radians(lat) - radians(20)) / 2), 2) + cos(radians(20)) * cos(radians(lat)) * pow(sin((radians(lon) - radians(10)) / 2), 2)))) AS m FROM ({_PLACED})) WHERE m <= 1500000",
    "geo_bbox": f"SELECT c_custkey FROM ({_PLACED}) WHERE lon BETWEEN -50 AND 20 AND lat BETWEEN -10 AND 40",
    "geo_polygon": f"SELECT c_custkey FROM ({_PLACED}) WHERE ({_CROSS}) % 2 = 1",
    "er_scores": f"{_ER} SELECT id_a, id_b, score, decision FROM decided",
    "er_block_pairs": f"{_ER} SELECT id_a, id_b FROM pairs",
    "list_explode": "SELECT p_partkey, 'entities/Tag/' || regexp_replace(v, '[^a-zA-Z0-9_-]', '_', 'g') AS node FROM (SELECT p_partkey, unnest([p_brand, p_type]) AS v FROM part)",
    "promote_to_node": "SELECT 'entities/Customer/' || c_custkey AS s, 'onto/segment' AS p, 'entities/Segment/' || regexp_replace(c_mktsegment, '[^a-zA-Z0-9_-]', '_', 'g') AS o FROM customer UNION ALL SELECT DISTINCT 'entities/Segment/' || regexp_replace(c_mktsegment, '[^a-zA-Z0-9_-]', '_', 'g'), 'rdfs:label', c_mktsegment FROM customer",
    "invariant_dangling": "SELECT 'onto/nation' AS p, count(*) AS n FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier) WHERE k IN (1, 7)",
    "invariant_literal_edge": "SELECT 'onto/segment' AS p, count(*) AS n FROM customer",
    "find_metrics": "WITH g AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority LIKE '1%'), f AS (SELECT CASE WHEN o_orderkey % 10 = 0 THEN -o_orderkey ELSE o_custkey END AS k FROM orders WHERE o_totalprice > 300000), r AS (SELECT k, CASE WHEN c_custkey IS NULL THEN 'made_up' WHEN c_acctbal < 0 THEN 'off_type' WHEN k IN (SELECT o_custkey FROM g) THEN 'right' ELSE 'wrong' END AS kind FROM f LEFT JOIN customer ON c_custkey = k) SELECT round(count(*) FILTER (kind = 'right') / count(*), 6) AS precision, round(count(DISTINCT k) FILTER (kind = 'right') / (SELECT count(*) FROM g), 6) AS coverage, round((count(*) - count(DISTINCT k)) / count(*), 6) AS duplicates, round(count(*) FILTER (kind = 'made_up') / count(*), 6) AS made_up, round(count(*) FILTER (kind = 'off_type') / count(*), 6) AS off_type FROM r",
    "evidence_verdict": "WITH n AS (SELECT event_id % 97 AS claim, count(DISTINCT user_id) FILTER (value > 20) AS up, count(DISTINCT user_id) FILTER (NOT value > 20) AS down FROM events GROUP BY 1) SELECT claim, CASE WHEN up > 0 THEN 'supported' WHEN down > 0 THEN 'refuted' ELSE 'unknown' END AS verdict, CAST(CASE WHEN up > 0 THEN round(least(0.9, 0.5 + 0.2 * (up - 1)), 4) WHEN down > 0 THEN round(least(0.9, 0.5 + 0.2 * (down - 1)), 4) ELSE 0 END AS DOUBLE) AS confidence FROM n",
    "membership_rule": "SELECT p_partkey FROM part WHERE (lower(p_brand) IN ('brand#11', 'brand#23') OR contains(lower(p_type), 'steel')) AND NOT regexp_matches(p_name, '^a', 'i') AND trim(p_name) <> ''",
    "key_join": "WITH o AS (SELECT s_nationkey AS k, min(s_suppkey) AS owner FROM supplier GROUP BY 1 HAVING count(*) = 1) SELECT n_nationkey, CASE WHEN owner IS NULL THEN 'mint' ELSE 'match' END AS action, owner FROM nation LEFT JOIN o ON k = n_nationkey",
    "er_clusters": f"{_ER}, {_REACH} SELECT a AS id, min(b) AS canonical FROM reach GROUP BY a",
    "er_survivors": f"{_ER}, {_REACH}, cl AS (SELECT a AS id, min(b) AS canonical FROM reach GROUP BY a) SELECT canonical, arg_min(id, (1 + (phone IS NOT NULL)::INT + (email IS NOT NULL)::INT)::BIGINT * -1000000000 + id) AS survivor FROM cl JOIN r USING (id) GROUP BY 1",
}
