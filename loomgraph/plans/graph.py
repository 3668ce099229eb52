"""Graph patterns over a virtual graph of the star-schema tables, in SPARQL, beside plain SQL on the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..model import EntityMap, Source, VirtualGraph, classes
from ..runtime import table
from ..sparql import Engine

CUSTOMER = EntityMap("Customer", "c_custkey", "c_name", {"acctbal": ("c_acctbal", "float"), "segment": ("c_mktsegment", "string")}, {"nation": ("Nation", "c_nationkey")})
SUPPLIER = EntityMap("Supplier", "s_suppkey", "s_name", {"acctbal": ("s_acctbal", "float")}, {"nation": ("Nation", "s_nationkey")})
NATION = EntityMap("Nation", "n_nationkey", "n_name", {}, {"region": ("Region", "n_regionkey")})
REGION = EntityMap("Region", "r_regionkey", "r_name")
ORDER = EntityMap("Order", "o_orderkey", None, {"total": ("o_totalprice", "float"), "status": ("o_orderstatus", "string"), "date": ("o_orderdate", "datetime"), "priority": ("o_orderpriority", "string")}, {"customer": ("Customer", "o_custkey")})
MAPS = {"customer": CUSTOMER, "supplier": SUPPLIER, "nation": NATION, "region": REGION, "orders": ORDER}
CLASS_TREE = [("Thing", None), ("Party", "Thing"), ("Customer", "Party"), ("Supplier", "Party"), ("Place", "Thing"), ("Nation", "Place"), ("Region", "Place"), ("Order", "Thing")]
NOW = "2001-08-02 00:00:00"


def virtual(spark: SparkSession, root: str) -> VirtualGraph:
    """The tables as a graph; each table has one row an identifier."""
    return VirtualGraph([Source(table(spark, root, t), m, unique=True) for t, m in MAPS.items()])


def graph(spark: SparkSession, root: str) -> DataFrame:
    return virtual(spark, root).quads()


def engine(spark: SparkSession, root: str) -> Engine:
    return Engine(virtual(spark, root), F.lit(NOW).cast("timestamp"))


def ontology(spark: SparkSession) -> DataFrame:
    return classes(spark, CLASS_TREE)


_E = lambda kind, key: f"'entities/{kind}/' || {key}"
#: name -> (SPARQL, casts of result columns, SQL)
SPARQL: dict[str, tuple[str, dict[str, str], str]] = {
    "bgp_count": ("SELECT (COUNT(?c) AS ?n) WHERE { ?c a <types/Customer> }", {}, "SELECT count(*) AS n FROM customer"),
    "bgp_join_group": (
        "SELECT ?name (COUNT(DISTINCT ?c) AS ?n) WHERE { ?c a <types/Customer> ; <onto/nation> ?x . ?x rdfs:label ?name } GROUP BY ?name",
        {}, "SELECT n_name AS name, count(DISTINCT c_custkey) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1",
    ),
    "bgp_top_nation": (
        "SELECT ?name (COUNT(DISTINCT ?c) AS ?n) WHERE { ?c a <types/Customer> ; <onto/nation> ?x . ?x rdfs:label ?name } GROUP BY ?name ORDER BY DESC(?n) ?name LIMIT 3",
        {}, "SELECT n_name AS name, count(DISTINCT c_custkey) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1 ORDER BY n DESC, name LIMIT 3",
    ),
    "bgp_four_hops": (
        "SELECT ?region (SUM(?t) AS ?total) (COUNT(?o) AS ?n) WHERE { ?o <onto/customer> ?c ; <attrs/total> ?t . ?c <onto/nation> ?n1 . ?n1 <onto/region> ?r . ?r rdfs:label ?region } GROUP BY ?region",
        {}, "SELECT r_name AS region, sum(o_totalprice) AS total, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1",
    ),
    "bgp_optional": (
        'SELECT ?c ?o WHERE { ?c <attrs/segment> "BUILDING" . OPTIONAL { ?o <onto/customer> ?c ; <attrs/status> "P" } }',
        {}, f"SELECT {_E('Customer', 'c_custkey')} AS c, {_E('Order', 'o_orderkey')} AS o FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' WHERE c_mktsegment = 'BUILDING'",
    ),
    "bgp_union": (
        "SELECT ?x ?b WHERE { { ?x a <types/Customer> ; <attrs/acctbal> ?b FILTER(?b > 9000) } UNION { ?x a <types/Supplier> ; <attrs/acctbal> ?b FILTER(?b < 0) } }",
        {"b": "double"}, f"SELECT {_E('Customer', 'c_custkey')} AS x, c_acctbal AS b FROM customer WHERE c_acctbal > 9000 UNION ALL SELECT {_E('Supplier', 's_suppkey')}, s_acctbal FROM supplier WHERE s_acctbal < 0",
    ),
    "bgp_minus": (
        'SELECT ?c WHERE { ?c a <types/Customer> MINUS { ?o <onto/customer> ?c ; <attrs/status> "P" } }',
        {}, f"SELECT {_E('Customer', 'c_custkey')} AS c FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')",
    ),
    "bgp_exists": (
        "SELECT ?c WHERE { ?c a <types/Customer> FILTER EXISTS { ?o <onto/customer> ?c ; <attrs/total> ?t FILTER(?t > 400000) } }",
        {}, f"SELECT {_E('Customer', 'c_custkey')} AS c FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)",
    ),
    "bgp_not_exists": (
        "SELECT ?n WHERE { ?n a <types/Nation> FILTER NOT EXISTS { ?s <onto/nation> ?n ; a <types/Supplier> ; <attrs/acctbal> ?b FILTER(?b > 7000) } }",
        {}, f"SELECT {_E('Nation', 'n_nationkey')} AS n FROM nation WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 7000)",
    ),
    "bgp_values": (
        'SELECT ?c ?s WHERE { ?c <attrs/segment> ?s . ?c <onto/nation> ?n VALUES (?s ?n) { ("BUILDING" <entities/Nation/1>) ("MACHINERY" <entities/Nation/2>) } }',
        {}, f"SELECT {_E('Customer', 'c_custkey')} AS c, c_mktsegment AS s FROM customer WHERE (c_mktsegment, c_nationkey) IN (('BUILDING', 1), ('MACHINERY', 2))",
    ),
    "bgp_bind_if": (
        'SELECT ?tier (COUNT(?c) AS ?n) WHERE { ?c a <types/Customer> ; <attrs/acctbal> ?b BIND(IF(?b >= 5000, "high", IF(?b >= 0, "low", "debt")) AS ?tier) } GROUP BY ?tier',
        {}, "SELECT CASE WHEN c_acctbal >= 5000 THEN 'high' WHEN c_acctbal >= 0 THEN 'low' ELSE 'debt' END AS tier, count(*) AS n FROM customer GROUP BY 1",
    ),
    "bgp_having": (
        "SELECT ?c (COUNT(?o) AS ?n) (AVG(?t) AS ?mean) WHERE { ?o <onto/customer> ?c ; <attrs/total> ?t } GROUP BY ?c HAVING (COUNT(?o) >= 15)",
        {}, f"SELECT {_E('Customer', 'o_custkey')} AS c, count(*) AS n, avg(o_totalprice) AS mean FROM orders GROUP BY o_custkey HAVING count(*) >= 15",
    ),
    "bgp_subselect": (
        "SELECT (MAX(?n) AS ?most) (MIN(?n) AS ?least) WHERE { { SELECT ?c (COUNT(?o) AS ?n) WHERE { ?o <onto/customer> ?c } GROUP BY ?c } }",
        {"most": "double", "least": "double"}, "SELECT CAST(max(n) AS DOUBLE) AS most, CAST(min(n) AS DOUBLE) AS least FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey)",
    ),
    "bgp_distinct": ("SELECT DISTINCT ?s WHERE { ?c <attrs/segment> ?s }", {}, "SELECT DISTINCT c_mktsegment AS s FROM customer"),
    "bgp_variable_predicate": (
        "SELECT ?p (COUNT(*) AS ?n) WHERE { ?c a <types/Customer> ; ?p ?o } GROUP BY ?p",
        {}, "SELECT p, count(*) AS n FROM (SELECT unnest(['rdf:type', 'rdfs:label', 'attrs/acctbal', 'attrs/segment', 'onto/nation']) AS p FROM customer) GROUP BY p",
    ),
    "bgp_same_variable": (
        "SELECT ?a ?b WHERE { ?a a <types/Supplier> ; <onto/nation> ?n . ?b a <types/Customer> ; <onto/nation> ?n ; <attrs/acctbal> ?x . ?a <attrs/acctbal> ?y FILTER(?x > 9900 && ?y > 9000) }",
        {}, f"SELECT {_E('Supplier', 's_suppkey')} AS a, {_E('Customer', 'c_custkey')} AS b FROM supplier JOIN customer ON s_nationkey = c_nationkey WHERE c_acctbal > 9900 AND s_acctbal > 9000",
    ),
    "filter_contains": (
        'SELECT ?n WHERE { ?x a <types/Nation> ; rdfs:label ?n FILTER(CONTAINS(LCASE(STR(?n)), "1")) }', {}, "SELECT n_name AS n FROM nation WHERE contains(lower(n_name), '1')",
    ),
    "filter_prefix_suffix": (
        'SELECT ?n WHERE { ?x a <types/Customer> ; rdfs:label ?n FILTER(STRSTARTS(?n, "Customer#") && STRENDS(?n, "7")) }', {}, "SELECT c_name AS n FROM customer WHERE starts_with(c_name, 'Customer#') AND suffix(c_name, '7')",
    ),
    "filter_typed_num": (
        'SELECT ?o WHERE { ?o <attrs/total> ?t FILTER(?t > "450000"^^xsd:float || xsd:integer(?t) = 1000) }', {}, f"SELECT {_E('Order', 'o_orderkey')} AS o FROM orders WHERE o_totalprice > 450000 OR trunc(o_totalprice) = 1000",
    ),
    "filter_typed_date": (
        'SELECT (COUNT(?o) AS ?n) WHERE { ?o <attrs/date> ?d FILTER(?d >= "1997-01-01T00:00:00"^^xsd:dateTime && ?d < "1998-01-01T00:00:00"^^xsd:dateTime) }',
        {}, "SELECT count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1998-01-01'",
    ),
    "filter_recency": (
        'SELECT (COUNT(?o) AS ?n) WHERE { ?o <attrs/date> ?d FILTER(?d >= NOW() - "P90D"^^xsd:duration) }', {}, f"SELECT count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '{NOW}' - INTERVAL 90 DAY",
    ),
    "filter_in": (
        'SELECT ?s (COUNT(?o) AS ?n) WHERE { ?o <attrs/status> ?s FILTER(?s IN ("F", "P")) } GROUP BY ?s', {}, "SELECT o_orderstatus AS s, count(*) AS n FROM orders WHERE o_orderstatus IN ('F', 'P') GROUP BY 1",
    ),
    "filter_not_in": (
        'SELECT ?s (COUNT(?o) AS ?n) WHERE { ?o <attrs/status> ?s FILTER(?s NOT IN ("F", "P")) } GROUP BY ?s', {}, "SELECT o_orderstatus AS s, count(*) AS n FROM orders WHERE o_orderstatus NOT IN ('F', 'P') GROUP BY 1",
    ),
    "filter_term_kind": (
        "SELECT ?p (SUM(IF(isLiteral(?o), 1, 0)) AS ?literals) (SUM(IF(isIRI(?o), 1, 0)) AS ?edges) WHERE { ?c a <types/Supplier> ; ?p ?o } GROUP BY ?p",
        {}, "SELECT p, CAST(count(*) * l AS DOUBLE) AS literals, CAST(count(*) * (1 - l) AS DOUBLE) AS edges FROM (SELECT unnest([{'p': 'rdf:type', 'l': 0}, {'p': 'rdfs:label', 'l': 1}, {'p': 'attrs/acctbal', 'l': 1}, {'p': 'onto/nation', 'l': 0}], recursive := true) FROM supplier) GROUP BY p, l",
    ),
    "filter_datatype": (
        "SELECT ?t (COUNT(*) AS ?n) WHERE { ?c a <types/Order> ; ?p ?o BIND(DATATYPE(?o) AS ?t) FILTER(isLiteral(?o)) } GROUP BY ?t",
        {}, "SELECT t, count(*) AS n FROM (SELECT unnest(['xsd:float', 'xsd:string', 'xsd:datetime', 'xsd:string']) AS t FROM orders) GROUP BY t",
    ),
    "filter_regex": ('SELECT ?n WHERE { ?x a <types/Region> ; rdfs:label ?n FILTER(REGEX(?n, "^a", "i")) }', {}, "SELECT r_name AS n FROM region WHERE regexp_matches(r_name, '^a', 'i')"),
    "filter_false": ("SELECT ?x WHERE { ?x a <types/Customer> FILTER(false) }", {}, "SELECT c_name AS x FROM customer WHERE false"),
    "path_alternation": (
        "SELECT ?p (COUNT(?o) AS ?n) WHERE { ?x (<onto/nation>|<onto/region>) ?p . ?p rdfs:label ?o } GROUP BY ?p",
        {}, f"SELECT p, count(*) AS n FROM (SELECT {_E('Nation', 'c_nationkey')} AS p FROM customer UNION ALL SELECT {_E('Nation', 's_nationkey')} FROM supplier UNION ALL SELECT {_E('Region', 'n_regionkey')} FROM nation) GROUP BY p",
    ),
    "path_sequence": (
        "SELECT ?r (COUNT(?c) AS ?n) WHERE { ?c a <types/Customer> ; <onto/nation>/<onto/region>/rdfs:label ?r } GROUP BY ?r",
        {}, "SELECT r_name AS r, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1",
    ),
    "path_inverse": (
        "SELECT ?n (COUNT(?x) AS ?k) WHERE { ?n a <types/Nation> ; ^<onto/nation> ?x } GROUP BY ?n",
        {}, f"SELECT {_E('Nation', 'k')} AS n, count(*) AS k FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier) t(k) GROUP BY t.k",
    ),
    "aggregate_functions": (
        "SELECT ?s (SUM(?t) AS ?total) (AVG(?t) AS ?mean) (MIN(?t) AS ?low) (MAX(?t) AS ?high) (COUNT(DISTINCT ?c) AS ?customers) WHERE { ?o <attrs/status> ?s ; <attrs/total> ?t ; <onto/customer> ?c } GROUP BY ?s",
        {"low": "double", "high": "double"}, "SELECT o_orderstatus AS s, sum(o_totalprice) AS total, avg(o_totalprice) AS mean, min(o_totalprice) AS low, max(o_totalprice) AS high, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1",
    ),
    "group_concat": (
        'SELECT ?r (GROUP_CONCAT(DISTINCT ?n; separator="||") AS ?names) WHERE { ?x <onto/region> ?r ; rdfs:label ?n } GROUP BY ?r',
        {}, f"SELECT {_E('Region', 'n_regionkey')} AS r, string_agg(DISTINCT n_name, '||' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey",
    ),
    "aggregate_sample": ("SELECT ?r (SAMPLE(?n) AS ?one) WHERE { ?x <onto/region> ?r ; rdfs:label ?n } GROUP BY ?r", {}, f"SELECT {_E('Region', 'n_regionkey')} AS r, min(n_name) AS one FROM nation GROUP BY n_regionkey"),
    "order_limit_offset": (
        "SELECT ?c ?b WHERE { ?c a <types/Customer> ; <attrs/acctbal> ?b } ORDER BY DESC(?b) ?c LIMIT 10 OFFSET 5",
        {"b": "double"}, f"SELECT {_E('Customer', 'c_custkey')} AS c, c_acctbal AS b FROM customer ORDER BY c_acctbal DESC, c LIMIT 10 OFFSET 5",
    ),
    "string_functions": (
        'SELECT ?u ?after ?n ?sub WHERE { ?x a <types/Customer> ; rdfs:label ?l BIND(UCASE(?l) AS ?u) BIND(STRAFTER(STR(?x), "/Customer/") AS ?after) BIND(STRLEN(?l) AS ?n) BIND(REPLACE(SUBSTR(?l, 1, 8), "mer", "MER") AS ?sub) }',
        {"n": "double"}, "SELECT upper(c_name) AS u, CAST(c_custkey AS VARCHAR) AS after, CAST(length(c_name) AS DOUBLE) AS n, regexp_replace(substr(c_name, 1, 8), 'mer', 'MER', 'g') AS sub FROM customer",
    ),
    "date_functions": (
        "SELECT ?y ?m (COUNT(?o) AS ?n) WHERE { ?o <attrs/date> ?d BIND(YEAR(?d) AS ?y) BIND(MONTH(?d) AS ?m) } GROUP BY ?y ?m",
        {"y": "int", "m": "int"}, "SELECT CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m, count(*) AS n FROM orders GROUP BY 1, 2",
    ),
    "arithmetic": (
        "SELECT ?o ?x WHERE { ?o <attrs/total> ?t ; <attrs/status> \"P\" BIND(ROUND(?t * 1.1 / 100) - 1 AS ?x) }",
        {"x": "double"}, f"SELECT {_E('Order', 'o_orderkey')} AS o, floor(o_totalprice * 1.1 / 100 + 0.5) - 1 AS x FROM orders WHERE o_orderstatus = 'P'",
    ),
    "coalesce_bound": (
        'SELECT ?n ?k WHERE { ?n a <types/Nation> OPTIONAL { ?s a <types/Supplier> ; <onto/nation> ?n ; <attrs/acctbal> ?b FILTER(?b > 9500) } BIND(COALESCE(?s, "none") AS ?k) FILTER(!BOUND(?s) || ?k != "x") }',
        {}, f"SELECT {_E('Nation', 'n_nationkey')} AS n, coalesce({_E('Supplier', 's_suppkey')}, 'none') AS k FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 9500",
    ),
    "ask": ('ASK { ?x a <types/Region> ; rdfs:label "ASIA" }', {}, "SELECT count(*) > 0 AS answer FROM region WHERE r_name = 'ASIA'"),
    "from_graph": ("SELECT (COUNT(?x) AS ?n) FROM <kg> WHERE { ?x a <types/Order> }", {}, "SELECT count(*) AS n FROM orders"),
    "graph_variable": (
        "SELECT ?g (COUNT(?x) AS ?n) WHERE { GRAPH ?g { ?x a ?t ; rdfs:label ?l } } GROUP BY ?g", {}, "SELECT 'kg' AS g, (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM region) AS n",
    ),
    "unbound_join": (
        'SELECT ?n ?s ?c WHERE { ?n a <types/Nation> OPTIONAL { ?s <onto/nation> ?n ; <attrs/acctbal> ?b FILTER(?b > 8000) } { ?s rdfs:label ?c } }',
        {}, f"WITH l AS (SELECT {_E('Nation', 'n_nationkey')} AS n, {_E('Supplier', 's_suppkey')} AS s FROM nation LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 8000) ON s_nationkey = n_nationkey UNION ALL SELECT {_E('Nation', 'c_nationkey')}, {_E('Customer', 'c_custkey')} FROM customer WHERE c_acctbal > 8000), m AS (SELECT * FROM l WHERE s IS NOT NULL OR n NOT IN (SELECT {_E('Nation', 'c_nationkey')} FROM customer WHERE c_acctbal > 8000)), r AS (SELECT {_E('Customer', 'c_custkey')} AS x, c_name AS c FROM customer UNION ALL SELECT {_E('Supplier', 's_suppkey')}, s_name FROM supplier UNION ALL SELECT {_E('Nation', 'n_nationkey')}, n_name FROM nation UNION ALL SELECT {_E('Region', 'r_regionkey')}, r_name FROM region) SELECT n, x AS s, c FROM m JOIN r ON s = x OR s IS NULL",
    ),
    "graph_pattern": ("SELECT ?l WHERE { GRAPH <kg> { ?x a <types/Region> ; rdfs:label ?l } }", {}, "SELECT r_name AS l FROM region"),
}


def _sparql(name: str):
    text, casts, _ = SPARQL[name]

    def run(spark: SparkSession, root: str) -> DataFrame:
        df = engine(spark, root).query(text)
        return df.withColumns({c: F.col(c).cast(t) for c, t in casts.items()}) if casts else df

    run.__name__ = name
    return run


def path_subclass_star(spark: SparkSession, root: str) -> DataFrame:
    """Instances of a class and of all classes below it."""
    return engine(spark, root).with_subclasses(ontology(spark)).query("SELECT (COUNT(DISTINCT ?x) AS ?n) WHERE { ?x a <types/Party> }")


def path_subclass_plus(spark: SparkSession, root: str) -> DataFrame:
    return Engine(ontology(spark)).query("SELECT ?c ?a WHERE { ?c rdfs:subClassOf+ ?a }")


def path_zero_or_more(spark: SparkSession, root: str) -> DataFrame:
    return Engine(ontology(spark)).query("SELECT ?c WHERE { ?c rdfs:subClassOf* <types/Party> }")


def same_as_closure(spark: SparkSession, root: str) -> DataFrame:
    """Components of a symmetric sameAs relation: customers of one nation and segment whose keys follow each other."""
    from ..operators.linking import canonical_ids

    c = table(spark, root, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    a, b = c.alias("a"), c.alias("b")
    links = a.join(b, (F.col("a.c_nationkey") == F.col("b.c_nationkey")) & (F.col("a.c_mktsegment") == F.col("b.c_mktsegment")) & (F.col("b.c_custkey") > F.col("a.c_custkey")) & (F.col("b.c_custkey") <= F.col("a.c_custkey") + 40))
    out = canonical_ids(links.select(F.col("a.c_custkey").alias("a"), F.col("b.c_custkey").alias("b")))
    return out.select(F.col("id").alias("member"), F.col("canonical"))


_TREE = " UNION ALL ".join(f"SELECT '{c}' AS c, {repr(p) if p else 'NULL'} AS p" for c, p in CLASS_TREE)
QUERIES = {n: _sparql(n) for n in SPARQL} | {f.__name__: f for f in (path_subclass_star, path_subclass_plus, path_zero_or_more, same_as_closure)}
ORACLE = {n: sql for n, (_, _, sql) in SPARQL.items()} | {
    "path_subclass_star": "SELECT (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) AS n",
    "path_subclass_plus": f"WITH RECURSIVE tree AS ({_TREE}), up AS (SELECT c, p AS a FROM tree WHERE p IS NOT NULL UNION SELECT up.c, tree.p FROM up JOIN tree ON up.a = tree.c WHERE tree.p IS NOT NULL) SELECT 'types/' || c AS c, 'types/' || a AS a FROM up",
    "path_zero_or_more": f"WITH RECURSIVE tree AS ({_TREE}), down AS (SELECT 'Party' AS c UNION SELECT tree.c FROM down JOIN tree ON tree.p = down.c) SELECT 'types/' || c AS c FROM down",
    "same_as_closure": """WITH RECURSIVE links AS (
        SELECT a.c_custkey AS a, b.c_custkey AS b FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey AND a.c_mktsegment = b.c_mktsegment AND b.c_custkey > a.c_custkey AND b.c_custkey <= a.c_custkey + 40),
        pairs AS (SELECT a, b FROM links UNION SELECT b, a FROM links UNION SELECT a, a FROM links UNION SELECT b, b FROM links),
        reach AS (SELECT a, b FROM pairs UNION SELECT r.a, e.b FROM reach r JOIN pairs e ON r.b = e.a)
        SELECT a AS member, min(b) AS canonical FROM reach GROUP BY a""",
}
