import pytest
from pyspark.sql import functions as F

from loomgraph.functions import cleaning as cl
from loomgraph.functions.text import overlapping_pieces
from loomgraph.operators import explorer as ex, ingest
from loomgraph.operators.records import append_events, set_intervals, streaks
from loomgraph.sources.files import byte_batches
from loomgraph.sources.pages import Paging, pages


def test_mapping_handles_nulls_and_clashes(spark):
    rows = [("1", "Ann", "x|y", "7", "a"), ("2", None, " ", "seven", None), (None, "Bo", None, None, None), (None, None, None, None, None), ("1", "Ann", "x|y", "7", "a")]
    df = spark.createDataFrame(rows, "id string, s string, p string, o string, g string")
    spec = [ingest.EntitySpec("T", ("id",), "s", {"n": ("o", "integer")}), ingest.EntitySpec("U", ("id", "g"))]
    facts, bad = ingest.map_rows(df, spec, [ingest.Link(0, "to", to=1), ingest.Link(0, "has", column="p", target="V")])
    got = {(r.s, r.p, r.o) for r in facts.collect()}
    assert {("entities/T/1", "onto/has", "entities/V/x"), ("entities/T/1", "onto/to", "entities/U/1_a"), ("entities/V/y", "rdfs:label", "y"), ("entities/T/1", "attrs/n", "7")} <= got
    assert len({s for s, p, _ in got if p == "rdf:type" and s.startswith("entities/T/")}) == 3 and facts.count() == len(got)
    assert [(r.s, r.raw, r.reason) for r in bad.collect()] == [("entities/T/2", "seven", "not integer")]
    assert ingest.map_rows(df.limit(0), spec, [])[0].count() == 0


def test_screening(spark):
    df = spark.createDataFrame([("Ann", "1998 x", 1), ("Home", "Oak", 2), (None, None, 3), ("!", "Oak", 4)], "name string, home_city string, scrubbed_n int")
    assert {(r.name, r.home_city, r.scrubbed) for r in ingest.screen_rows(df, "name", ["home_city"]).collect()} == {("Ann", None, "home_city"), (None, None, "")}
    assert ingest.role_of("email_address", "name") is None and ingest.role_of("home_city", "name") == "city" and ingest.role_of("k", "k") == "name"


def test_batches_never_exceed_their_limit(spark):
    df = spark.createDataFrame([("a", i, n) for i, n in enumerate([6, 6, 8, 3, 30, 2, 2])] + [("b", 0, 10), (None, 0, 1)], "g string, i int, n int").select("g", "i", F.repeat(F.lit("x"), F.col("n")).alias("t"))
    got = {(r.g, r.i): r.batch for r in byte_batches(df, ["g"], ["i"], F.col("t"), 10).collect()}
    assert [got["a", i] for i in range(7)] == [0, 1, 2, 3, 4, 5, 5] and got["b", 0] == got[None, 0] == 0
    assert byte_batches(df.limit(0), ["g"], ["i"], F.col("t"), 10).count() == 0


def test_pieces_cover_the_text():
    text = ("A sentence of some length. " * 300) + "x" * 7000
    parts = overlapping_pieces(text, 3000, 200)
    assert all(text[s : s + len(c)] == c and len(c) <= 3000 for s, c in parts) and parts[-1][0] + len(parts[-1][1]) == len(text)
    assert all(b[0] <= a[0] + len(a[1]) for a, b in zip(parts, parts[1:])) and overlapping_pieces("", 10, 2) == []


def test_paging():
    rows = list(range(7))
    assert list(pages(lambda p: (rows[p["offset"] : p["offset"] + p["limit"]], {}), Paging("offset", 3))) == [[0, 1, 2], [3, 4, 5], [6]]
    assert list(pages(lambda p: ([1], {"next": "same"}), Paging("cursor"))) == [[1], [1]]  # a cursor that comes again ends it
    assert list(pages(lambda p: (rows, {}), Paging("none", max_rows=4))) == [[0, 1, 2, 3]] and list(pages(lambda p: ([], {}), Paging("page"))) == []
    for bad in ({"style": "odd"}, {"size": 0}, {"max_rows": 0}):
        with pytest.raises(ValueError):
            Paging(**bad)


def test_orders_are_added_to_plain_queries_only():
    assert ex.ordered_query("SELECT ?a ?b WHERE { ?a <p> ?b }.").endswith("\nORDER BY ?a ?b")
    for q in ("SELECT * WHERE { ?a <p> ?b }", "SELECT (COUNT(?a) AS ?n) WHERE { ?a <p> ?b }", "SELECT ?a WHERE { ?a <p> ?b } ORDER BY ?a", "SELECT ?a WHERE { ?a <p> ?b } LIMIT 3", "ASK { ?a <p> ?b }"):
        assert ex.ordered_query(q) == q


def test_guards(spark):
    cases = {"SELECT ?x WHERE { ?x <drop> \"insert\" }": None, "": "empty", None: "empty", "DROP GRAPH <g>": "update: DROP", "SELECT { {": "unbalanced braces", "# delete me\nSELECT ?x { }": None, "select ?x { } ; insert data { }": "update: INSERT"}
    df = spark.createDataFrame([(i, q) for i, q in enumerate(cases)], "i int, q string")
    assert [r[0] for r in df.orderBy("i").select(ex.query_fault(F.col("q"))).collect()] == list(cases.values())


def test_values(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(cl.json_objects(F.lit('x [{"a": [1, 2]}, 3, {"b": 1}] y'))) == ['{"a":[1,2]}', '{"b":1}'] and one(cl.json_objects(F.lit("none"))) == []
    assert one(cl.scalar_cell(F.lit('["a", null, " b "]'))) == "a, b" and one(cl.scalar_cell(F.lit('{"a": 1}'))) is None and one(cl.scalar_cell(F.lit("3.5"))) == "3.5"
    assert one(cl.envelope_id(F.lit("a|b"), F.lit("c"), F.array(F.lit("x")), F.lit("1"))) != one(cl.envelope_id(F.lit("a"), F.lit("b|c"), F.array(F.lit("x")), F.lit("1")))


def test_records(spark):
    intervals = spark.createDataFrame([("a", 1, None), ("b", 1, 5)], "fact_id string, valid_from int, valid_to int")
    changes = spark.createDataFrame([("a", "close", 7), ("b", "reopen", 8), ("c", "open", 9), ("c", "close", 11)], "fact_id string, action string, at int")
    assert {tuple(r) for r in set_intervals(intervals, changes).collect()} == {("a", 1, 7), ("b", 1, None), ("c", 9, 11)}
    log = spark.createDataFrame([(1, 1, "x")], "n long, day int, kind string")
    got = append_events(log, spark.createDataFrame([(3, "b"), (2, "a"), (3, "c")], "day int, kind string"), ["day", "kind"])
    assert [(r.n, r.kind) for r in got.orderBy("n").collect()] == [(1, "x"), (2, "a"), (3, "b"), (4, "c")]
    assert append_events(log.limit(0), log.limit(0).drop("n"), ["day", "kind"]).count() == 0
    hits = spark.createDataFrame([("k", i, h) for i, h in enumerate([1, 1, 0, 1, 1, 1])], "k string, i int, h int")
    assert [(r.length, r.first, r.last) for r in streaks(hits, ["k"], ["i"], F.col("h") == 1, 3).collect()] == [(3, 3, 5)]
