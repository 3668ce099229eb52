import pytest

from loomgraph.model import QUAD, EntityMap, Source, VirtualGraph, closure, reachable
from loomgraph.runtime import materialize, release, shared_dir
from loomgraph.sources.store import GraphStore
from loomgraph.sparql import Engine
from loomgraph.sparql.parser import SparqlError
from loomgraph.sparql.update import update

SCHEMA = ", ".join(f"{c} string" for c in QUAD)


@pytest.fixture(scope="module")
def quads(spark):
    rows = [("kg", "a", "knows", "b", "iri", None), ("kg", "b", "knows", "c", "iri", None), ("kg", "c", "knows", "a", "iri", None), ("kg", "a", "age", "30", "literal", "integer"), ("kg", "b", "age", "40", "literal", "integer"), ("side", "a", "age", "31", "literal", "integer"), ("kg", "d", "name", "x", "literal", "string")]
    return spark.createDataFrame(rows, SCHEMA)


def facts(df):
    return {(r.g, r.s, r.p, r.o) for r in df.collect()}


def test_updates(quads):
    base = facts(quads)
    assert facts(update(quads, 'INSERT DATA { <a> <age> "30"^^<integer> . <z> <age> 5 }')) >= {("kg", "z", "age", "5")} | base
    assert facts(update(quads, "DELETE WHERE { ?x <knows> ?y }")) == {f for f in base if f[2] != "knows"}
    moved = facts(update(quads, "DELETE { ?x <age> ?a } INSERT { ?x <years> ?a } WHERE { ?x <age> ?a . ?x <knows> ?y FILTER(?a > 35) }"))
    assert moved == base - {("kg", "b", "age", "40")} | {("kg", "b", "years", "40")}
    # an unbound variable of a template gives no fact; an empty pattern's update changes nothing
    assert facts(update(quads, "INSERT { ?x <old> ?a } WHERE { ?x <name> ?n OPTIONAL { ?x <age> ?a } }")) == base
    assert facts(update(quads, "DELETE { ?x <age> ?a } WHERE { ?x <nothing> ?a }")) == base
    assert facts(update(quads.limit(0), "INSERT DATA { GRAPH <g2> { <s> <p> <o> } }")) == {("g2", "s", "p", "o")}
    for bad in ("SELECT ?x WHERE { ?x ?p ?o }", "INSERT { ?x <p> ?q } WHERE { ?x <age> ?a }", "DELETE DATA { <a> <b>/<c> <d> }", "DELETE"):
        with pytest.raises(SparqlError):
            update(quads, bad).collect()


def test_store_keeps_versions(spark, quads):
    store = GraphStore(spark, f"{shared_dir(spark)}/kept")
    assert store.versions() == [] and store.write(quads) == 1
    assert store.update('INSERT DATA { <n> <p> "v" }') == 2 and store.update("DELETE WHERE { ?x <age> ?a }") == 3
    assert facts(store.read(1)) == facts(quads) and {f[0] for f in facts(store.read()) if f[2] == "age"} == {"side"}  # an update without GRAPH is the default graph's matter
    store.drop(1)
    assert store.versions() == [3]


def test_paths_from_a_constant(spark, quads):
    e = Engine(quads)
    everything = {tuple(r) for r in e.query("SELECT ?a ?b WHERE { ?a <knows>+ ?b }").collect()}
    assert everything == {(x, y) for x in "abc" for y in "abc"}
    assert {r[0] for r in e.query("SELECT ?b WHERE { <a> <knows>+ ?b }").collect()} == {"a", "b", "c"}
    assert {r[0] for r in e.query("SELECT ?b WHERE { ?b <knows>* <a> }").collect()} == {"a", "b", "c"}
    assert [r[0] for r in e.query("SELECT ?b WHERE { <nobody> <knows>* ?b }").collect()] == ["nobody"]
    edges = spark.createDataFrame([(i, i + 1) for i in range(80)] + [(None, 1)], "src int, dst int")
    assert closure(edges.filter("src < 12")).count() == 78 and reachable(edges, "0").agg({"depth": "max"}).first()[0] == 80


def test_maybe_unbound_variables_join_as_sparql_says(spark):
    rows = [("kg", s, p, o, "literal", "string") for s, p, o in (("1", "a", "x"), ("2", "a", "y"), ("3", "a", "z"), ("1", "b", "p"), ("2", "b", "q"), ("7", "c", "p"), ("8", "c", "r"))]
    got = Engine(spark.createDataFrame(rows, SCHEMA)).query("SELECT ?s ?v ?t WHERE { ?s <a> ?n OPTIONAL { ?s <b> ?v } { ?t <c> ?v } }")
    assert sorted(map(tuple, got.collect())) == [("1", "p", "7"), ("3", "p", "7"), ("3", "r", "8")]


def test_virtual_graph_is_the_quads_it_stands_for(spark):
    """Fused projections against the same patterns over plain quads, with nulls, repeated keys and predicates that two tables share."""
    people = spark.createDataFrame([(1, "Ann", 3.5, 10), (2, None, None, 11), (3, "Bo", 1.0, None)], "id int, name string, score double, home int")
    homes = spark.createDataFrame([(10, "Oak", 1.0), (11, "Elm", None)], "id int, name string, score double")
    sources = [Source(people, EntityMap("P", "id", "name", {"score": ("score", "float")}, {"home": ("H", "home")}), unique=True), Source(homes, EntityMap("H", "id", "name", {"score": ("score", "float")}), unique=True)]
    graph = VirtualGraph(sources)
    twice = VirtualGraph([Source(s.df.union(s.df), s.map) for s in sources])
    for text in (
        "SELECT ?x ?s ?n WHERE { ?x <attrs/score> ?s ; rdfs:label ?n }", "SELECT ?x ?h ?n WHERE { ?x <onto/home> ?h . ?h rdfs:label ?n }", "SELECT ?p ?o WHERE { <entities/P/1> ?p ?o }", "SELECT ?x ?y WHERE { ?x <attrs/score> 1 ; ?y ?z }",
        "SELECT ?x WHERE { ?x a <types/H> FILTER NOT EXISTS { ?x <attrs/score> ?s } }", "SELECT ?x ?s WHERE { ?x a ?t OPTIONAL { ?x <attrs/score> ?s FILTER(?s > 2) } }", "SELECT ?g ?x WHERE { GRAPH ?g { ?x <onto/home> ?h ; rdfs:label ?l } }", "SELECT ?x WHERE { ?x rdfs:label ?x }", "SELECT ?n WHERE { ?x <onto/home>/rdfs:label ?n . ?x ^<onto/none> ?y }",
    ):
        for g in (graph, twice):
            rows = lambda engine: sorted(map(tuple, engine.query(text).collect()), key=str)  # noqa: B023, E731
            assert rows(Engine(g)) == rows(Engine(g.quads())), text


def test_release(spark):
    materialize(spark.range(3), "gone")
    assert release(spark) >= 1 and release(spark) == 0
