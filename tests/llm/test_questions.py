import random

from loomgraph.llm.edit_join import within
from loomgraph.llm.questions import Wording, canonical_query, overlap_counts, overlapping_pairs, plain_question, prepare, slips_only


def test_wording():
    same = ["How many Storms in Foo Bay have a wind speed above 499?", "how many storms in foo bay have a wind speed above 499", "In Foo Bay, what number of Storms show a wind speed over 499?", "Please tell me: how  many Storms in Foo Bay have a wind speed above 499? Thanks.", '"- In this graph, how many Storms in Foo Bay have a wind speed above 499 ?"']
    assert {" ".join(sorted(plain_question(q).split())) for q in same} == {"499 a above bay foo have how in many speed storms wind"}
    assert plain_question("What are the top eight farms?") == plain_question("Give me the top 8 farms")
    assert plain_question("Give me the top 8 farms, please", Wording(None, None, ())) == "give me the top 8 farms please"
    assert plain_question(None) is None and plain_question(" ?! ") is None


def test_slips():
    a = "how many storms in zulmarvek bay have a damage above 12"
    assert slips_only(a, a) and slips_only(a, a.replace("storms", "stroms").replace("zulmarvek", "zulmrvek")) and slips_only(a, a.replace("how many", "howmany"))
    for x, y in (("12", "13"), ("zulmarvek", "brindolpa"), ("above", "below"), ("bay", "city"), ("bay", "bar"), (" a ", " ")):
        assert not slips_only(a, a.replace(x, y))


Q = 'PREFIX rdfs: <http://l#>\nSELECT (COUNT(DISTINCT ?x) AS ?n) FROM <g> WHERE { # why\n ?x a <T> . ?x <p> ?y . ?y rdfs:label "A" . FILTER(?x > 3) }'


def test_queries():
    same = 'select (count(distinct ?s0) as ?s1) from <g> where {\n\t?s2 <http://l#label> "A" .\n ?s0 <p> ?s2 .\n?s0 <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <T> .\n filter(?s0 > 3)\n}'
    assert canonical_query(Q) == canonical_query(same)
    for a, b in (('"A"', '"B"'), ("> 3", "< 3"), ("> 3", "> 4"), ("?x <p> ?y", "?y <p> ?x"), ("COUNT", "SUM")):
        assert canonical_query(Q.replace(a, b)) != canonical_query(Q)
    assert canonical_query(None) is None and canonical_query("  ") is None and canonical_query("{ } { broken")


def test_long_chains_of_variables():
    chain = lambda names: "SELECT ?a0 WHERE { " + " . ".join(f"?{x} <p> ?{y}" for x, y in zip(names, names[1:])) + " }"
    a = [f"a{i}" for i in range(20)]
    assert canonical_query(chain(a)) == canonical_query(chain(["a0", *[f"z{(i * 7) % 19}" for i in range(1, 20)]]))


def frame(spark, rows):
    return prepare(spark.createDataFrame(rows, "id long, split string, kg string, question string, gold string"), "id", "split", "kg", "question", "gold")


def test_overlaps(spark):
    q = "How many Storms in Zulmarvek have a damage above 12?"
    rows = [
        (1, "train", "k", q, Q), (2, "test", "k", "How mnay Storms in Zulmarvek have a damage over 12", Q), (3, "test", "k", q.replace("12", "13"), Q.replace("3", "4")), (4, "validation", "j", q, Q), (5, "test", "k", None, Q),
        (6, "holdout_v2", "k", q.replace("Zulmarvek", "Zulmarvk"), None), (7, "holdout_v2", "k", q.replace("12", "21"), None), (8, "test", "k", None, None), (9, None, "k", q, Q), (10, "train", None, q, Q), (11, "train", "k", q, Q), (12, "test", "k", q.replace("Zulmarvek", "Brindolpa"), None),
        (13, "test", "k", "In Zulmarvek, how many Storms have a damage above 12?", Q), (14, "test", "k", q, Q.replace('"A"', '"B"')),
    ]
    got = {(r.question_a, r.question_b) for r in overlapping_pairs(frame(spark, rows)).collect()}
    assert got == {(1, 2), (2, 11), (1, 5), (5, 11), (1, 6), (6, 11), (1, 13), (11, 13)}
    counts = {(r.split, r.source): (r.n_pairs, r.n_slipped) for r in overlap_counts(frame(spark, rows)).collect()}
    assert counts == {("test", "k"): (6, 2), ("holdout_v2", "k"): (2, 2)}
    assert overlapping_pairs(frame(spark, rows[:0] or [(1, None, None, None, None)])).count() == 0


def test_recall_of_planted_slips(spark):
    """One or two slips inside of words of whole questions: all are found, and only by edits."""
    rnd = random.Random(3)
    names = ["".join(rnd.choice("bdfgklmnprstvz") + rnd.choice("aeiou") for _ in range(5)) for _ in range(60)]

    def slipped(t: str) -> str:
        for _ in range(rnd.choice([1, 1, 2])):
            i = rnd.choice([i for i in range(1, len(t) - 1) if t[i - 1 : i + 2].isalpha()])
            t = rnd.choice([t[:i] + t[i + 1 :], t[:i] + t[i] + t[i:], t[:i] + rnd.choice("aeiou") + t[i + 1 :]])
        return t

    rows, want = [], set()
    for i, n in enumerate(names):
        q, gold = f"How many Storms in {n} have a damage above {i + 100}?", Q.replace('"A"', f'"{n}"')
        rows += [(2 * i, "train", "k", q, gold), (2 * i + 1, "test", "k", slipped(q[:-1]), gold)]
        want.add((2 * i, 2 * i + 1))
    got = {(r.question_a, r.question_b): r.distance for r in overlapping_pairs(frame(spark, rows)).collect()}
    assert set(got) == want and sum(d > 0 for d in got.values()) >= 55


def test_an_ablation_of_the_edits_loses_links(spark):
    rows = [(1, "train", "k", "List the farms of Zulmarvek.", Q), (2, "test", "k", "List the frams of Zulmarvek.", Q)]
    assert overlapping_pairs(frame(spark, rows)).count() == 1 and overlapping_pairs(frame(spark, rows), k_same_query=0).count() == 0


def test_band():
    assert within("kitten", "sitting", 3) == 3 and within("kitten", "sitting", 2) is None
