from itertools import combinations

import pytest

from loomgraph.operators import matching
from loomgraph.plans import registry
from loomgraph.plans.search_geo_matching import _records

SOUND = {c: d for g, d in {"bfpv": "1", "cgjkqsxz": "2", "dt": "3", "l": "4", "mn": "5", "r": "6"}.items() for c in g}


def sound(word):
    kept = ""
    for c in word[1:]:
        if c in SOUND and not kept.endswith(SOUND[c]):
            kept += SOUND[c]
    return (word[0].upper() + kept + "000")[:4]


def keys(r):
    words = sorted(r.name.split()) if r.name else []
    out = {("mail", r.email.rpartition("@")[0])} if r.email else set()
    if words and len(words[-1]) >= 3 and r.phone:
        out.add(("phone", words[-1][:3], r.phone[-4:]))
    if len(words) >= 2:
        out.add(("sound", sound(words[-1]), words[0][0]))
    return out


def ratio(a, b):
    x, y = sorted(set(a.split())), sorted(set(b.split()))
    if set(x) <= set(y) or set(y) <= set(x):
        return 1.0
    p, q = " ".join(x), " ".join(y)
    row = list(range(len(q) + 1))
    for i, c in enumerate(p, 1):
        new = [i]
        for j, d in enumerate(q, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return 1.0 - row[-1] / max(len(p), len(q))


def score(a, b):
    total = used = 0.0
    if a.email and b.email:
        used += 0.5
        total += 0.5 * (1.0 if a.email == b.email else 0.6 if a.email.rpartition("@")[0] == b.email.rpartition("@")[0] else 0.0)
    if a.phone and b.phone:
        used += 0.25
        total += 0.25 * (a.phone == b.phone)
    if a.name and b.name:
        used += 0.2
        total += 0.2 * ratio(a.name, b.name)
    s = total / used if used else 0.0
    if a.phone and a.phone == b.phone and a.name and b.name and (ratio(a.name, b.name) >= 0.85 or sorted(a.name.split())[-1] == sorted(b.name.split())[-1]):
        s = max(s, 0.92)
    return 1.0 if a.email and a.email == b.email else s


def expected(rows):
    at = sorted(rows, key=lambda r: r.id)
    return {(a.id, b.id): score(a, b) for a, b in combinations(at, 2) if keys(a) & keys(b)}


def check(got, want):
    assert {(r.id_a, r.id_b) for r in got} == set(want)
    for r in got:
        s = want[r.id_a, r.id_b]
        assert r.score == pytest.approx(s, abs=2e-6)
        assert r.decision == ("merge" if r.score >= 0.9 else "review" if r.score >= 0.7 else "skip")


def test_all_pairs_and_scores(spark, root):
    want = expected(_records(spark, root).collect())
    assert any(b != a + 1 or a % 2 for a, b in want)
    assert sorted(map(tuple, registry.queries()["er_block_pairs"](spark, root).collect())) == sorted(want)
    check(registry.queries()["er_scores"](spark, root).collect(), want)


SCHEMA = "id long, name string, phone string, email string, address string, dob string"


def test_unrelated_records(spark):
    rows = [
        (1, "anna smith", "+12155550100", "a@x.example", None, None), (2, "anna smith", "+12155550100", None, None, None), (3, "anne smyth", None, "a@y.example", None, None), (4, "adam smoot", "+12155550111", "d@x.example", None, None),
        (5, None, None, "a@x.example", None, None), (6, "anna smithe", "+13125550100", "e@x.example", None, None), (7, "zoe quill", None, None, None, None), (8, "albert smith", "+12155550100", "f@x.example", None, None),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    got = matching.score_pairs(matching.candidate_pairs(df), df, matching.CUSTOMER).collect()
    check(got, expected(df.collect()))
    assert {r.decision for r in got} == {"merge", "review", "skip"}


def test_crowded_blocks_keep_all_pairs(spark):
    rows = [(i, n, "+12155550100", e, None, None) for i, (n, e) in enumerate([("anna smith", "a@x.example"), ("anne smith", None), ("ana smith", None), ("abby smith", None), (None, "a@y.example"), ("zelda smith", "a@z.example")])]
    df = spark.createDataFrame(rows, SCHEMA)
    want = set(expected(df.collect()))
    for most in (2, 400):
        assert {(r.id_a, r.id_b) for r in matching.candidate_pairs(df, most).collect()} == want, most
