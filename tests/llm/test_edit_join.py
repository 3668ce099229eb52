import random

import pytest

from loomgraph.llm.edit_join import cuts, segment_join, within


def plain(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_banded_distance():
    rnd = random.Random(1)
    for _ in range(2000):
        a = "".join(rnd.choice("abc") for _ in range(rnd.randint(0, 9)))
        b = "".join(rnd.choice("abc") for _ in range(rnd.randint(0, 9)))
        for k in (0, 1, 2, 4):
            d = plain(a, b)
            assert within(a, b, k) == (d if d <= k else None)


def test_cuts():
    assert cuts(7, 2) == [(0, 2), (2, 2), (4, 3)] and sum(n for _, n in cuts(1, 3)) == 1


@pytest.mark.parametrize("k", [0, 1, 2, 3])
def test_join_against_brute_force(spark, k):
    rnd = random.Random(k)
    base = ["".join(rnd.choice("abcd") for _ in range(rnd.randint(0, 14))) for _ in range(40)]

    def noisy(s):
        for _ in range(rnd.randint(0, 3)):
            i = rnd.randint(0, len(s))
            s = rnd.choice([s[:i] + "x" + s[i:], s[: max(0, i - 1)] + s[i:], s[:i] + s[i + 1 : i + 2] + s[i : i + 1] + s[i + 2 :]])
        return s

    left = {(rnd.choice("AB"), noisy(s)) for s in base}
    right = {(rnd.choice("AB"), noisy(s)) for s in base for _ in range(2)}
    frame = lambda rows: spark.createDataFrame([(*r, r[1]) for r in sorted(rows)], "block string, text string, tag string")
    got = {(r.block, r.probe, r.target, r.distance) for r in segment_join(frame(left), frame(right), k).collect()}
    assert got == {(b, x, y, d) for b, x in left for c, y in right if b == c and (d := plain(x, y)) <= k}
