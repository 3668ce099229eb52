import random

from pyspark.sql import functions as F

from loomgraph.operators.intervals import gaps, periods, with_range

SCHEMA = "e string, lo long, hi long, b string, k0 int"


def brute(rows):
    """Periods and gaps per entity by sorting."""
    by = {}
    for e, lo, hi in rows:
        if (lo is None and hi is None) or (lo is not None and hi is not None and lo > hi):
            continue
        by.setdefault(e, []).append((float("-inf") if lo is None else lo, float("inf") if hi is None else hi))
    p, g = set(), set()
    for e, spans in by.items():
        out = []
        for lo, hi in sorted(spans):
            if out and lo <= out[-1][1]:
                out[-1][1] = max(out[-1][1], hi)
            else:
                out.append([lo, hi])
        p |= {(e, None if a == float("-inf") else a, None if b == float("inf") else b) for a, b in out}
        g |= {(e, a[1], b[0]) for a, b in zip(out, out[1:])}
    return p, g


def run(spark, rows, bucket):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    args = (df, [F.col("e")], F.col("lo"), F.col("hi"), bucket)
    return {tuple(r) for r in periods(*args).collect()}, {tuple(r) for r in gaps(*args).collect()}


def test_random_against_brute_force(spark):
    rnd = random.Random(5)
    rows = []
    for _ in range(400):
        lo = rnd.randint(-100, 2000)
        hi = lo + rnd.randint(-3, 25)
        rows.append((rnd.choice(["a", "b", "c", None, "hot", "hot", "hot"]), lo if rnd.random() > 0.02 else None, hi if rnd.random() > 0.02 else None))
    for bucket in (7, 100, 10**6):
        assert run(spark, rows, bucket) == brute(rows)


def test_cases(spark):
    rows = [("a", 1, 2), ("a", 2, 3), ("a", 1, 2), ("b", 5, 5), ("b", 1, 2), ("b", 8, 9), ("c", None, None), ("c", 4, 3), ("d", None, 3), ("d", 7, None), (None, 1, 2), (None, 4, 5)]
    assert run(spark, rows, 2) == brute(rows)


def test_empty(spark):
    assert run(spark, [], 10) == (set(), set())


def test_texts(spark):
    cases = {
        '["2020-01-01 00:00:00+00","2020-01-02 00:00:00+00")': (1577836800, 1577923200), "[2020-01-01T02:00:00+02:00,2020-01-02T00:00:00Z]": (1577836800, 1577923200), '("2020-01-01 00:00:00+00", )': (1577836800, None),
        "[-infinity,2020-01-01T00:00:00Z)": (None, 1577836800), "[2020-01-01T00:00:00Z,infinity)": (1577836800, None), "[,": None, "empty": None, "since 2022": None, "(,)": None, "[2020-01-02T00:00:00Z,2020-01-01T00:00:00Z)": None, "": None, None: None,
    }
    df = spark.createDataFrame([(i, k) for i, k in enumerate(cases)], "lo int, v string").withColumnRenamed("lo", "i")
    got = {r.i: (r.lo and r.lo // 10**6, r.hi and r.hi // 10**6) for r in with_range(df, ["i"], F.col("v")).collect()}
    assert got == {i: v for i, v in enumerate(cases.values()) if v is not None}
