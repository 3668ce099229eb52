from pyspark.sql import functions as F

from loomgraph.operators.packed import CANDIDATES, Splitter, delimiter_profile, split_packed

TERMS = frozenset(["Surgery, Hand", "Coffee & Tea", "Bed and Breakfast", "Tea", "Coffee", 'The "Slow" Bar', "Soup/Salad", "Deli", "Bakery, Vegan"])
SPLIT = Splitter(TERMS, {n: 1.0 for n, _ in CANDIDATES})


def test_notations():
    cases = {
        "Tea": ["Tea"],
        "Surgery, Hand": ["Surgery, Hand"],
        "Surgery, Hand, Tea": ["Surgery, Hand", "Tea"],
        "Tea,Coffee": ["Tea", "Coffee"],
        "Tea | Soup/Salad": ["Tea", "Soup/Salad"],
        "Tea || Deli||": ["Tea", "Deli"],
        "Coffee & Tea": ["Coffee & Tea"],
        "Deli & Tea": ["Deli", "Tea"],
        "Tea, Deli, and Bed and Breakfast": ["Tea", "Deli", "Bed and Breakfast"],
        '["Tea", "The \\"Slow\\" Bar"]': ["Tea", 'The "Slow" Bar'],
        "['Tea', 'Deli']": ["Tea", "Deli"],
        '{Tea,"Bakery, Vegan"}': ["Tea", "Bakery, Vegan"],
        '"The ""Slow"" Bar"; Tea': ['The "Slow" Bar', "Tea"],
        'Tea; "Unknown, Thing"': ["Tea", "Unknown, Thing"],
        "1) Tea; 2) Bakery, Vegan": ["Tea", "Bakery, Vegan"],
        "Tea\r\nDeli": ["Tea", "Deli"],
        "Tea • Deli": ["Tea", "Deli"],
        " Tea ;;Deli; ": ["Tea", "Deli"],
        "Tea, Tea": ["Tea", "Tea"],
        "Grove Corner / Tea": ["Grove Corner", "Tea"],
    }
    assert {k: SPLIT(k) for k in cases} == cases


def test_absent():
    for v in (None, "", "  ", "-", "N/A", "none", "unknown", "[]", "null"):
        assert SPLIT(v) == []


def test_long_text():
    assert len(SPLIT("; ".join(["Bakery, Vegan"] * 5000))) == 5000


def test_rows(spark):
    df = spark.createDataFrame([(1, "s", "Tea; Deli", 9), (2, "s", None, 9), (3, None, "Coffee|Tea", 9), (4, "s", "n/a", 9), (1, "s", "Tea; Deli", 9)], "id long, src string, packed string, pos int")
    terms = spark.createDataFrame([("Tea",), ("Deli",), ("Coffee",)], "term string")
    got = sorted(map(tuple, split_packed(df, "id", "packed", F.col("src"), terms).collect()))
    assert got == sorted([(1, 1, "Tea"), (1, 2, "Deli"), (1, 1, "Tea"), (1, 2, "Deli"), (3, 1, "Coffee"), (3, 2, "Tea")])
    assert split_packed(df.limit(0), "id", "packed", F.col("src"), terms).count() == 0


def test_profile(spark):
    df = spark.createDataFrame([("a", "Tea; Deli"), ("a", "Tea; Deli"), ("b", "x"), ("a", "Tea; x|y")], "s string, v string")
    p = {(r["source"], r["delimiter"]): r for r in delimiter_profile(df, F.col("s"), F.col("v"), frozenset(["Tea", "Deli"])).collect()}
    assert p["a", "semicolon"]["n_rows"] == 3 and p["a", "bar"]["score"] < p["a", "semicolon"]["score"]
    assert ("b", "semicolon") not in p


def test_scores_decide():
    """A delimiter that scores low in a source stays inside of unknown values; with all scores alike it is cut."""
    inferred, blind = Splitter(TERMS, {"semicolon": 0.8, "ampersand": 0.05, "and": 0.4}), Splitter(TERMS, {"semicolon": 1.0, "ampersand": 1.0, "and": 1.0})
    assert inferred("Nuts & Bolts; Tea") == ["Nuts & Bolts", "Tea"] and blind("Nuts & Bolts; Tea") == ["Nuts", "Bolts", "Tea"]
    assert inferred("Nuts and Bolts; Tea") == ["Nuts", "Bolts", "Tea"]
    assert inferred("Nuts & Tea; Deli") == ["Nuts", "Tea", "Deli"]  # the cut sets a known value free
    assert inferred("North Corner & South Corner; Deli") == ["North Corner", "South Corner", "Deli"]  # parts of one form


def test_inference_without_terms(spark):
    """Sources use different delimiters and hold one another's inside of their values: the scores tell which is which."""
    a = ["Tea", "Deli", "Soup", "Cake", "Bed and Breakfast", "Nuts & Bolts"]
    rows = [("a", v) for v in a * 4] + [("a", "; ".join(x)) for x in zip(a * 3, a[1:] * 3)] + [("b", v.replace("and", "&")) for v in a * 4 if v != "Nuts & Bolts"] + [("b", f"{x} and {y}") for x, y in zip(a[:3] * 3, a[1:4] * 3)]
    rows = [(i, *r) for i, r in enumerate(rows)] + [(900, "a", "Bed and Breakfast; Tea"), (901, "b", "Tea and Soup"), (902, "a", "Rock and Roll; Tea")]
    df = spark.createDataFrame(rows, "id long, s string, v string")
    got = {}
    for r in split_packed(df, "id", "v", F.col("s")).orderBy("id", "pos").collect():
        got.setdefault(r.id, []).append(r.value)
    assert got[900] == ["Bed and Breakfast", "Tea"] and got[901] == ["Tea", "Soup"] and got[902] == ["Rock and Roll", "Tea"]
    assert all(got[i] == [v] for i, _, v in rows[:24])


def test_many_sources(spark):
    """Scores meet their rows by a join, so there may be more sources than fit a broadcast table of old."""
    df = spark.range(30_000).selectExpr("id", "'s' || id AS src", "'Tea; Deli' AS packed")
    terms = spark.createDataFrame([("Tea",), ("Deli",)], "term string")
    assert split_packed(df, "id", "packed", F.col("src"), terms).count() == 60_000
    rows = lambda small: sorted(map(tuple, split_packed(df.limit(300), "id", "packed", F.col("src"), terms, small=small).collect()))
    assert rows(10_000) == rows(5)


def test_a_term_with_many_delimiters():
    long = "A, B, C, D, E, F, G, H & I"
    assert Splitter(frozenset([long, "Tea"]), {n: 1.0 for n, _ in CANDIDATES})(f"{long}, Tea") == [long, "Tea"]
