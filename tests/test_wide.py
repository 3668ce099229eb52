import datetime as dt

from pyspark.sql import functions as F

from loomgraph.functions import typed_text as t
from loomgraph.operators.wide import cells_of, widen

SCHEMA = "id string, attributes array<struct<name string, value string, datatype string>>, at timestamp, name string"
DECLARED = [("rating", "float"), ("seat_count", "integer"), ("open", "boolean"), ("opened_on", "datetime"), ("location", "geo"), ("website", "uri"), ("name", "string"), ("id", "string")]


def day(n):
    return dt.datetime(2024, 1, n)


def frame(spark, rows):
    return spark.createDataFrame([(i, [(n, v, None) for n, v in a] if a is not None else None, d, "clash") for i, a, d in rows], SCHEMA)


def cells(spark, rows):
    declarations = spark.createDataFrame(DECLARED, "name string, datatype string")
    wide = widen(frame(spark, rows), "id", "attributes", "at", declarations)
    return wide, {(r[0], r["name"]): r["value"] for r in cells_of(wide, "id", DECLARED).collect()}


def test_latest_readable_value(spark):
    wide, got = cells(spark, [
        ("a", [("Rating", "4,5"), ("Seat Count", "1,234"), ("OPEN", "Yes"), ("opened-on", "03/04/2020"), ("location", "10.5,-20.25"), ("website", " https://x "), ("name", " N ")], day(1)),
        ("a", [("rating", "see notes"), ("seatCount", "65.0"), ("open", "N/A"), ("opened_on", "2021-02-03T04:05:06Z"), ("website", "ftp://x")], day(2)),
        ("b", [("rating", "four")], day(1)), (None, [("rating", "1")], day(1)), ("c", [], day(1)), ("d", None, day(1)),
    ])
    assert got == {("a", "rating"): "4.50", ("a", "seat_count"): "65", ("a", "open"): "true", ("a", "opened_on"): "2021-02-03 04:05:06", ("a", "location"): "POINT(-20.25 10.5)", ("a", "website"): "https://x", ("a", "name"): "N"}
    rows = {r["id"]: r for r in wide.collect()}
    assert set(rows) == {"a", "b", "c", "d"} and rows["b"]["cast_failures"] == {"rating": "four"} and rows["a"]["cast_failures"] == {"rating": "see notes", "website": "ftp://x"}
    assert "_id" in wide.columns  # a declared name that clashes with the key


def test_empty(spark):
    wide, got = cells(spark, [])
    assert wide.count() == 0 and got == {}


def test_texts(spark):
    rows = [("+012", "12", "12.0"), ("-5", "-5", "-5.0"), ("-0", "0", "-0.0"), ("1.5", None, "1.5"), ("1e3", None, "1000.0"), ("abc", None, None), ("12,34", None, "12.34"), ("9" * 30, "9" * 30, "1.0E30")]
    df = spark.createDataFrame([(a,) for a, _, _ in rows], "v string")
    got = df.select("v", t.integer_text(F.col("v")).alias("i"), t.float_text(F.col("v")).alias("f")).collect()
    assert [(r.v, r.i, r.f) for r in got] == rows
