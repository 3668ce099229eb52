"""Runs queries beside their SQL: python tests/compare.py SF_DIR [NAME...]."""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


def session():
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def plain(v):
    """A value in a form in which both engines agree."""
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, bool):
        return v
    if type(v).__name__ == "Decimal":
        return float(f"{float(v):.9g}")
    if isinstance(v, int):
        return v
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if hasattr(v, "tzinfo"):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(plain(r[i]) for i in order) for r in rows)


def duck(root):
    import duckdb

    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for p in sorted(Path(root).glob("*.parquet")):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return con


def compare(spark, con, root, name, query, sql):
    """Empty if both agree, else what differs; and the seconds that Spark took."""
    began = time.time()
    df = query(spark, root)
    got = df.collect()
    took = time.time() - began
    if sql is None:
        return "", took, len(got)
    rel = con.sql(sql)
    a, b = rows_of(df.columns, got), rows_of(rel.columns, rel.fetchall())
    if a[0] != b[0]:
        return f"columns {a[0]} and {b[0]}", took, len(got)
    if a[1] != b[1]:
        return f"{sum((a[1] - b[1]).values())} rows only in Spark {list((a[1] - b[1]))[:3]}, {sum((b[1] - a[1]).values())} only in SQL {list((b[1] - a[1]))[:3]}", took, len(got)
    return "", took, len(got)


if __name__ == "__main__":
    import __spark_entry__ as entry

    root, names = sys.argv[1], sys.argv[2:]
    spark, con, bad = session(), duck(root), 0
    for name, query in entry.queries().items():
        if names and not any(name == n or (n.endswith("*") and name.startswith(n[:-1])) for n in names):
            continue
        try:
            why, took, n = compare(spark, con, root, name, query, entry.oracle_sql().get(name))
        except Exception as e:  # noqa: BLE001
            why, took, n = f"{type(e).__name__}: {str(e)[:600]}", 0, 0
        bad += bool(why)
        print(f"{name}: {'FAIL ' + why if why else 'ok' if name in entry.oracle_sql() else 'ran'} ({n} rows, {took:.1f} s)", flush=True)
    print("failed:", bad)
    os._exit(bool(bad))
