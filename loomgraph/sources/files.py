"""Files in and out: mapped CSV, JSON records by dotted path, HTML reduced to text, guarded CSV export, batches by size."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import csv_safe
from ..model import EntityMap, quads_of


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Rows of CSV files with a header; all columns are text unless a schema is given (types are never guessed from the data)."""
    r = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    return r.schema(schema).csv(path) if schema else r.csv(path)


def ingest_csv(spark: SparkSession, path: str, mapping: EntityMap, graph: str = "kg") -> DataFrame:
    """Facts of mapped CSV rows. Rows without a key keep their place under a key made of their filled values; all-empty rows are dropped."""
    from ..functions.text import synthetic_key

    df = read_csv(spark, path)
    filled = F.coalesce(*[F.when(F.trim(F.col(c)) != "", F.lit(True)) for c in df.columns], F.lit(False))
    key = F.when(F.trim(F.col(mapping.key)) != "", F.col(mapping.key)).otherwise(synthetic_key(mapping.type_name, {c: F.col(c) for c in df.columns}))
    return quads_of(df.filter(filled).withColumn(mapping.key, key), mapping, graph)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header in which no cell can be taken for a formula."""
    df.select(*[csv_safe(F.col(c).cast("string")).alias(c) for c in df.columns]).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def json_records(df: DataFrame, text: str, result_path: str, fields: dict[str, str]) -> DataFrame:
    """One row per record of the array at `result_path` ($.a.b) in a JSON text, with fields by their dotted paths."""
    array = F.get_json_object(F.col(text), result_path)
    records = df.select(F.explode(F.from_json(array, "array<string>")).alias("record"))
    return records.select(*[F.get_json_object("record", p).alias(n) for n, p in fields.items()])


def byte_batches(df: DataFrame, group: list[str], order: list[str], payload: Column, limit: int = 900_000) -> DataFrame:
    """With `batch`: rows of a group in order, a new batch before the row that would take the running size beyond `limit`; a larger row is a batch of its own.

    Rows stream through in order, so a task holds one number a group. Give a coarse part of the order as a further group where one group holds a large share of the rows.
    """
    keys = [df.columns.index(g) for g in group]
    sized = df.select("*", F.octet_length(payload).cast("long").alias("_size")).repartition(*[F.col(g) for g in group]).sortWithinPartitions(*group, *order)
    size = len(df.columns)

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held, batch = object(), 0, 0
        for b in batches:
            out = []
            for row in zip(*(b.iloc[:, k] for k in keys), b.iloc[:, size]):
                key, n = tuple(None if pd.isna(x) else x for x in row[:-1]), 0 if pd.isna(row[-1]) else int(row[-1])
                if key != at:
                    at, held, batch = key, 0, 0
                elif held + n > limit:
                    held, batch = 0, batch + 1
                held += n
                out.append(batch)
            yield b.drop(columns=[b.columns[size]]).assign(batch=np.array(out, np.int32))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return sized.mapInPandas(number, f"{schema}, batch int")


class _Reducer(HTMLParser):
    """Title and readable text: blocks on lines of their own, table cells between bars, terms before their definitions."""

    HIDDEN, BLOCK = {"script", "style", "noscript", "template", "svg", "head"}, {"p", "div", "section", "article", "li", "ul", "ol", "br", "h1", "h2", "h3", "h4", "h5", "h6", "table", "header", "footer", "dl", "blockquote", "pre"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.title, self.lines, self.now, self.cells, self.hidden, self.in_title, self.term = "", [], "", None, 0, False, False

    def flush(self):
        line = " ".join(self.now.split())
        if line:
            self.lines.append(line)
        self.now = ""

    def handle_starttag(self, tag, attrs):
        if tag == "title":
            self.in_title = True
        elif tag in self.HIDDEN:
            self.hidden += 1
        elif tag == "tr":
            self.flush()
            self.cells = []
        elif tag in ("td", "th"):
            self.now = ""
        elif tag == "dt":
            self.flush()
        elif tag in self.BLOCK and self.cells is None:
            self.flush()

    def handle_endtag(self, tag):
        if tag == "title":
            self.in_title = False
        elif tag in self.HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag in ("td", "th") and self.cells is not None:
            self.cells.append(" ".join(self.now.split()))
            self.now = ""
        elif tag == "tr" and self.cells is not None:
            if any(self.cells):
                self.lines.append(" | ".join(self.cells))
            self.cells, self.now = None, ""
        elif tag == "dt":
            self.now = self.now.rstrip() + ": "
        elif tag == "dd" or (tag in self.BLOCK and self.cells is None):
            self.flush()

    def handle_data(self, data):
        if self.in_title:
            self.title += data
        elif not self.hidden:
            self.now += data


def reduce_html(html: str | None) -> tuple[str, str]:
    if not html:
        return "", ""
    r = _Reducer()
    r.feed(html)
    r.close()
    r.flush()
    return " ".join(r.title.split()), "\n".join(r.lines)


def html_text():
    """Arrow function: struct of title and text."""

    @F.pandas_udf("title string, text string")
    def reduce(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([reduce_html(x if isinstance(x, str) else None) for x in b], columns=["title", "text"])

    return reduce
