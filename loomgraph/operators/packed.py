"""Several values packed in one field: delimiter inference per source, split, explode with position.

1. `delimiter_profile`: one aggregation per source scores each candidate delimiter by the consistency of its piece count and by how regular the types of its
   pieces are: the share of them that are values of the source's vocabulary (reduced in each batch, so one row a source and candidate moves). The
   vocabulary is a table of known terms, or else the values that often stand alone in the source (`own_terms`).
2. `split_packed`: every value is cut by the segmentation of least cost. A delimiter costs the less, the higher it scores in the source. Where it scores below
   `WEAK`, it stands inside of values more often than between them: then a piece that is no known value keeps it, unless the cut sets a known value free or its parts are of one form. A piece
   that is a known value costs least, so a comma inside of it doesn't cut.

The scores of up to `small` sources go to the tasks with the code, those of more join the rows by their source; the rows come out the same.

Defined results: null, blank and absence words give no row; repeats stay; pieces that are empty don't take a position;
values of any length are split whole; columns of the input other than the key and the value are ignored.
"""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Iterator
from itertools import repeat

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..runtime import bounded_rows

#: Words for "no value".
ABSENT = frozenset(["", "-", "--", "?", "[]", "{}", "none", "null", "nil", "nan", "n/a", "na", "n.a.", "unknown", "tbd", "not available", "not applicable", "not known", "no value", "undefined"])

#: Candidate delimiters, as name and pattern, longer ones first.
CANDIDATES = (
    ("newline", r"\s*[\r\n]+\s*"),
    ("tab", r"[ ]*\t[ \t]*"),
    ("double_bar", r"\s*\|\|\s*"),
    ("bar", r"\s*\|\s*"),
    ("semicolon", r"\s*;\s*"),
    ("double_slash", r"\s*//\s*"),
    ("comma_and", r"\s*,\s+(?:and|&)\s+"),
    ("comma", r"\s*,\s*"),
    ("bullet", r"\s*•\s*"),
    ("dot", r"\s*·\s*"),
    ("slash", r"\s+/\s+"),
    ("dash", r"\s+[-–—]\s+"),
    ("plus", r"\s+\+\s+"),
    ("ampersand", r"\s+&\s+"),
    ("and", r"\s+and\s+"),
)
#: Delimiters that score less stand inside of values more often than between them.
WEAK = 0.2
NUMBERED = re.compile(r"(?:^|[,;|\s])\s*\d{1,3}[.)]\s+")
_QUOTED = re.compile(r'"((?:[^"\\]|\\.|"")*)"')


_COMPILED = [(n, re.compile(p)) for n, p in CANDIDATES]
_ANY = re.compile("|".join(p for _, p in CANDIDATES))


def clean_piece(piece: str) -> str:
    """Without surrounding blanks, quotes and escapes."""
    piece = piece.strip()
    if len(piece) > 1 and piece[0] == piece[-1] == '"':
        piece = piece[1:-1].replace('""', '"')
        piece = re.sub(r"\\(.)", r"\1", piece).strip()
    elif len(piece) > 1 and piece[0] == piece[-1] == "'":
        piece = piece[1:-1].strip()
    return piece


def parallel(pieces: list[str]) -> bool:
    """Whether pieces are values of one type by their form: of several words each, all with the same last word."""
    words = [p.split() for p in pieces]
    return all(len(w) > 1 for w in words) and len({w[-1].lower() for w in words}) == 1


def own_terms(df: DataFrame, source: Column, value: Column, share: float = 0.0005, least: int = 3) -> DataFrame:
    """(source, terms): values that stand alone in at least `share` of a source's rows, so at most 1 / share of them. One that holds a candidate delimiter is a term only if some piece of it never stands alone."""
    base = df.select(source.cast("string").alias("source"), F.trim(value).alias("value")).filter("value <> ''")
    counts = base.groupBy("source", "value").agg(F.count("*").alias("n"))
    totals = counts.groupBy(F.col("source").alias("_source")).agg(F.sum("n").alias("of"))
    often = counts.join(totals, F.col("source").eqNullSafe(F.col("_source"))).filter(F.col("n") >= F.greatest(F.lit(least), share * F.col("of")))
    lists = often.groupBy("source").agg(F.collect_list("value").alias("terms"))

    @F.pandas_udf("array<string>")
    def settled(v: pd.Series) -> pd.Series:
        out = []
        for terms in v:
            whole = [clean_piece(t) for t in terms]
            plain = {t for t in whole if not _ANY.search(t)}
            out.append(sorted(plain | {t for t in whole if _ANY.search(t) and not all(clean_piece(x) in plain for x in _ANY.split(t) if x.strip())}))
        return pd.Series(out)

    return lists.select("source", settled("terms").alias("terms"))


def delimiter_profile(df: DataFrame, source: Column, value: Column, known: frozenset[str] = frozenset(), own: DataFrame | None = None) -> DataFrame:
    """One row per source and candidate delimiter: rows that hold it, consistency of piece counts, regularity, score. known: vocabulary of all sources; own: result of own_terms.

    Every batch is reduced to at most one row a source and candidate before anything moves.
    """

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo: dict[tuple, list] = {}
        own_of: dict = {}
        for b in batches:
            sums: dict[tuple, list[int]] = {}
            for s, v, terms in zip(b["source"], b["value"], b["terms"] if "terms" in b else repeat(None)):
                got = memo.get((s, v))
                if got is None:
                    if s not in own_of:
                        own_of[s] = known if terms is None else known | set(terms)
                    if len(memo) > 50_000:
                        memo.clear()
                    got = []
                    for name, pattern in _COMPILED:
                        if pattern.search(v):
                            pieces = [clean_piece(x) for x in pattern.split(v) if x.strip()]
                            got.append((name, len(pieces), sum(x in own_of[s] for x in pieces)))
                    memo[s, v] = got
                for name, n, regular in got:
                    t = sums.setdefault((s, name), [0, 0, 0, 0])
                    t[0] += 1
                    t[1] += n
                    t[2] += n * n
                    t[3] += regular
            yield pd.DataFrame([(*k, *t) for k, t in sums.items()], columns=["source", "delimiter", "n", "pieces", "squares", "regular"])

    base = df.select(source.cast("string").alias("source"), value.alias("value")).filter(F.trim("value") != "")
    base = base if own is None else _by_source(base, "source", own, "terms")
    sums = base.mapInPandas(partial, "source string, delimiter string, n long, pieces long, squares long, regular long").groupBy("source", "delimiter").sum()
    n, pieces, squares, regular = (F.col(f"sum({c})").cast("double") for c in ("n", "pieces", "squares", "regular"))
    mean = pieces / n
    spread = F.sqrt(F.greatest(F.lit(0.0), squares / n - mean * mean))
    consistency = F.when(pieces > 0, 1.0 / (1.0 + spread / mean)).otherwise(0.0)
    regularity = F.when(pieces > 0, regular / pieces).otherwise(0.0)
    return sums.select("source", "delimiter", F.col("sum(n)").alias("n_rows"), consistency.alias("consistency"), regularity.alias("regularity"), (consistency * regularity).alias("score"))


def _by_source(rows: DataFrame, source: str, settings: DataFrame, column: str) -> DataFrame:
    """Rows with their source's setting; a null source is one, too."""
    s = settings.select(F.col("source").alias("_source"), column)
    return rows.join(s, F.col(source).eqNullSafe(F.col("_source")), "left").drop("_source")


class Splitter:
    """Cuts one packed text; `scores` maps a candidate's name to its score in the source (absent: not used)."""

    def __init__(self, terms: frozenset[str], scores: dict[str, float], weak: float = WEAK):
        self.terms = terms
        used = [(n, p) for n, p in CANDIDATES if n in scores]
        self.cost = {n: 0.3 * (1.0 - min(1.0, scores[n])) for n, _ in used}
        self.weak = frozenset(n for n, _ in used if scores[n] < weak)
        self.any = re.compile("|".join(f"(?P<{n}>{p})" for n, p in used)) if used else None
        # a known value spans no more delimiters than the one that holds most
        self.span = 1 + max((sum(1 for _ in self.any.finditer(t)) for t in terms), default=0) if used else 1
        self.memo: dict[str, list[str]] = {}

    def __call__(self, text: str | None) -> list[str]:
        if text is None:
            return []
        got = self.memo.get(text)
        if got is None:
            if len(self.memo) > 50_000:
                self.memo.clear()
            got = self.memo[text] = [v for v in self._split(text.strip()) if v.lower() not in ABSENT]
        return got

    def _split(self, s: str) -> list[str]:
        if s.lower() in ABSENT:
            return []
        if s in self.terms:
            return [s]
        if s[0] == "[" and s[-1] == "]":
            for read in (json.loads, ast.literal_eval):
                try:
                    items = read(s)
                except (ValueError, SyntaxError, RecursionError, MemoryError):
                    continue
                if isinstance(items, list):
                    return [str(x).strip() for x in items if x is not None and str(x).strip()]
            s = s[1:-1].strip()
        elif s[0] == "{" and s[-1] == "}":
            return self._braces(s[1:-1])
        if s and NUMBERED.match(s):
            return [p for p in (clean_piece(x.strip().strip(",;|").strip()) for x in NUMBERED.split(s)) if p]
        return self._segment(s)

    def _braces(self, s: str) -> list[str]:
        out, i = [], 0
        while i < len(s):
            m = _QUOTED.match(s, i)
            if m and (m.end() == len(s) or s[m.end() :].lstrip()[:1] in (",", "")):
                out.append(re.sub(r"\\(.)", r"\1", m[1]).strip())
                i = s.find(",", m.end())
            else:
                j = s.find(",", i)
                piece = s[i : j if j >= 0 else len(s)].strip()
                out.append("" if piece.upper() == "NULL" else piece)
                i = j
            if i < 0:
                break
            i += 1
            while i < len(s) and s[i] == " ":
                i += 1
        return [x for x in out if x]

    def _segment(self, s: str) -> list[str]:
        """Least-cost segmentation at delimiter positions; a quoted piece is one piece."""
        if not s or self.any is None:
            return [clean_piece(s)] if s else []
        cuts, i = [(0, 0, "")], 0  # (end of the piece before, start of the piece after, delimiter)
        while i < len(s):
            if s[i] == '"' and cuts[-1][1] == i and (q := _QUOTED.match(s, i)):
                rest = self.any.match(s, q.end())
                if rest or q.end() == len(s):
                    i = q.end()
                    continue
            m = self.any.match(s, i)
            if m and m.end() > i:
                cuts.append((i, m.end(), m.lastgroup))
                i = m.end()
            else:
                i += 1
        cuts.append((len(s), len(s), ""))
        n = len(cuts)
        best: list[tuple[float, int]] = [(0.0, -1)] + [(float("inf"), -1)] * (n - 1)
        for j in range(1, n):
            only_weak = True  # whether all delimiters inside of the piece are weak
            for k in range(j - 1, -1, -1):
                if j - k > 1 and cuts[k + 1][2] not in self.weak:
                    only_weak = False
                if j - k > self.span and not only_weak:
                    break
                clean = clean_piece(s[cuts[k][1] : cuts[j][0]])
                if not clean:
                    c = 0.0
                elif clean in self.terms:
                    c = 0.1
                elif only_weak and not (j - k > 1 and parallel([s[cuts[x][1] : cuts[x + 1][0]] for x in range(k, j)])):
                    c = 1.0 + 0.5 * (j - k - 1)
                else:
                    continue
                c += best[k][0] + self.cost.get(cuts[j][2], 0.0)
                if c < best[j][0]:
                    best[j] = (c, k)
        out, j = [], n - 1
        while j > 0:
            k = best[j][1]
            out.append(clean_piece(s[cuts[k][1] : cuts[j][0]]))
            j = k
        return [p for p in reversed(out) if p]


def split_packed(df: DataFrame, key: str, value: str, source: Column, terms: DataFrame | None = None, max_terms: int = 1_000_000, small: int = 10_000) -> DataFrame:
    """`key`, pos (from 1) and value of every single value in `value`.

    terms: one column of known single values, at most `max_terms` (checked, since they are sent to every task); without it each source's own terms are used.
    """
    known = frozenset(r[0] for r in bounded_rows(terms, max_terms, "the table of known terms") if r[0]) if terms is not None else frozenset()
    base = df.select(F.col(key).alias("k"), source.cast("string").alias("s"), F.col(value).alias("v")).filter(F.trim("v") != "")
    own = own_terms(base, F.col("s"), F.col("v")) if terms is None else None
    profile = delimiter_profile(base, F.col("s"), F.col("v"), known, own)
    scores = profile.groupBy("source").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("delimiter", "score")))).alias("scores"))
    few = scores.take(small + 1) if own is None else None
    local = {r[0]: r[1] for r in few} if few is not None and len(few) <= small else None

    def split(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        splitters: dict = {}
        for names, values, *rest in batches:
            found, vocabulary = rest if rest else (None, None)
            out = []
            for i, (a, b) in enumerate(zip(names, values)):
                a = None if pd.isna(a) else a
                if a not in splitters:
                    c = local.get(a) if local is not None else found[i]
                    t = None if vocabulary is None else vocabulary[i]
                    splitters[a] = Splitter(known if t is None else known | set(t), json.loads(c) if isinstance(c, str) else {})
                out.append(splitters[a](None if pd.isna(b) else b))
            yield pd.Series(out)

    if local is not None:

        @F.pandas_udf("array<string>")
        def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            yield from split(batches)

        got = base.select("k", cut("s", "v").alias("values"))
    else:

        @F.pandas_udf("array<string>")
        def cut_joined(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            yield from split(batches)

        rows = _by_source(base, "s", scores, "scores")
        rows = rows.withColumn("terms", F.lit(None).cast("array<string>")) if own is None else _by_source(rows, "s", own, "terms")
        got = rows.select("k", cut_joined("s", "v", "scores", "terms").alias("values"))
    return got.select(F.col("k").alias(key), F.posexplode("values").alias("pos", "value")).select(key, (F.col("pos") + 1).cast("int").alias("pos"), "value")
