"""Evaluation texts leaking into training text.

Passages and answers of the evaluation side are folded into words; instructions, which are sentences that several items share and that open a passage, are
left out. All runs of `seed_words` words of the passages, and the answers, become one Aho-Corasick automaton, built once a Python worker. More than
`max_items` items are cut into shards by hash, each with an automaton of its own that scans all documents. Each
document is scanned once a shard; each seed found names item, passage position and document position. Where at most one word in six of twenty
differs, at least one run of five words is whole, so seeds of four miss nothing.

Seeds of one item that lie near one diagonal are verified together: a banded alignment of passage and document words around them
gives matched and differing words (only where a window of the passage holds as many seeds as it must: 5 in 20 words), and the longest stretch of the passage with at most a sixth of differing words counts if it has at
least `min_words`. Offsets of the stretch refer to the document as given. Documents are read where they lie: no shuffle at all.

Defined results: null, empty and wordless texts leak nothing; a document that holds an item twice gives one row, of the longest stretch;
texts of any length are scanned whole; an answer alone leaks nothing, but a document that leaks a passage says whether it holds the answer, too (null if the item has none).
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..runtime import materialize
from .text import sentences, words_of, words_with_offsets


def item_words(items: list[tuple[int, str]], shared_by: int = 3) -> dict[int, list[str | None]]:
    """Words of each item's passage; those of sentences that open it and that at least `shared_by` items hold are null."""
    split = {i: [words_with_offsets(s)[0] for s in sentences(text)] for i, text in items if text}
    often = Counter(x for s in split.values() for x in {tuple(w) for w in s if len(w) > 2})
    out = {}
    for i, ss in split.items():
        own = next((k for k, s in enumerate(ss) if often[tuple(s)] < shared_by), len(ss))
        out[i] = [None if k < own else w for k, s in enumerate(ss) for w in s]
    return out


def prepared_items(items: DataFrame, item_id: str, passage: str, answer: str | None, shared_by: int = 3) -> DataFrame:
    """(i, words, answer): item_words of any number of items, and the folded words of their answers; null words where instructions stand."""

    @F.pandas_udf("array<array<string>>")
    def split(b: pd.Series) -> pd.Series:
        return pd.Series([[words_with_offsets(s)[0] for s in sentences(x)] if isinstance(x, str) else [] for x in b])

    @F.pandas_udf("array<string>")
    def folded(b: pd.Series) -> pd.Series:
        return pd.Series([words_of(x) if isinstance(x, str) else [] for x in b])

    base = items.filter(F.col(item_id).isNotNull()).groupBy(F.col(item_id).alias("i")).agg(F.min(passage).alias("p"), (F.min(answer) if answer else F.lit(None).cast("string")).alias("a"))
    base = materialize(base.select("i", split("p").alias("ss"), folded("a").alias("answer")), "items")
    rows = base.select("i", F.posexplode("ss").alias("k", "w")).withColumn("key", F.when(F.size("w") > 2, F.array_join("w", " ")))
    often = rows.filter("key IS NOT NULL").select("i", "key").distinct().groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") >= shared_by).select("key", F.lit(True).alias("shared"))
    own = rows.join(often, "key", "left").groupBy("i").agg(F.min(F.when(F.col("shared").isNull(), F.col("k"))).alias("own"))
    blank = lambda w, k: F.transform(w, lambda x: F.when(k >= F.coalesce("own", F.size("ss")), x))
    return base.join(own, "i", "left").select("i", F.flatten(F.transform("ss", blank)).alias("words"), "answer")


def align(passage: list, words: list[str], diagonal_low: int, diagonal_high: int, band: int) -> list[tuple[int, int]]:
    """Matched (passage index, word index) of a cheapest alignment within the diagonals, widened by `band`."""
    low, high = diagonal_low - band, diagonal_high + band
    width = high - low + 1
    n, big = len(passage), 10**9
    # cost[i][d]: passage[:i] aligned, ending before word i + low + d; free start and end in the document
    previous = [0] * width
    moves = []
    for i in range(n):
        current, how = [big] * width, [0] * width
        p = passage[i]
        for d in range(width):
            j = i + low + d
            c = previous[d] + (0 if 0 <= j < len(words) and p is not None and words[j] == p else 1)
            m = 0
            if d + 1 < width and previous[d + 1] + 1 < c:  # the passage's word is missing in the document
                c, m = previous[d + 1] + 1, 1
            if d > 0 and current[d - 1] + 1 < c:  # an extra word in the document
                c, m = current[d - 1] + 1, 2
            current[d], how[d] = c, m
        moves.append(how)
        previous = current
    d, i, out = min(range(width), key=previous.__getitem__), n - 1, []
    while i >= 0:
        m = moves[i][d]
        if m == 2:
            d -= 1
            continue
        j = i + low + d
        if m == 0:
            if 0 <= j < len(words) and passage[i] is not None and words[j] == passage[i]:
                out.append((i, j))
            i -= 1
        else:
            d += 1
            i -= 1
    return out[::-1]


def longest_stretch(passage: list, matched: list[tuple[int, int]], min_words: int, share: float) -> tuple[int, int] | None:
    """First and last index into `matched` of the longest stretch of the passage of at least `min_words` words with at most `share` of differing ones.

    A differing word is a word of the passage that is missing or replaced, or an extra word of the document beyond those replaced; words of
    shared sentences end a stretch.
    """
    best = None
    for a in range(len(matched)):
        errors = 0
        for b in range(a, len(matched)):
            if b > a:
                gap_p, gap_w = matched[b][0] - matched[b - 1][0] - 1, matched[b][1] - matched[b - 1][1] - 1
                if gap_p and any(passage[x] is None for x in range(matched[b - 1][0] + 1, matched[b][0])):
                    break
                errors += max(gap_p, gap_w)
            n = matched[b][0] - matched[a][0] + 1
            # words at the ends that differ may belong to the stretch: up to the share, where the passage goes on
            room = 0
            if n < min_words:
                left, right = matched[a][0], matched[b][0]
                while n + room < min_words and errors + room + 1 <= share * (n + room + 1):
                    if right + 1 < len(passage) and passage[right + 1] is not None:
                        right += 1
                    elif left > 0 and passage[left - 1] is not None:
                        left -= 1
                    else:
                        break
                    room += 1
            if n + room >= min_words and errors + room <= share * (n + room) and (best is None or n > best[0]):
                best = (n, a, b)
    return None if best is None else best[1:]


class Scanner:
    def __init__(self, passages: dict[int, list[str | None]], seed_words: int, min_words: int, share: float, answers: dict[int, list[str]] | None = None):
        import ahocorasick

        self.passages, self.seed, self.min_words, self.share, self.answers = passages, seed_words, min_words, share, answers or {}
        answered: dict[str, list[int]] = defaultdict(list)
        for item, words in self.answers.items():
            if words:
                answered[" " + " ".join(words) + " "].append(item)
        places: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for item, words in passages.items():
            for i in range(len(words) - seed_words + 1):
                run = words[i : i + seed_words]
                if None not in run:
                    places[" " + " ".join(run) + " "].append((item, i))
        self.automaton = ahocorasick.Automaton()
        for text in {*places, *answered}:
            self.automaton.add_word(text, (len(text), places.get(text, ()), answered.get(text, ())))
        self.empty = not places
        if places:
            self.automaton.make_automaton()

    def dense(self, at: list[int]) -> bool:
        """Whether some `min_words` words of the passage hold as many seeds as a stretch with the most differing words must."""
        errors = int(self.min_words * self.share)
        least = max(1, self.min_words - errors - (errors + 1) * (self.seed - 1))
        at = sorted(set(at))
        span = self.min_words - self.seed
        return any(at[k + least - 1] - at[k] <= span for k in range(len(at) - least + 1))

    def scan(self, text: str | None) -> list[tuple[int, int, int, int, bool | None]]:
        """(item, words, start, end, whether the answer stands in the text, too) of each item that leaks into the text."""
        if self.empty or not text:
            return []
        words = words_of(text)
        if len(words) < self.seed:
            return []
        line = " " + " ".join(words) + " "
        seeds: dict[int, list[tuple[int, int]]] = defaultdict(list)
        position: dict[int, int] | None = None
        said: set[int] = set()
        for end, (length, where, answered) in self.automaton.iter(line):
            said.update(answered)
            if not where:
                continue
            if position is None:
                position, at = {}, 0
                for k, w in enumerate(words):
                    position[at] = k
                    at += len(w) + 1
            j = position[end - length + 1]
            for item, i in where:
                seeds[item].append((j - i, j))
        out: list[tuple[int, int, int, int, bool | None]] = []
        starts: list[int] | None = None
        for item, found in seeds.items():
            passage = self.passages[item]
            best = None
            found.sort()
            slack = max(3, len(passage) // 6)
            group = [found[0][0], found[0][0], []]
            groups = [group]
            for d, j in found:
                if d - group[1] <= slack and d - group[0] <= 3 * slack:
                    group[1] = d
                else:
                    group = [d, d, []]
                    groups.append(group)
                group[2].append(j - d)
            for low, high, at in groups:
                if not self.dense(at):
                    continue
                matched = align(passage, words, low, high, 4)
                stretch = longest_stretch(passage, matched, self.min_words, self.share)
                if stretch:
                    a, b = matched[stretch[0]], matched[stretch[1]]
                    if best is None or b[0] - a[0] + 1 > best[0]:
                        best = (b[0] - a[0] + 1, a[1], b[1])
            if best:
                if starts is None:  # offsets are worked out for the few texts that leak
                    _, starts, ends = words_with_offsets(text)
                out.append((item, best[0], starts[best[1]], ends[best[2]], item in said if self.answers.get(item) else None))
        return out


def leaks(documents: DataFrame, id_col: str, text: str, items: DataFrame, item_id: str, passage: str, answer: str | None = None, seed_words: int = 4, min_words: int = 20, share: float = 1 / 6, max_items: int = 100_000) -> DataFrame:
    """(id_col, item_id, n_words, start, end, with_answer): documents that hold at least `min_words` consecutive words of an item's passage."""
    ready = prepared_items(items, item_id, passage, answer)
    shards = max(1, -(-ready.count() // max_items))
    base = documents.selectExpr(f"`{id_col}` AS d", f"`{text}` AS t")
    out = None
    for k in range(shards):
        rows = ready.filter(F.pmod(F.xxhash64("i"), F.lit(shards)) == k).collect()
        shared = items.sparkSession.sparkContext.broadcast(({r[0]: list(r[1]) for r in rows}, {r[0]: list(r[2]) for r in rows}))

        def scan(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            passages, answers = shared.value
            scanner = Scanner(passages, seed_words, min_words, share, answers)
            for b in batches:
                found = [(d, *x) for d, t in zip(b["d"], b["t"]) if isinstance(t, str) for x in scanner.scan(t)]
                yield pd.DataFrame(found, columns=["d", "i", "n", "s", "e", "a"]).astype({"a": "boolean"})

        part = base.mapInPandas(scan, "d long, i long, n int, s int, e int, a boolean")
        out = part if out is None else out.unionByName(part)
    return out.selectExpr(f"d AS `{id_col}`", f"i AS `{item_id}`", "n AS n_words", "s AS start", "e AS end", "a AS with_answer")
