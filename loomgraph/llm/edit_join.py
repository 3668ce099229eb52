"""Edit-distance join by segments: all pairs of a probe and a target string at most k edits apart, within blocks.

A probe string is cut into k + 1 segments of even length; k edits leave at least one of them whole, so a target within k
edits holds that segment at a position shifted by at most k. Targets emit their substrings at those positions for each probe
length from their own less k to their own plus k. Segments meet by equality (block, length, segment number, text) in a plain hash
join; what meets is verified by a banded dynamic program that stops as soon as the band exceeds k.

Strings equal within a block are one class on each side, so copies cost nothing and never form pairs of their own. A tag says what a string stands
for, if not for itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F


def within(a: str, b: str, k: int) -> int | None:
    """Levenshtein distance of a and b if it is at most k, by dynamic programming in a band of 2k + 1 diagonals."""
    if a == b:
        return 0
    n, m = len(a), len(b)
    if abs(n - m) > k:
        return None
    start = 0
    while start < min(n, m) and a[start] == b[start]:
        start += 1
    while n > start and m > start and a[n - 1] == b[m - 1]:
        n, m = n - 1, m - 1
    a, b = a[start:n], b[start:m]
    n, m = len(a), len(b)
    big = k + 1
    row = {j: j for j in range(min(m, k) + 1)}
    for i in range(1, n + 1):
        new: dict[int, int] = {}
        for j in range(max(0, i - k), min(m, i + k) + 1):
            if j == 0:
                new[j] = i
            else:
                new[j] = min(row.get(j - 1, big) + (a[i - 1] != b[j - 1]), row.get(j, big) + 1, new.get(j - 1, big) + 1)
        if min(new.values()) > k:
            return None
        row = new
    d = row.get(m, big)
    return d if d <= k else None


def cuts(length: int, k: int) -> list[tuple[int, int]]:
    """Start and length of the k + 1 segments of a string of `length`; the last ones are longer by one where it doesn't divide."""
    base, extra = divmod(length, k + 1)
    out, at = [], 0
    for i in range(k + 1):
        size = base + (i >= k + 1 - extra)
        out.append((at, size))
        at += size
    return out


def segment_join(probes: DataFrame, targets: DataFrame, k: int) -> DataFrame:
    """probes and targets: (block string, text string, tag string), distinct. Gives (block, probe, target, distance), probe and target being tags, for all pairs of texts at most k edits apart."""

    def cut_probes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(block, text, tag, len(text), i, text[s : s + n]) for block, text, tag in zip(b["block"], b["text"], b["tag"]) for i, (s, n) in enumerate(cuts(len(text), k))]
            yield pd.DataFrame(rows, columns=["block", "a", "probe", "n", "i", "piece"])

    def cut_targets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for block, text, tag in zip(b["block"], b["text"], b["tag"]):
                m = len(text)
                for n in range(max(0, m - k), m + k + 1):
                    for i, (s, size) in enumerate(cuts(n, k)):
                        # edits before the segment shift it by at most min(i, k), those after it the rest of the length difference
                        low, high = max(0, s - k, s - i, s + (m - n) - (k - i)), min(m - size, s + k, s + i, s + (m - n) + (k - i))
                        rows.extend({(block, text, tag, n, i, text[p : p + size]) for p in range(low, high + 1)})
            yield pd.DataFrame(rows, columns=["block", "b", "target", "n", "i", "piece"])

    # only blocks that stand on both sides are cut
    here, there = probes.select("block").distinct(), targets.select("block").distinct()
    probes, targets = probes.join(there, "block", "left_semi"), targets.join(here, "block", "left_semi")
    left = probes.select("block", "text", "tag").mapInPandas(cut_probes, "block string, a string, probe string, n int, i int, piece string")
    right = targets.select("block", "text", "tag").mapInPandas(cut_targets, "block string, b string, target string, n int, i int, piece string")

    @F.pandas_udf("int")
    def distance(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([within(x, y, k) for x, y in zip(a, b)], dtype="Int32")

    # the pieces outgrow what the optimizer knows of their inputs, so neither side may be broadcast
    met = left.hint("merge").join(right, ["block", "n", "i", "piece"]).select("block", "a", "b", "probe", "target").distinct()
    # not to be evaluated again for the filter
    return met.select("block", "probe", "target", distance.asNondeterministic()("a", "b").alias("distance")).filter("distance IS NOT NULL")
