"""Filling fixed-capacity containers: documents into contexts of a given length in tokens.

Texts are tokenised once, where they lie. The histogram of lengths (at most `classes` rows, whatever the number of items) goes to the driver. Dynamic
programming over it chooses the bounds of a given number of length buckets that leave the least room unused when token-budget batches form inside each
bucket; no context mixes buckets. Batches are formed on the histogram, too: the longest length left, filled up with the longest that still fit, as often as
the counts allow. So the plan is a list of patterns (so many items of each length a context) with how often each is used, and no longer than the
number of lengths.

Items take their places in the plan by rank in their length. Ranks need no sort of a whole length: one with many items is spread over as many
parts as its count demands, parts get offsets from their counts, and items are numbered inside a part. So a length with a third of all items is no hot spot.

Defined results: null, empty and tokenless texts take no room and have no row; only texts longer than the capacity are cut, into full
pieces and a rest; a null or non-positive capacity is an error; equal texts are items of their own.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..runtime import materialize

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How a byte-level tokenizer of rank files cuts a text before it merges bytes.
PRETOKENS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


def token_counter(tokenizer: str):
    """A function from a list of texts to their token counts; rank files (.tiktoken) and tokenizer files (.json) of the same vocabulary agree."""
    if tokenizer.endswith(".tiktoken"):
        import base64

        import tiktoken

        with open(tokenizer, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        own = tiktoken.Encoding("own", pat_str=PRETOKENS, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [len(own.encode_ordinary(t)) for t in texts]
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer)
    t.encode_special_tokens = True
    return lambda texts: [len(e.ids) for e in t.encode_batch_fast(texts, add_special_tokens=False)]


def count_tokens(documents: DataFrame, id_col: str, text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """(id, n_tokens) of texts with at least one token. tokenizer: path of a tokenizer file, readable on every worker."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sizes_of = token_counter(tokenizer)
        for b in batches:
            ids, sizes = [], []
            known = [(i, x) for i, x in zip(b["d"], b["t"]) if isinstance(x, str) and x]
            for k in range(0, len(known), 256):
                part = known[k : k + 256]
                ids += [i for i, _ in part]
                sizes += sizes_of([x for _, x in part])
            yield pd.DataFrame({"id": np.array(ids, np.int64), "n_tokens": np.array(sizes, np.int64)})

    return documents.selectExpr(f"`{id_col}` AS d", f"`{text}` AS t").mapInPandas(count, "id long, n_tokens long").filter("n_tokens > 0")


def patterns(sizes: list[int], counts: list[int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(times used, {index of a size: items a context}) that take up all items: the largest size left, filled up with the largest that fit. sizes ascend."""
    left, out = list(counts), []
    active = [k for k, c in enumerate(left) if c]
    widths = [sizes[k] for k in active]
    while active:
        room, use, at = capacity, {}, len(active)
        while at := bisect_right(widths, room, 0, at):
            k = active[at - 1]
            n = min(left[k], room // sizes[k])
            use[k] = n
            room -= n * sizes[k]
            at -= 1
        times = min(left[k] // n for k, n in use.items())
        out.append((times, use))
        for k, n in use.items():
            left[k] -= times * n
        if any(not left[k] for k in use):
            active = [k for k in active if left[k]]
            widths = [sizes[k] for k in active]
    return out


def unused_room(sizes: list[int], counts: list[int], capacity: int) -> int:
    """Tokens of room that batches of these items leave unused."""
    return sum(times for times, _ in patterns(sizes, counts, capacity)) * capacity - sum(s * c for s, c in zip(sizes, counts))


def best_bounds(sizes: list[int], counts: list[int], capacity: int, buckets: int) -> list[int]:
    """Indices of the largest size of each of `buckets` buckets (fewer only if there are fewer sizes) that leave the least room unused.

    best[k][j] = min over i of best[k - 1][i] + unused(i, j), where unused(i, j) is what batches of the sizes i to j - 1 leave.
    """
    m = len(sizes)
    k = min(buckets, m)
    unused = {(i, j): unused_room(sizes[i:j], counts[i:j], capacity) for i in range(m) for j in range(i + 1, m + 1)}
    best, back = {(0, 0): 0}, {}
    for b in range(1, k + 1):
        for j in range(b, m + 1):
            best[b, j], back[b, j] = min((best[b - 1, i] + unused[i, j], i) for i in range(b - 1, j) if (b - 1, i) in best)
    out, j = [], m
    for b in range(k, 0, -1):
        out.append(j - 1)
        j = back[b, j]
    return out[::-1]


def bucket_bounds(sizes: list[int], counts: list[int], capacity: int, buckets: int, candidates: int = 48) -> list[int]:
    """Upper bounds of the buckets. The dynamic program runs over at most `candidates` bounds of equal shares of tokens, between which sizes count as their mean."""
    if not sizes:
        return []
    tokens = np.cumsum([s * c for s, c in zip(sizes, counts)])
    ends = sorted({bisect_left(tokens, tokens[-1] * q / candidates) for q in range(1, candidates + 1)}) if len(sizes) > candidates else list(range(len(sizes)))
    groups = [range(a + 1, b + 1) for a, b in zip([-1, *ends[:-1]], ends)]
    totals = [sum(counts[k] for k in g) for g in groups]
    means = [-(-sum(counts[k] * sizes[k] for k in g) // n) for g, n in zip(groups, totals)]
    return [sizes[ends[j]] for j in best_bounds(means, totals, capacity, buckets)]


def plan_contexts(sizes: list[int], counts: list[int], bounds: list[int], capacity: int) -> dict[int, list[tuple[int, int, int, int]]]:
    """For each size: (first rank, first context, items a context, first slot) of each stretch of the plan. Buckets are planned apart."""
    stretches: dict[int, list[tuple[int, int, int, int]]] = {s: [] for s in sizes}
    taken, context, low = dict.fromkeys(sizes, 0), 0, 0
    for bound in bounds:
        high = bisect_right(sizes, bound)
        for times, use in patterns(sizes[low:high], counts[low:high], capacity):
            slot = 0
            for k, n in sorted(use.items(), reverse=True):
                s = sizes[low + k]
                stretches[s].append((taken[s], context, n, slot))
                taken[s] += times * n
                slot += n
            context += times
        low = high
    return stretches


def pack(documents: DataFrame, id_col: str, text: str, capacity: int, tokenizer: str = TOKENIZER, buckets: int = 8, classes: int = 4_096, part_items: int = 200_000) -> DataFrame:
    """(context_id, slot, bucket, id_col, piece, token_from, token_to, n_tokens): every token of every text once, at most `capacity` tokens a context, one bucket a context.

    Where the capacity exceeds `classes`, lengths count as the next multiple of capacity / classes.
    """
    if capacity is None or capacity < 1:
        raise ValueError("the capacity must be a positive number of tokens")
    step = -(-capacity // classes)
    sizes = count_tokens(documents, id_col, text, tokenizer)
    pieces = sizes.select("id", "n_tokens", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_tokens") - 1) / capacity).cast("long"))).alias("piece"))
    n = F.least(F.lit(capacity).cast("long"), F.col("n_tokens") - F.col("piece") * capacity)
    items = materialize(pieces.select("id", "piece", n.alias("n"), F.least(F.lit(capacity).cast("long"), F.ceil(n / step) * step).cast("int").alias("size")), "items")
    histogram = sorted((r[0], r[1]) for r in items.groupBy("size").count().collect())  # at most `classes` rows
    widths, counts = [s for s, _ in histogram], [c for _, c in histogram]
    bounds = bucket_bounds(widths, counts, capacity, buckets)
    table = {s: [np.array(c, np.int64) for c in zip(*rows)] for s, rows in plan_contexts(widths, counts, bounds, capacity).items()}
    parts = np.zeros(capacity + 1, np.int64)
    parts[widths] = [-(-c // part_items) for c in counts]

    @F.pandas_udf("int")
    def part_of(size: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series((h.to_numpy() % np.maximum(1, parts[size.to_numpy()])).astype(np.int32))

    placed = items.select("id", "piece", "n", "size", part_of("size", F.xxhash64("id", "piece")).alias("part"))
    offsets = placed.groupBy("size", "part").count()
    before = F.sum("count").over(Window.partitionBy("size").orderBy("part")) - F.col("count")
    number = F.row_number().over(Window.partitionBy("size", "part").orderBy("id", "piece")) - 1
    ranked = placed.select("*", number.alias("i")).join(offsets.select("size", "part", before.alias("before")), ["size", "part"]).select("id", "piece", "n", "size", (F.col("before") + F.col("i")).alias("rank"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            contexts, slots = np.zeros(len(x), np.int64), np.zeros(len(x), np.int32)
            size, rank = x["size"].to_numpy(), x["rank"].to_numpy()
            for s in np.unique(size):
                first, start, each, slot = table[int(s)]
                own = size == s
                j = np.searchsorted(first, rank[own], "right") - 1
                offset = rank[own] - first[j]
                contexts[own] = start[j] + offset // each[j]
                slots[own] = slot[j] + offset % each[j]
            yield pd.DataFrame({"context_id": contexts, "slot": slots, "bucket": np.searchsorted(bounds, size).astype(np.int32), "id": x["id"], "piece": x["piece"].astype(np.int32), "token_from": x["piece"] * capacity, "token_to": x["piece"] * capacity + x["n"], "n_tokens": x["n"]})

    out = ranked.mapInPandas(place, "context_id long, slot int, bucket int, id long, piece int, token_from long, token_to long, n_tokens long")
    return out.withColumnRenamed("id", id_col)
