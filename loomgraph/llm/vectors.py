"""Most similar vectors for every vector: shifted space-filling curves.

Each of several orderings projects the unit vectors on a few random directions, shifts the grid at random and takes the
Hilbert index of the cell. Rows of one ordering (of one group of comparable vectors) are cut into ranges of the index; the
ranges' bounds are quantiles of a bounded sample, while every row is indexed. In a range, rows in order of the index are
compared with those at most a window away by one matrix product per block. Ranges overlap by a fine quantile, so that windows
don't end at a bound. Candidates of all orderings merge, and a rerank with the exact vectors gives cosines and ranks.

What moves per ordering is one byte a dimension: vectors are quantised for the search only; the rerank reads the
full ones. Equal keys beyond a range's share (a group of copies) are spread over several ranges by id, each of which holds
more copies than the k that are asked for.

Defined results: vectors that are null, of another length, with null or non-finite values or all zero take no part; lengths don't matter;
ties are broken by id; repeated rows are vectors of their own; an empty table gives no rows. Bounds: `sample_rows` vectors on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..runtime import materialize


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert indices (uint64) of points whose coordinates are integers of `bits` bits, one column a dimension."""
    x = cells.astype(np.uint64).T.copy()
    n = len(x)
    q = np.uint64(1) << np.uint64(bits - 1)
    one = np.uint64(1)
    while q > one:
        p = q - one
        for i in range(n):
            high = (x[i] & q) != 0
            t = np.where(high, np.uint64(0), (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, t)
            x[i] ^= t
        q >>= one
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = np.uint64(1) << np.uint64(bits - 1)
    while q > one:
        t ^= np.where((x[n - 1] & q) != 0, q - one, np.uint64(0))
        q >>= one
    x ^= t
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << one) | ((x[i] >> np.uint64(b)) & one)
    return out


class Orderings:
    """Random projections, shifts and scales of `n` Hilbert orderings of unit vectors of `width` values."""

    def __init__(self, width: int, n: int, dims: int, bits: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.bits, self.dims = bits, dims
        self.maps = [np.linalg.qr(rng.standard_normal((width, width)))[0][:, :dims].astype(np.float32) for _ in range(n)]
        self.shifts = [rng.random(dims).astype(np.float32) for _ in range(n)]
        self.centre, self.scale = np.zeros(width, np.float32), np.float32(1 / np.sqrt(width))

    def fit(self, sample: np.ndarray) -> None:
        if len(sample):
            self.centre = sample.mean(axis=0)
            self.scale = np.float32(max(1e-6, float((sample - self.centre).std())))

    def keys(self, unit: np.ndarray, t: int) -> np.ndarray:
        """The grid spans six deviations; the shift moves it by up to a quarter of its width."""
        y = (unit - self.centre) @ self.maps[t] / self.scale
        g = (y + 4.0) / 8.0 * 0.75 + self.shifts[t] * 0.25
        cells = np.clip(g * (1 << self.bits), 0, (1 << self.bits) - 1).astype(np.uint64)
        return hilbert_index(cells, self.bits).astype(np.int64)


def usable(vector: Column, width: int) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) == width) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _unit(batch: pd.Series) -> np.ndarray:
    v = np.stack(batch.to_numpy()).astype(np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)


def _quantise(unit: np.ndarray) -> np.ndarray:
    return np.rint(unit / np.abs(unit).max(axis=1, keepdims=True) * 127).astype(np.int8)


def neighbour_pairs(ids: np.ndarray, q: np.ndarray, window: int, block: int, k: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
    """For rows in order of their keys: pairs (id, neighbour id) of each row with its best at most `k` rows of the window whose approximate cosine is at least `floor`."""
    u = q.astype(np.float32)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    n, left, right = len(ids), [], []
    for s in range(0, n, block):
        e = min(n, s + block)
        a, b = max(0, s - window), min(n, e + window)
        sim = u[s:e] @ u[a:b].T
        sim[np.arange(e - s), np.arange(s, e) - a] = -2
        if b - a > k:
            if floor > -1:
                rows = np.nonzero((sim >= floor).sum(axis=1) > k)[0]
            else:
                rows = np.arange(e - s)
            if len(rows):
                cut = -np.partition(-sim[rows], k - 1, axis=1)[:, k - 1]
                sim[rows] = np.where(sim[rows] >= cut[:, None], sim[rows], -2)
        i, j = np.nonzero(sim >= max(floor, -1.5))
        left.append(ids[s:e][i])
        right.append(ids[a:b][j])
    return (np.concatenate(left), np.concatenate(right)) if left else (np.empty(0, np.int64), np.empty(0, np.int64))


def candidate_pairs(vectors: DataFrame, width: int, k: int, floor: float, orderings: int, dims: int, bits: int, window: int, block: int, range_rows: int, sample_rows: int) -> DataFrame:
    """Distinct unordered pairs (grp, a, b) met in some ordering's window; vectors: id long, grp string, v array<float> (all usable)."""
    o = Orderings(width, orderings, dims, bits)
    sizes = {r[0]: r[1] for r in vectors.groupBy("grp").count().collect()}
    total = sum(sizes.values())
    # a bounded sample by hash of the id, which does not depend on the order of files
    share = min(1.0, sample_rows / max(1, total))
    sample = vectors.filter(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(share * 1_000_000) + 1).select("grp", "v").limit(2 * sample_rows).toPandas() if total else pd.DataFrame({"grp": [], "v": []})
    unit = _unit(sample["v"]) if len(sample) else np.empty((0, width), np.float32)
    o.fit(unit)
    groups = sorted(sizes, key=lambda g: (g is not None, g))
    number = {g: i for i, g in enumerate(groups)}
    fine = 20  # fine quantiles a range; a row in the outermost one goes to the neighbouring range, too
    bounds: dict = {}
    for g in groups:
        own = unit[(sample["grp"].isna() if g is None else sample["grp"] == g).to_numpy()] if len(sample) else unit
        ranges = max(1, round(sizes[g] / range_rows))
        if len(own) < 2 * ranges:
            ranges = max(1, len(own) // 2)
        for t in range(orderings):
            keys = np.sort(o.keys(own, t)) if len(own) else np.empty(0, np.int64)
            steps = np.arange(1, ranges * fine)
            bounds[number[g], t] = (ranges, keys[(steps * len(keys)) // (ranges * fine)] if len(keys) and ranges > 1 else np.empty(0, np.int64))
    first, base = {}, 0
    for key, (ranges, _) in bounds.items():
        first[key] = base
        base += ranges

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for g, part in b.groupby("grp", dropna=False, sort=False):
                g = None if pd.isna(g) else g
                u, ids = _unit(part["v"]), part["id"].to_numpy()
                q = _quantise(u)
                salt = ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
                for t in range(orderings):
                    ranges, edge = bounds[number[g], t]
                    keys = o.keys(u, t)
                    lo, hi = np.searchsorted(edge, keys, "left"), np.searchsorted(edge, keys, "right")
                    cell = lo + (salt % (hi - lo + 1).astype(np.uint64)).astype(np.int64)
                    home, at = cell // fine, cell % fine
                    sides = [(np.ones(len(ids), bool), home), ((at == 0) & (home > 0), home - 1), ((at == fine - 1) & (home < ranges - 1), home + 1)]
                    for mask, where in sides:
                        if mask.any():
                            yield pd.DataFrame({"part": (where[mask] + first[number[g], t]).astype(np.int32), "key": keys[mask], "id": ids[mask], "q": [x.tobytes() for x in q[mask]]})

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["key", "id"], kind="stable")
        ids = pdf["id"].to_numpy()
        q = np.frombuffer(b"".join(pdf["q"]), np.int8).reshape(len(pdf), width)
        i, j = neighbour_pairs(ids, q, window, block, k, floor)
        a, b = np.minimum(i, j), np.maximum(i, j)
        out = np.unique(np.stack([a, b], axis=1), axis=0) if len(a) else np.empty((0, 2), np.int64)
        return pd.DataFrame({"a": out[:, 0], "b": out[:, 1]})

    spread_rows = vectors.mapInPandas(spread, "part int, key long, id long, q binary")
    # as many partitions as the ranges need, whatever the session's default
    return spread_rows.repartition(max(1, base // 2), "part").groupBy("part").applyInPandas(compare, "a long, b long").filter("a <> b").distinct()


def most_similar(df: DataFrame, id_col: str, vector: str, group: Column, width: int = 64, k: int = 10, min_cosine: float = -1.0, orderings: int = 8, dims: int = 9, bits: int = 7, window: int = 128, block: int = 256, range_rows: int = 20_000, sample_rows: int = 20_000) -> DataFrame:
    """(id, neighbour, cosine, rank) of the `k` most similar of each usable vector within its group.

    min_cosine restricts the result to neighbours of at least that cosine; the search uses it, too (less the error of
    quantisation), which leaves ranks among those as they are.
    """
    v = df.select(F.col(id_col).cast("long").alias("id"), group.cast("string").alias("grp"), F.col(vector).cast("array<float>").alias("v")).filter(F.col("id").isNotNull() & usable(F.col("v"), width))
    floor = min_cosine - 0.02 if min_cosine > -1 else -1.0
    pairs = materialize(candidate_pairs(v, width, k, floor, orderings, dims, bits, window, block, range_rows, sample_rows), "pairs")

    @F.pandas_udf("double")
    def cosine(a: pd.Series, b: pd.Series) -> pd.Series:
        if not len(a):
            return pd.Series([], dtype="float64")
        x, y = (np.stack(s.to_numpy()).astype(np.float64) for s in (a, b))
        x, y = (z / np.abs(z).max(axis=1, keepdims=True) for z in (x, y))
        return pd.Series(np.einsum("ij,ij->i", x, y) / np.linalg.norm(x, axis=1) / np.linalg.norm(y, axis=1))

    full = v.select("id", "v")
    # the candidates grow with the data, so they are not to be broadcast
    both = pairs.hint("merge").join(full.withColumnRenamed("id", "a").withColumnRenamed("v", "va"), "a").hint("merge").join(full.withColumnRenamed("id", "b").withColumnRenamed("v", "vb"), "b")
    scored = both.select("a", "b", cosine.asNondeterministic()("va", "vb").alias("cosine"))
    if min_cosine > -1:
        scored = scored.filter(F.col("cosine") >= min_cosine)
    directed = scored.select(F.inline(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("neighbour"), "cosine"), F.struct(F.col("b").alias("id"), F.col("a").alias("neighbour"), "cosine"))))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("cosine"), "neighbour"))
    return directed.select("*", rank.alias("rank")).filter(F.col("rank") <= k)


def exact_neighbours(df: DataFrame, id_col: str, vector: str, group: Column, queries: Column, width: int = 64, k: int = 10, chunk_rows: int = 4096) -> DataFrame:
    """(id, neighbour, cosine, rank) by brute force for the rows that `queries` selects, against all rows: chunks of vectors meet blocks of queries, one matrix product each."""
    v = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(group.cast("string"), F.lit("")).alias("grp"), F.col(vector).cast("array<float>").alias("v"), queries.alias("is_query")).filter(F.col("id").isNotNull() & usable(F.col("v"), width))

    def chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for g, part in b.groupby("grp", sort=False):
                for i in range(0, len(part), chunk_rows):
                    x = part.iloc[i : i + chunk_rows]
                    yield pd.DataFrame({"grp": [g], "ids": [x["id"].to_numpy().tobytes()], "m": [_unit(x["v"]).tobytes()]})

    schema = "grp string, ids binary, m binary"
    all_rows = v.select("id", "grp", "v").mapInPandas(chunks, schema)
    asked = v.filter("is_query").select("id", "grp", "v").mapInPandas(chunks, schema)

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for qi, qm, ri, rm in zip(b["qids"], b["qm"], b["ids"], b["m"]):
                qi, ri = np.frombuffer(qi, np.int64), np.frombuffer(ri, np.int64)
                sim = np.frombuffer(qm, np.float32).reshape(-1, width) @ np.frombuffer(rm, np.float32).reshape(-1, width).T
                sim[qi[:, None] == ri[None, :]] = -2
                n = min(k, sim.shape[1])
                top = np.argpartition(-sim, n - 1, axis=1)[:, :n]
                yield pd.DataFrame({"id": np.repeat(qi, n), "neighbour": ri[top].ravel(), "cosine": np.take_along_axis(sim, top, 1).ravel().astype(np.float64)})

    # chunks of all rows are dealt to parts, each of which meets every chunk of queries: one group is as many tasks as it has parts
    parts = 32
    dealt = all_rows.withColumn("part", F.pmod(F.xxhash64("ids"), F.lit(parts)).cast("int"))
    queries_ = asked.select("grp", F.col("ids").alias("qids"), F.col("m").alias("qm"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    met = dealt.join(queries_, ["grp", "part"])
    found = met.select("qids", "qm", "ids", "m").mapInPandas(products, "id long, neighbour long, cosine double").filter("cosine > -1.5")
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("cosine"), "neighbour"))
    return found.select("*", rank.alias("rank")).filter(F.col("rank") <= k)
