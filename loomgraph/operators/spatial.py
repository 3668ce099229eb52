"""Points near other points, and regions containing points.

Radius join: pivots are fitted on a bounded sample of both sides by hash of the id, as many as the sizes of the sides demand (up to the sample's size); every point goes to the Voronoi cell of its nearest
pivot, every centre to all cells that can hold a point within its radius: with d the great-circle distance, a
point x of cell i within r of centre a has d(a, p_i) <= d(x, p_i) + r <= d(x, p_j) + r <= d(a, p_j) + 2r for every j. So the
join is complete for any pivots. Many pivots are searched by groups around a few of them: a group can hold a point's nearest pivot only if the
distance to the group's centre, less the group's radius, is small enough. In each cell a vantage-point tree over the cell's centres, with the exact great-circle metric, is
descended by all points of a batch at once.

Hot cells: points of a cell are spread over as many parts as its count of points demands (counts come from one
aggregation over all points), and the cell's centres go to each part, so no task gets more than about `part_rows` points.
Parts with no centre are not shuffled. Centres of one cell are cut into blocks of `block_centres`, too, so both sides
of a group are bounded whatever the skew.

Defined results: rows with null, non-finite or out-of-range coordinates, or a null or negative radius, take no part;
repeated rows give repeated pairs only if their ids repeat; the antimeridian and the poles need no special care, since distances are
taken between unit vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.geometry import polygon_rings
from ..runtime import materialize

EARTH_M = 6_371_008.8
#: Metres added to every pruning bound, for rounding; results themselves are exact.
SLACK_M = 0.01


def unit_vectors(lon: np.ndarray, lat: np.ndarray) -> np.ndarray:
    a, b = np.radians(lon), np.radians(lat)
    return np.stack([np.cos(b) * np.cos(a), np.cos(b) * np.sin(a), np.sin(b)], axis=1)


def great_circle_m(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Metres between unit vectors (broadcast), exact for near points."""
    d = u - v
    return 2 * EARTH_M * np.arcsin(np.minimum(1.0, np.sqrt(np.einsum("...i,...i->...", d, d)) / 2))


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first traversal over a sample of unit vectors, then one round of averaging; at least one pivot."""
    if not len(sample):
        return np.array([[1.0, 0.0, 0.0]])
    chosen = [0]
    nearest = great_circle_m(sample, sample[0])
    owner = np.zeros(len(sample), dtype=int)
    while len(chosen) < min(n, len(sample)) and nearest.max() > 1.0:
        i = int(nearest.argmax())
        d = great_circle_m(sample, sample[i])
        owner[d < nearest] = len(chosen)
        nearest = np.minimum(nearest, d)
        chosen.append(i)
    centres = np.stack([sample[owner == k].mean(axis=0) if (owner == k).any() else sample[c] for k, c in enumerate(chosen)])
    norms = np.linalg.norm(centres, axis=1, keepdims=True)
    return np.where(norms > 1e-9, centres / np.maximum(norms, 1e-9), sample[chosen])


class Pivots:
    """Pivots in groups around some of them; nearest pivots and all pivots within a bound are found group by group, exactly."""

    def __init__(self, pivots: np.ndarray):
        self.v = pivots
        n = max(1, int(np.sqrt(len(pivots)))) if len(pivots) > 512 else 1
        self.heads = pivots[:: max(1, len(pivots) // n)][:n]
        owner = (pivots @ self.heads.T).argmax(axis=1)
        self.groups = [np.nonzero(owner == g)[0] for g in range(n)]
        self.radius = np.array([great_circle_m(pivots[i], self.heads[g]).max() + SLACK_M if len(i) else 0.0 for g, i in enumerate(self.groups)])

    def _bounds(self, u: np.ndarray) -> np.ndarray:
        """The least distance at which a pivot of each group may lie."""
        return great_circle_m(u[:, None, :], self.heads[None, :, :]) - self.radius

    def nearest(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of and distance to the nearest pivot of each unit vector."""
        low = self._bounds(u)
        best, at = np.full(len(u), np.inf), np.zeros(len(u), np.int64)
        first = low.argmin(axis=1)
        for own in (True, False):  # each vector's likeliest group first, then those that may still be nearer
            for g, members in enumerate(self.groups):
                rows = np.nonzero((first == g) if own else ((first != g) & (low[:, g] < best)))[0]
                if len(rows) and len(members):
                    d = great_circle_m(u[rows][:, None, :], self.v[members][None, :, :])
                    k = d.argmin(axis=1)
                    nearer = d[np.arange(len(rows)), k] < best[rows]
                    at[rows[nearer]] = members[k[nearer]]
                    best[rows[nearer]] = d[np.arange(len(rows)), k][nearer]
        return at, best

    def within(self, u: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (row, pivot) at most `bound` apart."""
        low = self._bounds(u)
        rows_out, cells_out = [], []
        for g, members in enumerate(self.groups):
            rows = np.nonzero(low[:, g] <= bound)[0]
            if len(rows) and len(members):
                r, k = np.nonzero(great_circle_m(u[rows][:, None, :], self.v[members][None, :, :]) <= bound[rows][:, None])
                rows_out.append(rows[r])
                cells_out.append(members[k])
        return (np.concatenate(rows_out), np.concatenate(cells_out)) if rows_out else (np.empty(0, np.int64), np.empty(0, np.int64))


class VantagePointTree:
    """Over centres (unit vectors) with radii in metres; `pairs` gives all (point, centre) at most a radius apart."""

    LEAF = 24

    def __init__(self, centres: np.ndarray, radii: np.ndarray):
        self.v, self.r = centres, radii
        self.root = self._build(np.arange(len(centres)))

    def _build(self, idx: np.ndarray):
        if len(idx) <= self.LEAF:
            return ("leaf", idx)
        vp = idx[0]
        d = great_circle_m(self.v[idx], self.v[vp])
        if d.max() == 0:
            return ("leaf", idx)
        mid = np.median(d)
        near = d <= mid
        if near.all():
            near = d < mid if (d < mid).any() else d <= d.min()
        inner, outer = idx[near], idx[~near]
        di, do = d[near], d[~near]
        # a query at distance q of the vantage point can match a centre at distance d, radius r only if |q - d| <= r
        bounds = [((dd - self.r[ii]).min() - SLACK_M, (dd + self.r[ii]).max() + SLACK_M) for ii, dd in ((inner, di), (outer, do))]
        return ("node", vp, bounds, self._build(inner), self._build(outer))

    def pairs(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found_p, found_c = [], []
        stack = [(self.root, np.arange(len(points)))]
        while stack:
            node, q = stack.pop()
            if not len(q):
                continue
            if node[0] == "leaf":
                for c in node[1]:
                    hit = q[great_circle_m(points[q], self.v[c]) <= self.r[c]]
                    if len(hit):
                        found_p.append(hit)
                        found_c.append(np.full(len(hit), c))
                continue
            _, vp, bounds, inner, outer = node
            d = great_circle_m(points[q], self.v[vp])
            for (low, high), child in zip(bounds, (inner, outer)):
                stack.append((child, q[(d >= low) & (d <= high)]))
        if not found_p:
            return np.empty(0, int), np.empty(0, int)
        return np.concatenate(found_p), np.concatenate(found_c)


def _usable(df: DataFrame, lon: str, lat: str) -> DataFrame:
    return df.filter(f"abs({lon}) <= 180 AND abs({lat}) <= 90")


def _sampled(df: DataFrame, key: str, rows: int) -> tuple[list[tuple[float, float]], int]:
    """At most `rows` coordinates by hash of the id, and about how many rows there are (exactly how many, if few)."""
    share = df.filter(F.pmod(F.xxhash64(key), F.lit(1024)) == 0).select("lon", "lat").orderBy(F.xxhash64(key)).limit(rows + 1).collect()
    if len(share) >= 200:
        n = len(share) * 1024 if len(share) <= rows else df.count()
        return [(r[0], r[1]) for r in share[:rows]], n
    few = df.select("lon", "lat").limit(rows).collect()
    return [(r[0], r[1]) for r in few], max(len(few), len(share) * 1024)


def radius_join(points: DataFrame, centres: DataFrame, n_pivots: int | None = None, sample_rows: int = 20_000, part_rows: int = 50_000, block_centres: int = 4_000) -> DataFrame:
    """points: (point_id long, lon, lat); centres: (centre_id long, lon, lat, radius_m). Gives all (point_id, centre_id) at most radius_m apart.

    n_pivots: as many as leave about half a part of points and half a block of centres to a cell, 256 at least, if not given.
    sample_rows bounds the sample on which the pivots are fitted (half from either side), and their number; it affects speed only.
    """
    p = _usable(points.select(F.col("point_id").cast("long"), F.col("lon").cast("double"), F.col("lat").cast("double")), "lon", "lat")
    c = _usable(centres.select(F.col("centre_id").cast("long"), F.col("lon").cast("double"), F.col("lat").cast("double"), F.col("radius_m").cast("double")), "lon", "lat").filter("radius_m >= 0")
    (near_c, size_c), (near_p, size_p) = _sampled(c, "centre_id", sample_rows // 2), _sampled(p, "point_id", sample_rows // 2)
    sample = unit_vectors(*np.array(near_c + near_p).T) if near_c or near_p else np.empty((0, 3))
    wanted = n_pivots or min(sample_rows, max(256, 2 * size_p // part_rows, 2 * size_c // block_centres))
    # many pivots are taken at random, so as dense as the data; few are spread out
    rng = np.random.default_rng(5)
    pivots = Pivots(choose_pivots(sample, wanted) if wanted <= 1024 else sample[rng.permutation(len(sample))[:wanted]])

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            u = unit_vectors(b["lon"].to_numpy(), b["lat"].to_numpy())
            if len(pivots.groups) == 1:
                cell = np.concatenate([(u[i : i + 8192] @ pivots.v.T).argmax(axis=1) for i in range(0, len(u), 8192)]) if len(u) else np.empty(0, int)
            else:
                cell = np.concatenate([pivots.nearest(u[i : i + 8192])[0] for i in range(0, len(u), 8192)]) if len(u) else np.empty(0, int)
            yield pd.DataFrame({"point_id": b["point_id"], "lon": b["lon"], "lat": b["lat"], "cell": cell.astype(np.int32)})

    def reachable(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(0, len(b), 2048):
                x = b.iloc[i : i + 2048]
                u = unit_vectors(x["lon"].to_numpy(), x["lat"].to_numpy())
                # the cell of a point is found by inner product, whose rounding is worth less than a metre
                row, cell = pivots.within(u, pivots.nearest(u)[1] + 2 * x["radius_m"].to_numpy() + 2.0)
                yield x.iloc[row].assign(cell=cell.astype(np.int32))

    # written once, since the cells are counted before they are cut into parts
    placed = materialize(p.mapInPandas(nearest, "point_id long, lon double, lat double, cell int"), "cells")
    spread = c.mapInPandas(reachable, "centre_id long, lon double, lat double, radius_m double, cell int")
    # at most as many rows as pivots
    spread = spread.withColumn("block", F.pmod(F.xxhash64("centre_id"), F.lit(1 << 20)))
    n_points = {r[0]: r[1] for r in placed.groupBy("cell").count().collect()}
    n_centres = {r[0]: r[1] for r in spread.groupBy("cell").count().collect()}
    plan = [(k, -(-n_points[k] // part_rows), -(-n // block_centres)) for k, n in n_centres.items() if k in n_points]
    if not plan:
        return p.sparkSession.createDataFrame([], "point_id long, centre_id long")
    parts = F.broadcast(p.sparkSession.createDataFrame(plan, "cell int, parts int, blocks int"))
    left = placed.join(parts, "cell").select("point_id", "lon", "lat", "cell", F.pmod(F.xxhash64("point_id"), F.col("parts")).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    right = spread.join(parts, "cell").select("centre_id", "lon", "lat", "radius_m", "cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), (F.col("block") % F.col("blocks")).cast("int").alias("block"))

    def match(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"point_id": np.empty(0, "int64"), "centre_id": np.empty(0, "int64")})
        tree = VantagePointTree(unit_vectors(b["lon"].to_numpy(), b["lat"].to_numpy()), b["radius_m"].to_numpy())
        i, k = tree.pairs(unit_vectors(a["lon"].to_numpy(), a["lat"].to_numpy()))
        return pd.DataFrame({"point_id": a["point_id"].to_numpy()[i], "centre_id": b["centre_id"].to_numpy()[k]})

    keys = ["cell", "part", "block"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(match, "point_id long, centre_id long")


def regions_containing(points: DataFrame, regions: DataFrame, grid_degrees: float = 1.0) -> DataFrame:
    """points: (point_id, lon, lat); regions: (region_id, boundary as WKT). Gives (point_id, region_id), boundary taken as plane, holes excluded.

    A region is cut along the rows and columns of a grid; a cell holds the edges of the region that matter for a ray from a point
    of the cell westwards, so a point meets only the regions and edges of its own cell. Regions are cut in tasks and written once; the cells join by
    equality and are broadcast only if their files are small enough for Spark's own threshold. Unreadable boundaries contain nothing.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for region_id, boundary in zip(b["region_id"], b["boundary"]):
                e = np.array([(x1, y1, x2, y2) for ring in polygon_rings(boundary if isinstance(boundary, str) else None) for (x1, y1), (x2, y2) in zip(ring, ring[1:]) if y1 != y2])
                if not len(e):
                    continue
                low, high = np.minimum(e[:, 1], e[:, 3]), np.maximum(e[:, 1], e[:, 3])
                left, right = np.minimum(e[:, 0], e[:, 2]), np.maximum(e[:, 0], e[:, 2])
                for gy in range(int(np.floor(low.min() / grid_degrees)), int(np.floor(high.max() / grid_degrees)) + 1):
                    row = (low <= (gy + 1) * grid_degrees) & (high >= gy * grid_degrees)
                    cells = [(gx, e[row & (left <= (gx + 1) * grid_degrees)]) for gx in range(int(np.floor(left.min() / grid_degrees)), int(np.floor(right.max() / grid_degrees)) + 1)]
                    cells = [(gx, near) for gx, near in cells if len(near)]
                    if cells:
                        yield pd.DataFrame({"region_id": [region_id] * len(cells), "gx": [gx for gx, _ in cells], "gy": [gy] * len(cells), "edges": [[dict(zip(("x1", "y1", "x2", "y2"), map(float, n))) for n in near] for _, near in cells]})

    schema = "region_id long, gx int, gy int, edges array<struct<x1:double,y1:double,x2:double,y2:double>>"
    cells = materialize(regions.select(F.col("region_id").cast("long").alias("region_id"), "boundary").mapInPandas(cut, schema), "regions")
    p = _usable(points, "lon", "lat").select("point_id", "lon", "lat", F.floor(F.col("lon") / grid_degrees).cast("int").alias("gx"), F.floor(F.col("lat") / grid_degrees).cast("int").alias("gy"))
    crosses = """aggregate(edges, false, (inside, e) -> inside != ((e.y1 > lat) != (e.y2 > lat) AND lon > (e.x2 - e.x1) * (lat - e.y1) / (e.y2 - e.y1) + e.x1))"""
    return p.join(cells, ["gx", "gy"]).filter(F.expr(crosses)).select("point_id", "region_id")
