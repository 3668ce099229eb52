import random
import struct

import numpy as np
from pyspark.sql import functions as F

from loomgraph.functions.geometry import polygon_rings, with_point
import pytest

from loomgraph.operators.spatial import Pivots, great_circle_m, radius_join, regions_containing, unit_vectors


def test_points(spark):
    wkb = "0101000020E6100000" + struct.pack("<dd", -179.5, 12.25).hex()
    big = "0000000001" + struct.pack(">dd", 1e-5, -0.0).hex().upper()
    cases = {"POINT(1.5 -2)": (1.5, -2.0), "SRID=4326;POINT(3 4)": (3.0, 4.0), "point(  5   6 )": (5.0, 6.0), "POINT Z (7 8 9)": (7.0, 8.0), "10, 20": (20.0, 10.0), '{"type":"Point","coordinates":[1,2]}': (1.0, 2.0), wkb: (-179.5, 12.25), big: (1e-5, 0.0), "POINT EMPTY": None, "POINT(nan nan)": None, "unknown": None, "": None, None: None, "95,10": None, "POINT(190 0)": None}
    df = spark.createDataFrame(list(enumerate(cases)), "i int, g string")
    got = {r.i: (r.lon, r.lat) for r in with_point(df, ["i"], F.col("g")).collect()}
    assert got == {i: v for i, v in enumerate(cases.values()) if v}


def test_grouped_pivots():
    rng = np.random.default_rng(2)
    around = lambda n: unit_vectors(rng.uniform(-180, 180, n), np.degrees(np.arcsin(rng.uniform(-1, 1, n))))
    pivots, u = Pivots(around(1500)), around(300)
    d = great_circle_m(u[:, None, :], pivots.v[None, :, :])
    at, best = pivots.nearest(u)
    assert len(pivots.groups) > 30 and np.allclose(best, d.min(axis=1)) and (d[np.arange(300), at] == best).all()
    bound = best + rng.uniform(0, 1e6, 300)
    assert set(zip(*pivots.within(u, bound))) == set(zip(*np.nonzero(d <= bound[:, None])))


@pytest.mark.parametrize("n_pivots", [20, 1100, None])
def test_radius_against_brute_force(spark, n_pivots):
    rnd = random.Random(3)
    spots = [(179.99, 10.0), (0.0, 89.99), (-70.0, -30.0)]
    points = []
    for i in range(900):
        x, y = rnd.choice(spots)
        lon = x + rnd.uniform(-0.03, 0.03) * (100 if y > 89 else 1)
        points.append((i, (lon + 180) % 360 - 180, max(-90.0, min(90.0, y + rnd.uniform(-0.01, 0.01)))))
    centres = [(k, *points[rnd.randrange(900)][1:], rnd.choice([0.0, 50.0, 500.0, 5000.0])) for k in range(120)] + [(900, 0.0, 0.0, 2.1e7), (901, None, 1.0, 5.0), (902, 200.0, 1.0, 5.0), (903, 1.0, 1.0, None), (904, 1.0, 1.0, -1.0)]
    points += [(900, None, 1.0), (901, 181.0, 0.0)]
    p = spark.createDataFrame(points, "point_id int, lon double, lat double")
    c = spark.createDataFrame(centres, "centre_id int, lon double, lat double, radius_m double")
    got = [tuple(r) for r in radius_join(p, c, n_pivots=n_pivots, part_rows=100, block_centres=30).collect()]
    good = [x for x in points if x[1] is not None and abs(x[1]) <= 180]
    u = unit_vectors(np.array([x[1] for x in good]), np.array([x[2] for x in good]))
    expected = set()
    for k, lon, lat, r in centres:
        if None not in (lon, lat, r) and abs(lon) <= 180 and r >= 0:
            d = great_circle_m(u, unit_vectors(np.array([lon]), np.array([lat])))
            expected |= {(good[i][0], k) for i in np.nonzero(d <= r)[0]}
    assert len(got) == len(set(got)) and set(got) == expected


def test_empty_sides(spark):
    p = spark.createDataFrame([], "point_id int, lon double, lat double")
    c = spark.createDataFrame([(1, 0.0, 0.0, 5.0)], "centre_id int, lon double, lat double, radius_m double")
    assert radius_join(p, c).count() == 0
    assert regions_containing(p, spark.createDataFrame([], "region_id long, boundary string")).count() == 0


def test_regions(spark):
    square = "POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0), (4 4, 6 4, 6 6, 4 6, 4 4))"
    two = "MULTIPOLYGON (((-5 -5, -1 -5, -1 -1, -5 -1, -5 -5)), ((20 20, 30 20, 25 30, 20 20)))"
    r = spark.createDataFrame([(1, square), (2, two), (3, "nonsense"), (4, None)], "region_id long, boundary string")
    p = spark.createDataFrame([(1, 5.0, 5.0), (2, 1.0, 1.0), (3, -2.0, -2.0), (4, 25.0, 21.0), (5, 11.0, 5.0), (6, None, 5.0)], "point_id int, lon double, lat double")
    assert {tuple(x) for x in regions_containing(p, r).collect()} == {(2, 1), (3, 2), (4, 2)}
    assert polygon_rings("POLYGON ((0 0, 1 1))") == []
