import json
import math
import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.conftest import got
from wakeline.functions import geo
from wakeline.operators import containment, proximity
from wakeline.workspace import cut

STAR = [[0, 0], [4, 1], [8, 0], [7, 4], [8, 8], [4, 7], [0, 8], [1, 4], [0, 0]]
HOLE = [[3, 3], [5, 3], [5, 5], [3, 5], [3, 3]]


def brute(rings, x, y):
    n = 0
    for r in rings:
        for (ax, ay), (bx, by) in zip(r, r[1:]):
            if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
                n += 1
    return n % 2 == 1


def in_cover(cover, x, y):
    for level, cell, interior, edges in cover:
        size = 360 / 2**level
        if cell == (level << 56) | (int((x + 180) // size) << 28) | int((y + 90) // size):
            if interior:
                return True
            return brute([[(e[0], e[1]), (e[2], e[3])] for e in edges], x, y)
    return False


@settings(max_examples=300, deadline=None)
@given(st.floats(-1, 9), st.floats(-1, 9), st.booleans())
def test_coverage_equals_the_plain_test(x, y, turned):
    rings = [STAR[::-1] if turned else STAR, HOLE]
    cover = containment.cover_polygon(json.dumps({"type": "Polygon", "coordinates": rings}))
    assert in_cover(cover, x, y) == brute(rings, x, y)


def test_unreadable_polygons_cover_nothing():
    for text in (None, "", "{}", "[1]", '{"coordinates":[]}', '{"coordinates":[[[1]]]}', '{"coordinates":[[["a","b"],["c","d"]]]}'):
        assert containment.cover_polygon(text) == []


@pytest.mark.parametrize("limit", [64_000_000, -1])
def test_points_in_regions(spark, square, monkeypatch, limit):
    monkeypatch.setattr(containment, "BROADCAST_BYTES", limit)
    regions = spark.createDataFrame([(1, square(0, 0, 1, 1), True), (2, square(0.5, 0.5, 2, 2), True), (3, square(0, 0, 9, 9), False), (4, "broken", True), (5, None, True)], "id int, polygon string, active boolean")
    rng = random.Random(1)
    pts = [(i, rng.uniform(-1, 3), rng.uniform(-1, 3)) for i in range(400)] + [(400, None, 0.5), (401, 0.5, None), (402, 0.5, 91.0), (403, 0.7, 0.7), (403, 0.7, 0.7)]
    points = spark.createDataFrame(pts, "position_id long, lon double, lat double")
    want = sorted((i, r) for i, x, y in pts if x is not None and y is not None and y <= 90 for r, b in ((1, (0, 0, 1, 1)), (2, (0.5, 0.5, 2, 2))) if b[0] < x < b[2] and b[1] < y < b[3])
    assert got(containment.positions_in_regions(points, regions)) == want
    assert got(containment.positions_in_regions(points.limit(0), regions)) == []
    assert got(containment.positions_in_regions(points, regions.limit(0))) == []


def test_many_edges_are_split_and_multipolygons_are_read():
    wheel = [(math.cos(k / 3000 * 2 * math.pi), math.sin(k / 3000 * 2 * math.pi)) for k in range(3000)]
    wheel.append(wheel[0])
    cover = containment.cover_polygon(json.dumps({"type": "Polygon", "coordinates": [wheel]}))
    assert max(len(e) for *_, e in cover) <= containment.MOST_EDGES
    rng = random.Random(7)
    for _ in range(200):
        x, y = rng.uniform(-1.1, 1.1), rng.uniform(-1.1, 1.1)
        assert in_cover(cover, x, y) == brute([wheel], x, y)
    ring = lambda x: [[x, 0], [x + 1, 0], [x + 1, 1], [x, 1], [x, 0]]
    many = containment.cover_polygon(json.dumps({"type": "MultiPolygon", "coordinates": [[ring(0)], [ring(5)]]}))
    assert [in_cover(many, x, 0.5) for x in (0.5, 3.0, 5.5)] == [True, False, True]


def test_boundaries_belong_to_a_region_on_request(spark, square):
    regions = containment.cut(containment.coverage(spark.createDataFrame([(1, square(0, 0, 1, 1))], "id int, polygon string")))
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, 1.0, 0.5), (3, 0.5, 1.0), (4, 0.5, 0.5), (5, 1.0, 1.0), (6, 1.0001, 0.5)], "position_id long, lon double, lat double")
    assert {i for i, _ in got(containment.containing(points, regions, "position_id", on_edge=True))} == {1, 2, 3, 4, 5}


def hav(a, b):
    p, q = math.radians(a[1]), math.radians(b[1])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[0] - a[0]) / 2) ** 2
    return 2 * geo.EARTH_M * math.asin(min(1, math.sqrt(h)))


def test_near_pairs_against_all_pairs(spark, at):
    rng = random.Random(2)
    rows = []
    for i in range(500):  # by a harbour, the antimeridian, both poles
        lon, lat = rng.choice([(10, 50), (179.9999, 10), (-179.9999, 10), (rng.uniform(-180, 180), 89.9995), (rng.uniform(-180, 180), -89.9995)])
        x = lon + rng.uniform(-0.02, 0.02)
        rows.append((rng.randrange(40), at(rng.uniform(0, 60)), (x + 180) % 360 - 180, max(-90.0, min(90.0, lat + rng.uniform(-0.01, 0.01)))))
    rows += [rows[0], (None, at(1), 10.0, 50.0), (99, None, 10.0, 50.0), (98, at(1), None, 50.0), (97, at(1), 10.0, 95.0)]
    df = spark.createDataFrame(rows, "mmsi long, reported_at timestamp, lon double, lat double")
    want = set()
    good = [r for r in rows if None not in r and r[3] <= 90]
    for i, a in enumerate(good):
        for b in good[:i]:
            if a[0] != b[0] and abs((a[1] - b[1]).total_seconds()) <= 300 and hav(a[2:], b[2:]) <= 400:
                want.add((min(a[0], b[0]), max(a[0], b[0])))
    assert len(want) > 20
    assert got(proximity.near_pairs(df)) == sorted(want)
    assert got(proximity.near_pairs(df.limit(0))) == []


def test_distances(spark):
    df = spark.range(1).select(
        geo.local_m(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(0.018)).alias("ns"),
        geo.local_m(F.lit(179.999), F.lit(0.0), F.lit(-179.999), F.lit(0.0)).alias("wrap"),
        geo.haversine_m(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(0.018)).alias("sphere"),
    )
    ns, wrap, sphere = df.first()
    assert abs(ns - 1990.3) < 0.1 and abs(wrap - 222.6) < 0.1 and abs(sphere - 2001.5) < 0.1


def test_inside_is_boundary_inclusive_on_request(spark, square):
    df = spark.createDataFrame([(square(0, 0, 1, 1), 1.0, 0.5), (square(0, 0, 1, 1), 0.5, 0.5), (square(0, 0, 1, 1), 1.5, 0.5)], "p string, x double, y double")
    e = geo.edges(geo.rings(F.col("p")))
    out = [tuple(r) for r in df.select(geo.inside(F.col("x"), F.col("y"), e, on_edge=True)).collect()]
    assert out == [(True,), (True,), (False,)]
