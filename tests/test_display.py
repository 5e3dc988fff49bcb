"""Simplified and subdivided polygons: valid, whole, and the same at every run; tampered parts are found."""

import math
import random

import numpy as np
import pyspark.sql.functions as F
import pytest

from landsift.functions import display
from landsift.functions import geometry as G
from landsift.operators import reports


def closed(points):
    p = np.array(points, float)
    return np.vstack((p, p[:1]))


def star(r, n, x=0.0, y=0.0, low=0.5, high=1.0):
    turn = np.sort(np.array([r.random() for _ in range(n)])) * 2 * math.pi
    if len(set(turn)) < 3 or np.diff(np.append(turn, turn[0] + 2 * math.pi)).max() > 3:
        turn = np.arange(n) * 2 * math.pi / n
    size = np.array([r.uniform(low, high) for _ in range(n)])
    return closed(np.column_stack((x + size * np.cos(turn), y + size * np.sin(turn))))


def comb(r, teeth):
    points = [p for i in range(teeth) for p in ((i * 2.0, 0.0), (i * 2.0 + 1 - 0.9 * r.random(), 9 + r.random()), (i * 2.0 + 1 + 0.4 * r.random(), 9.0))]
    return closed([*points, (2.0 * teeth, -1.0), (0.0, -1.0 - r.random())])


def shapes(seed, n):
    r = random.Random(seed)
    while n:
        kind = r.randrange(4)
        if kind == 0:
            rings = [star(r, r.choice([5, 20, 80, 200]))]
        elif kind == 1:
            rings = [star(r, r.choice([20, 80, 300]), low=0.6)] + [star(r, r.choice([3, 8, 30]), 0.25 * math.cos(a), 0.25 * math.sin(a), 0.02, 0.12) for a in (0, 2, 4)]
        elif kind == 2:
            rings = [comb(r, r.choice([3, 10, 30]))]
        else:  # small holes close to a smooth shell: a chord would leave them outside
            rings = [star(r, r.choice([40, 100]), low=0.8, high=0.82)] + [star(r, 5, 0.77 * math.cos(a), 0.77 * math.sin(a), 0.005, 0.02) for a in np.arange(8) * 0.7]
        if display.fault(rings) is None:
            n -= 1
            yield r, rings


def crossings(rings):
    """Proper crossings of all pairs of edges, without any index."""
    a, b = np.concatenate([r[:-1] for r in rings]), np.concatenate([r[1:] for r in rings])
    side = lambda p, q, s: np.sign((q[:, None, 0] - p[:, None, 0]) * (s[None, :, 1] - p[:, None, 1]) - (q[:, None, 1] - p[:, None, 1]) * (s[None, :, 0] - p[:, None, 0]))
    across = side(a, b, a) * side(a, b, b) < 0
    shared = (a[:, None] == a[None]).all(axis=2) | (a[:, None] == b[None]).all(axis=2) | (b[:, None] == a[None]).all(axis=2) | (b[:, None] == b[None]).all(axis=2)
    return int((across & across.T & ~shared).sum())


@pytest.mark.parametrize("seed", range(10))
def test_simplified_polygons_are_valid_and_keep_their_rings(seed):
    for r, rings in shapes(seed, 100):
        tolerance = float(np.ptp(rings[0], axis=0).max()) * r.choice([0.001, 0.01, 0.05, 0.2, 0.6])
        found = display.simplified(rings, tolerance)
        assert len(found) == len(rings) and crossings(found) == 0 and display.fault(found) is None
        for ring, before in zip(found, rings, strict=True):
            assert len(ring) >= 4 and set(map(tuple, ring)) <= set(map(tuple, before))
        for hole in found[1:]:
            assert display._inside(hole[:-1], found[0][:-1], found[0][1:]).all()


@pytest.mark.parametrize("seed", range(5))
def test_parts_are_valid_small_and_the_whole(seed):
    for r, rings in shapes(100 + seed, 40):
        most = r.choice([8, 16, 64, 256])
        parts = display.subdivided(rings, most)
        assert all(sum(map(len, p)) <= most and display.fault(p, True) is None for p in parts)
        assert sum(map(display.area, parts)) == pytest.approx(display.area(rings), rel=1e-9)
        assert display.recomposed(rings, parts)
        inner = [(p[0][0] + p[0][1] + p[0][2]) / 3 for p in parts]  # no place lies in two parts
        for q in inner:
            assert sum(int((display._inside(q[None], np.concatenate([x[:-1] for x in p]), np.concatenate([x[1:] for x in p])))[0]) for p in parts) <= 1
        if len(parts) > 1:
            assert not display.recomposed(rings, parts[1:])
            assert not display.recomposed(rings, [*parts, parts[0]])
            moved = [[x.copy() for x in p] for p in parts]
            moved[0][0][1] += float(np.ptp(rings[0], axis=0).max()) * 1e-4
            assert not display.recomposed(rings, moved)


def test_a_notch_never_pierces_the_edge_before_it():
    ring = closed([(0, 0), (50, -9), (100, 0), (100, 50), (55, 50), (50, -8), (45, 50), (0, 50)])
    for tolerance in (5, 10, 30, 60, 500):
        found = display.simplified([ring], tolerance)
        assert display.fault(found) is None and crossings(found) == 0
    assert len(display.simplified([closed([(0, 0), (9, 0), (9, 9), (0, 9)])], 100)[0]) == 4  # a triangle is left, not the whole


def test_a_c_is_cut_into_its_arms():
    c = closed([(0, 0), (10, 0), (10, 4), (3, 4), (3, 6), (10, 6), (10, 10), (0, 10)])
    below, above = display.cut([c], 0, 5.0)
    assert len(below) == 1 and len(above) == 2 and all(display.fault(p) is None for p in below + above)
    ring = [closed([(0, 0), (10, 0), (10, 10), (0, 10)]), closed([(4, 4), (6, 4), (6, 6), (4, 6)]), closed([(1, 1), (2, 1), (2, 2), (1, 2)])]
    below, above = display.cut(ring, 0, 5.0)
    assert [len(p) for p in below] == [2] and [len(p) for p in above] == [1]  # the hole that is cut is no hole any more
    assert display.recomposed(ring, [*below, *above])


def test_what_isnt_valid_is_said():
    assert display.fault([closed([(0, 0), (2, 2), (2, 0), (0, 2)])]) == "crossing" or display.fault([closed([(0, 0), (2, 2), (2, 0), (0, 2)])]) == "degenerate"
    assert display.fault([closed([(0, 0), (4, 0), (2, 0), (2, 3)])]) is not None
    square = closed([(0, 0), (9, 0), (9, 9), (0, 9)])
    assert display.fault([square, closed([(20, 20), (21, 20), (21, 21)])]) == "hole_outside"
    assert display.fault([square, closed([(1, 1), (8, 1), (8, 8), (1, 8)]), closed([(3, 3), (4, 3), (4, 4)])]) == "holes_nest"
    assert display.fault([square, closed([(0, 0), (3, 1), (1, 3)])], True) is None  # touches in a corner


def test_a_large_polygon_takes_little_more_than_its_share():
    import time

    n = 60_000
    turn = np.arange(n) * 2 * math.pi / n
    ring = closed(np.column_stack((1e6 * np.cos(turn), 1e6 * np.sin(turn) * (1 + 0.01 * np.sin(turn * 900)))))
    start = time.time()
    found = display.simplified([ring], 500.0)
    parts = display.subdivided([ring], 256)
    assert len(found[0]) < n / 5 and sum(len(p[0]) for p in parts) > n and display.recomposed([ring], parts)
    assert time.time() - start < 90


def test_columns_of_polygons(spark):
    ring = lambda n, size: F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: G.point(size * F.cos((i % n) * 6.283185307179586 / n), size * F.sin((i % n) * 6.283185307179586 / n)))
    df = spark.range(6).select("id", F.when(F.col("id") == 3, F.lit(None)).when(F.col("id") % 2 == 0, F.array(ring(90, 5.0), ring(8, 1.0))).otherwise(F.array(ring(40, 5.0))).alias("p"))
    df = df.withColumn("parts", display.subdivide("p", F.lit(32)))
    got = df.select("id", F.size("parts").alias("n"), display.recomposes("p", "parts").alias("same"), display.polygon_fault("p").alias("fault"), F.size(display.simplify("p", F.lit(0.5))).alias("rings")).orderBy("id").collect()
    assert [(r.same, r.fault) for r in got if r.id != 3] == [(True, None)] * 5 and all(r.n > 1 for r in got if r.id != 3)
    assert got[3].same is None and [r.rings for r in got if r.id != 3] == [2, 1, 2, 2, 1]


def test_a_build_tells_a_crossing_shape(spark):
    import json

    bow = {"type": "Polygon", "coordinates": [[[0, 0], [0.2, 0.2], [0.2, 0], [0, 0.3], [0, 0]]]}
    df = spark.createDataFrame([("bow", json.dumps(bow))], "feature_id string, g string").withColumn("geom", G.from_geojson(F.col("g"))).drop("g")
    built = reports.display_build(df).collect()
    assert {r.error_code for r in built if r.band == "z17_18"} == {"invalid_crossing"} and all(r.parts is None for r in built if r.error_code)


def test_features_of_one_shape_are_built_once(spark, monkeypatch):
    """Three hundred features of three shapes: fifteen polygons are built, and each feature has its own row a band. A place without polygon has an error."""
    x = (F.col("id") % 3).cast("double")
    ring = G.box_ring(x, F.lit(1.0), x + 0.1, F.lit(1.1))
    rows = spark.range(300).select(F.concat(F.lit("f"), "id").alias("feature_id"), F.when(F.col("id") != 299, G.polygon(ring)).alias("geom"))
    seen = spark.sparkContext.accumulator(0)
    plain = display._build

    @F.arrow_udf(display.BUILT)
    def counted(polygon: display.pa.Array, tolerance: display.pa.Array, most: display.pa.Array) -> display.pa.Array:
        seen.add(len(polygon))
        return plain(polygon, list(zip(tolerance.to_pylist(), most.to_pylist(), strict=True)))

    monkeypatch.setattr(display, "build", counted)
    got = reports.display_build(rows, 128).select("feature_id", "band", "vertices", "part_count", "error_code").collect()
    assert seen.value == 20 and len(got) == 1500 == len({(r.feature_id, r.band) for r in got})
    assert {(r.vertices, r.part_count, r.error_code) for r in got if r.feature_id != "f299"} == {(5, 1, None)}
