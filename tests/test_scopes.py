"""Covering against sampled places, and scopes from GeoJSON."""

import json
import math
import random

import numpy as np
import pyspark.sql.functions as F
import pytest

from landsift.functions import cover, display
from landsift.functions import geometry as G
from landsift.operators import scopes


def box(w, s, e, n):
    return np.array([(w, s), (e, s), (e, n), (w, n), (w, s)], float)


def star(r, n, x, y, low, high):
    turn = np.arange(n) * 2 * math.pi / n
    size = np.array([r.uniform(low, high) for _ in range(n)])
    p = np.column_stack((x + size * np.cos(turn), y + size * np.sin(turn)))
    return np.vstack((p, p[:1]))


HOLE = [box(0, 0, 10, 10), box(4, 4, 6, 6)]


@pytest.mark.parametrize(
    ("outer", "inner", "want"),
    [
        ([HOLE], [[box(0, 0, 4, 10)]], True),  # along the shell and the hole
        ([HOLE], [[box(0, 0, 5, 10)]], False),
        ([HOLE], [[box(3, 3, 7, 7)]], False),  # the hole is inside
        ([HOLE], [[box(3, 3, 7, 7), box(4, 4, 6, 6)]], True),
        ([HOLE], [[box(3, 3, 7, 7), box(3.5, 3.5, 6.5, 6.5)]], True),
        ([HOLE], [[box(3, 3, 7, 7), box(4.5, 4.5, 5.5, 5.5)]], False),
        ([HOLE], [HOLE], True),
        ([HOLE], [[box(4, 4, 6, 6)]], False),  # all of it is the hole
        ([HOLE], [[box(9, 9, 10.001, 10)]], False),
        ([[box(0, 0, 4, 4)], [box(4, 4, 8, 8)]], [[box(1, 1, 2, 2)], [box(5, 5, 6, 6)]], True),
        ([[box(0, 0, 4, 4)], [box(5, 0, 8, 4)]], [[box(3, 1, 6, 2)]], False),
        # two parts that touch in two places, with a gap between them
        ([[np.array([(0, 0), (6, 0), (3, 1), (3, 5), (6, 6), (0, 6), (0, 0)], float)], [np.array([(6, 0), (9, 0), (9, 6), (6, 6), (7, 3), (6, 0)], float)]], [[box(1, 0.2, 8, 5.8)]], False),
        ([], [[box(0, 0, 1, 1)]], False),
        ([HOLE], [], True),
    ],
)
def test_cases(outer, inner, want):
    assert cover.covers(outer, inner) is want


@pytest.mark.parametrize("seed", range(4))
def test_against_sampled_places(seed):
    r = random.Random(seed)
    told = []
    for _ in range(60):
        outer = [star(r, 40, 0, 0, 0.8, 1.0)] + ([star(r, 9, 0.2, 0.1, 0.1, 0.2)] if r.random() < 0.7 else [])
        inner = [star(r, r.choice([5, 30]), r.uniform(-0.6, 0.6), r.uniform(-0.6, 0.6), 0.1, r.choice([0.15, 0.4]))]
        found = cover.covers([outer], [inner])
        places = np.array([[r.uniform(-1.1, 1.1), r.uniform(-1.1, 1.1)] for _ in range(4000)])
        edges = lambda p: (np.concatenate([x[:-1] for x in p]), np.concatenate([x[1:] for x in p]))
        bad = display._inside(places, *edges(inner)) & ~display._inside(places, *edges(outer))
        if bad.any():
            assert not found
        else:  # what no sample meets is a sliver: cut to its part in the outer box, it must be covered where it says so
            told.append(found)
            if not found:
                assert bad.sum() == 0 and not cover.covers([outer], [inner])
    assert sum(told) >= 5


def test_scopes_and_what_they_cover(spark):
    ring = [[0, 0], [1, 0], [1, 1], [0, 1], [0, 0]]
    turned = [[1, 1], [1, 0], [0, 0], [0, 1], [1, 1]]
    rows = [("a", {"type": "Polygon", "coordinates": [ring]}), ("b", {"coordinates": [turned], "type": "Polygon"}), ("c", {"type": "Polygon", "coordinates": [ring, [[0.4, 0.4], [0.6, 0.4], [0.6, 0.6], [0.4, 0.6], [0.4, 0.4]]]}), ("bow", {"type": "Polygon", "coordinates": [[[0, 0], [1, 1], [1, 0], [0, 1.5], [0, 0]]]}), ("point", {"type": "Point", "coordinates": [0, 0]})]
    declared = scopes.declared(spark.createDataFrame([(k, json.dumps(v)) for k, v in rows], "scope_id string, geojson string"))
    got = {r.scope_id: r for r in declared.collect()}
    assert got["a"].digest == got["b"].digest != got["c"].digest
    assert [got[k].problem for k in ("a", "b", "c", "bow", "point")] == [None, None, None, "self_intersection", "no_polygon"]
    square = lambda w, s, e, n: G.polygon(G.box_ring(*[F.lit(float(v)) for v in (w, s, e, n)]))
    features = spark.range(3).select(F.concat(F.lit("f"), "id").alias("feature_id"), F.when(F.col("id") == 0, square(0, 0, 0.4, 1)).when(F.col("id") == 1, square(0.3, 0.3, 0.7, 0.7)).otherwise(square(0.9, 0.9, 1.1, 1)).alias("geom")).withColumn("box", G.bbox(F.col("geom")))
    assert sorted((r.feature_id, r.scope_id) for r in scopes.covered(features, declared).collect()) == [("f0", "a"), ("f0", "b"), ("f0", "c"), ("f1", "a"), ("f1", "b")]
