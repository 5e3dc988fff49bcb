"""Planar geometry against literal fixtures."""

import json
import math

import pyspark.sql.functions as F
import pytest

from landsift.functions import geometry as G
from landsift.functions import mercator as M
from landsift.operators import reports, spatial


def geom(value):
    return G.from_geojson(F.lit(json.dumps(value)))


def square(w, s, e, n):
    return {"type": "Polygon", "coordinates": [[[w, s], [e, s], [e, n], [w, n], [w, s]]]}


TRIANGLE = {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [0, 1], [0, 0]]]}
FAR_CORNER = {"type": "Polygon", "coordinates": [[[1, 1], [1, 0.6], [0.6, 1], [1, 1]]]}


def test_boxes_overlap_but_triangles_do_not(one):
    a, b = geom(TRIANGLE), geom(FAR_CORNER)
    assert one(G.bboxes_intersect(G.bbox(a), G.bbox(b)))
    assert not one(G.intersects(a, b))
    assert one(G.distance_m(a, b)) > 0


def test_touching_counts(one):
    a, b = geom(square(0, 0, 1, 1)), geom(square(1, 0, 2, 1))
    assert one(G.bboxes_intersect(G.bbox(a), G.bbox(b)))
    assert one(G.intersects_projected(a, b))


def test_containment_without_crossing_edges(one):
    assert one(G.intersects(geom(square(0, 0, 4, 4)), geom(square(1, 1, 2, 2))))


def test_a_hole_is_outside(one):
    ring = [[[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]], [[1, 1], [3, 1], [3, 3], [1, 3], [1, 1]]]
    poly = geom({"type": "Polygon", "coordinates": ring})["polys"][0]
    p = lambda x, y: G.point(F.lit(x), F.lit(y))
    assert not one(G.point_in_polygon(p(2.0, 2.0), poly))
    assert one(G.point_in_polygon(p(0.5, 0.5), poly))
    assert one(G.point_in_polygon(p(1.0, 2.0), poly))


@pytest.mark.parametrize("kind,coordinates,points", [("Point", [1, 2], 1), ("MultiPoint", [[1, 2], [3, 4]], 2), ("LineString", [[0, 0], [1, 1]], 2), ("MultiLineString", [[[0, 0], [1, 1]], [[2, 2], [3, 3]]], 4), ("MultiPolygon", [[[[0, 0], [1, 0], [0, 1], [0, 0]]]], 4)])
def test_types_that_are_understood(one, kind, coordinates, points):
    assert one(F.size(G.positions(geom({"type": kind, "coordinates": coordinates})))) == points


def test_a_collection_is_not_understood(one):
    assert one(geom({"type": "GeometryCollection", "geometries": []})) is None


def test_area_ignores_holes_and_centroids_differ(one):
    ring = [[[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]], [[0, 0], [2, 0], [2, 2], [0, 2], [0, 0]]]
    with_hole, plain = geom({"type": "Polygon", "coordinates": ring}), geom({"type": "Polygon", "coordinates": ring[:1]})
    assert one(G.area_m2(with_hole)) == one(G.area_m2(plain))
    assert one(G.vertex_mean(plain))["x"] == pytest.approx(1.6)
    assert one(G.area_centroid(plain))["x"] == pytest.approx(2.0)


@pytest.mark.parametrize("ring,problem", [([[0, 0], [1, 0], [1, 1], [0, 0]], None), ([[0, 0], [1, 1], [0, 0]], "too_few_points"), ([[0, 0], [1, 0], [1, 1], [0, 1]], "not_closed"), ([[0, 0], [2, 2], [2, 0], [0, 1], [0, 0]], "self_intersection"), ([[0, 95], [1, 95], [1, 96], [0, 95]], "out_of_range"), ([[-179, 0], [179, 0], [179, 1], [-179, 0]], "antimeridian")])
def test_ring_problems(one, ring, problem):
    assert one(G.ring_problem(geom({"type": "LineString", "coordinates": ring})["lines"][0])) == problem


def test_canonical_ring_forgets_start_and_direction(one):
    rings = ([[0, 0], [2, 0], [2, 1], [0, 0]], [[2, 0], [2, 1], [0, 0], [2, 0]], [[0, 0], [2, 1], [2, 0], [0, 0]])
    made = [one(G.canonical_ring(geom({"type": "LineString", "coordinates": r})["lines"][0])) for r in rings]
    assert made[0] == made[1] == made[2]


def test_segment_distances(one):
    s = lambda a, b: F.struct(G.point(F.lit(a[0]), F.lit(a[1])).alias("a"), G.point(F.lit(b[0]), F.lit(b[1])).alias("b"))
    assert one(G.segment_distance(s((0.0, 0.0), (2.0, 2.0)), s((0.0, 2.0), (2.0, 0.0)))) == 0
    assert one(G.segment_distance(s((0.0, 0.0), (1.0, 0.0)), s((0.0, 3.0), (1.0, 3.0)))) == 3
    assert one(G.segment_distance(s((0.0, 0.0), (0.0, 0.0)), s((3.0, 4.0), (9.0, 4.0)))) == 5


def test_spatial_join_is_that_of_all_pairs(spark):
    boxes = lambda seed, n: [(i, float((i * seed) % 97), float((i * seed * 7) % 89), float(1 + i % 9)) for i in range(n)]
    frame = lambda rows: spark.createDataFrame(rows, "id int, x double, y double, d double").withColumn("box", F.struct(F.col("x").alias("w"), F.col("y").alias("s"), (F.col("x") + F.col("d")).alias("e"), (F.col("y") + F.col("d")).alias("n")))
    a, b = frame(boxes(13, 60)), frame(boxes(29, 60))
    got = {(r["id"], r["r_id"]) for r in spatial.candidate_pairs(a, b, 10.0, 2.0).collect()}
    rows = spatial.candidate_pairs(a, b, 10.0, 2.0).count()
    want = {(i, j) for i, x, y, d in boxes(13, 60) for j, u, v, e in boxes(29, 60) if x - 2 <= u + e and u <= x + d + 2 and y - 2 <= v + e and v <= y + d + 2}
    assert got == want and rows == len(want)


def test_flags_keep_the_first_match_not_the_nearest(spark):
    def rows(items, schema):
        df = spark.createDataFrame(items, schema)
        return df.withColumn("geom", G.from_geojson(F.col("g"))).withColumn("box", G.bbox(F.col("geom")))

    records = rows([("r", json.dumps(square(11.3, 34.2, 11.31, 34.21)))], "public_id string, g string")
    near, nearer = square(11.294, 34.2, 11.296, 34.21), square(11.298, 34.2, 11.299, 34.21)
    flood = square(11.305, 34.205, 11.32, 34.22)
    features = rows([("wetlands", 0, "w0", json.dumps(near)), ("wetlands", 1, "w1", json.dumps(nearer)), ("floodplain", 2, "f", json.dumps(flood))], "category string, feature_order int, feature_id string, g string")
    flags = {f["flag_type"]: f for f in spatial.flags(records, features).first()["proximity_flags"]}
    assert flags["near_wetland"]["source_feature_id"] == "w0"
    assert flags["near_wetland"]["relationship"] == "within" and 0 < flags["near_wetland"]["distance_m"] < 500
    assert flags["intersects_floodplain"]["relationship"] == "intersects"


def test_rings_become_shells_holes_and_islands(spark):
    ring = lambda w, e: [(float(w), float(w)), (float(e), float(w)), (float(e), float(e)), (float(w), float(e)), (float(w), float(w))]
    df = spark.createDataFrame([("f", 0, ring(0, 10)), ("f", 1, ring(1, 9)), ("f", 2, ring(2, 3)), ("f", 3, ring(20, 30))], "feature_id string, ring_no int, ring array<struct<x:double,y:double>>")
    got = {r["ring_no"]: (r["role"], r["shell_no"]) for r in spatial.assemble_rings(df).collect()}
    assert got == {0: ("shell", None), 1: ("hole", 0), 2: ("shell", None), 3: ("shell", None)}


def test_simplify_and_subdivide_keep_area(spark):
    import math

    wave = [[math.cos(t / 300 * 2 * math.pi) * (1 + 0.01 * math.sin(t)), math.sin(t / 300 * 2 * math.pi)] for t in range(300)]
    df = spark.createDataFrame([("a", json.dumps({"type": "Polygon", "coordinates": [[*wave, wave[0]]]}))], "feature_id string, g string").withColumn("geom", G.from_geojson(F.col("g")))
    built = {r["band"]: r for r in reports.display_build(df.drop("g"), 64).collect()}
    assert all(r["error_code"] is None for r in built.values())
    assert built["z08_10"]["vertices"] <= built["z17_18"]["vertices"] == 301
    assert all(sum(len(x) for x in p) <= 64 + 8 for p in built["z17_18"]["parts"])
    again = reports.band_report(reports.display_build(df.drop("g").repartition(3), 64)).orderBy("band").collect()
    assert again == reports.band_report(reports.display_build(df.drop("g"), 64)).orderBy("band").collect()


def test_mercator(one):
    p = one(M.forward(G.point(F.lit(180.0), F.lit(0.0))))
    assert p["x"] == pytest.approx(20037508.342789) and abs(p["y"]) < 1e-6
    assert one(M.tile_west_edge(F.lit(12), F.lit(1061))) == pytest.approx(1061 / 4096 * 360 - 180)


def test_areas_of_small_rings_are_exact_far_from_the_equator(spark):
    """Rings whose area is within thousandths of a half: products of metres from the equator would round some the other way."""
    rows = []
    for k in range(3000):
        s, half = 34.6 + k / 1000, 0.0002 * (1 + k % 5)
        w, lat = -86.88 + k / 1000, (3 * (s - half) + 2 * (s + half)) / 5
        area = 2 * half * G.METRES_LON * math.cos(math.radians(lat)) * 2 * half * G.METRES_LAT
        if abs(area % 1 - 0.5) < 0.005:
            rows.append((w - half, s - half, w + half, s + half, math.floor(area + 0.5)))
    assert len(rows) > 10
    df = spark.createDataFrame(rows, "w double, s double, e double, n double, area long")
    ring = G.box_ring(*(F.col(c) for c in "wsen"))
    assert [r["area"] for r in df.select("area", G.area_m2(G.polygon(ring)).alias("got")).where("area <> got").collect()] == []


def test_a_long_ring_is_canonical_without_all_its_rotations(spark):
    """20,000 points: all rotations would be 400 million. A least point that repeats, as in a figure of eight, has its rotations compared."""
    n = 20000
    circle = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: G.point(F.cos(k * 2 * math.pi / n), F.sin(k * 2 * math.pi / n)))
    closed = lambda r: F.concat(r, F.slice(r, 1, 1))
    df = spark.range(1).select(circle.alias("r")).select("r", F.reverse(F.concat(F.slice("r", 7001, n), F.slice("r", 1, 7000))).alias("t"))
    row = df.select(G.canonical_ring(closed(F.col("r"))).alias("a"), G.canonical_ring(closed(F.col("t"))).alias("b")).select(F.size("a").alias("n"), (F.col("a") == F.col("b")).alias("same"), F.expr("a[0] = array_min(a)").alias("least")).first()
    assert row.asDict() == {"n": n, "same": True, "least": True}
    eight = F.array(*[G.point(F.lit(x), F.lit(y)) for x, y in ((0.0, 0.0), (2.0, 1.0), (1.0, 2.0), (0.0, 0.0), (1.0, 1.0), (0.5, 3.0), (0.0, 0.0))])
    got = spark.range(1).select(G.canonical_ring(eight).alias("r")).first()["r"]
    assert [tuple(p) for p in got] == [(0.0, 0.0), (1.0, 1.0), (0.5, 3.0), (0.0, 0.0), (2.0, 1.0), (1.0, 2.0)]


def test_a_box_reads_its_text_once(spark, tmp_path):
    """The plan of the round trip holds one reader a type of geometry, not one a side of the box."""
    from landsift.plans import fields

    spark.createDataFrame([(k, 1, "F", "1-URGENT") for k in range(8)], "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string").withColumn("o_orderdate", F.current_timestamp()).write.parquet(f"{tmp_path}/orders.parquet")
    df = fields.geojson_round_trip(spark, str(tmp_path))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("from_json") <= 6
    assert {(r["w"], r["e"]) for r in df.where("public_id in ('rec-3', 'rec-4')").collect()} == {(-86877400, -86877400), (-86876400, -86875600)}
