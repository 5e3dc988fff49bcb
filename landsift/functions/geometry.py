"""Planar geometry as column expressions.

A geometry is ``struct<polys array<array<array<struct<x,y>>>>, lines array<array<struct<x,y>>>,
points array<struct<x,y>>>`` in degrees; a ring is closed (its last point repeats its first).
What concerns one geometry stays in the JVM; pairs are compared in blocks (``pairs``). Distances use a local
equirectangular projection about the mean of both geometries' vertices, so they hold for one pair and aren't
consistent across pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyspark.sql.functions as F
from pyspark.sql import Column
from pyspark.sql import types as T

from landsift.functions import pairs

# Metres a degree, and the tolerance of the planar predicates, as a distance in the geometry's units.
METRES_LON, METRES_LAT, EPSILON = pairs.METRES_LON, pairs.METRES_LAT, 1e-9
#: The WGS 84 ellipsoid.
SEMI_AXIS_KM, FLATTENING = 6378.137, 1 / 298.257223563

POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
RING = T.ArrayType(POINT)
GEOMETRY = T.StructType([T.StructField("polys", T.ArrayType(T.ArrayType(RING))), T.StructField("lines", T.ArrayType(RING)), T.StructField("points", RING)])
_POINTS = "array<struct<x:double,y:double>>"


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def _empty(kind: str) -> Column:
    return F.array().cast(kind)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it; a column that stands in several places is computed in each."""
    return F.transform(F.array(value), body)[0]


def polygon(*rings: Column) -> Column:
    """A geometry of one polygon; the first ring is the shell."""
    return F.struct(F.array(F.array(*rings)).alias("polys"), _empty(f"array<{_POINTS}>").alias("lines"), _empty(_POINTS).alias("points"))


def box_ring(w: Column, s: Column, e: Column, n: Column) -> Column:
    return F.array(point(w, s), point(e, s), point(e, n), point(w, n), point(w, s))


def from_geojson(text: Column) -> Column:
    """The geometry of a GeoJSON text; null for a type that isn't understood or for coordinates that don't fit it."""
    return from_geojson_parts(F.get_json_object(text, "$.type"), F.get_json_object(text, "$.coordinates"))


def from_geojson_parts(kind: Column, body: Column) -> Column:
    """``from_geojson`` of a text's type and coordinates; where they are columns, the text is read once for all types."""
    pts = lambda a: F.transform(a, lambda p: F.when(F.size(p) >= 2, point(p[0], p[1])))
    rings = lambda a: F.transform(a, pts)
    read = lambda depth: F.from_json(body, "array<" * depth + "double" + ">" * depth)
    polys, lines, points = f"array<array<{_POINTS}>>", f"array<{_POINTS}>", _POINTS
    one = lambda p, li, pt: F.struct(p.alias("polys"), li.alias("lines"), pt.alias("points"))
    none_p, none_l, none_pt = _empty(polys), _empty(lines), _empty(points)
    return (
        F.when(kind == "Point", one(none_p, none_l, pts(F.array(read(1)))))
        .when(kind == "MultiPoint", one(none_p, none_l, pts(read(2))))
        .when(kind == "LineString", one(none_p, F.array(pts(read(2))), none_pt))
        .when(kind == "MultiLineString", one(none_p, rings(read(3)), none_pt))
        .when(kind == "Polygon", one(F.array(rings(read(3))), none_l, none_pt))
        .when(kind == "MultiPolygon", one(F.transform(read(4), rings), none_l, none_pt))
    )


def positions(g: Column) -> Column:
    """All vertices, closing ones included."""
    return F.concat(F.flatten(F.flatten(g["polys"])), F.flatten(g["lines"]), g["points"])


def mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / F.size(values)


def bbox(g: Column) -> Column:
    """struct<w,s,e,n>; null when there are no vertices."""

    def of(p: Column) -> Column:
        xs, ys = F.transform(p, lambda v: v["x"]), F.transform(p, lambda v: v["y"])
        return F.when(F.size(p) > 0, let(F.struct(xs.alias("x"), ys.alias("y")), lambda v: F.struct(F.array_min(v["x"]).alias("w"), F.array_min(v["y"]).alias("s"), F.array_max(v["x"]).alias("e"), F.array_max(v["y"]).alias("n"))))

    return let(let(g, positions), of)


def has_positions(g: Column) -> Column:
    """Whether ``bbox`` finds a vertex; to be asked of a geometry that is a column."""
    return F.coalesce(F.size(positions(g)) > 0, F.lit(False))


def bboxes_intersect(a: Column, b: Column) -> Column:
    """Closed boxes: touching counts."""
    return (a["e"] >= b["w"]) & (b["e"] >= a["w"]) & (a["n"] >= b["s"]) & (b["n"] >= a["s"])


def bbox_distance_m(a: Column, b: Column) -> Column:
    dx = F.greatest(b["w"] - a["e"], a["w"] - b["e"], F.lit(0.0))
    dy = F.greatest(b["s"] - a["n"], a["s"] - b["n"], F.lit(0.0))
    lat = (a["s"] + a["n"] + b["s"] + b["n"]) / 4
    return F.when(bboxes_intersect(a, b), 0.0).otherwise(F.hypot(dx * METRES_LON * F.cos(F.radians(lat)), dy * METRES_LAT))


def round_to(value: Column, digits: int) -> Column:
    """floor(x * 10^n + 0.5) / 10^n: one rule that every engine shares."""
    scale = float(10**digits)
    return F.floor(value * scale + 0.5) / scale


def vertex_mean(g: Column) -> Column:
    """The mean of all vertices, to 7 digits; the vertex that closes a ring counts twice."""
    p = positions(g)
    x, y = mean(F.transform(p, lambda v: v["x"])), mean(F.transform(p, lambda v: v["y"]))
    return F.when(F.size(p) > 0, point(round_to(x, 7), round_to(y, 7)))


def bbox_centre(g: Column, default: Column) -> Column:
    b = bbox(g)
    return F.coalesce(F.when(b.isNotNull(), point((b["w"] + b["e"]) / 2, (b["s"] + b["n"]) / 2)), default)


def _pairs(ring: Column) -> Column:
    """Consecutive points of a ring as segments a, b."""
    n = F.size(ring)
    both = F.zip_with(F.slice(ring, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(ring, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return F.when(n > 1, both).otherwise(F.filter(both, lambda s: F.lit(False)))


def segments(ring: Column, closed: bool = False) -> Column:
    """Segments between distinct neighbours; a ring that isn't closed is, if ``closed``."""
    if closed:
        first, last = F.element_at(ring, 1), F.element_at(ring, -1)
        ring = F.when((F.size(ring) > 0) & ((first["x"] != last["x"]) | (first["y"] != last["y"])), F.concat(ring, F.array(first))).otherwise(ring)
    return F.filter(_pairs(ring), lambda s: (s["a"]["x"] != s["b"]["x"]) | (s["a"]["y"] != s["b"]["y"]))


def shoelace(ring: Column) -> Column:
    """Twice the signed area of a closed ring, in its own units."""
    return F.aggregate(_pairs(ring), F.lit(0.0), lambda t, s: t + s["a"]["x"] * s["b"]["y"] - s["b"]["x"] * s["a"]["y"])


def area_m2(g: Column) -> Column:
    """Whole square metres of the shells; holes are ignored. Null without polygons.

    Sums are taken about a shell's first vertex, else the products of metres from the equator would swallow a small ring.
    """

    def placed(shell: Column) -> Column:
        scale = F.struct(shell[0].alias("home"), (METRES_LON * F.cos(F.radians(mean(F.transform(shell, lambda v: v["y"]))))).alias("lon"))
        return let(scale, lambda k: F.transform(shell, lambda v: point((v["x"] - k["home"]["x"]) * k["lon"], (v["y"] - k["home"]["y"]) * METRES_LAT)))

    def shell_area(poly: Column) -> Column:
        return let(poly[0], lambda shell: F.when(F.size(shell) < 4, 0.0).otherwise(F.abs(let(placed(shell), shoelace)) / 2))

    return let(g["polys"], lambda polys: F.when(F.size(polys) > 0, F.floor(F.aggregate(F.transform(polys, shell_area), F.lit(0.0), lambda a, v: a + v) + 0.5)))


def area_centroid(g: Column) -> Column:
    """The centroid weighted by signed ring areas (a hole turns the other way); the point itself for a lone point.

    Sums are taken about the first vertex, else the products of degrees would swallow a small ring.
    """
    home = F.element_at(F.flatten(F.flatten(g["polys"])), 1)
    rings = F.transform(F.flatten(g["polys"]), lambda r: F.transform(r, lambda p: point(p["x"] - home["x"], p["y"] - home["y"])))
    pairs = F.flatten(F.transform(rings, _pairs))
    cross = lambda s: s["a"]["x"] * s["b"]["y"] - s["b"]["x"] * s["a"]["y"]
    total = F.aggregate(pairs, F.lit(0.0), lambda t, s: t + cross(s))
    along = lambda k: home[k] + F.aggregate(pairs, F.lit(0.0), lambda t, s: t + (s["a"][k] + s["b"][k]) * cross(s)) / (3 * total)
    return F.when(F.size(F.flatten(F.flatten(g["polys"]))) > 0, F.when(total != 0, point(along("x"), along("y")))).when(F.size(g["points"]) == 1, g["points"][0])


def orientation(a: Column, b: Column, c: Column) -> Column:
    """Positive where a, b, c turn left."""
    return (b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"])


def off_line(p: Column, s: Column) -> Column:
    """Distance of a point from the line through a segment, with its side; an orientation alone grows with the segment's length."""
    return orientation(s["a"], s["b"], p) / F.nullif(F.hypot(s["b"]["x"] - s["a"]["x"], s["b"]["y"] - s["a"]["y"]), F.lit(0.0))


def _in_box(p: Column, s: Column) -> Column:
    within = lambda k: (p[k] >= F.least(s["a"][k], s["b"][k]) - EPSILON) & (p[k] <= F.greatest(s["a"][k], s["b"][k]) + EPSILON)
    return within("x") & within("y")


def point_on_segment(p: Column, s: Column) -> Column:
    return (F.abs(F.coalesce(off_line(p, s), F.lit(0.0))) <= EPSILON) & _in_box(p, s)


def _crosses(s: Column, t: Column) -> Column:
    """Segments that pass through each other, clear of all ends; null where one has no length."""
    o1, o2, o3, o4 = off_line(t["a"], s), off_line(t["b"], s), off_line(s["a"], t), off_line(s["b"], t)
    return ((o1 > 0) != (o2 > 0)) & ((o3 > 0) != (o4 > 0)) & (F.abs(o1) > EPSILON) & (F.abs(o2) > EPSILON) & (F.abs(o3) > EPSILON) & (F.abs(o4) > EPSILON)


def segments_intersect(s: Column, t: Column) -> Column:
    return F.coalesce(_crosses(s, t), F.lit(False)) | point_on_segment(t["a"], s) | point_on_segment(t["b"], s) | point_on_segment(s["a"], t) | point_on_segment(s["b"], t)


def point_in_ring(p: Column, ring: Column) -> Column:
    """Even-odd ray cast."""

    def flip(inside: Column, s: Column) -> Column:
        a, b = s["a"], s["b"]
        crosses = (a["y"] > p["y"]) != (b["y"] > p["y"])
        at = (b["x"] - a["x"]) * (p["y"] - a["y"]) / F.nullif(b["y"] - a["y"], F.lit(0.0)) + a["x"]
        return F.when(crosses & (p["x"] < at), ~inside).otherwise(inside)

    return F.when(F.size(ring) < 3, False).otherwise(F.aggregate(segments(ring, True), F.lit(False), flip))


def point_in_polygon(p: Column, poly: Column) -> Column:
    """The boundary counts as inside; holes don't."""
    on_edge = F.exists(poly, lambda r: F.exists(segments(r, True), lambda s: point_on_segment(p, s)))
    holes = F.exists(F.slice(poly, F.lit(2), F.greatest(F.size(poly) - 1, F.lit(0))), lambda r: point_in_ring(p, r))
    return F.when(F.size(poly) == 0, False).otherwise(on_edge | (point_in_ring(p, poly[0]) & ~holes))


def _measure(project: bool, distance: bool):
    """A column function of two geometries that compares blocks of pairs; null where one is null."""

    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        none = pc.or_(a.is_null(), b.is_null())
        met, least = pairs.measures(a, b, project, distance)
        return pa.array(least if distance else met, pa.float64() if distance else pa.bool_(), mask=none.to_numpy(zero_copy_only=False))

    return F.arrow_udf(run, T.DoubleType() if distance else T.BooleanType())


#: Whether two geometries meet (touching counts), in their own units.
intersects_projected = _measure(False, False)
#: The same in metres about the mean of both geometries' vertices.
intersects = _measure(True, False)
#: 0 where they meet, else the least distance between them, in their own units.
distance_projected = _measure(False, True)
#: The same in metres.
distance_m = _measure(True, True)
#: The same, computed once where a filter on it follows: the optimizer doesn't copy what it takes for nondeterministic.
distance_m_once = _measure(True, True).asNondeterministic()


def point_distance(p: Column, q: Column) -> Column:
    return F.hypot(p["x"] - q["x"], p["y"] - q["y"])


def point_segment_distance(p: Column, s: Column) -> Column:
    dx, dy = s["b"]["x"] - s["a"]["x"], s["b"]["y"] - s["a"]["y"]
    length = F.nullif(dx * dx + dy * dy, F.lit(0.0))
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((p["x"] - s["a"]["x"]) * dx + (p["y"] - s["a"]["y"]) * dy) / length))
    there = F.hypot(p["x"] - (s["a"]["x"] + t * dx), p["y"] - (s["a"]["y"] + t * dy))
    return F.when((F.abs(dx) <= EPSILON) & (F.abs(dy) <= EPSILON), point_distance(p, s["a"])).otherwise(there)


def segment_distance(s: Column, t: Column) -> Column:
    ends = F.least(point_segment_distance(s["a"], t), point_segment_distance(s["b"], t), point_segment_distance(t["a"], s), point_segment_distance(t["b"], s))
    return F.when(segments_intersect(s, t), 0.0).otherwise(ends)


def component_count(g: Column) -> Column:
    return F.size(g["polys"])


def hole_count(g: Column) -> Column:
    return F.aggregate(g["polys"], F.lit(0), lambda t, p: t + F.size(p) - 1)


def ring_problem(ring: Column) -> Column:
    """Null for a sound ring, else the first thing wrong with it."""
    finite = F.forall(ring, lambda p: p.isNotNull() & p["x"].isNotNull() & p["y"].isNotNull() & ~F.isnan(p["x"]) & ~F.isnan(p["y"]))
    ranged = F.forall(ring, lambda p: (F.abs(p["x"]) <= 180) & (F.abs(p["y"]) <= 90))
    first, last = F.element_at(ring, 1), F.element_at(ring, -1)
    span = F.array_max(F.transform(ring, lambda p: p["x"])) - F.array_min(F.transform(ring, lambda p: p["x"]))
    return (
        F.when(ring.isNull() | (F.size(ring) < 4), "too_few_points")
        .when(~finite, "not_finite")
        .when(~ranged, "out_of_range")
        .when((first["x"] != last["x"]) | (first["y"] != last["y"]), "not_closed")
        .when(span > 180, "antimeridian")
        .when(shoelace(ring) == 0, "zero_area")
        .when(self_intersects(ring), "self_intersection")
    )


def geometry_class(g: Column) -> Column:
    """point, line, polygon or mixed; null for an empty geometry."""
    has = lambda k: (F.size(g[k]) > 0).cast("int")
    return F.when(has("polys") + has("lines") + has("points") > 1, "mixed").when(has("polys") == 1, "polygon").when(has("lines") == 1, "line").when(has("points") == 1, "point")


def same_geometry(a: Column, b: Column) -> Column:
    """Whether two geometries have the same parts and coordinates in the same order."""
    return a.eqNullSafe(b)


def _authalic_sine(lat: Column) -> Column:
    """The sine of the authalic latitude: on a sphere of the ellipsoid's area, the place with as much area below it."""
    e, pole = math.sqrt(FLATTENING * (2 - FLATTENING)), _authalic_pole()
    es = F.sin(F.radians(lat)) * e
    return F.least(F.lit(1.0), F.greatest(F.lit(-1.0), (es / (1 - es * es) - F.log((1 - es) / (1 + es)) / 2) * ((1 - e * e) / e / pole)))


def _authalic_pole() -> float:
    e = math.sqrt(FLATTENING * (2 - FLATTENING))
    return 1 - (1 - e * e) / (2 * e) * math.log((1 - e) / (1 + e))


def geodesic_area_km2(ring: Column) -> Column:
    """The area of a ring in degrees on the WGS 84 ellipsoid, its edges great circles of the sphere that has the ellipsoid's area.

    For edges of some tens of kilometres these are its geodesics to some parts in ten million.
    """
    half = lambda p: F.tan(F.asin(_authalic_sine(p["y"])) / 2)
    turn = lambda a, b, t: F.tan(F.radians(b["x"] - a["x"]) / 2) * t
    placed = F.transform(ring, lambda p: F.struct(p["x"].alias("x"), half(p).alias("t")))
    excess = lambda s: 2 * F.atan2(turn(s["a"], s["b"], s["a"]["t"] + s["b"]["t"]), 1 + s["a"]["t"] * s["b"]["t"])
    return F.abs(F.aggregate(_pairs(placed), F.lit(0.0), lambda t, s: t + excess(s))) * (SEMI_AXIS_KM**2 * _authalic_pole() / 2)


@F.arrow_udf(T.StringType())
def _ring_faults(rings: pa.Array) -> pa.Array:
    """pairs.ring_fault of each polygon whose points are all there; a ring's own problems are told apart."""

    def one(value):
        if value is None or any(r is None or any(p is None or p["x"] is None or p["y"] is None for p in r) for r in value):
            return None
        return pairs.ring_fault([np.array([(p["x"], p["y"]) for p in r], float).reshape(-1, 2) for r in value])

    return pa.array([one(v) for v in rings.to_pylist()], pa.string())


def polygon_problem(rings: Column, most_km2: float | None = None) -> Column:
    """Null for a sound polygon (shell first, then holes), else what is wrong: a ring's own problem, rings that cross, a hole outside of the shell, holes in each other, too large an area.

    A hole may touch the shell or another hole in single points.
    """
    shell, holes = rings[0], F.slice(rings, F.lit(2), F.greatest(F.size(rings) - 1, F.lit(0)))
    own = F.get(F.array_compact(F.transform(rings, ring_problem)), F.lit(0))
    area = geodesic_area_km2(shell) - F.aggregate(holes, F.lit(0.0), lambda t, h: t + geodesic_area_km2(h))
    large = F.lit(False) if most_km2 is None else area > most_km2
    return F.coalesce(own, F.when(F.size(rings) == 0, "too_few_points"), _ring_faults(rings), F.when(large, "too_large"))


def self_intersects(ring: Column) -> Column:
    """Whether two edges that aren't neighbours meet."""
    numbered = F.transform(segments(ring), lambda s, i: F.struct(s["a"].alias("a"), s["b"].alias("b"), i.alias("i")))
    later = lambda own, s, t: (t["i"] > s["i"] + 1) & ~((s["i"] == 0) & (t["i"] == F.size(own) - 1))
    return let(numbered, lambda own: F.exists(own, lambda s: F.exists(own, lambda t: later(own, s, t) & segments_intersect(s, t))))


def canonical_ring(ring: Column, clockwise: bool = False) -> Column:
    """The ring's points from its least rotation, in one orientation, without the closing point: start and turn don't show.

    Only rotations that begin with the least point are compared, one after the other: one, unless that point repeats.
    """

    def turned(r: Column) -> Column:
        return let(F.slice(r, F.lit(1), F.greatest(F.size(r) - 1, F.lit(0))), lambda o: F.when((shoelace(r) < 0) != F.lit(clockwise), F.reverse(o)).otherwise(o))

    def least(t: Column) -> Column:
        n = F.size(t)
        from_ = lambda k: F.concat(F.slice(t, k, n - k + 1), F.slice(t, F.lit(1), k - 1))
        low = F.when(~F.exists(t, lambda p: p.isNull()), F.array_min(t))  # nulls come first
        starts = let(low, lambda p: F.filter(F.sequence(F.lit(1), n), lambda k: F.element_at(t, k).eqNullSafe(p)))
        return let(starts, lambda ks: F.aggregate(F.slice(ks, F.lit(2), F.size(ks)), from_(ks[0]), lambda best, k: F.least(best, from_(k))))

    return let(let(ring, turned), lambda t: F.when(F.size(t) > 0, least(t)).otherwise(t))


def grid_cells(box: Column, size: Column | float, margin: Column | float = 0.0) -> Column:
    """Numbers of the square cells that a box, widened by ``margin``, touches: the equi-join key of a spatial join."""
    size, margin = (v if isinstance(v, Column) else F.lit(float(v)) for v in (size, margin))
    cells = lambda low, high: F.sequence(F.floor((low - margin) / size).cast("long"), F.floor((high + margin) / size).cast("long"))
    return F.flatten(F.transform(cells(box["w"], box["e"]), lambda i: F.transform(cells(box["s"], box["n"]), lambda j: F.struct(i.alias("i"), j.alias("j")))))
