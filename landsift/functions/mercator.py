"""Web Mercator: the transform as column expressions."""

from __future__ import annotations

import math

import pyspark.sql.functions as F
from pyspark.sql import Column

from landsift.functions.geometry import point

RADIUS, EXTENT, MOST_LAT = 6378137.0, 20_037_509.0, 85.05112878


def forward(p: Column) -> Column:
    """Degrees to metres of EPSG:3857."""
    lat = F.least(F.lit(MOST_LAT), F.greatest(F.lit(-MOST_LAT), p["y"]))
    return point(F.radians(p["x"]) * RADIUS, F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)) * RADIUS)


def polygon_forward(rings: Column) -> Column:
    return F.transform(rings, lambda r: F.transform(r, forward))


def extent_ok(box: Column) -> Column:
    return F.forall(F.array(box["w"], box["s"], box["e"], box["n"]), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) <= EXTENT))


def tile_west_edge(zoom: Column, x: Column) -> Column:
    return x / F.pow(F.lit(2.0), zoom) * 360 - 180


def tile_envelope(zoom: Column, x: Column, y: Column, extent: int = 4096, buffer: int = 64) -> Column:
    """struct<w,s,e,n> in metres of a tile widened by its buffer."""
    side = F.lit(2 * math.pi * RADIUS) / F.pow(F.lit(2.0), zoom)
    edge, more = math.pi * RADIUS, side * buffer / extent
    w, n = x * side - edge, F.lit(edge) - y * side
    return F.struct((w - more).alias("w"), (n - side - more).alias("s"), (w + side + more).alias("e"), (n + more).alias("n"))
