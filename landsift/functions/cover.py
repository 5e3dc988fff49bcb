"""Whether one polygon geometry covers another: no part of the other lies outside of it, its boundary included."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyspark.sql.functions as F
from pyspark.sql import types as T

from landsift.functions.display import MOST_PAIRS, _cross, _inside, _off, _polygons

#: A place nearer to an edge than this share of the geometries' extent lies on it.
NEAR = 1e-10


def _edges(polygons: list[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    rings = [r for p in polygons for r in p]
    return (np.concatenate([r[:-1] for r in rings]), np.concatenate([r[1:] for r in rings])) if rings else (np.zeros((0, 2)),) * 2


def _pieces(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray, near: float) -> np.ndarray:
    """The middles of the pieces into which the edges c-d cut the edges a-b; each lies on one side of all of them, or along one."""
    owner, at = [np.arange(len(a)), np.arange(len(a))], [np.zeros(len(a)), np.ones(len(a))]
    step = max(1, MOST_PAIRS // max(len(c), 1))
    low, high = np.minimum(c, d) - near, np.maximum(c, d) + near
    for k in range(0, len(a), step):
        p, q = a[k : k + step], b[k : k + step]
        i, j = np.nonzero(((np.minimum(p, q)[:, None] <= high[None]) & (low[None] <= np.maximum(p, q)[:, None])).all(axis=2))
        p, v, s, w = p[i], q[i] - p[i], c[j], d[j] - c[j]
        turn, length = _cross(v, w), (v * v).sum(axis=1)
        across = np.abs(turn) > 1e-12 * np.sqrt(length * (w * w).sum(axis=1))
        safe = np.where(across, turn, 1.0)
        t, u = _cross(s - p, w) / safe, _cross(s - p, v) / safe
        slack = near / np.maximum(np.hypot(w[:, 0], w[:, 1]), near)
        met = across & (u >= -slack) & (u <= 1 + slack)
        owner.append(k + i[met])
        at.append(t[met])
        for end in (s, s + w):  # along each other: the other's ends
            owner.append(k + i[~across])
            at.append((((end - p) * v).sum(axis=1) / np.where(length > 0, length, 1.0))[~across])
    owner, at = np.concatenate(owner), np.clip(np.concatenate(at), 0.0, 1.0)
    order = np.lexsort((at, owner))
    owner, at = owner[order], at[order]
    same = owner[1:] == owner[:-1]
    middle, own, size = (at[1:] + at[:-1])[same] / 2, owner[1:][same], (at[1:] - at[:-1])[same]
    kept = size * np.hypot(*(b[own] - a[own]).T) > 2 * near
    return a[own[kept]] + middle[kept, None] * (b[own[kept]] - a[own[kept]])


def _on(points: np.ndarray, a: np.ndarray, b: np.ndarray, near: float) -> np.ndarray:
    """Whether each point lies on one of the edges."""
    out = np.zeros(len(points), bool)
    step = max(1, MOST_PAIRS // max(len(a), 1))
    for k in range(0, len(points), step):
        p = points[k : k + step]
        i, j = np.nonzero(((p[:, None] >= np.minimum(a, b)[None] - near) & (p[:, None] <= np.maximum(a, b)[None] + near)).all(axis=2))
        out[k + i[_off(p[i], a[j], b[j]) <= near]] = True
    return out


def _within(polygon: list[np.ndarray]) -> np.ndarray:
    """A place inside of a polygon: the middle of the widest stretch along a line between two of its vertices."""
    a, b = _edges([polygon])
    heights = np.unique(a[:, 1])
    gaps = np.diff(heights)
    y = heights[int(gaps.argmax())] + gaps.max() / 2
    over = (a[:, 1] > y) != (b[:, 1] > y)
    p, q = a[over], b[over]
    x = np.sort(p[:, 0] + (y - p[:, 1]) * (q[:, 0] - p[:, 0]) / (q[:, 1] - p[:, 1]))
    widest = int((x[1::2] - x[::2]).argmax())
    return np.array([(x[2 * widest] + x[2 * widest + 1]) / 2, y])


def covers(outer: list[list[np.ndarray]], inner: list[list[np.ndarray]]) -> bool:
    """Whether ``outer`` covers ``inner``; both are valid multipolygons, so their parts share no edges. An empty one is covered by any.

    All of the inner boundary must lie in the outer polygons or on their boundary, and no outer boundary inside of the inner polygons:
    else a hole, or a gap between parts, would be uncovered. Then each inner polygon is in or out as a whole, which one place tells.
    """
    a, b = _edges(outer)
    c, d = _edges(inner)
    if not len(c):
        return True
    if not len(a):
        return False
    near = NEAR * float(max(np.ptp(a, axis=0).max(), np.ptp(c, axis=0).max()))
    if (np.minimum(c, d).min(axis=0) < a.min(axis=0) - near).any() or (np.maximum(c, d).max(axis=0) > a.max(axis=0) + near).any():
        return False
    spots = np.concatenate((c, _pieces(c, d, a, b, near)))
    out = ~_inside(spots, a, b)
    if out.any() and not _on(spots[out], a, b, near).all():
        return False
    spots = _pieces(a, b, c, d, near)
    within = _inside(spots, c, d)
    if within.any() and not _on(spots[within], c, d, near).all():
        return False
    return bool(_inside(np.array([_within(p) for p in inner]), a, b).all())


@F.arrow_udf(T.BooleanType())
def polygons_cover(outer: pa.Array, inner: pa.Array) -> pa.Array:
    """``covers`` of two columns of polygons (arrays of polygons, each an array of rings); null if either is."""
    sides = []
    for column in (outer, inner):
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        flat, at, found = _polygons(column.flatten()), 0, []
        for n in pc.list_value_length(column).to_pylist():
            found.append(None if n is None else flat[at : at + n])
            at += n or 0
        sides.append(found)
    return pa.array([None if a is None or b is None else covers(a, b) for a, b in zip(*sides, strict=True)], pa.bool_())
