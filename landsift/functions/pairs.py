"""Exact predicates and distances of pairs of geometries, a block of pairs at a time.

Spark deals the pairs; a task turns a batch of them into flat arrays of vertices and edges and compares all edges
of a pair at once with numpy. A block holds MOST comparisons at most, so memory doesn't grow
with the batch. Pairs whose boxes are apart are settled without comparing edges.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Metres a degree. A point nearer to an edge than NEAR units lies on it.
METRES_LON, METRES_LAT, NEAR = 111_320.0, 110_540.0, 1e-6
MOST = 1 << 20


class Shapes:
    """Vertices and edges of the geometries of a column, with the row, ring and polygon that each belongs to."""

    def __init__(self, column: pa.Array):
        polys, lines, points = (pc.struct_field(column, k) for k in ("polys", "lines", "points"))
        number = lambda a: a.to_numpy(zero_copy_only=False).astype(np.int64)
        self.rows = len(column)
        rings, own = pc.list_flatten(polys), number(pc.list_parent_indices(polys))
        poly = number(pc.list_parent_indices(rings))
        ends = pc.list_flatten(rings)
        ring = number(pc.list_parent_indices(ends))
        corner, bends, spots = pc.list_flatten(ends), pc.list_flatten(lines), points
        bend, line = pc.list_flatten(bends), number(pc.list_parent_indices(bends))
        spot = pc.list_flatten(spots)
        xy = lambda a: np.stack([pc.struct_field(a, k).to_numpy(zero_copy_only=False).astype(float) for k in "xy"], axis=1) if len(a) else np.zeros((0, 2))
        corners, bent = xy(corner), xy(bend)
        self.poly_row, self.ring_poly = own, poly
        self.ring_row = own[poly]
        self.shell = np.concatenate(([True], poly[1:] != poly[:-1])) if len(poly) else np.zeros(0, bool)
        line_row = number(pc.list_parent_indices(lines))
        self.xy = np.concatenate((corners, bent, xy(spot)))
        self.row = np.concatenate((self.ring_row[ring], line_row[line], number(pc.list_parent_indices(spots))))
        a, b, of = _edges(corners, ring, True)
        c, d, along = _edges(bent, line, False)
        self.a, self.b = np.concatenate((a, c)), np.concatenate((b, d))
        self.edge_row = np.concatenate((self.ring_row[of], line_row[along]))
        self.edge_ring = np.concatenate((of, np.full(len(along), -1, np.int64)))

    def move(self, home: np.ndarray, scale: np.ndarray) -> None:
        self.xy = (self.xy - home[self.row]) * scale[self.row]
        self.a, self.b = ((p - home[self.edge_row]) * scale[self.edge_row] for p in (self.a, self.b))

    def boxes(self) -> tuple[np.ndarray, np.ndarray]:
        low, high = np.full((self.rows, 2), np.inf), np.full((self.rows, 2), -np.inf)
        np.minimum.at(low, self.row, self.xy)
        np.maximum.at(high, self.row, self.xy)
        return low, high


def _edges(points: np.ndarray, group: np.ndarray, closed: bool):
    """(starts, ends, group) of the edges between distinct neighbours; an open ring is closed."""
    inner = np.flatnonzero(group[1:] == group[:-1]) if len(group) else np.zeros(0, np.int64)
    a, b = inner, inner + 1
    if closed and len(group):
        last = np.flatnonzero(np.append(group[1:] != group[:-1], True))
        first = np.concatenate(([0], last[:-1] + 1))
        a, b = np.concatenate((a, last)), np.concatenate((b, first))
    there = (points[a] != points[b]).any(axis=1)
    a, b = a[there], b[there]
    return points[a], points[b], group[a]


def _grouped(row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(items by row, where each row's start, how many)"""
    count = np.bincount(row, minlength=rows)
    return np.argsort(row, kind="stable"), np.concatenate(([0], np.cumsum(count)[:-1])).astype(np.int64), count


def _crossed(left: np.ndarray, right: np.ndarray, rows: int, wanted: np.ndarray):
    """Blocks (row, left item, right item) of all combinations within each wanted row."""
    (lo, ls, ln), (ro, rs, rn) = _grouped(left, rows), _grouped(right, rows)
    # one run a left item of a wanted row: the row's right items
    run_row = np.repeat(wanted, ln[wanted])
    run_item = lo[np.repeat(ls[wanted] - np.concatenate(([0], np.cumsum(ln[wanted])[:-1])), ln[wanted]) + np.arange(len(run_row))] if len(run_row) else run_row
    size, at = rn[run_row], 0
    ends = np.cumsum(size)
    while at < len(run_row):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + MOST, "right")))
        n = size[at:to]
        within = np.arange(int(n.sum())) - np.repeat(np.concatenate(([0], np.cumsum(n)[:-1])), n)
        yield np.repeat(run_row[at:to], n), np.repeat(run_item[at:to], n), ro[np.repeat(rs[run_row[at:to]], n) + within]
        at = to


def _to_edge(p: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distance of points from edges."""
    d = b - a
    t = np.clip(((p - a) * d).sum(axis=1) / (d * d).sum(axis=1), 0, 1)
    return np.hypot(*(p - (a + t[:, None] * d)).T)


def _crossing(a, b, c, d, near: float = NEAR) -> np.ndarray:
    """Edges that pass through each other, clear of all ends."""

    def off(p, q, r):  # distance of r from the line through p and q, with its side
        u = q - p
        return (u[:, 0] * (r[:, 1] - p[:, 1]) - u[:, 1] * (r[:, 0] - p[:, 0])) / np.hypot(*u.T)

    o1, o2, o3, o4 = off(a, b, c), off(a, b, d), off(c, d, a), off(c, d, b)
    clear = np.min(np.abs([o1, o2, o3, o4]), axis=0) > near
    return clear & ((o1 > 0) != (o2 > 0)) & ((o3 > 0) != (o4 > 0))


def _inside(points: Shapes, other: Shapes, wanted: np.ndarray, met: np.ndarray) -> None:
    """Marks rows where a vertex lies in a polygon of the other geometry, clear of its holes. Vertices on edges are settled before."""
    rings = len(other.ring_row)
    if not rings or not len(points.row):
        return
    flips: dict = {}
    in_ring = other.edge_ring >= 0
    edges = np.flatnonzero(in_ring)
    for row, p, e in _crossed(points.row, other.edge_row[edges], points.rows, wanted):
        e = edges[e]
        a, b, v = other.a[e], other.b[e], points.xy[p]
        over = (a[:, 1] > v[:, 1]) != (b[:, 1] > v[:, 1])
        p, e, a, b, v = p[over], e[over], a[over], b[over], v[over]
        left = v[:, 0] < (b[:, 0] - a[:, 0]) * (v[:, 1] - a[:, 1]) / (b[:, 1] - a[:, 1]) + a[:, 0]
        key, n = np.unique(p[left] * rings + other.edge_ring[e[left]], return_counts=True)
        for k in key[n % 2 == 1].tolist():  # few: a ring around a vertex
            flips[k] = not flips.get(k, False)
    found = np.array([k for k, odd in flips.items() if odd], np.int64)
    if not len(found):
        return
    vertex, ring = np.divmod(found, rings)
    polys = len(other.poly_row)
    key = vertex * polys + other.ring_poly[ring]
    within, holed = np.unique(key[other.shell[ring]]), np.unique(key[~other.shell[ring]])
    met[points.row[np.setdiff1d(within, holed) // polys]] = True


def measures(left: pa.Array, right: pa.Array, project: bool, distance: bool) -> tuple[np.ndarray, np.ndarray]:
    """(whether the geometries of each pair meet, their distance: 0 where they meet, infinite where one is empty)."""
    a, b = Shapes(left), Shapes(right)
    if project:
        n = np.maximum(np.bincount(a.row, minlength=a.rows) + np.bincount(b.row, minlength=b.rows), 1)
        home = np.stack([(np.bincount(a.row, a.xy[:, k], a.rows) + np.bincount(b.row, b.xy[:, k], b.rows)) / n for k in (0, 1)], axis=1)
        scale = np.stack([METRES_LON * np.cos(np.radians(home[:, 1])), np.full(a.rows, METRES_LAT)], axis=1)
        a.move(home, scale)
        b.move(home, scale)
    (alow, ahigh), (blow, bhigh) = a.boxes(), b.boxes()
    close = np.flatnonzero(((alow <= bhigh + NEAR) & (blow <= ahigh + NEAR)).all(axis=1))
    met, least = np.zeros(a.rows, bool), np.full(a.rows, np.inf)
    wanted = np.arange(a.rows) if distance else close
    for row, p, q in _crossed(a.row, b.row, a.rows, wanted):
        np.minimum.at(least, row, np.hypot(*(a.xy[p] - b.xy[q]).T))
    for x, y in ((a, b), (b, a)):
        for row, p, e in _crossed(x.row, y.edge_row, a.rows, wanted):
            np.minimum.at(least, row, _to_edge(x.xy[p], y.a[e], y.b[e]))
    met |= least <= NEAR
    for row, s, t in _crossed(a.edge_row, b.edge_row, a.rows, close[~met[close]]):
        met[row[_crossing(a.a[s], a.b[s], b.a[t], b.b[t])]] = True
    _inside(a, b, close[~met[close]], met)
    _inside(b, a, close[~met[close]], met)
    return met, np.where(met, 0.0, least)


def _within(points: np.ndarray, a: np.ndarray, b: np.ndarray, near: float) -> np.ndarray:
    """Which points lie in the ring of the edges a to b, its boundary included."""
    out = np.zeros(len(points), bool)
    for at in range(0, len(points), max(1, MOST // max(len(a), 1))):
        p = points[at : at + max(1, MOST // max(len(a), 1))]
        n, m = len(p), len(a)
        q, s, e = np.repeat(p, m, axis=0), np.tile(a, (n, 1)), np.tile(b, (n, 1))
        over = (s[:, 1] > q[:, 1]) != (e[:, 1] > q[:, 1])
        rise = np.where(over, e[:, 1] - s[:, 1], 1.0)
        left = over & (q[:, 0] < (e[:, 0] - s[:, 0]) * (q[:, 1] - s[:, 1]) / rise + s[:, 0])
        out[at : at + n] = (left.reshape(n, m).sum(axis=1) % 2 == 1) | (_to_edge(q, s, e) <= near).reshape(n, m).any(axis=1)
    return out


def ring_fault(rings: list[np.ndarray], near: float = 1e-9) -> str | None:
    """What is wrong between the closed rings of one polygon: rings_cross, hole_outside (of the shell), holes_nest, or nothing. Touching is allowed."""
    if len(rings) < 2:
        return None
    edges = [_edges(r, np.zeros(len(r), np.int64), True)[:2] for r in rings]
    for k, (a, b) in enumerate(edges):
        for c, d in edges[k + 1 :]:
            step = max(1, MOST // max(len(c), 1))
            for at in range(0, len(a), step):
                s, e = a[at : at + step], b[at : at + step]
                n, m = len(s), len(c)
                if n and m and _crossing(np.repeat(s, m, axis=0), np.repeat(e, m, axis=0), np.tile(c, (n, 1)), np.tile(d, (n, 1)), near).any():
                    return "rings_cross"
    if not all(_within(r, *edges[0], near).all() for r in rings[1:]):
        return "hole_outside"
    if any(i != j and _within(rings[j], *edges[i], near).all() for i in range(1, len(rings)) for j in range(1, len(rings))):
        return "holes_nest"
    return None
