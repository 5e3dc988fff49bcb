"""Polygons for display: simplified without losing topology, subdivided into valid parts, and put together again.

A polygon is a list of closed rings, the shell first, as (n, 2) arrays. Each function works on one polygon with numpy; the Arrow
functions at the end read and write a batch of them as flat arrays. What a polygon needs is in proportion to its own vertices.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyspark.sql.functions as F
from pyspark.sql import types as T

POINTS = T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))
POLYGON = T.ArrayType(POINTS)
#: Places nearer to each other than this share of a polygon's extent are one.
NEAR = 1e-12
BLOCK, MOST_PAIRS, MOST_DEPTH = 64, 1 << 18, 60


def signed_area(ring: np.ndarray) -> float:
    p = ring - ring[0]
    return float((p[:-1, 0] * p[1:, 1] - p[1:, 0] * p[:-1, 1]).sum() / 2)


def area(rings: list[np.ndarray]) -> float:
    return abs(signed_area(rings[0])) - sum(abs(signed_area(r)) for r in rings[1:])


def _cross(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a[..., 0] * b[..., 1] - a[..., 1] * b[..., 0]


def _reach(p: np.ndarray) -> float:
    return float(np.ptp(p, axis=0).max()) * NEAR if len(p) else 0.0


def _meet(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray, near: float) -> np.ndarray:
    """Whether the segments a-b and c-d cross or touch, row by row."""
    ab, cd = b - a, d - c
    slack_ab, slack_cd = near * np.hypot(ab[..., 0], ab[..., 1]), near * np.hypot(cd[..., 0], cd[..., 1])
    side = lambda v, slack: np.where(v > slack, 1, np.where(v < -slack, -1, 0))
    apart = (side(_cross(ab, c - a), slack_ab) * side(_cross(ab, d - a), slack_ab) > 0) | (side(_cross(cd, a - c), slack_cd) * side(_cross(cd, b - c), slack_cd) > 0)
    boxes = (np.minimum(a, b) <= np.maximum(c, d) + near).all(axis=-1) & (np.minimum(c, d) <= np.maximum(a, b) + near).all(axis=-1)
    return boxes & ~apart


def _inside(points: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether each point has an odd number of the edges a-b to its right."""
    out = np.zeros(len(points), bool)
    for k in range(0, len(points), max(1, MOST_PAIRS // max(len(a), 1))):
        p = points[k : k + max(1, MOST_PAIRS // max(len(a), 1))]
        over = (a[None, :, 1] > p[:, 1, None]) != (b[None, :, 1] > p[:, 1, None])
        rise = np.where(over, b[:, 1] - a[:, 1], 1.0)
        at = a[:, 0] + (p[:, 1, None] - a[:, 1]) * ((b[:, 0] - a[:, 0]) / rise)
        out[k : k + len(p)] = (over & (p[:, 0, None] < at)).sum(axis=1) % 2 == 1
    return out


def _pairs(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of edges whose boxes meet, by a sweep along x, some at a time."""
    low, high = np.minimum(a, b), np.maximum(a, b)
    order = np.argsort(low[:, 0], kind="stable")
    low, high = low[order], high[order]
    n = np.searchsorted(low[:, 0], high[:, 0], "right") - np.arange(len(order)) - 1
    edges = [0, *np.flatnonzero(np.diff(np.cumsum(n) // MOST_PAIRS)) + 1, len(order)]
    for start, stop in zip(edges, edges[1:], strict=False):
        part = n[start:stop]
        i = np.repeat(np.arange(start, stop), part)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(part) - part, part)
        hit = (low[i, 1] <= high[j, 1]) & (low[j, 1] <= high[i, 1])
        yield order[i[hit]], order[j[hit]]


def fault(rings: list[np.ndarray], touching: bool = False) -> str | None:
    """What makes a polygon invalid, or None. ``touching``: rings may touch each other in single vertices."""
    for r in rings:
        if len(r) < 4 or (r[0] != r[-1]).any() or signed_area(r) == 0:
            return "degenerate"
    a, b = np.concatenate([r[:-1] for r in rings]), np.concatenate([r[1:] for r in rings])
    ring = np.repeat(np.arange(len(rings)), [len(r) - 1 for r in rings])
    if (a == b).all(axis=1).any():
        return "degenerate"
    near = _reach(a)
    for i, j in _pairs(a, b):
        same = ring[i] == ring[j]
        after, before = same & (b[i] == a[j]).all(axis=1), same & (b[j] == a[i]).all(axis=1)
        # neighbours share a vertex; they must not run back over each other
        for x, y in ((i[after], j[after]), (j[before], i[before])):
            back, on = a[x] - b[x], b[y] - a[y]
            if ((np.abs(_cross(back, on)) <= near * np.hypot(back[:, 0], back[:, 1])) & ((back * on).sum(axis=1) > 0)).any():
                return "spike"
        i, j = i[~(after | before)], j[~(after | before)]
        met = _meet(a[i], b[i], a[j], b[j], near)
        if touching:
            shared = (ring[i] != ring[j]) & np.logical_or.reduce([(p[i] == q[j]).all(axis=1) for p in (a, b) for q in (a, b)])
            met &= ~shared
        if met.any():
            return "crossing"
    for k in range(1, len(rings)):
        for m in range(len(rings)):
            if m != k and _sees(rings[k], rings[m]) != (m == 0):
                return "hole_outside" if m == 0 else "holes_nest"
    return None


def _sees(ring: np.ndarray, other: np.ndarray) -> bool:
    """Whether ``ring``, which doesn't cross ``other``, lies inside of it; told by most of its places, as some may touch."""
    if (ring.max(axis=0) < other.min(axis=0)).any() or (ring.min(axis=0) > other.max(axis=0)).any():
        return False
    places = np.concatenate((ring[:-1], (ring[:-1] + ring[1:]) / 2))[:: max(1, len(ring) // 16)]
    return bool(_inside(places, other[:-1], other[1:]).mean() > 0.5)


def _off(points: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Distances of points from segments, row by row."""
    d, v = q - p, points - p
    length = (d * d).sum(axis=-1)
    t = np.clip((v * d).sum(axis=-1) / np.where(length > 0, length, 1.0), 0.0, 1.0)
    rest = v - t[..., None] * d
    return np.hypot(rest[..., 0], rest[..., 1])


def _kept(ring: np.ndarray, tolerance: float) -> np.ndarray:
    """Which vertices of a closed ring stay if each section is replaced that is nowhere farther off; all sections of a round at once."""
    n = len(ring) - 1
    keep = np.zeros(n + 1, bool)
    far = int(((ring[:-1] - ring[0]) ** 2).sum(axis=1).argmax())
    keep[[0, far, n]] = True
    a, b = np.array([0, far]), np.array([far, n])
    while True:
        open_ = b - a > 1
        a, b = a[open_], b[open_]
        if not len(a):
            return keep
        size = b - a - 1
        first = np.cumsum(size) - size
        at = np.arange(int(size.sum())) - np.repeat(first - a - 1, size)
        off = _off(ring[at], np.repeat(ring[a], size, axis=0), np.repeat(ring[b], size, axis=0))
        most = np.maximum.reduceat(off, first)
        mid = np.minimum.reduceat(np.where(off == np.repeat(most, size), at, n), first)
        split = most > tolerance
        a, mid, b = a[split], mid[split], b[split]
        keep[mid] = True
        a, b = np.concatenate((a, mid)), np.concatenate((mid, b))


class _Outline:
    """The current edges of a polygon while sections are replaced one by one; it stays valid after each."""

    def __init__(self, rings: list[np.ndarray]):
        self.p = np.concatenate([r[:-1] for r in rings])
        size = np.array([len(r) - 1 for r in rings])
        self.start, n = np.cumsum(size) - size, len(self.p)
        self.ring = np.repeat(np.arange(len(rings)), size)
        self.after = np.arange(1, n + 1)
        self.after[self.start + size - 1] = self.start
        self.alive, self.near = np.ones(n, bool), _reach(self.p)
        self.area = [signed_area(r) for r in rings]
        low, high = np.minimum(self.p, self.p[self.after]), np.maximum(self.p, self.p[self.after])
        cut = np.arange(0, n, BLOCK)
        self.low, self.high = np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut)

    def about(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Vertices from which an edge starts that may meet a box."""
        hit = np.flatnonzero((self.low <= high + self.near).all(axis=1) & (self.high >= low - self.near).all(axis=1))
        at = (hit[:, None] * BLOCK + np.arange(BLOCK)).ravel()
        at = at[at < len(self.p)]
        return at[self.alive[at]]

    def may_replace(self, ring: int, section: np.ndarray) -> bool:
        """Whether the edge from the first to the last vertex of ``section`` keeps all rings apart and on their sides."""
        first, last = section[0], section[-1]
        p, q = self.p[first], self.p[last]
        path = self.p[section]
        closed = np.concatenate((path, path[:1]))
        left = self.area[ring] - signed_area(closed)
        if (p == q).all() or left * self.area[ring] <= 0 or abs(left) <= self.near**2:
            return False
        at = self.about(np.minimum(p, q), np.maximum(p, q))
        own = np.isin(at, section[:-1])
        at = at[~own]
        a, b = self.p[at], self.p[self.after[at]]
        before, behind = (self.after[at] == first) & (self.ring[at] == ring), at == last
        for beside, away, corner, chord in ((before, a, p, q - p), (behind, b, q, p - q)):  # it must not run back over its neighbours
            v = away[beside] - corner
            if ((np.abs(_cross(v, chord)) <= self.near * np.hypot(*chord)) & ((v * chord).sum(axis=1) > 0)).any():
                return False
        rest = ~(before | behind)
        if _meet(p[None, :], q[None, :], a[rest], b[rest], self.near).any():
            return False
        low, high = path.min(axis=0), path.max(axis=0)
        others = self.about(low, high)
        others = others[self.ring[others] != ring]
        spots = self.p[others]
        spots = spots[(spots >= low - self.near).all(axis=1) & (spots <= high + self.near).all(axis=1)]
        if not len(spots):
            return True
        if _inside(spots, closed[:-1], closed[1:]).any():
            return False
        return not any((_off(s[None, :], closed[:-1], closed[1:]) <= self.near).any() for s in spots)

    def replace(self, ring: int, section: np.ndarray) -> None:
        path = self.p[section]
        self.area[ring] -= signed_area(np.concatenate((path, path[:1])))
        self.alive[section[1:-1]] = False
        self.after[section[0]] = section[-1]
        block = section[0] // BLOCK
        self.low[block], self.high[block] = np.minimum(self.low[block], path[-1]), np.maximum(self.high[block], path[-1])

    def rings(self) -> list[np.ndarray]:
        found = [self.p[(self.ring == k) & self.alive] for k in range(len(self.start))]
        return [np.concatenate((r, r[:1])) for r in found]


def _carefully(rings: list[np.ndarray], tolerance: float) -> list[np.ndarray]:
    outline = _Outline(rings)
    for k, r in enumerate(rings):
        n, base = len(r) - 1, outline.start[k]
        far = int(((r[:-1] - r[0]) ** 2).sum(axis=1).argmax())
        todo = [(far, n), (0, far)]
        while todo:
            a, b = todo.pop()
            if b - a < 2:
                continue
            off = _off(r[a + 1 : b], r[a], r[b])
            section = base + np.arange(a, b + 1) % n
            if off.max() <= tolerance and outline.may_replace(k, section):
                outline.replace(k, section)
            else:
                mid = a + 1 + int(off.argmax())
                todo += [(mid, b), (a, mid)]
    return outline.rings()


def simplified(rings: list[np.ndarray], tolerance: float) -> list[np.ndarray]:
    """The polygon with vertices left out that are ``tolerance`` off at most; as many rings as before, none crossing, each on its side.

    Sections are replaced freely first; if that makes rings cross, jump or collapse, one by one, each only where the polygon stays valid.
    """
    if tolerance <= 0:
        return rings
    found = [r[_kept(r, tolerance)] for r in rings]
    return found if fault(found) is None else _carefully(rings, tolerance)


def _place(values: np.ndarray) -> Iterator[float]:
    """Places to cut at, between neighbouring coordinates, the widest gaps about the middle first."""
    values = np.unique(values)
    low, high = values[0], values[-1]
    middle, gap = (values[1:] + values[:-1]) / 2, np.diff(values)
    inner = (middle > values[:-1]) & (middle < values[1:])
    central = np.abs(middle - (low + high) / 2) <= (high - low) / 5
    for k in np.lexsort((np.arange(len(gap)), -gap, ~central)):
        if inner[k]:
            yield float(middle[k])


def cut(rings: list[np.ndarray], axis: int, at: float) -> tuple[list[list[np.ndarray]], list[list[np.ndarray]]]:
    """The parts of a polygon below and above a line that is parallel to an axis and holds none of its vertices.

    Crossings are sorted along the line; the polygon's inside lies between the first and second, third and fourth, and so on.
    """
    rings = [r if (signed_area(r) > 0) == (k == 0) else r[::-1] for k, r in enumerate(rings)]
    arcs: list[tuple[bool, int, np.ndarray, int]] = []  # side, first crossing, points between, last crossing
    whole: list[tuple[bool, np.ndarray, bool]] = []
    crossings: list[np.ndarray] = []
    for k, r in enumerate(rings):
        below = r[:-1, axis] < at
        change = np.flatnonzero(below != np.roll(below, -1))
        if not len(change):
            whole.append((bool(below[0]), r, k == 0))
            continue
        p, q = r[change], r[change + 1]
        swap = (p[:, axis] > q[:, axis])[:, None]  # the same place whichever way an edge runs
        lo, hi = np.where(swap, q, p), np.where(swap, p, q)
        spot = lo + ((at - lo[:, axis]) / (hi[:, axis] - lo[:, axis]))[:, None] * (hi - lo)
        spot[:, axis] = at
        base = sum(map(len, crossings))
        crossings.append(spot)
        n = len(change)
        for m in range(n):
            a, b = change[m] + 1, change[(m + 1) % n] + 1
            inner = r[a:b] if a < b else np.concatenate((r[a:-1], r[:b]))
            arcs.append((bool(below[a % len(below)]), base + m, inner, base + (m + 1) % n))
    sides: tuple[list, list] = ([], [])
    spots = np.concatenate(crossings) if crossings else np.zeros((0, 2))
    along = np.argsort(spots[:, 1 - axis], kind="stable")
    rank = np.empty(len(along), np.int64)
    rank[along] = np.arange(len(along))
    for below, out in ((True, sides[0]), (False, sides[1])):
        mine = {first: (inner, last) for side, first, inner, last in arcs if side == below}
        while mine:
            first, (inner, last) = mine.popitem()
            points, start = [spots[first], *inner, spots[last]], first
            while (on := int(along[rank[last] ^ 1])) != start:
                inner, last = mine.pop(on)
                points += [spots[on], *inner, spots[last]]
            out.append([np.array([*points, points[0]])])
        shells = [r for side, r, shell in whole if shell and side == below]
        out += [[r] for r in shells]
        for side, r, shell in whole:
            if not shell and side == below:
                next(p for p in out if len(out) == 1 or _sees(r, p[0])).append(r)
    return sides


def subdivided(rings: list[np.ndarray], most: int) -> list[list[np.ndarray]]:
    """Valid parts of at most ``most`` vertices, closing ones counted, that meet in edges only and make up the polygon, in a fixed order."""
    done, todo = [], [(rings, 0)]
    while todo:
        part, depth = todo.pop()
        if sum(map(len, part)) <= most or depth > MOST_DEPTH:
            done.append(part)
            continue
        points = np.concatenate(part)
        longer = int(np.ptp(points, axis=0).argmax())
        halves = None
        for axis in (longer, 1 - longer):
            for _, at in zip(range(8), _place(points[:, axis]), strict=False):
                try:
                    found = cut(part, axis, at)
                except (KeyError, StopIteration):  # crossings too near to each other to be told apart
                    continue
                if all(found) and all(fault(p, True) is None for side in found for p in side):
                    halves = found
                    break
            if halves:
                break
        if halves is None:
            done.append(part)
        else:
            todo += [(p, depth + 1) for side in halves for p in side]
    return sorted(done, key=lambda p: (*p[0].min(axis=0).tolist(), *p[0].max(axis=0).tolist(), len(p[0])))


def _directed(rings: list[np.ndarray]) -> list[np.ndarray]:
    """Edges (x, y, x, y), shells turning left, holes right."""
    rings = [r if (signed_area(r) > 0) == (k == 0) else r[::-1] for k, r in enumerate(rings)]
    return [np.concatenate((r[:-1], r[1:]), axis=1) for r in rings]


def recomposed(rings: list[np.ndarray], parts: list[list[np.ndarray]]) -> bool:
    """Whether the parts make up the polygon: along cuts edges cancel, and what is left is the polygon's outline.

    Cut edges occur twice, reversed, though not with the same ends; along each line their directions must sum up to
    nothing. Edges that were cut are joined again at the cuts and must then be the polygon's own edges, each once.
    """
    whole = np.concatenate(_directed(rings))
    corners = set(map(tuple, whole[:, :2].tolist()))
    pieces = np.concatenate([e for p in parts for e in _directed(p)]) if parts else np.zeros((0, 4))
    near = 1e3 * _reach(np.concatenate(rings))
    own = np.array([[(x, y) in corners for x, y in (e[:2], e[2:])] for e in pieces.tolist()], bool).reshape(-1, 2)
    left = []
    for axis in (0, 1):
        on = (pieces[:, axis] == pieces[:, axis + 2]) & ~own.any(axis=1)
        lines: dict[float, list[tuple[float, float, tuple]]] = {}
        for e in pieces[on].tolist():
            lines.setdefault(e[axis], []).append((e[1 - axis], e[3 - axis], tuple(e)))
        for found in lines.values():
            net: dict[float, int] = {}
            for a, b, _ in found:
                net[a] = net.get(a, 0) + 1
                net[b] = net.get(b, 0) - 1
            if any(net.values()):  # an edge of the outline that lies along a line and was cut twice
                left += [e for _, _, e in found]
        pieces, own = pieces[~on], own[~on]
    after: dict[tuple, list[tuple]] = {}
    starts = []
    for e, (is_corner, _) in zip([*pieces.tolist(), *left], [*own.tolist(), *[[False, False]] * len(left)], strict=True):
        if is_corner:
            starts.append((tuple(e[:2]), tuple(e[2:])))
        else:
            after.setdefault(tuple(e[:2]), []).append(tuple(e[2:]))
    made = []
    for start, to in starts:
        passed = []
        while to not in corners:
            if len(after.get(to, ())) != 1:
                return False
            passed.append(to)
            to = after.pop(to)[0]
        if passed and (_off(np.array(passed), np.array(start), np.array(to)) > near).any():
            return False
        made.append((*start, *to))
    return not after and sorted(made) == sorted(map(tuple, whole.tolist()))


def _polygons(column: pa.Array) -> list[list[np.ndarray] | None]:
    """The polygons of a column (array of rings of points), cut from flat arrays."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    rings = column.flatten()
    points = rings.flatten()
    xy = np.column_stack([pc.struct_field(points, k).to_numpy(zero_copy_only=False) for k in "xy"]).astype(float) if len(points) else np.zeros((0, 2))
    sizes = np.cumsum(np.concatenate(([0], pc.fill_null(pc.list_value_length(rings), 0).to_numpy(zero_copy_only=False)))).astype(np.int64)
    counts = pc.list_value_length(column).to_pylist()
    out, at = [], 0
    for n in counts:
        out.append(None if n is None else [xy[sizes[k] : sizes[k + 1]] for k in range(at, at + n)])
        at += n or 0
    return out


_POINT = pa.struct([("x", pa.float64()), ("y", pa.float64())])


def _lists(sizes: list[int], values: pa.Array, gone: list[bool] | None = None) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    mask = pa.array(gone) if gone and any(gone) else None
    return pa.ListArray.from_arrays(pa.array(offsets), values, mask=mask)


def _column(polygons: list[list[np.ndarray]], gone: list[bool] | None = None) -> pa.Array:
    rings = [r for p in polygons for r in p]
    xy = np.concatenate(rings) if rings else np.zeros((0, 2))
    points = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(xy[:, k])) for k in (0, 1)], ["x", "y"])
    return _lists([len(p) for p in polygons], _lists([len(r) for r in rings], points), gone)


@F.arrow_udf(POLYGON)
def simplify(polygon: pa.Array, tolerance: pa.Array) -> pa.Array:
    """Each polygon simplified by its tolerance, in the polygon's units."""
    found = _polygons(polygon)
    made = [[] if p is None else simplified(p, t) for p, t in zip(found, tolerance.to_pylist(), strict=True)]
    return _column(made, [p is None for p in found])


@F.arrow_udf(T.ArrayType(POLYGON))
def subdivide(polygon: pa.Array, most: pa.Array) -> pa.Array:
    """The polygon in parts of at most ``most`` vertices, in a fixed order."""
    found = _polygons(polygon)
    made = [[] if p is None else subdivided(p, m) for p, m in zip(found, most.to_pylist(), strict=True)]
    return _lists([len(m) for m in made], _column([p for m in made for p in m]), [p is None for p in found])


@F.arrow_udf(T.StringType())
def polygon_fault(polygon: pa.Array) -> pa.Array:
    """What makes a polygon invalid; null if nothing does. Rings may touch in vertices."""
    return pa.array([None if p is None else fault(p, True) for p in _polygons(polygon)], pa.string())


@F.arrow_udf(T.BooleanType())
def recomposes(polygon: pa.Array, parts: pa.Array) -> pa.Array:
    """Whether parts make up a polygon exactly."""
    parts = parts.combine_chunks() if isinstance(parts, pa.ChunkedArray) else parts
    flat, at, out = _polygons(parts.flatten()), 0, []
    for p, n in zip(_polygons(polygon), pc.list_value_length(parts).to_pylist(), strict=True):
        out.append(None if p is None or n is None else recomposed(p, flat[at : at + n]))
        at += n or 0
    return pa.array(out, pa.bool_())


#: What a build tells of a polygon: vertices and rings left, what makes it invalid, whether the parts make it up, and the parts.
BUILT = T.StructType([T.StructField("vertices", T.IntegerType()), T.StructField("rings", T.IntegerType()), T.StructField("fault", T.StringType()), T.StructField("same", T.BooleanType()), T.StructField("parts", T.ArrayType(POLYGON))])
#: Polygons that are worked on at once; of the others a task holds flat arrays only.
AT_ONCE = 64


@F.arrow_udf(BUILT)
def build(polygon: pa.Array, tolerance: pa.Array, most: pa.Array) -> pa.Array:
    """Each polygon simplified, subdivided, and checked, in one pass."""
    polygon = polygon.combine_chunks() if isinstance(polygon, pa.ChunkedArray) else polygon
    limits = list(zip(tolerance.to_pylist(), most.to_pylist(), strict=True))
    return pa.concat_arrays([_build(polygon.slice(at, AT_ONCE), limits[at : at + AT_ONCE]) for at in range(0, max(len(polygon), 1), AT_ONCE)])


def _build(polygon: pa.Array, limits: list[tuple[float, int]]) -> pa.Array:
    simple = [None if p is None else simplified(p, t) for p, (t, _) in zip(_polygons(polygon), limits, strict=True)]
    parts = [None if p is None else subdivided(p, m) for p, (_, m) in zip(simple, limits, strict=True)]
    tell = lambda of, kind: pa.array([None if p is None else of(p, q) for p, q in zip(simple, parts, strict=True)], kind)
    facts = [tell(lambda p, _: sum(map(len, p)), pa.int32()), tell(lambda p, _: len(p), pa.int32()), tell(lambda p, _: fault(p, True), pa.string()), tell(recomposed, pa.bool_())]
    made = _lists([len(m or ()) for m in parts], _column([p for m in parts for p in m or ()]), [m is None for m in parts])
    return pa.StructArray.from_arrays([*facts, made], BUILT.names)
