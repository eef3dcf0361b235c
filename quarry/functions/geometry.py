"""Plane geometry of polygons in the JVM, as higher-order functions over their edges.

A polygon is an array of rings, a ring an array of points (x, y), closed or not; rings may
be outlines or holes, as insides are told by parity. ``edges`` is computed once a polygon
and kept as a column; everything else takes edges. Only ``metres`` and ``near_pairs``, which pairs
of points and polygons go through by the million, run in numpy: higher-order functions are
interpreted and took 86 microseconds a pair. Null polygons give nulls, polygons
without a point have no edges, contain nothing and are at no distance (null).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

EDGE = "struct<ax:double,ay:double,bx:double,by:double>"
POINT = "struct<x:double,y:double>"


def edges(rings: Column) -> Column:
    """array<struct<ax, ay, bx, by>>: each ring's points with their successors, the last with the first."""

    def of(ring: Column) -> Column:
        following = lambda i: F.get(ring, (i + 1) % F.size(ring))
        return F.transform(ring, lambda p, i: F.struct(p["x"].alias("ax"), p["y"].alias("ay"), following(i)["x"].alias("bx"), following(i)["y"].alias("by")))

    return F.flatten(F.transform(rings, of)).cast(f"array<{EDGE}>")


def box(e: Column) -> Column:
    """struct<x0, y0, x1, y1>."""
    least, most = (lambda c: F.array_min(F.transform(e, lambda s: s[c]))), (lambda c: F.array_max(F.transform(e, lambda s: s[c])))
    return F.struct(least("ax").alias("x0"), least("ay").alias("y0"), most("ax").alias("x1"), most("ay").alias("y1"))


def _crossing(s: Column, y: Column) -> Column:
    """x at which an edge that passes the height y does so."""
    return s["ax"] + (y - s["ay"]) * (s["bx"] - s["ax"]) / F.nullif(s["by"] - s["ay"], F.lit(0.0))


def _passes(s: Column, y: Column) -> Column:
    return (s["ay"] > y) != (s["by"] > y)


def contains(e: Column, x: Column, y: Column) -> Column:
    """An odd number of edges lies to the right of the point."""
    return F.size(F.filter(e, lambda s: _passes(s, y) & (x < _crossing(s, y)))) % 2 == 1


def from_edge(s: Column, x: Column, y: Column) -> Column:
    """Distance to an edge: of its nearer end, or of the line where the point lies beside it.

    No foot of a perpendicular is rounded: where coordinates are short fractions, distances that are equal come out equal.
    """
    dx, dy = s["bx"] - s["ax"], s["by"] - s["ay"]
    dot, long = (x - s["ax"]) * dx + (y - s["ay"]) * dy, dx * dx + dy * dy
    end = lambda a, b: F.sqrt((x - s[a]) * (x - s[a]) + (y - s[b]) * (y - s[b]))
    beside = F.when(dx == 0, F.abs(x - s["ax"])).when(dy == 0, F.abs(y - s["ay"])).otherwise(F.abs(dx * (y - s["ay"]) - dy * (x - s["ax"])) / F.sqrt(long))
    return F.when(dot <= 0, end("ax", "ay")).when(dot >= long, end("bx", "by")).when(dot.isNotNull(), beside)


def from_boundary(e: Column, x: Column, y: Column) -> Column:
    return F.array_min(F.transform(e, lambda s: from_edge(s, x, y)))


def from_point(e: Column, x: Column, y: Column) -> Column:
    """Distance of a point to a polygon, 0 inside."""
    return F.when(contains(e, x, y), F.lit(0.0)).otherwise(from_boundary(e, x, y))


#: Edges, and pairs of points and polygons, that are measured at once.
EDGES_AT_ONCE, PAIRS_AT_ONCE = 200_000, 50_000


def _sizes(a: pa.ListArray) -> np.ndarray:
    return pc.list_value_length(a).fill_null(0).to_numpy(zero_copy_only=False).astype("i8")


def _floats(a: pa.Array) -> np.ndarray:
    """Nulls become NaN."""
    return a.to_numpy(zero_copy_only=False).astype("f8", copy=False)


class _Edges:
    """Edges of many polygons, with what their distances take: a line is (u, v) . (point - a) / long, along an axis without rounding."""

    def __init__(self, edges: pa.ListArray) -> None:
        self.sizes = _sizes(edges)
        self.first, flat = np.cumsum(self.sizes) - self.sizes, edges.flatten()
        self.ax, self.ay, self.bx, self.by = (_floats(flat.field(c)) for c in ("ax", "ay", "bx", "by"))
        self.dx, self.dy = self.bx - self.ax, self.by - self.ay
        self.square, up, level = self.dx * self.dx + self.dy * self.dy, self.dx == 0, self.dy == 0
        self.u, self.v = np.where(up, 1.0, np.where(level, 0.0, -self.dy)), np.where(up, 0.0, np.where(level, 1.0, self.dx))
        self.long = np.where(np.isnan(self.square), np.nan, np.where(up | level, 1.0, np.sqrt(self.square)))

    def measured(self, k: np.ndarray, px: np.ndarray, py: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``from_edge`` of points to the edges ``k``, and where an edge passes the point's height to its right."""
        with np.errstate(all="ignore"):
            ux, uy, dx, dy = px - self.ax[k], py - self.ay[k], self.dx[k], self.dy[k]
            along, far = ux * dx + uy * dy, np.abs(self.u[k] * ux + self.v[k] * uy) / self.long[k]
            end = np.flatnonzero(along >= self.square[k])
            ex, ey = px[end] - self.bx[k[end]], py[end] - self.by[k[end]]
            far[end] = np.sqrt(ex * ex + ey * ey)
            end = np.flatnonzero(along <= 0)
            ex, ey = ux[end], uy[end]
            far[end] = np.sqrt(ex * ex + ey * ey)
            passed = np.flatnonzero((uy < 0) != (self.by[k] > py))
            return far, passed[px[passed] < self.ax[k[passed]] + uy[passed] * dx[passed] / dy[passed]]


@F.arrow_udf(DoubleType())
def _metres(edges: pa.Array, x: pa.Array, y: pa.Array) -> pa.Array:
    held, xs, ys = _Edges(edges), _floats(x), _floats(y)
    ends, out, row = np.cumsum(held.sizes), np.full(len(xs), np.nan), 0
    while row < len(xs):
        first = ends[row] - held.sizes[row]
        last = max(row + 1, int(np.searchsorted(ends, first + EDGES_AT_ONCE, "right")))
        own = held.sizes[row:last]
        filled, odd = np.flatnonzero(own), np.zeros(own.sum(), "i8")
        far, crossed = held.measured(np.arange(first, ends[last - 1]), np.repeat(xs[row:last], own), np.repeat(ys[row:last], own))
        odd[crossed] = 1
        if len(filled):
            starts = (np.cumsum(own) - own)[filled]
            out[row + filled] = np.where(np.add.reduceat(odd, starts) % 2 == 1, 0.0, np.fmin.reduceat(far, starts))
        row = last
    return pa.array(out, mask=np.isnan(out))


_METRES = _metres.asNondeterministic()


def metres(e: Column, x: Column, y: Column) -> Column:
    """``from_point`` for tables of many pairs, in Arrow batches; measured once, however often the column is used."""
    return _METRES(e, x, y)


def near_pairs(points: pa.ListArray, polygons: pa.ListArray, reach: float, best: bool) -> Iterator[list[pa.Array]]:
    """[ids of points, ids of polygons, ``from_point``] of all pairs within ``reach`` of each other, some at a time.

    Each row has an array of points (id, x, y) and one of polygons (id, box, edges). With ``best``,
    of the pairs that are measured together only those stay that are a point's nearest.
    """
    at, held = points.flatten(), polygons.flatten()
    x, y, box, edges = _floats(at.field("x")), _floats(at.field("y")), held.field("box"), _Edges(held.field("edges"))
    x0, y0, x1, y1 = (_floats(box.field(c)) for c in ("x0", "y0", "x1", "y1"))
    x0, y0, x1, y1 = x0 - reach, y0 - reach, *(np.where(np.isnan(v), np.inf, v) + reach for v in (x1, y1))  # Spark orders NaN last
    asked, row = _sizes(points), np.repeat(np.arange(len(points)), _sizes(polygons))
    first, tried = (np.cumsum(asked) - asked)[row], asked[row]  # a polygon is tried with the points of its row
    done, k = np.cumsum(tried), 0
    while k < len(row):
        last = max(k + 1, int(np.searchsorted(done, done[k] - tried[k] + PAIRS_AT_ONCE, "right")))
        own = tried[k:last]
        i = np.arange(own.sum()) + np.repeat(first[k:last] - (np.cumsum(own) - own), own)
        px, j = x[i], np.repeat(np.arange(k, last), own)
        near, k = np.flatnonzero((px >= np.repeat(x0[k:last], own)) & (px <= np.repeat(x1[k:last], own))), last
        i, j = i[near], j[near]
        py = y[i]
        near = np.flatnonzero((py >= y0[j]) & (py <= y1[j]))
        i, j = i[near], j[near]
        metres, odd = _from_polygons(edges, j, x[i], y[i])
        metres[odd] = 0.0
        kept = np.flatnonzero(metres <= reach)
        i, j, metres = i[kept], j[kept], metres[kept]
        if best:
            least = np.full(len(x), np.inf)
            np.minimum.at(least, i, metres)
            kept = np.flatnonzero(metres == least[i])
            i, j, metres = i[kept], j[kept], metres[kept]
        yield [at.field("id").take(pa.array(i)), held.field("id").take(pa.array(j)), pa.array(metres)]


def _from_polygons(edges: _Edges, j: np.ndarray, px: np.ndarray, py: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distances of points to the boundaries of polygons ``j``, and whether they lie inside."""
    metres, odd, e = np.full(len(j), np.nan), np.zeros(len(j), bool), 0
    sizes, k, rest = edges.sizes[j], edges.first[j], None
    while len(k):  # the next edge of each polygon that has one
        if sizes.min() <= e:
            more = np.flatnonzero(sizes > e)
            rest = more if rest is None else rest[more]
            sizes, k, px, py = sizes[more], k[more], px[more], py[more]
        far, crossed = edges.measured(k + e, px, py)
        if rest is None:
            np.fmin(metres, far, out=metres)
        else:
            metres[rest], crossed = np.fmin(metres[rest], far), rest[crossed]
        odd[crossed] ^= True
        e += 1
    return metres, odd


def _side(s: Column, x: Column, y: Column) -> Column:
    return F.signum((s["bx"] - s["ax"]) * (y - s["ay"]) - (s["by"] - s["ay"]) * (x - s["ax"]))


def edges_meet(s: Column, t: Column) -> Column:
    """Two edges cross or touch."""
    apart = lambda p, q: (F.greatest(s[p], s[q]) < F.least(t[p], t[q])) | (F.greatest(t[p], t[q]) < F.least(s[p], s[q]))
    across = lambda a, b: _side(a, b["ax"], b["ay"]) * _side(a, b["bx"], b["by"]) <= 0
    return ~apart("ax", "bx") & ~apart("ay", "by") & across(s, t) & across(t, s)


def between(e: Column, f: Column) -> Column:
    """Distance of two polygons, 0 where they meet or one holds the other."""
    meet = F.exists(e, lambda s: F.exists(f, lambda t: edges_meet(s, t)))
    first = lambda g: (F.get(g, F.lit(0))["ax"], F.get(g, F.lit(0))["ay"])
    held = contains(f, *first(e)) | contains(e, *first(f))
    near = lambda g, h: F.array_min(F.transform(g, lambda s: from_boundary(h, s["ax"], s["ay"])))
    return F.when(meet | held, F.lit(0.0)).otherwise(F.least(near(e, f), near(f, e)))


def point_inside(e: Column) -> Column:
    """struct<x, y>: the middle of the widest inner section of a line through the polygon; its first point where it has no height.

    The line runs halfway between the corners next to the middle of the height, so it meets no corner.
    """
    heights = F.transform(e, lambda s: s["ay"])
    middle = (F.array_min(heights) + F.array_max(heights)) / 2
    below, above = F.array_max(F.filter(heights, lambda h: h <= middle)), F.array_min(F.filter(heights, lambda h: h > middle))
    y = (below + above) / 2
    xs = F.array_sort(F.transform(F.filter(e, lambda s: _passes(s, y)), lambda s: _crossing(s, y)))
    sections = F.transform(F.sequence(F.lit(0), F.size(xs) - 2, F.lit(2)), lambda k: F.struct((F.get(xs, k + 1) - F.get(xs, k)).alias("width"), ((F.get(xs, k) + F.get(xs, k + 1)) / 2).alias("x")))
    flat = F.struct(F.get(e, F.lit(0))["ax"].alias("x"), F.get(e, F.lit(0))["ay"].alias("y"))
    return F.when(F.size(xs) >= 2, F.struct(F.array_max(sections)["x"].alias("x"), y.alias("y"))).otherwise(flat).cast(POINT)
