"""Point, segment and polygon predicates. Polygons are literal vertex lists: they are configuration, not data."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

Point = tuple[float, float]


def _edges(polygon: Sequence[Point]):
    return list(zip(polygon, [*polygon[1:], polygon[0]]))


def contains(x: Column, y: Column, polygon: Sequence[Point]) -> Column:
    """True where the point is strictly inside (ray casting, boundary excluded)."""
    crossings = F.lit(0)
    for (ax, ay), (bx, by) in _edges(polygon):
        if ay == by:
            continue
        lo, hi = min(ay, by), max(ay, by)
        at = F.lit(float(ax)) + (y - F.lit(float(ay))) * F.lit((bx - ax) / (by - ay))
        crossings = crossings + ((y >= lo) & (y < hi) & (x < at)).cast("int")
    return (crossings % 2 == 1) & ~on_boundary(x, y, polygon)


def on_boundary(x: Column, y: Column, polygon: Sequence[Point]) -> Column:
    result = F.lit(False)
    for (ax, ay), (bx, by) in _edges(polygon):
        cross = (x - ax) * F.lit(float(by - ay)) - (y - ay) * F.lit(float(bx - ax))
        within = x.between(min(ax, bx), max(ax, bx)) & y.between(min(ay, by), max(ay, by))
        result = result | ((cross == 0) & within)
    return result


def covers(x: Column, y: Column, polygon: Sequence[Point]) -> Column:
    """Inside or on the boundary."""
    return contains(x, y, polygon) | on_boundary(x, y, polygon)


def _side(px: Column, py: Column, qx, qy, rx, ry) -> Column:
    return F.signum((qx - px) * (ry - py) - (qy - py) * (rx - px))


def segments_cross(ax: Column, ay: Column, bx: Column, by: Column, line: Sequence[Point]) -> Column:
    """True where segment a-b touches the literal segment.

    Against an upright or level segment the place where a-b meets its axis decides, as in SQL: signs of areas round otherwise where
    a-b runs through an end.
    """
    (lx, ly), (mx, my) = [(float(x), float(y)) for x, y in line]
    if (lx == mx) != (ly == my):
        p, u, q, v = (ax, ay, bx, by) if lx == mx else (ay, ax, by, bx)
        fixed, (low, high) = F.lit(lx if lx == mx else ly), (F.lit(e) for e in sorted((ly, my) if lx == mx else (lx, mx)))
        at = u + (fixed - p) / F.nullif(q - p, F.lit(0.0)) * (v - u)
        meets = (p != q) & (F.least(p, q) <= fixed) & (F.greatest(p, q) >= fixed) & (at >= low) & (at <= high)
        return F.coalesce(meets, F.lit(False)) | ((p == fixed) & (q == fixed) & (F.least(u, v) <= high) & (F.greatest(u, v) >= low))
    (cx, cy), (dx, dy) = [(F.lit(float(x)), F.lit(float(y))) for x, y in line]
    o1, o2 = _side(ax, ay, bx, by, cx, cy), _side(ax, ay, bx, by, dx, dy)
    o3, o4 = _side(cx, cy, dx, dy, ax, ay), _side(cx, cy, dx, dy, bx, by)

    def spans(px, py, qx, qy, rx, ry):
        return (
            (rx >= F.least(px, qx)) & (rx <= F.greatest(px, qx)) & (ry >= F.least(py, qy)) & (ry <= F.greatest(py, qy))
        )

    return (
        ((o1 != o2) & (o3 != o4))
        | ((o1 == 0) & spans(ax, ay, bx, by, cx, cy))
        | ((o2 == 0) & spans(ax, ay, bx, by, dx, dy))
        | ((o3 == 0) & spans(cx, cy, dx, dy, ax, ay))
        | ((o4 == 0) & spans(cx, cy, dx, dy, bx, by))
    )


def joint_angle(a: Column, b: Column, c: Column) -> Column:
    """Angle in degrees at ``b``, in [0, 180]; points are structs ``(x, y)``."""
    turn = F.atan2(c["y"] - b["y"], c["x"] - b["x"]) - F.atan2(a["y"] - b["y"], a["x"] - b["x"])
    degrees = F.abs(F.degrees(turn))
    return F.when(degrees > 180, F.lit(360.0) - degrees).otherwise(degrees)


def box_foreground(b: Column, window: Column, eps: float = 1e-6) -> Column:
    """Share of a box that lies inside a window (exact for axis-aligned boxes)."""
    from .boxes import area, intersection

    return intersection(b, window) / F.greatest(area(b), F.lit(eps))


def _clamped_mean(u: Column, v: Column, low: Column, high: Column) -> Column:
    """Mean of ``least(greatest(t, low), high)`` for t running evenly from u to v."""

    def area_to(t: Column) -> Column:
        return F.when(t <= low, low * (t - low)).when(t <= high, (t * t - low * low) / 2).otherwise((high * high - low * low) / 2 + high * (t - high))

    flat = F.abs(v - u) < F.lit(1e-9)
    middle = F.least(F.greatest((u + v) / 2, low), high)
    return F.when(flat, middle).otherwise((area_to(v) - area_to(u)) / F.when(flat, 1.0).otherwise(v - u))


def area_in_window(corners: Column, n: int, window: Column | Mapping[str, Column]) -> Column:
    """Area of a simple polygon inside a window: an array of 2n numbers (x, y by turns) and a box.

    Under each edge lies the integral of its height cut to the window, over its run cut to the window; edges that go back take
    it off again. Each step names its results, so that no part is worked out twice.
    """
    point = lambda i: (corners[2 * (i % n)], corners[2 * (i % n) + 1])
    low, high = window["y1"], window["y2"]
    edges = F.array(*[F.struct(point(i)[0].alias("ax"), point(i)[1].alias("ay"), point(i + 1)[0].alias("bx"), point(i + 1)[1].alias("by")) for i in range(n)])
    cut = lambda x: F.least(F.greatest(x, window["x1"]), window["x2"])
    steep = lambda e: F.when(e["bx"] == e["ax"], 0.0).otherwise((e["by"] - e["ay"]) / F.when(e["bx"] == e["ax"], 1.0).otherwise(e["bx"] - e["ax"]))
    runs = F.transform(edges, lambda e: F.struct(cut(e["ax"]).alias("u"), cut(e["bx"]).alias("v"), steep(e).alias("s"), e["ax"].alias("ax"), e["ay"].alias("ay")))
    ends = F.transform(runs, lambda e: F.struct((e["v"] - e["u"]).alias("run"), (e["ay"] + e["s"] * (e["u"] - e["ax"])).alias("p"), (e["ay"] + e["s"] * (e["v"] - e["ax"])).alias("q")))
    terms = F.transform(ends, lambda e: e["run"] * _clamped_mean(e["p"], e["q"], low, high))
    return F.abs(F.aggregate(terms, F.lit(0.0), lambda total, x: total + x))


def polygon_area(corners: Column, n: int) -> Column:
    point = lambda i: (corners[2 * (i % n)], corners[2 * (i % n) + 1])
    cross = [point(i)[0] * point(i + 1)[1] - point(i + 1)[0] * point(i)[1] for i in range(n)]
    return F.abs(sum(cross[1:], cross[0])) / 2


def quad_foreground(corners: Column | str, window: Column | str, eps: float = 1e-6) -> Column:
    """Share of a quadrilateral (array of 8 numbers) that lies inside a window (array of 4 numbers)."""
    corners, window = (F.col(c) if isinstance(c, str) else c for c in (corners, window))
    window = {k: window[i] for i, k in enumerate(("x1", "y1", "x2", "y2"))}
    return area_in_window(corners, 4, window) / F.greatest(polygon_area(corners, 4), F.lit(eps))


# ---- the same predicates on arrays, for stateful steps ---------------------------------------------------------------


def array_contains(x: np.ndarray, y: np.ndarray, polygon: Sequence[Point]) -> np.ndarray:
    """:func:`contains` for arrays of points."""
    inside, edge = np.zeros(len(x), bool), np.zeros(len(x), bool)
    for (ax, ay), (bx, by) in _edges(polygon):
        edge |= ((bx - ax) * (y - ay) == (by - ay) * (x - ax)) & (x >= min(ax, bx)) & (x <= max(ax, bx)) & (y >= min(ay, by)) & (y <= max(ay, by))
        if ay != by:
            inside ^= (y >= min(ay, by)) & (y < max(ay, by)) & (x < ax + (y - ay) * ((bx - ax) / (by - ay)))
    return inside & ~edge


def array_segments_cross(ax: np.ndarray, ay: np.ndarray, bx: np.ndarray, by: np.ndarray, line: Sequence[Point]) -> np.ndarray:
    """:func:`segments_cross` for arrays of segments a-b."""
    (cx, cy), (dx, dy) = line

    def side(px, py, qx, qy, rx, ry):
        return np.sign((qx - px) * (ry - py) - (qy - py) * (rx - px))

    def on(px, py, qx, qy, rx, ry):
        return (rx >= np.minimum(px, qx)) & (rx <= np.maximum(px, qx)) & (ry >= np.minimum(py, qy)) & (ry <= np.maximum(py, qy))

    s = side(ax, ay, bx, by, cx, cy), side(ax, ay, bx, by, dx, dy), side(cx, cy, dx, dy, ax, ay), side(cx, cy, dx, dy, bx, by)
    touch = (s[0] == 0) & on(ax, ay, bx, by, cx, cy) | (s[1] == 0) & on(ax, ay, bx, by, dx, dy) | (s[2] == 0) & on(cx, cy, dx, dy, ax, ay) | (s[3] == 0) & on(cx, cy, dx, dy, bx, by)
    return (s[0] != s[1]) & (s[2] != s[3]) | touch
