"""Box geometry as Column expressions. A box is a struct ``(x1, y1, x2, y2)`` unless named otherwise."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIRECTIONS = (("left", -1, 0), ("right", 1, 0), ("up", 0, -1), ("down", 0, 1))


def box(x1, y1, x2, y2) -> Column:
    """Struct box from four columns (names or expressions)."""
    parts = zip(("x1", "y1", "x2", "y2"), (x1, y1, x2, y2))
    return F.struct(*[_col(c).cast("double").alias(n) for n, c in parts])


def _col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c) if isinstance(c, str) else F.lit(c)


def width(b: Column) -> Column:
    return b["x2"] - b["x1"]


def height(b: Column) -> Column:
    return b["y2"] - b["y1"]


def area(b: Column) -> Column:
    return width(b) * height(b)


def intersection(a: Column, b: Column) -> Column:
    """Overlap area of two boxes."""
    w = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    h = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    zero = F.lit(0.0)
    return F.greatest(w, zero) * F.greatest(h, zero)


def iou(a: Column, b: Column, eps: float = 1e-7) -> Column:
    """Intersection over union with eps in the denominator."""
    inter = intersection(a, b)
    return inter / (area(a) + area(b) - inter + F.lit(eps))


def ioa(a: Column, b: Column, eps: float = 1e-7) -> Column:
    """Intersection over the second box's area."""
    return intersection(a, b) / (area(b) + F.lit(eps))


def _padded(a: Column, b: Column, eps: float):
    """Widths, heights (eps on the height only), IoU and enclosing extents."""
    e = F.lit(eps)
    w1, h1 = width(a), height(a) + e
    w2, h2 = width(b), height(b) + e
    inter = intersection(a, b)
    union = w1 * h1 + w2 * h2 - inter + e
    cw = F.greatest(a["x2"], b["x2"]) - F.least(a["x1"], b["x1"])
    ch = F.greatest(a["y2"], b["y2"]) - F.least(a["y1"], b["y1"])
    return w1, h1, w2, h2, inter / union, union, cw, ch


def giou(a: Column, b: Column, eps: float = 1e-7) -> Column:
    *_, overlap, union, cw, ch = _padded(a, b, eps)
    hull = cw * ch + F.lit(eps)
    return overlap - (hull - union) / hull


def _centre_penalty(a: Column, b: Column, cw: Column, ch: Column, eps: float) -> Column:
    dx = b["x1"] + b["x2"] - a["x1"] - a["x2"]
    dy = b["y1"] + b["y2"] - a["y1"] - a["y2"]
    return ((dx * dx + dy * dy) / F.lit(4.0)) / (cw * cw + ch * ch + F.lit(eps))


def diou(a: Column, b: Column, eps: float = 1e-7) -> Column:
    *_, overlap, _, cw, ch = _padded(a, b, eps)
    return overlap - _centre_penalty(a, b, cw, ch, eps)


def aspect_term(w1: Column, h1: Column, w2: Column, h2: Column) -> Column:
    d = F.atan(w2 / h2) - F.atan(w1 / h1)
    return F.lit(4.0 / math.pi**2) * d * d


def ciou(a: Column, b: Column, eps: float = 1e-7) -> Column:
    w1, h1, w2, h2, overlap, _, cw, ch = _padded(a, b, eps)
    v = aspect_term(w1, h1, w2, h2)
    alpha = v / (v - overlap + F.lit(1.0 + eps))
    return overlap - (_centre_penalty(a, b, cw, ch, eps) + v * alpha)


def alignment(score: Column, overlap: Column) -> Column:
    """score^0.5 * overlap^6, written with sqrt and products so that every engine agrees to the bit."""
    cube = overlap * overlap * overlap
    return F.sqrt(score) * (cube * cube)


def _gaussian(w: Column, h: Column, r: Column):
    a, b = w * w / F.lit(12.0), h * h / F.lit(12.0)
    c, s = F.cos(r), F.sin(r)
    return a * c * c + b * s * s, a * s * s + b * c * c, (a - b) * c * s


def gaussian(rot: Column) -> Column:
    """A rotated box with the terms ``ga``, ``gb``, ``gc`` of its covariance, worked out once a box and not once a pair."""
    terms = _gaussian(rot["w"], rot["h"], rot["r"])
    return F.struct(*[rot[c].alias(c) for c in ("cx", "cy", "w", "h", "r")], *[t.alias(n) for t, n in zip(terms, ("ga", "gb", "gc"))])


def probiou(a: Column, b: Column, eps: float = 1e-7, aspect: bool = False) -> Column:
    """Probabilistic IoU of rotated boxes, structs ``(cx, cy, w, h, r)``."""
    return _probiou(a, b, _gaussian(a["w"], a["h"], a["r"]), _gaussian(b["w"], b["h"], b["r"]), eps, aspect)


def gaussian_iou(a: Column, b: Column) -> Column:
    """:func:`probiou` of boxes that carry their covariance (:func:`gaussian`)."""
    return _probiou(a, b, (a["ga"], a["gb"], a["gc"]), (b["ga"], b["gb"], b["gc"]), 1e-7, False)


def _probiou(a: Column, b: Column, of_a: tuple, of_b: tuple, eps: float, aspect: bool) -> Column:
    e = F.lit(eps)
    a1, b1, c1 = of_a
    a2, b2, c2 = of_b
    det = (a1 + a2) * (b1 + b2) - (c1 + c2) * (c1 + c2)
    dx, dy = a["cx"] - b["cx"], a["cy"] - b["cy"]
    t1 = ((a1 + a2) * dy * dy + (b1 + b2) * dx * dx) / (det + e) * F.lit(0.25)
    t2 = -((c1 + c2) * dx * dy) / (det + e) * F.lit(0.5)
    zero = F.lit(0.0)
    own = F.greatest(a1 * b1 - c1 * c1, zero) * F.greatest(a2 * b2 - c2 * c2, zero)
    t3 = F.ln(det / (F.lit(4.0) * F.sqrt(own) + e) + e) * F.lit(0.5)
    distance = F.least(F.greatest(t1 + t2 + t3, e), F.lit(100.0))
    value = F.lit(1.0) - F.sqrt(F.lit(1.0) - F.exp(-distance) + e)
    if not aspect:
        return value
    v = aspect_term(a["w"], a["h"], b["w"], b["h"])
    return value - v * (v / (v - value + F.lit(1.0 + eps)))


def keypoint_similarity(truth: Column, pred: Column, area_: Column, sigmas: Sequence[float], eps: float = 1e-7) -> Column:
    """Object keypoint similarity. Keypoints are arrays of structs ``(x, y, v)``; sigmas are per keypoint."""
    scale = F.array(*[F.lit((2.0 * s) ** 2) for s in sigmas])
    terms = F.zip_with(
        F.zip_with(
            truth,
            pred,
            lambda t, p: F.struct(
                ((t["x"] - p["x"]) * (t["x"] - p["x"]) + (t["y"] - p["y"]) * (t["y"] - p["y"])).alias("d"),
                (t["v"] != 0).cast("double").alias("seen"),
            ),
        ),
        scale,
        lambda m, k: F.exp(-(m["d"] / (k * (area_ + F.lit(eps)) * F.lit(2.0)))) * m["seen"],
    )
    seen = F.aggregate(truth, F.lit(0.0), lambda acc, t: acc + (t["v"] != 0).cast("double"))
    return F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + x) / (seen + F.lit(eps))


def diagonal(b: Column, eps: float = 1e-9) -> Column:
    return F.sqrt(width(b) * width(b) + height(b) * height(b) + F.lit(eps))


def wasserstein_similarity(truth: Column, pred: Column, norm: Column, gamma: float = 0.5, eps: float = 1e-9) -> Column:
    """Scaled Wasserstein similarity; ``norm`` is a constant or the mean truth diagonal (at least 1)."""
    e = F.lit(eps)

    def scaled(b):
        w, h = width(b), height(b)
        q = F.pow(F.greatest(w / (h + e), e), F.lit(gamma / 2))
        return q * w / 2, (h / 2) / (q + e)

    (wt, ht), (wp, hp) = scaled(truth), scaled(pred)
    dx = (pred["x1"] + pred["x2"] - truth["x1"] - truth["x2"]) / 2
    dy = (pred["y1"] + pred["y2"] - truth["y1"] - truth["y2"]) / 2
    distance = F.sqrt(dx * dx + dy * dy + (wp - wt) * (wp - wt) + (hp - ht) * (hp - ht) + e)
    return F.least(F.greatest(F.exp(-distance / F.greatest(norm, F.lit(1.0))), F.lit(0.0)), F.lit(1.0))


def eligibility_box(b: Column, smallest: float = 8.0, extent: float = 16.0) -> Column:
    """Box used for the centre-in-box test: a side below ``smallest`` becomes ``extent``."""
    cx, cy = (b["x1"] + b["x2"]) / 2, (b["y1"] + b["y2"]) / 2
    w = F.when(width(b) < smallest, F.lit(extent)).otherwise(width(b))
    h = F.when(height(b) < smallest, F.lit(extent)).otherwise(height(b))
    return box(cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2)


def strictly_inside(x: Column, y: Column, b: Column, eps: float = 1e-9) -> Column:
    return F.least(x - b["x1"], y - b["y1"], b["x2"] - x, b["y2"] - y) > F.lit(eps)


def anchor_grid(width: Column, height: Column, strides: Sequence[int], offset: float = 0.5) -> Column:
    """Array of structs (anchor, ax, ay, stride) to be exploded: cell centres of each stride's grid, rows first, strides in order.

    Coordinates are pixels; a grid has ceil(side / stride) cells a side.
    """

    def level(cells: Column, nx: Column, s: int, before: Column) -> Column:
        return F.transform(cells, lambda i: F.struct((before + i).alias("anchor"), ((i % nx + offset) * s).alias("ax"), ((F.floor(i / nx) + offset) * s).alias("ay"), F.lit(s).alias("stride")))

    levels, before = [], F.lit(0).cast("long")
    for s in strides:
        nx, ny = F.ceil(width / F.lit(float(s))), F.ceil(height / F.lit(float(s)))
        cells = F.when(nx * ny > 0, F.sequence(F.lit(0).cast("long"), nx * ny - 1)).otherwise(F.array().cast("array<bigint>"))
        levels.append(level(cells, nx, s, before))
        before = before + nx * ny
    return F.concat(*levels)


def anchors(df: DataFrame, width: Column, height: Column, strides: Sequence[int], offset: float = 0.5) -> DataFrame:
    """``df`` with one row per anchor of :func:`anchor_grid` (``anchor``, ``ax``, ``ay``, ``stride``). Only numbers are exploded, so no
    array of structs is built for an image.
    """
    sizes, before = [], F.lit(0).cast("long")
    for s in strides:
        nx, ny = F.ceil(width / F.lit(float(s))), F.ceil(height / F.lit(float(s)))
        sizes.append(F.struct(F.lit(s).alias("stride"), nx.alias("nx"), (nx * ny).alias("n"), before.alias("before")))
        before = before + F.greatest(nx * ny, F.lit(0))
    levels = df.withColumn("_l", F.explode(F.array(*sizes))).filter("_l.n > 0").select(*df.columns, "_l.*")
    cells = levels.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    i, nx, stride = F.col("_i"), F.col("nx"), F.col("stride")
    return cells.select(*df.columns, (F.col("before") + i).alias("anchor"), ((i % nx + offset) * stride).alias("ax"), ((F.floor(i / nx) + offset) * stride).alias("ay"), "stride")


def anchor_to_box(x: Column, y: Column, l: Column, t: Column, r: Column, b: Column) -> Column:
    """Left/top/right/bottom distances from an anchor to a box."""
    return box(x - l, y - t, x + r, y + b)


def box_to_distances(x: Column, y: Column, b: Column, limit: float | None = None) -> Column:
    """Inverse of :func:`anchor_to_box`, optionally clamped to ``[0, limit - 0.01]``."""
    values = {"l": x - b["x1"], "t": y - b["y1"], "r": b["x2"] - x, "b": b["y2"] - y}
    if limit is not None:
        values = {k: F.least(F.greatest(v, F.lit(0.0)), F.lit(limit - 0.01)) for k, v in values.items()}
    return F.struct(*[v.alias(k) for k, v in values.items()])


def equivalent_side(b: Column) -> Column:
    return F.sqrt(area(b))


def centre_distance(a: Column, b: Column) -> Column:
    return F.hypot((a["x1"] + a["x2"] - b["x1"] - b["x2"]) / 2, (a["y1"] + a["y2"] - b["y1"] - b["y2"]) / 2)


def normalised_centre_distance(a: Column, b: Column) -> Column:
    """Centre distance over the mean equivalent side."""
    norm = (equivalent_side(a) + equivalent_side(b)) / 2
    checked = F.when(norm > 0, norm).otherwise(F.raise_error(F.lit("non-positive equivalent side")).cast("double"))
    return centre_distance(a, b) / checked


# ---- format conversion -------------------------------------------------------------------------------------------


def xyxy_to_xywh(b: Column) -> Column:
    return F.struct(
        ((b["x1"] + b["x2"]) / 2).alias("cx"), ((b["y1"] + b["y2"]) / 2).alias("cy"), width(b).alias("w"), height(b).alias("h")
    )


def xywh_to_xyxy(cx: Column, cy: Column, w: Column, h: Column) -> Column:
    return box(cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2)


def ltwh_to_xyxy(left: Column, top: Column, w: Column, h: Column) -> Column:
    return box(left, top, left + w, top + h)


def xyxy_to_ltwh(b: Column) -> Column:
    return F.struct(b["x1"].alias("l"), b["y1"].alias("t"), width(b).alias("w"), height(b).alias("h"))


def xywhn_to_xyxy(cx: Column, cy: Column, w: Column, h: Column, iw, ih, padx=0.0, pady=0.0) -> Column:
    iw, ih = _col(iw), _col(ih)
    return box(iw * (cx - w / 2) + padx, ih * (cy - h / 2) + pady, iw * (cx + w / 2) + padx, ih * (cy + h / 2) + pady)


def xyxy_to_xywhn(b: Column, iw, ih) -> Column:
    iw, ih = _col(iw), _col(ih)
    return F.struct(
        ((b["x1"] + b["x2"]) / 2 / iw).alias("cx"),
        ((b["y1"] + b["y2"]) / 2 / ih).alias("cy"),
        (width(b) / iw).alias("w"),
        (height(b) / ih).alias("h"),
    )


def clip(b: Column, iw, ih) -> Column:
    iw, ih, zero = _col(iw).cast("double"), _col(ih).cast("double"), F.lit(0.0)

    def bound(v, top):
        return F.least(F.greatest(v, zero), top)

    return box(bound(b["x1"], iw), bound(b["y1"], ih), bound(b["x2"], iw), bound(b["y2"], ih))


def unletterbox(b: Column, model_w, model_h, image_w, image_h) -> Column:
    """Map a box from a letterboxed canvas back to the image and clip it."""
    mw, mh, iw, ih = (_col(c).cast("double") for c in (model_w, model_h, image_w, image_h))
    gain = F.least(mh / ih, mw / iw)
    padx = F.rint((mw - F.rint(iw * gain)) / 2 - F.lit(0.1))
    pady = F.rint((mh - F.rint(ih * gain)) / 2 - F.lit(0.1))
    moved = box((b["x1"] - padx) / gain, (b["y1"] - pady) / gain, (b["x2"] - padx) / gain, (b["y2"] - pady) / gain)
    return clip(moved, iw, ih)


def rotated_corners(cx: Column, cy: Column, w: Column, h: Column, r: Column) -> Column:
    """Four corners of a rotated box as an array of ``(x, y)``, walking round the box."""
    c, s = F.cos(r), F.sin(r)
    ux, uy, vx, vy = w / 2 * c, w / 2 * s, -h / 2 * s, h / 2 * c
    signs = ((1, 1), (1, -1), (-1, -1), (-1, 1))
    return F.array(*[F.struct((cx + ux * i + vx * j).alias("x"), (cy + uy * i + vy * j).alias("y")) for i, j in signs])


def corners_to_rotated(points: Column) -> Column:
    """Rotated box of a four-corner rectangle given in walking order."""
    p, q, t = points[0], points[1], points[2]
    w = F.hypot(t["x"] - q["x"], t["y"] - q["y"])
    h = F.hypot(q["x"] - p["x"], q["y"] - p["y"])
    return F.struct(
        ((p["x"] + t["x"]) / 2).alias("cx"),
        ((p["y"] + t["y"]) / 2).alias("cy"),
        w.alias("w"),
        h.alias("h"),
        F.atan2(q["y"] - t["y"], q["x"] - t["x"]).alias("r"),
    )


def points_box(points: Column) -> Column:
    """Bounding box of an array of ``(x, y)`` structs."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return box(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))


# ---- shifts ------------------------------------------------------------------------------------------------------


def shift_delta(mode: str, kappa, w: Column, h: Column) -> Column:
    """Shift length per axis: one pixel, kappa times the equivalent side, or kappa times each side."""
    k = _col(kappa)
    if mode == "fixed":
        dx = dy = F.lit(1.0)
    elif mode == "equivalent_side":
        dx = dy = k * F.sqrt(w * h)
    elif mode == "axis":
        dx, dy = k * w, k * h
    else:
        raise ValueError(f"unknown shift mode {mode!r}")
    return F.struct(dx.cast("double").alias("dx"), dy.cast("double").alias("dy"))


def directions() -> Column:
    """Array of the four unit shifts, to be exploded."""
    return F.array(
        *[
            F.struct(F.lit(n).alias("direction"), F.lit(float(x)).alias("ux"), F.lit(float(y)).alias("uy"))
            for n, x, y in DIRECTIONS
        ]
    )


def translate(b: Column, dx: Column, dy: Column) -> Column:
    return box(b["x1"] + dx, b["y1"] + dy, b["x2"] + dx, b["y2"] + dy)


def legal_shift(b: Column, dx: Column, dy: Column, image_w, image_h) -> Column:
    """Translated box, or null where it leaves the image. Never clipped."""
    moved = translate(b, dx, dy)
    inside = (moved["x1"] >= 0) & (moved["y1"] >= 0) & (moved["x2"] <= _col(image_w)) & (moved["y2"] <= _col(image_h))
    return F.when(inside, moved)


def scan_limit(b: Column, direction: Column, ux: Column, uy: Column, image_w, image_h, scale: Column, rmax: float) -> Column:
    """Radius up to which a shift stays legal, the reason, and the inward guard that was needed."""
    iw, ih = _col(image_w).cast("double"), _col(image_h).cast("double")
    pixels = (
        F.when(direction == "left", b["x1"])
        .when(direction == "right", iw - b["x2"])
        .when(direction == "up", b["y1"])
        .when(direction == "down", ih - b["y2"])
    )
    edge = F.greatest(F.lit(0.0), pixels / scale)
    start = F.least(F.lit(rmax), edge)
    reason = F.when(F.lit(rmax) <= edge + F.lit(1e-12), F.lit("rmax")).otherwise(F.lit("image_boundary"))
    step = F.lit(2.0**-23) * F.greatest(iw, ih, F.lit(1.0)) / scale
    tries = F.array(start, *[F.greatest(F.lit(0.0), start - F.lit(m) * step) for m in (8.0, 16.0, 32.0, 64.0, 128.0)])
    fits = F.filter(
        tries, lambda r: (r <= 0) | legal_shift(b, ux * r * scale, uy * r * scale, iw, ih).isNotNull()
    )
    limit = F.element_at(fits, 1)
    checked = F.when(F.size(fits) > 0, limit).otherwise(F.raise_error(F.lit("no legal scan limit")).cast("double"))
    return F.struct(checked.alias("limit"), reason.alias("reason"), ((start - checked) * scale).alias("guard"))
