"""Polygon areas in windows, quadrilaterals of windows, rotated matching and anchor grids against plain loops."""

import numpy as np
from pyspark.sql import functions as F

from driftline.functions import boxes as bx
from driftline.functions import polygons as pg
from driftline.operators import dataset as ds
from driftline.operators import detection as dt
from driftline.operators import estimators as es
from driftline.operators import trajectory as tr


def clipped_area(points, window):
    """Area of a polygon after cutting it by the four half-planes of a window."""
    points = [tuple(p) for p in points]
    for axis, bound, sign in ((0, window[0], 1), (0, window[2], -1), (1, window[1], 1), (1, window[3], -1)):
        out = []
        for p, q in zip(points, points[1:] + points[:1]):
            d, e = sign * (p[axis] - bound), sign * (q[axis] - bound)
            if d >= 0:
                out.append(p)
            if (d < 0) != (e < 0):
                out.append(tuple(np.array(p) + (np.array(q) - np.array(p)) * (d / (d - e))))
        points = out
        if not points:
            return 0.0
    x, y = np.array(points).T
    return abs(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1))) / 2


def quads(n, seed):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        at = np.sort(rng.uniform(0, 2 * np.pi, 4))
        centre, size = rng.uniform(-60, 160, 2), rng.uniform(1, 120)
        out.append((centre + size * np.stack([np.cos(at), np.sin(at)], 1)).round(int(rng.integers(0, 4))))
    out += [np.array([[0, 0], [10, 0], [10, 10], [0, 10]]), np.array([[5, 5]] * 4), np.array([[0, 50], [100, 50], [100, 50], [0, 50]]), np.array([[20, -30], [20, 140], [20, 140], [20, -30]])]
    return out


def test_area_in_window_matches_clipping(spark):
    window = (0.0, 10.0, 100.0, 90.0)
    rows = [(k, q.ravel().astype(float).tolist(), list(window)) for k, q in enumerate(quads(300, 1))]
    rows += [(1000 + k, [c[i] for j in (3, 2, 1, 0) for i in (2 * j, 2 * j + 1)], w) for k, c, w in rows[:40]]  # the other way round
    df = spark.createDataFrame(rows, "k long, c array<double>, w array<double>")
    box = {n: F.col("w")[i] for i, n in enumerate(("x1", "y1", "x2", "y2"))}
    for r in df.select("k", "c", pg.area_in_window(F.col("c"), 4, box).alias("a"), pg.quad_foreground("c", "w").alias("s"), pg.polygon_area(F.col("c"), 4).alias("whole")).collect():
        want = clipped_area(np.array(r.c).reshape(4, 2), window)
        assert abs(r.a - want) < 1e-5 * max(1, want)
        assert abs(r.s - want / max(clipped_area(np.array(r.c).reshape(4, 2), (-1e4, -1e4, 1e4, 1e4)), 1e-6)) < 1e-5


def test_quads_of_windows(spark):
    objs = [("a", k, q.ravel().astype(float).tolist()) for k, q in enumerate(quads(200, 2))] + [("b", 900, [0.0, 0.0, 30.0, 0.0, 30.0, 30.0, 0.0, 30.0])]
    objects = spark.createDataFrame(objs, "image_id string, gt_id long, corners array<double>")
    wins = ds.windows(spark.createDataFrame([("a", 150, 120), ("c", 50, 50)], "image_id string, width int, height int"), 64, 16)
    got = {(r.image_id, r.gt_id, r.x_start, r.y_start): r for r in ds.window_quads(objects, wins, 64, 0.4).collect()}
    want = set()
    for w in wins.collect():
        for image, k, c in objs:
            points = np.array(c).reshape(4, 2)
            whole = clipped_area(points, (-1e4, -1e4, 1e4, 1e4))
            if image == w.image_id and clipped_area(points, (w.x_start, w.y_start, w.x_stop, w.y_stop)) / max(whole, 1e-6) >= 0.4:
                want.add((image, k, w.x_start, w.y_start))
    assert set(got) == want and len(want) > 20
    r = next(iter(got.values()))
    own = next(c for i, k, c in objs if (i, k) == (r.image_id, r.gt_id))
    assert np.allclose(np.array(r.corners).reshape(4, 2) + [r.x_start, r.y_start], np.array(own).reshape(4, 2))


def test_rotated_pairs_lose_nothing(spark):
    rng = np.random.default_rng(3)
    rot = lambda: tuple(float(x) for x in (*rng.uniform(0, 60, 2), *rng.uniform(1, 40, 2), rng.uniform(-2, 2)))
    shape = F.struct("cx", "cy", "w", "h", "r").alias("rot")
    d = spark.createDataFrame([("a", k, float(rng.random()), int(k % 2), *rot()) for k in range(150)], "image_id string, det long, conf double, cls int, cx double, cy double, w double, h double, r double").select("image_id", "det", "conf", "cls", shape)
    t = spark.createDataFrame([("a", k, int(k % 2), *rot()) for k in range(120)], "image_id string, gt_id long, cls int, cx double, cy double, w double, h double, r double").select("image_id", "gt_id", "cls", shape)
    every = d.join(t.select("gt_id", "cls", F.col("rot").alias("g")), "cls").withColumn("sim", bx.probiou(F.col("g"), F.col("rot")))
    for least in (0.2, 0.5):
        want = {(r.det, r.gt_id) for r in every.filter(F.col("sim") >= least).collect()}
        assert {(r.det, r.gt_id) for r in dt.rotated_pairs(d, t, least).collect()} == want and want


def test_anchor_grid_rows_first(spark):
    df = spark.createDataFrame([(20, 9), (0, 5)], "w int, h int")
    rows = [tuple(r) for r in df.select(F.explode(bx.anchor_grid(F.col("w"), F.col("h"), (8, 16)))).select("col.*").collect()]
    want = [(x + y * 3, (x + 0.5) * 8, (y + 0.5) * 8, 8) for y in range(2) for x in range(3)] + [(6 + x, (x + 0.5) * 16, 8.0, 16) for x in range(2)]
    assert rows == want


def test_fixed_sets_and_contract_difference(spark):
    base = spark.createDataFrame([("i", 1, k, q) for k, q in enumerate((0.9, 0.5, 0.5, 0.0))], "image_id string, gt_id long, candidate long, q double")
    shifted = spark.createDataFrame([("i", 1, "up", 2, 0.4), ("i", 1, "up", 7, 0.3)], "image_id string, gt_id long, direction string, candidate long, q double")
    moved = spark.createDataFrame([("i", 1, "up"), ("i", 1, "down"), ("i", 2, "up")], "image_id string, gt_id long, direction string")
    got = {(r.gt_id, r.direction): (r.base_size, r.shift_size, r.intersection, r.jaccard) for r in tr.fixed_sets(base, shifted, moved, 2).collect()}
    assert got == {(1, "up"): (2, 2, 0, 0.0), (1, "down"): (2, 0, 0, 0.0), (2, "up"): (0, 0, 0, None)}
    v = spark.createDataFrame([("x", "a", 3.0), ("x", "b", 1.0), ("y", "a", 1.0)], "k string, c string, v double")
    assert {r.k: r.v for r in es.contract_difference(v, ["k"], "c", "a", "b", ["v"]).collect()} == {"x": 2.0, "y": None}
