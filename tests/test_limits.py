"""Beyond former limits: long claim lists, many queries, wide boxes, many categories; and frames without detections."""

import random
import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from driftline.operators import assign as asg
from driftline.operators import dataset as ds
from driftline.operators import detection as dt
from driftline.operators import linking as lk
from driftline.operators import reconcile as rc

BOX = "struct<x1:double,y1:double,x2:double,y2:double>"


def test_claims_of_any_length(spark):
    rng = random.Random(1)
    cands = [("im", c, (0.0, 0.0, 90.0, 90.0) if c % 3 == 0 else (500.0, 500.0, 510.0, 510.0), rng.uniform(1, 99), rng.uniform(1, 99), (c % 7 + 1) / 10) for c in range(40)]
    c = spark.createDataFrame(cands, f"image_id string, candidate long, box {BOX}, ax double, ay double, p double")
    t = spark.createDataFrame([("im", 1, (0.0, 0.0, 100.0, 100.0))], f"image_id string, gt_id long, box {BOX}")
    pairs = asg.eligible_pairs(t, c)
    q = {r.candidate: r.q for r in pairs.collect()}
    assert len(q) == 40 and 0 < sum(v > 0 for v in q.values()) < 25
    for k in (5, 12, 25):
        want = sorted(q, key=lambda i: (-q[i], i))[:k]
        assert sorted(r.candidate for r in asg.claims(pairs, k).collect()) == sorted(want)


def test_queries_in_blocks(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(i, [float(x) for x in rng.standard_normal(6)]) for i in range(120)], "id long, v array<double>")
    q = df.filter("id % 2 = 0")
    one = sorted(map(tuple, dt.vector_topk(df, q, "id", "v", 3, -1.0).collect()))
    many = sorted(map(tuple, dt.vector_topk(df, q, "id", "v", 3, -1.0, block_bytes=400).collect()))
    assert one == many and len(one) == 180


def test_windows_catch_boxes_wider_than_a_crop(spark):
    wins = ds.windows(spark.createDataFrame([("im", 900, 900)], "image_id string, width int, height int"), crop=100, gap=0, rate=0.0)
    objects = spark.createDataFrame([("im", 1, (10.0, 410.0, 290.0, 430.0)), ("im", 2, (110.0, 110.0, 120.0, 120.0))], f"image_id string, gt_id long, box {BOX}")
    got = {(r.gt_id, r.x_start, r.y_start) for r in ds.window_objects(objects, wins, 100, 0.3).collect()}
    want = set()
    for w in wins.collect():
        for g, b in ((1, (10, 410, 290, 430)), (2, (110, 110, 120, 120))):
            inter = max(0, min(b[2], w.x_stop) - max(b[0], w.x_start)) * max(0, min(b[3], w.y_stop) - max(b[1], w.y_start))
            if inter / ((b[2] - b[0]) * (b[3] - b[1])) >= 0.3:
                want.add((g, w.x_start, w.y_start))
    assert got == want and any(g == 1 and x == 200 for g, x, _ in got)


def test_examples_of_every_category(spark):
    df = spark.range(500).withColumn("c", (F.col("id") % 50).cast("string"))
    out = rc.examples(df, F.col("c"), [], ["id"]).collect()
    assert len(out) == 150 and len({r.category for r in out}) == 50


def test_no_limit_on_detections_unless_given(spark):
    rows = [("im", i, 0, 0.9, (i * 50.0, 0.0, i * 50.0 + 10, 10.0)) for i in range(400)]
    df = spark.createDataFrame(rows, f"image_id string, det long, cls int, conf double, box {BOX}")
    assert dt.greedy_nms(df, 0.5).count() == 400 and dt.greedy_nms(df, 0.5, max_det=300).count() == 300


def steps(frames, rules):
    state = lk.Tracks()
    out = {}
    for frame, boxes in frames:
        linked = lk.advance(state, frame, np.array(boxes, float), np.full(len(boxes), 0.9), np.zeros(len(boxes)), rules)
        out[frame] = sorted((j, t) for j, t in linked)
    return out, state


def test_frames_without_detections_end_unconfirmed_tracks():
    a, b = [50, 50, 20, 20], [300, 300, 20, 20]
    out, state = steps([(1, [a]), (2, [a, b]), (5, [a, b])], lk.Rules())
    assert out[1] == [(0, 1)] and out[2] == [(0, 1)] and out[5] == [(0, 1)]
    assert {t["id"] for t in state.items if t["active"]} == {1}
    out, _ = steps([(1, [a]), (2, [a, b]), (3, [a, b])], lk.Rules())
    assert out[3] == [(0, 1), (1, 2)]


def test_gaps_up_to_the_buffer_keep_a_track():
    rules = lk.Rules()
    a = [50, 50, 20, 20]
    for gap in (1, 2, 5, rules.buffer, rules.buffer + 1, rules.buffer + 2):
        out, state = steps([(1, [a]), (2, [a]), (2 + gap, [a])], rules)
        kept = out[2 + gap] == [(0, 1)]
        assert kept == (gap <= rules.buffer + 1), gap


def test_possible_pairs_beyond_memory(monkeypatch):
    """In a crowd nearly all pairs are possible; those that aren't held are worked out anew, with equal pairs."""
    rng = np.random.default_rng(8)
    n = 250
    a = np.column_stack([rng.uniform(0, 12, (n, 2)), rng.uniform(18, 22, (n, 2))])
    b, conf = a[rng.permutation(n)] + rng.normal(0, 1.0, (n, 4)), rng.uniform(0.3, 1.0, n)
    tracks = [{"mean": np.array([x, y, w / h, h, 0, 0, 0, 0])} for x, y, w, h in a]
    want = lk._associate(tracks, b, conf, 0.8)
    row, col, iou = (np.concatenate(x) for x in zip(*lk._overlaps(lk._boxes(tracks), b)))
    gain = 0.8 - (1.0 - iou * conf[col])
    row, col, gain = row[gain > 0], col[gain > 0], gain[gain > 0]
    order = np.lexsort((col, row))
    assert want[0] == lk.best_pairs(n, n, row[order], col[order], gain[order])
    monkeypatch.setattr(lk, "PAIRS", 5000)
    assert lk._associate(tracks, b, conf, 0.8) == want
    # Two million pairs and more, of which few are held: nothing grows with them.
    tracemalloc.start()
    crowd = lk._Possible(np.tile(a, (8, 1)), np.tile(b, (8, 1)), np.tile(conf, 8), 0.8)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert crowd.size.sum() > 2_000_000 and sum(len(c) for c, _ in crowd.held.values()) <= 5000 and most < 80 << 20


def test_rows_worked_out_are_those_held(monkeypatch):
    rng = np.random.default_rng(9)
    a = np.column_stack([rng.uniform(-50, 50, (120, 2)), rng.uniform(1, 30, (120, 2))])
    b, conf = np.column_stack([rng.uniform(-50, 50, (90, 2)), rng.uniform(1, 30, (90, 2))]), rng.uniform(0.1, 1.0, 90)
    for limit in (0.5, 0.99, 1.2):
        held = lk._Possible(a, b, conf, limit)
        monkeypatch.setattr(lk, "PAIRS", 0)
        bare = lk._Possible(a, b, conf, limit)
        monkeypatch.undo()
        assert not bare.held and held.size.tolist() == bare.size.tolist() == [len(bare.of(i)[0]) for i in range(120)]
        for i in held.held:
            assert all(x.tolist() == y.tolist() for x, y in zip(held.of(i), bare.of(i)))
