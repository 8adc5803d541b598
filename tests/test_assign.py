"""Assignment against a brute-force replay on small random images, zero alignments included."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.functions.boxes import DIRECTIONS
from driftline.operators import assign as asg
from driftline.operators import reconcile as rc
from driftline.operators import trajectory as tr


def ciou(a, b):
    w1, h1, w2, h2 = a[2] - a[0], a[3] - a[1] + 1e-7, b[2] - b[0], b[3] - b[1] + 1e-7
    inter = max(min(a[2], b[2]) - max(a[0], b[0]), 0) * max(min(a[3], b[3]) - max(a[1], b[1]), 0)
    union = w1 * h1 + w2 * h2 - inter + 1e-7
    cw, ch = max(a[2], b[2]) - min(a[0], b[0]), max(a[3], b[3]) - min(a[1], b[1])
    rho = ((b[0] + b[2] - a[0] - a[2]) ** 2 + (b[1] + b[3] - a[1] - a[3]) ** 2) / 4
    v = 4 / np.pi**2 * (np.arctan(w2 / h2) - np.arctan(w1 / h1)) ** 2
    i = inter / union
    return i - (rho / (cw**2 + ch**2 + 1e-7) + v * v / (v - i + 1 + 1e-7))


def brute(gts, cands, k, single, locked=None):
    """Dense replay: returns owner masks (gt x candidate) after every stage."""
    n, m = len(gts), len(cands)
    elig, c = np.zeros((n, m), bool), np.zeros((n, m))
    for g, b in enumerate(gts):
        cx, cy, w, h = (b[0] + b[2]) / 2, (b[1] + b[3]) / 2, b[2] - b[0], b[3] - b[1]
        w, h = (16 if w < 8 else w), (16 if h < 8 else h)
        for j, (box, ax, ay, p) in enumerate(cands):
            elig[g, j] = min(ax - cx + w / 2, ay - cy + h / 2, cx + w / 2 - ax, cy + h / 2 - ay) > 1e-9 if locked is None else locked[g, j]
            if elig[g, j]:
                c[g, j] = max(ciou(b, box), 0)
    q = np.sqrt([x[3] for x in cands])[None, :] * c**6 * elig
    claim = np.zeros((n, m), bool)
    for g in range(n):
        claim[g, sorted(range(m), key=lambda j: (-q[g, j], j))[:k]] = True
    claim &= elig
    own = claim.copy()
    for j in np.flatnonzero(claim.sum(0) > 1):
        own[:, j] = False
        own[int(np.argmax(c[:, j])), j] = True
    post = own.copy()
    if single:
        for g in range(n):
            best = int(np.argmax(q[g] * own[g]))
            post[g] = False
            post[g, best] = own[g, best]
    return elig, claim, own, post


def random_image(seed, tiny):
    r = random.Random(seed)
    gts, cands = [], []
    for _ in range(r.randint(2, 6)):
        w, h, x, y = (r.choice([3, 5]) if tiny else r.randint(8, 20)), (r.choice([3, 5]) if tiny else r.randint(8, 20)), r.randint(20, 60), r.randint(20, 60)
        gts.append((float(x), float(y), float(x + w), float(y + h)))
    for _ in range(40):
        x, y, s = r.uniform(10, 80), r.uniform(10, 80), r.uniform(2, 12)
        cands.append(((x - s, y - s, x + s, y + s), x, y, r.randint(0, 20) / 20))
    return gts, cands


@pytest.fixture(scope="module")
def images():
    return {f"im{i}": random_image(i, i % 2 == 0) for i in range(10)}


@pytest.fixture(scope="module")
def frames(spark, images):
    t = [(k, g, w) for k, (gts, _) in images.items() for g, w in enumerate(gts)]
    c = [(k, j, *row) for k, (_, cands) in images.items() for j, row in enumerate(cands)]
    b = "struct<x1: double, y1: double, x2: double, y2: double>"
    truth = spark.createDataFrame(t, f"image_id string, gt_id long, box {b}")
    cands = spark.createDataFrame(c, f"image_id string, candidate long, box {b}, ax double, ay double, p double")
    return truth.cache(), cands.cache()


def as_set(df):
    return {(r["image_id"], r["gt_id"], r["candidate"]) for r in df.select("image_id", "gt_id", "candidate").collect()}


def expected(images, k, single, stage):
    out = set()
    for name, (gts, cands) in images.items():
        mask = brute(gts, cands, k, single)[stage]
        out |= {(name, int(g), int(j)) for g, j in np.argwhere(mask)}
    return out


@pytest.mark.parametrize("k,single", [(7, True), (10, False), (3, True)])
def test_stages(frames, images, k, single):
    truth, cands = frames
    flagged = asg.flag_claims(asg.eligible_pairs(truth, cands), k)
    assert as_set(flagged) == expected(images, k, single, 0)
    assert as_set(flagged.filter("claimed")) == expected(images, k, single, 1)
    assert as_set(asg.owners(flagged)) == expected(images, k, single, 2)
    assert as_set(asg.assign(flagged, single=single)) == expected(images, k, single, 3)


@pytest.mark.parametrize("lock", [False, True])
def test_replay_of_each_object(frames, images, lock):
    truth, cands = frames
    base = asg.eligible_pairs(truth, cands)
    moved = asg.shifted_truth(truth, F.lit(3.0), F.lit(3.0), 200, 200)
    extra = ["direction"]
    shifted = asg.locked_pairs(base, moved, cands, extra=extra) if lock else asg.eligible_pairs(moved, cands, base=truth, extra=extra)
    flagged = asg.flag_claims(base, 7)
    got = {(r["image_id"], r["gt_id"], r["direction"], r["candidate"]) for r in asg.replay(flagged, shifted, k=7, extra=extra, single=True).collect()}
    want = set()
    for name, (gts, cs) in images.items():
        held = brute(gts, cs, 7, True)[0] if lock else None
        for g in range(len(gts)):
            for d, ux, uy in DIRECTIONS:
                world = list(gts)
                b = world[g]
                world[g] = (b[0] + 3 * ux, b[1] + 3 * uy, b[2] + 3 * ux, b[3] + 3 * uy)
                post = brute(world, cs, 7, True, held)[3]
                want |= {(name, g, d, int(j)) for j in np.flatnonzero(post[g])}
    assert got == want


def test_conflict_off_lets_candidates_be_shared(frames):
    truth, cands = frames
    flagged = asg.flag_claims(asg.eligible_pairs(truth, cands), 7)
    off = asg.assign(flagged, single=False, conflict=False)
    assert as_set(off) == as_set(flagged.filter("claimed"))


def test_partitions_and_row_order_do_not_matter(frames):
    truth, cands = frames
    one = asg.assign(asg.flag_claims(asg.eligible_pairs(truth, cands), 7))
    two = asg.assign(asg.flag_claims(asg.eligible_pairs(truth.orderBy(F.rand(3)).repartition(5), cands.orderBy(F.rand(4)).repartition(3)), 7))
    assert as_set(one) == as_set(two)


def test_stage_parity_of_equal_outputs(frames):
    truth, cands = frames
    flagged = asg.flag_claims(asg.eligible_pairs(truth, cands), 7)
    r = rc.stage_parity(flagged, flagged, ["image_id", "gt_id", "candidate"], ["claimed"], {"q": 1e-6}).first()
    assert r["claimed_mismatch"] == 0 and r["q_mismatch"] == 0


def test_divergence_priority(spark):
    rows = [(True, True, True, True, 1), (False, True, True, True, 1), (False, False, True, True, 1), (False, False, False, True, 1), (False, False, False, False, None), (False, False, False, False, 1)]
    df = spark.createDataFrame(rows, "e boolean, t boolean, c boolean, r boolean, a int")
    got = [x[0] for x in df.select(tr.divergence_label(F.col("e"), F.col("t"), F.col("c"), F.col("r"), F.col("a"))).collect()]
    assert got == ["eligibility_boundary", "topk_membership_transition", "conflict_reassignment", "within_set_geometry_rank_reversal", "active_disappearance", "compound_or_other"]


def test_forward_grid(spark):
    df = spark.createDataFrame([(0.0, 1.0), (0.0, 0.9), (1.0, 1.0), (0.0, 0.25)], "a double, b double")
    got = [r[0] for r in df.select(tr.forward_grid(F.col("a"), F.col("b"), 0.25)).collect()]
    assert got == [[0.25, 0.5, 0.75, 1.0], [0.25, 0.5, 0.75, 0.9], [], [0.25]]


def test_first_change_treats_null_as_a_value(spark):
    rows = [("a", 0.0, 1), ("a", 0.1, 1), ("a", 0.2, None), ("b", 0.0, None), ("b", 0.1, None), ("c", 0.0, None), ("c", 0.1, 4)]
    df = spark.createDataFrame(rows, "k string, r double, v int")
    got = {x["k"]: (x["event_observed"], x["event_radius"], x["bracket_low"], x["censor_radius"]) for x in tr.first_change(df, ["k"], "r", "v").collect()}
    assert got == {"a": (1, 0.2, 0.1, None), "b": (0, None, None, 0.1), "c": (1, 0.1, 0.0, None)}


def test_target_scores_and_foreground(frames):
    truth, cands = frames
    a = asg.assign(asg.flag_claims(asg.eligible_pairs(truth, cands), 10), single=False)
    assert asg.target_scores(a).filter("target_score > c + 1").count() == 0
    assert asg.foreground(a).count() == a.select("image_id", "candidate").distinct().count()
