"""Plans that stay bounded on large tables: what is broadcast, stored and exchanged."""

import hashlib
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from driftline.functions import boxes as bx
from driftline.operators import assign as asg
from driftline.operators import detection as dt
from driftline.operators import linking as lk
from driftline.operators import resample as rs
from driftline.operators import scan
from driftline.operators import tracks as tk
from driftline.operators.replicates import first_words
from driftline.plans import fixtures, geometry_queries, source_queries

QUERIES = contract.queries()


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["oks", "probiou", "iou_family"])
def test_pairs_keep_their_boxes(spark, sf, name):
    """The boxes come with the pair: exploded candidates are neither joined again nor broadcast."""
    plan = plan_of(QUERIES[name](spark, sf))
    assert plan.count("BroadcastHashJoin") == 0 and plan.count("SortMergeJoin") == 1


@pytest.mark.parametrize("name", ["confirmatory", "bootstrap_ratio", "holm_gate", "precision_plan"])
def test_draws_travel_packed(spark, sf, name):
    """No row per draw: a thousand rows a cluster would be exchanged."""
    plan = plan_of(QUERIES[name](spark, sf))
    assert "MapInArrow" in plan and "false, [rep#" not in plan


def test_draws_are_md5():
    heads, tails = [b"7|%d|a|" % r for r in (1, 20, 300)], [b"%d" % k for k in (0, 9, 10, 123456)]
    for more in (b"", b"x" * 50):  # one block of 64 bytes, and longer
        got = first_words([more + h for h in heads], tails)
        assert got.tolist() == [[int(hashlib.md5(more + h + k).hexdigest()[:8], 16) for h in heads] for k in tails]


def test_step_through_an_end_of_the_line(spark):
    """The step meets x = 20 at y = 90 exactly; signs of areas round it to a miss."""
    points = spark.createDataFrame([(0, 1, 1, "a", 15.39, 96.0), (0, 1, 2, "a", 52.27, 48.0)], "video_id int, track_id int, frame int, cls string, cx double, cy double")
    for line in ([(20.0, 10.0), (20.0, 90.0)], [(20.0, 90.0), (20.0, 10.0)]):
        assert [r.direction for r in tk.line_crossings(points, line).collect()] == ["IN"]
    level = points.select("video_id", "track_id", "frame", "cls", F.col("cy").alias("cx"), F.col("cx").alias("cy"))
    assert tk.line_crossings(level, [(10.0, 20.0), (90.0, 20.0)]).count() == 1


def test_anchors_are_those_of_the_array(spark, sf):
    images = spark.createDataFrame([("a", 70, 33), ("b", 0, 10), ("c", 16, 16)], "image_id string, w int, h int")
    size = F.col("w"), F.col("h"), (16, 32)
    rows = bx.anchors(images, *size).select("image_id", "anchor", "ax", "ay", "stride")
    want = images.select("image_id", F.explode(bx.anchor_grid(*size)).alias("a")).select("image_id", "a.*")
    assert sorted(rows.collect()) == sorted(want.collect()) and rows.count() > 20
    assert "lambda" not in plan_of(QUERIES["anchor_grid"](spark, sf))


def test_tasks_of_curves_follow_the_rays(spark, sf, monkeypatch):
    monkeypatch.setattr(fixtures, "RAYS_A_TASK", 50)
    for name in ("boundary_events", "coarse_fine_search", "return_signature"):
        plan = plan_of(QUERIES[name](spark, sf))
        assert f", {fixtures.table(spark, sf, 'orders').count() // 50})" in plan and "REPARTITION_BY_NUM" in plan


REPLAYS = ["replay_endpoint", "eligibility_lock", "gap_shift", "rank_correlation", "assignment_targets"]


@pytest.mark.parametrize("name", REPLAYS)
def test_pairs_stay_with_their_image(spark, sf, name):
    """Only tables dealt by image are exchanged, no candidates by cell and no pairs of moved objects."""
    exchanges = [line for line in plan_of(QUERIES[name](spark, sf)).split("\n") if "Exchange hashpartitioning" in line]
    assert any("hashpartitioning(image_id" in e and "REPARTITION_BY_NUM" in e for e in exchanges)
    assert not any("_cx#" in e or ("direction#" in e and "candidate#" in e) for e in exchanges)


@pytest.mark.parametrize("name", ["replay_endpoint", "rank_correlation", "assignment_targets"])
def test_crowded_images_are_not_dealt_whole(spark, sf, monkeypatch, name):
    """An image of too many candidates for one task goes by its cells, with the same rows."""
    rows = sorted(map(str, QUERIES[name](spark, sf).collect()))
    monkeypatch.setattr(asg, "CANDS_A_TASK", 20)
    assert "REPARTITION_BY_NUM" not in plan_of(QUERIES[name](spark, sf))
    assert sorted(map(str, QUERIES[name](spark, sf).collect())) == rows


@pytest.mark.parametrize("name", ["match_rotated", "tile_merge"])
def test_covariances_are_made_once_a_box(spark, sf, name):
    """Exploded boxes are not broadcast, and what follows from one box alone is not worked out for every pair."""
    plan = plan_of(QUERIES[name](spark, sf)).split("\n")
    assert not any("BroadcastHashJoin" in line and "_cx#" in line for line in plan)
    joins = [line for line in plan if "Join [" in line and "_cx#" in line]
    assert joins and not any("COS(" in line for line in joins)


def test_vectors_meet_queries_by_matrix(spark, sf, monkeypatch):
    """No row per pair; equal vectors tie whatever their group, and a vector with a null element matches nothing."""
    assert "zip_with" not in plan_of(QUERIES["vector_topk"](spark, sf))
    rows = [(i, [float(i % 5), 1.0, 0.1 * (i % 5)]) for i in range(60)] + [(60, None), (61, [1.0, None, 1.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    monkeypatch.setattr(dt, "GROUP", 7)
    found = dt.vector_topk(df, df.filter("id IN (3, 60, 61)"), "id", "v", 4, 0.5).orderBy("rank").collect()
    assert [(r["query"], r["id"], r["rank"]) for r in found] == [(3, i, n) for n, i in enumerate((3, 8, 13, 18), 1)]


def test_budget_draws_are_limited_before_the_exchange(spark, sf):
    assert plan_of(QUERIES["budget_efficiency"](spark, sf)).count("WindowGroupLimit") >= 2


def test_budgets_beyond_the_limit_give_the_same_draws(spark, monkeypatch):
    roster = spark.range(400).selectExpr("CAST(id % 3 AS STRING) AS s", "CAST(id AS STRING) AS c")
    draws = lambda: sorted(map(tuple, rs.budget_draws(roster, "s", "c", (20, 50), 3, 7).collect()))
    limited = draws()
    monkeypatch.setattr(rs, "GROUP_LIMIT", 10)
    assert limited == draws() and len(limited) == 3 * 70


def test_files_are_written_by_a_task_each(spark, sf, monkeypatch):
    tasks = []
    monkeypatch.setattr(source_queries.fs, "scan_files", lambda s, folder, glob: tasks.extend({r.name.split("-")[1] for r in s.read.text(folder).select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("name")).distinct().collect()}) or s.range(1).selectExpr("1L AS size", "'' AS sha256"))
    monkeypatch.setattr(source_queries, "table", lambda s, *_: s.range(60_000).withColumnRenamed("id", "o_orderkey"))
    QUERIES["file_scan"](spark, sf)
    assert len(tasks) > 1


def test_scan_ranks_the_base_once(spark, sf):
    """The base pairs are worked out and joined once: one join by cell each for pairs and reach, one of the two, two by object."""
    truth, cands = geometry_queries.dealt_tables(spark, sf)
    met = scan.reachable(truth, cands, F.lit(2.0))
    plan = plan_of(scan.beside_others(met, asg.eligible_pairs(truth, cands)))
    assert plan.count("SortMergeJoin") + plan.count("HashJoin") <= 4 and plan.count("rank#") > 0


def test_rays_leave_when_their_events_are_found(monkeypatch):
    """A ray of 1,025 radii whose events all lie at its beginning is not replayed to its end."""
    seen, plain = [], scan.states
    monkeypatch.setattr(scan, "states", lambda *a: seen.append(a[1].size) or plain(*a))
    flat = {"candidate": np.arange(2), "ord": np.arange(1, 3), "others_one": np.zeros(2, int), "others_many": np.zeros(2, int), "rival_gt": np.full(2, -1)}
    flat |= {"ax": np.array([20.0, 22.0]), "ay": np.full(2, 20.0), "p": np.array([0.5, 0.5]), "rival_c": np.zeros(2)}
    flat |= {"x1": np.array([10.0, 12.0]), "x2": np.array([30.0, 32.0]), "y1": np.full(2, 10.0), "y2": np.full(2, 30.0)}
    c = scan._padded(flat, np.zeros(1, int), np.full(1, 2), np.zeros(1, int), np.zeros(1, int))
    c.pop("names")
    out = scan.events(np.array([[10.0, 10.0, 30.0, 30.0]]), np.full(1, 20.0), np.ones(1), 1.0, False, c, 1 / 1024)
    # Half way between the two candidates, 1 of 20 pixels, the second one takes over.
    assert [int(out[k][0]) for k in ("o2o_at", "o2o_now", "active", "runner", "pair_at")] == [52, 1, 0, 1, 52]
    assert sum(seen) < 100


def test_crowded_frames_meet_in_pieces(monkeypatch):
    """Boxes of a crowded frame are not met all by all, and the pairs are those of the dense matrix."""
    rng = np.random.default_rng(3)
    tracks = [{"mean": np.array([x, y, 1.0, 20.0])} for x, y in rng.uniform(0, [6000, 100], (700, 2))]
    boxes = np.column_stack([rng.uniform(0, 6000, 800), rng.uniform(0, 100, 800), np.full((800, 2), 20.0)])
    conf = rng.uniform(0.3, 1, 800)
    gain = np.maximum(0.8 - (1.0 - lk._iou(lk._boxes(tracks), boxes) * conf), 0.0)
    sizes, plain = [], lk._iou
    monkeypatch.setattr(lk, "_iou", lambda a, b: sizes.append(len(a) * len(b)) or plain(a, b))
    pairs, left, right = lk._associate(tracks, boxes, conf, 0.8)
    assert pairs == lk.optimal_pairs(gain) and len(pairs) > 100 and len(left) == 700 - len(pairs) and len(right) == 800 - len(pairs)
    assert sum(sizes) < 700 * 800 / 2


def test_pairs_of_equal_gains_are_optimal():
    """Rows that tie for the same columns: the total is that of the best of all permutations."""
    rng = np.random.default_rng(4)
    for _ in range(40):
        gain = rng.integers(0, 3, (5, 6)) / 4
        best = max(sum(gain[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(6), 5))
        pairs = lk.optimal_pairs(gain)
        assert sum(gain[i, j] for i, j in pairs) == best and len({j for _, j in pairs}) == len(pairs)
