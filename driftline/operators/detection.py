"""Detection post-processing and evaluation.

Detections: (image_id, det, cls, conf, box); truth: (image_id, gt_id, cls, box). Overlaps are found by grid cell, so a crowded
image is spread over its cells, and best-match steps are hash aggregations.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.boxes import gaussian, gaussian_iou, iou, points_box
from .assign import home_cell, with_cells
from .ordered import running_sums

CELL = 32.0
THRESHOLDS = tuple(range(50, 100, 5))


def near_pairs(a: DataFrame, b: DataFrame, keys: Sequence[str], a_reach: str, b_reach: str, cell: float = CELL) -> DataFrame:
    """Rows of ``a`` and ``b`` with equal keys whose reach boxes intersect, each pair once.

    Reaches are covered by grid cells and joined by cell; a pair counts in the cell that holds the lower corner of the
    intersection. Exploded rows pass for as few as their source, so the join is asked to merge, not to send one side to every task.
    """
    left, right = with_cells(a, F.col(a_reach), cell), with_cells(b, F.col(b_reach), cell)
    ra, rb = F.col(a_reach), F.col(b_reach)
    meets = (ra["x1"] <= rb["x2"]) & (rb["x1"] <= ra["x2"]) & (ra["y1"] <= rb["y2"]) & (rb["y1"] <= ra["y2"])
    return left.hint("merge").join(right, [*keys, "_cx", "_cy"]).filter(meets & home_cell(ra, rb, cell)).drop("_cx", "_cy")


def shape_predictions(preds: DataFrame, scores: str, conf: float = 0.25, *, multi_label: bool = False, classes: Sequence[int] | None = None, max_nms: int | None = None) -> DataFrame:
    """Candidate detections from per-class score arrays: confidence filter, best class or one row per class, class filter.

    ``max_nms``, where given, is the pre-suppression limit per image, by score.
    """
    if multi_label:
        rows = preds.select("*", F.posexplode(scores).alias("cls", "conf")).filter(F.col("conf") > conf)
    else:
        best = F.array_max(scores)
        rows = preds.withColumns({"conf": best, "cls": (F.array_position(scores, best) - 1).cast("int")}).filter(F.col("conf") > conf)
    if classes is not None:
        rows = rows.filter(F.col("cls").isin(list(classes)))
    return top_detections(rows.drop(scores), max_nms)


def top_detections(dets: DataFrame, n: int | None) -> DataFrame:
    """At most ``n`` detections per image by score, all if None; Spark limits each group before the shuffle."""
    if n is None:
        return dets
    w = Window.partitionBy("image_id").orderBy(F.desc("conf"), "det", "cls")
    return dets.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def _ahead(prefix: str = "o_") -> Column:
    """Whether the other box has the higher score (lower id on ties)."""
    return (F.col(prefix + "conf") > F.col("conf")) | ((F.col(prefix + "conf") == F.col("conf")) & (F.col(prefix + "det") < F.col("det")))


def fast_nms(dets: DataFrame, threshold: float, *, similarity: Callable[[Column, Column], Column] = iou, shape: str = "box", reach: Column | None = None, cell: float = CELL) -> DataFrame:
    """Drop a box if any higher-scored box of its image and class is at least ``threshold`` similar.

    A semi join by grid cell finds the dropped boxes: it stops at the first hit and never lists pairs. As in
    :func:`near_pairs` the joins are asked to merge: exploded rows are never sent to every task.
    """
    base = dets.withColumn("_reach", F.col("box") if reach is None else reach)
    cells = with_cells(base, F.col("_reach"), cell)
    keys = ["image_id", "cls", "_cx", "_cy"]
    low = cells.select(*keys, "det", "conf", shape)
    high = cells.select(*[F.col(k).alias("o_" + k) for k in keys], F.col("det").alias("o_det"), F.col("conf").alias("o_conf"), F.col(shape).alias("o_shape"))
    same = [F.col(k) == F.col("o_" + k) for k in keys]
    hit = (
        same[0] & same[1] & same[2] & same[3] & _ahead() & (similarity(F.col("o_shape"), F.col(shape)) >= threshold)
    )
    dropped = low.join(high.hint("merge"), hit, "left_semi").select("image_id", "cls", "det").distinct()
    return dets.join(dropped.hint("merge"), ["image_id", "cls", "det"], "left_anti")


def rotated_reach(rot: Column, threshold: float) -> Column:
    """Square around a rotated box such that two boxes of at least ``threshold`` similarity have meeting squares."""
    distance = -math.log(1.0 - (1.0 - threshold) ** 2)
    r = F.greatest(rot["w"], rot["h"]) * F.lit(math.sqrt(distance / 3.0) + 1e-3)
    return F.struct((rot["cx"] - r).alias("x1"), (rot["cy"] - r).alias("y1"), (rot["cx"] + r).alias("x2"), (rot["cy"] + r).alias("y2"))


def tile_merge(dets: DataFrame, tile: str, threshold: float = 0.3) -> DataFrame:
    """Merge detections of tiles: image and offset from names like ``image__size__x___y``, shift, fast NMS on rotated boxes."""
    pattern = r"^(.*)__\d+__(\d+)___(\d+)$"
    part = lambda i: F.regexp_extract(F.col(tile), pattern, i)
    moved = dets.withColumns({"image_id": part(1), "_ox": part(2).cast("double"), "_oy": part(3).cast("double")})
    rot = F.struct(
        (F.col("rot.cx") + F.col("_ox")).alias("cx"), (F.col("rot.cy") + F.col("_oy")).alias("cy"), F.col("rot.w").alias("w"), F.col("rot.h").alias("h"), F.col("rot.r").alias("r")
    )
    moved = moved.withColumn("rot", rot).drop("_ox", "_oy")
    ready = moved.withColumn("_g", gaussian(F.col("rot")))
    return fast_nms(ready, threshold, similarity=gaussian_iou, shape="_g", reach=rotated_reach(F.col("rot"), threshold)).drop("_g")


def _suppress(pdf, threshold: float, agnostic: bool):
    """Greedy suppression of all groups of a batch at once: in each round the first live row of every group is kept and
    removes the rows of its group that overlap it too much. Rows are sorted by group and score.
    """
    keys = pdf["image_id"] if agnostic else pdf["image_id"].astype(str) + "|" + pdf["cls"].astype(str)
    group = (keys != keys.shift()).cumsum().to_numpy()
    b = pdf[["x1", "y1", "x2", "y2"]].to_numpy(dtype=float)
    areas = (b[:, 2] - b[:, 0]) * (b[:, 3] - b[:, 1])
    alive, keep = np.arange(len(b)), []
    while len(alive):
        lead = np.r_[True, group[alive][1:] != group[alive][:-1]]
        keep.append(alive[lead])
        rest = alive[~lead]
        top = alive[lead][np.cumsum(lead) - 1][~lead]
        w = np.minimum(b[top, 2], b[rest, 2]) - np.maximum(b[top, 0], b[rest, 0])
        h = np.minimum(b[top, 3], b[rest, 3]) - np.maximum(b[top, 1], b[rest, 1])
        inter = np.clip(w, 0, None) * np.clip(h, 0, None)
        union = areas[top] + areas[rest] - inter
        alive = rest[np.divide(inter, union, out=np.zeros_like(inter), where=union > 0) <= threshold]
    return pdf.iloc[np.sort(np.concatenate(keep))] if keep else pdf


def greedy_nms(dets: DataFrame, threshold: float, *, max_nms: int | None = None, max_det: int | None = None, agnostic: bool = False) -> DataFrame:
    """Keep a box iff its IoU with every kept higher box is at most ``threshold``; then the ``max_det`` best per image.

    Greedy suppression is sequential within an image and class. Both limits are rules of a detector, off unless given:
    ``max_nms`` before suppression bounds each group, ``max_det`` cuts the result. Groups reach a task sorted, in Arrow batches; a group cut by a batch end waits for its rest.
    """
    limited = top_detections(dets, max_nms)
    flat = limited.select("image_id", "cls", "det", "conf", *[F.col(f"box.{c}").alias(c) for c in ("x1", "y1", "x2", "y2")])
    keys = ["image_id"] if agnostic else ["image_id", "cls"]
    ready = flat.repartition(*keys).sortWithinPartitions(*keys, F.desc("conf"), "det")

    def run(batches):
        held = None
        for pdf in batches:
            rows = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            if not len(rows):
                continue
            open_ = (rows[keys] == rows[keys].iloc[-1]).all(axis=1).to_numpy()
            held = rows[open_]
            if not open_.all():
                yield _suppress(rows[~open_], threshold, agnostic)
        if held is not None and len(held):
            yield _suppress(held, threshold, agnostic)

    kept = ready.mapInPandas(run, flat.schema)
    out = kept.select("image_id", "cls", "det", "conf", F.struct("x1", "y1", "x2", "y2").alias("box"))
    return top_detections(out, max_det)


# ---- matching ----------------------------------------------------------------------------------------------------


def overlap_pairs(dets: DataFrame, truth: DataFrame, least: float, *, same_class: bool = True, cell: float = CELL) -> DataFrame:
    """Detection-truth pairs with IoU of at least ``least``: (image_id, det, conf, cls, gt_id, gt_cls, sim)."""
    t = truth.select("image_id", "gt_id", F.col("cls").alias("gt_cls"), F.col("box").alias("gt_box"))
    d = dets.select("image_id", "det", "conf", "cls", "box")
    if same_class:
        near = near_pairs(d, t.withColumnRenamed("gt_cls", "cls"), ["image_id", "cls"], "box", "gt_box", cell).withColumn("gt_cls", F.col("cls"))
    else:
        near = near_pairs(d, t, ["image_id"], "box", "gt_box", cell)
    near = near.withColumn("sim", iou(F.col("gt_box"), F.col("box"))).filter(F.col("sim") >= least)
    return near.select("image_id", "det", "conf", "cls", "gt_id", "gt_cls", "sim")


def keypoint_pairs(dets: DataFrame, truth: DataFrame, least: float, similarity: Callable, sigmas: Sequence[float]) -> DataFrame:
    """Detection-truth pairs with keypoint similarity of at least ``least``.

    Some keypoint must then lie within a known distance, so pairs are looked for only where the keypoint boxes, grown by
    that distance, meet. Truth rows carry ``kpts`` and ``area``, detections ``kpts``.
    """
    grow = F.sqrt(F.lit(-2.0 * math.log(least)) * F.col("gt_area")) * F.lit(2.0 * max(sigmas) * (1 + 1e-6))
    b = points_box(F.col("gt_kpts"))
    t = truth.select("image_id", "gt_id", F.col("cls").alias("gt_cls"), F.col("kpts").alias("gt_kpts"), F.col("area").alias("gt_area"))
    t = t.withColumn("_tr", F.struct((b["x1"] - grow).alias("x1"), (b["y1"] - grow).alias("y1"), (b["x2"] + grow).alias("x2"), (b["y2"] + grow).alias("y2")))
    d = dets.select("image_id", "det", "conf", "cls", "kpts").withColumn("_dr", points_box(F.col("kpts")))
    near = near_pairs(d, t.withColumnRenamed("gt_cls", "cls"), ["image_id", "cls"], "_dr", "_tr").withColumn("gt_cls", F.col("cls"))
    near = near.withColumn("sim", similarity(F.col("gt_kpts"), F.col("kpts"), F.col("gt_area"), sigmas)).filter(F.col("sim") >= least)
    return near.select("image_id", "det", "conf", "cls", "gt_id", "gt_cls", "sim")


def rotated_pairs(dets: DataFrame, truth: DataFrame, least: float) -> DataFrame:
    """Detection-truth pairs of rotated boxes with probabilistic IoU of at least ``least``.

    Such boxes have centres within a distance bounded by their longer sides, so only those whose squares of that reach meet are
    compared: an exact range join by grid cell. Both tables carry ``rot``, a struct (cx, cy, w, h, r).
    """
    t = truth.select("image_id", "gt_id", "cls", gaussian(F.col("rot")).alias("_tg"), rotated_reach(F.col("rot"), least).alias("_tr"))
    d = dets.select("image_id", "det", "conf", "cls", gaussian(F.col("rot")).alias("_dg"), rotated_reach(F.col("rot"), least).alias("_dr"))
    near = near_pairs(d, t, ["image_id", "cls"], "_dr", "_tr").withColumn("gt_cls", F.col("cls"))
    near = near.withColumn("sim", gaussian_iou(F.col("_tg"), F.col("_dg"))).filter(F.col("sim") >= least)
    return near.select("image_id", "det", "conf", "cls", "gt_id", "gt_cls", "sim")


def match(pairs: DataFrame, thresholds: Sequence[int] = THRESHOLDS) -> DataFrame:
    """True positives: (image_id, gt_id, threshold, det). Best truth per detection, then the first detection per truth.

    The best truth does not depend on the threshold, so one aggregation serves all of them; the second step takes the
    first detection in score order among those that pass each threshold.
    """
    best = pairs.groupBy("image_id", "det").agg(
        F.max_by(F.struct("gt_id", "sim", "conf"), F.struct(F.col("sim"), (-F.col("gt_id")).alias("g"))).alias("_b")
    ).select("image_id", "det", "_b.*")
    first = F.struct((-F.col("conf")).alias("c"), F.col("det").alias("det"))
    per = best.groupBy("image_id", "gt_id").agg(*[F.min(F.when(F.col("sim") >= F.lit(t / 100), first)).alias(f"t{t}") for t in thresholds])
    rows = F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"t{t}.det").alias("det")) for t in thresholds])
    return per.select("image_id", "gt_id", F.explode(rows).alias("_m")).select("image_id", "gt_id", "_m.*").filter("det IS NOT NULL")


def confusion(dets: DataFrame, truth: DataFrame, n_classes: int, conf: float = 0.25, threshold: float = 0.45) -> DataFrame:
    """Confusion counts (predicted, actual); class ``n_classes`` is the background.

    Best truth per detection, then, ordered by overlap again, the best detection per truth.
    """
    strong = dets.filter(F.col("conf") > conf)
    pairs = overlap_pairs(strong, truth, 0.0, same_class=False).filter(F.col("sim") > threshold)
    by_det = pairs.groupBy("image_id", "det").agg(F.max_by(F.struct("gt_id", "sim", "cls"), F.struct(F.col("sim"), (-F.col("gt_id")).alias("g"))).alias("_b"))
    by_det = by_det.select("image_id", "det", "_b.*")
    by_gt = by_det.groupBy("image_id", "gt_id").agg(F.max_by(F.struct("det", "cls"), F.struct(F.col("sim"), (-F.col("det")).alias("d"))).alias("_d"))
    matched = by_gt.select("image_id", "gt_id", F.col("_d.det").alias("det"), F.col("_d.cls").alias("predicted"))
    background = F.lit(n_classes)
    rows = truth.select("image_id", "gt_id", "cls").join(matched, ["image_id", "gt_id"], "left")
    seen = rows.groupBy(F.coalesce("predicted", background).alias("predicted"), F.col("cls").alias("actual")).agg(F.count("*").alias("n"))
    spurious = strong.join(matched.select("image_id", "det"), ["image_id", "det"], "left_anti")
    false = spurious.groupBy(F.col("cls").alias("predicted"), background.alias("actual")).agg(F.count("*").alias("n"))
    return seen.unionByName(false)


# ---- precision and recall ----------------------------------------------------------------------------------------


def scored_detections(dets: DataFrame, matches: DataFrame, thresholds: Sequence[int] = THRESHOLDS) -> DataFrame:
    """Detections with cumulative counts in score order per class: rank ``n`` and true positives ``s<t>`` per threshold.

    A frequent class is worked in score blocks; equal scores are further split by detection id.
    """
    hits = matches.groupBy("image_id", "det").agg(*[F.max((F.col("threshold") == t).cast("int")).alias(f"tp{t}") for t in thresholds])
    rows = dets.select("image_id", "det", "cls", "conf").join(hits, ["image_id", "det"], "left").na.fill(0, [f"tp{t}" for t in thresholds])
    rows = rows.withColumn("_down", -F.col("conf"))
    sums = {"n": F.lit(1).cast("long"), **{f"s{t}": F.col(f"tp{t}").cast("long") for t in thresholds}}
    return running_sums(rows, ["cls"], "_down", sums, block=F.floor(F.col("_down") * 32), tie="det", tie_block=F.floor(F.col("det") / 65536))


def average_precision(scored: DataFrame, truth: DataFrame, thresholds: Sequence[int] = THRESHOLDS, points: int = 100) -> DataFrame:
    """101-point interpolated average precision per class and threshold.

    The interpolated envelope depends only on true-positive rows. Each is put in the last recall grid cell it still
    serves; the envelope is then a running maximum over at most 101 cells per class and threshold, and the value at a
    grid point needs the one true positive that ends its recall interval.
    """
    labels = truth.groupBy("cls").agg(F.count("*").alias("n_labels"))
    arr = F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"tp{t}").alias("tp"), F.col(f"s{t}").alias("s")) for t in thresholds])
    hits = scored.select("cls", "n", F.explode(arr).alias("_h")).filter("_h.tp = 1").select("cls", "_h.threshold", F.col("_h.s").alias("s"), (F.col("n") - F.col("_h.s")).alias("f"))
    hits = hits.join(labels, "cls")
    k, n, s = F.lit(points), F.col("n_labels"), F.col("s")
    last = F.least(F.floor((k * s + n - 1) / n) - 1, k - 1)
    cells = hits.groupBy("cls", "threshold", last.alias("i")).agg(F.max(s / (s + F.col("f"))).alias("p"))
    # For each grid point: the best precision among the cells at or beyond it. 101 x 101 small steps per class at most.
    spread = cells.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("i"))))
    envelope = spread.groupBy("cls", "threshold", "i").agg(F.max("p").alias("e"))
    grid = envelope.join(labels, "cls").withColumn("s", F.floor(F.col("i") * n / k) + 1)
    at = grid.join(hits.select("cls", "threshold", "s", "f"), ["cls", "threshold", "s"])
    t = F.col("s") - 1
    own = F.when(t > 0, t / (t + F.col("f"))).otherwise(F.when(F.col("f") == 0, 1.0).otherwise(0.0))
    left = F.greatest(own, F.col("e"))
    y = left + (F.col("i") / k * n - t) * (F.col("e") - left)
    share = F.when(F.col("i") == 0, 0.5).otherwise(1.0) / k
    ap = at.groupBy("cls", "threshold").agg(F.sum(y * share).alias("ap"))
    every = labels.select("cls", F.explode(F.array(*[F.lit(x) for x in thresholds])).alias("threshold"))
    return every.join(ap, ["cls", "threshold"], "left").na.fill(0.0, ["ap"])


def map_summary(ap: DataFrame) -> DataFrame:
    """mAP at 0.5, at 0.75 and over all thresholds. One row."""
    at = lambda t: F.avg(F.when(F.col("threshold") == t, F.col("ap")))
    return ap.agg(at(50).alias("map50"), at(75).alias("map75"), F.avg("ap").alias("map50_95"))


def confidence_curves(scored: DataFrame, truth: DataFrame, threshold: int = 50, points: int = 999) -> DataFrame:
    """Precision, recall and F1 of each class on a confidence grid of ``points + 1`` values, linearly interpolated.

    Detections are reduced to the first and last row of each grid cell, so the step between neighbours is at most one row
    per grid point and class.
    """
    labels = truth.groupBy("cls").agg(F.count("*").alias("n_labels"))
    row = F.struct("conf", F.col(f"s{threshold}").alias("s"), "n")
    cells = scored.groupBy("cls", F.floor(F.col("conf") * points).cast("int").alias("i")).agg(F.max_by(row, "n").alias("low"), F.min_by(row, "n").alias("high"))
    grid = labels.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points))))
    full = grid.join(cells, ["cls", "i"], "left")
    w = Window.partitionBy("cls").orderBy("i")
    # At or above the grid value: the nearest cell at i or beyond; below it: the nearest cell under i.
    above = F.first("low", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    below = F.last("high", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    full = full.select("cls", "i", "n_labels", above.alias("a"), below.alias("b"))
    x = F.col("i") / F.lit(float(points))

    def between(value, outside):
        va, vb = value(F.col("a")), value(F.col("b"))
        step = (F.col("a.conf") - x) / (F.col("a.conf") - F.col("b.conf"))
        inner = F.when(F.col("b").isNull(), va).otherwise(va + step * (vb - va))
        return F.when(F.col("a").isNull(), F.when(F.col("b").isNull(), 0.0).otherwise(outside)).otherwise(inner)

    p = between(lambda r: r["s"] / r["n"], 1.0)
    r = between(lambda q: q["s"] / F.col("n_labels"), 0.0)
    out = full.select("cls", "i", "n_labels", p.alias("precision"), r.alias("recall"))
    return out.withColumn("f1", F.lit(2.0) * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + F.lit(1e-16)))


def best_confidence(curves: DataFrame, points: int = 999, fraction: float = 0.1) -> DataFrame:
    """Confidence of the maximum of the smoothed mean F1, and each class's precision, recall and counts there."""
    size = round((points + 1) * fraction * 2) // 2 + 1
    half = size // 2
    mean = curves.groupBy("i").agg(F.avg("f1").alias("f1"))
    # One row per grid point: a window over the whole grid is bounded.
    w = Window.partitionBy(F.lit(1)).orderBy("i")
    ends = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("f1").over(w.rowsBetween(-half, half))
    pad = F.greatest(F.lit(half) - F.col("i"), F.lit(0)) * F.first("f1").over(ends) + F.greatest(F.col("i") + half - points, F.lit(0)) * F.last("f1").over(ends)
    smooth = mean.select("i", F.round((total + pad) / size, 9).alias("smooth"))
    best = smooth.agg(F.max_by("i", F.struct(F.col("smooth"), (-F.col("i")).alias("m"))).alias("i"))
    at = curves.join(best, "i")
    tp = F.rint(F.col("recall") * F.col("n_labels"))
    fp = F.rint(tp / (F.col("precision") + F.lit(1e-16)) - tp)
    return at.select("cls", (F.col("i") / float(points)).alias("confidence"), "precision", "recall", "f1", tp.cast("long").alias("tp"), fp.cast("long").alias("fp"))


def image_prf(dets: DataFrame, truth: DataFrame, matches: DataFrame, images: DataFrame, threshold: int = 50) -> DataFrame:
    """Per-image precision, recall and F1; an image without truth and detections scores one."""
    n = lambda df, name: df.groupBy("image_id").agg(F.count("*").alias(name))
    out = images.select("image_id").join(n(dets, "preds"), "image_id", "left").join(n(truth, "targets"), "image_id", "left")
    out = out.join(n(matches.filter(F.col("threshold") == threshold), "tp"), "image_id", "left").na.fill(0, ["preds", "targets", "tp"])
    p = F.when(F.col("preds") > 0, F.col("tp") / F.col("preds")).otherwise(0.0)
    r = F.when(F.col("targets") > 0, F.col("tp") / F.col("targets")).otherwise(0.0)
    f1 = F.when(p + r > 0, F.lit(2.0) * p * r / (p + r)).otherwise(0.0)
    none = (F.col("preds") == 0) & (F.col("targets") == 0)
    score = lambda c: F.when(none, 1.0).otherwise(c)
    return out.select(
        "image_id", score(p).alias("precision"), score(r).alias("recall"), score(f1).alias("f1"), "tp",
        (F.col("preds") - F.col("tp")).alias("fp"), (F.col("targets") - F.col("tp")).alias("fn"),
    )


def topk_accuracy(df: DataFrame, target: str, ranked: str, by: Sequence[str] = (), k: int = 5) -> DataFrame:
    """Top-1 and top-k accuracy of ranked class arrays."""
    at = F.array_position(F.slice(ranked, 1, k), F.col(target))
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.avg((at == 1).cast("double")).alias("top1"), F.avg((at > 0).cast("double")).alias("topk"))


# ---- vector search -----------------------------------------------------------------------------------------------


GROUP = 8192


def vector_topk(vectors: DataFrame, queries: DataFrame, key: str, vector: str, k: int, least: float, block_bytes: int = 4 << 20) -> DataFrame:
    """Top-k cosine matches of each query with at least ``least`` similarity.

    Groups of vectors meet blocks of queries of about ``block_bytes``, each pair as one matrix product in a task; only the k best
    rows a query and group reach the final ranking. The product only chooses: similarities are those of the sum in the order of
    the dimensions, so that equal vectors tie whatever their group. Vectors that are null, zero or hold nulls match nothing.
    """
    size = queries.agg(F.count("*").alias("n"), F.max(F.size(vector)).alias("d")).first()
    blocks = max(1, -(-size.n * 8 * max(1, size.d or 1) // block_bytes))
    groups = max(1, -(-vectors.count() // GROUP))
    ready = lambda df, name: df.select(F.col(key).alias(name), F.col(vector).cast("array<double>").alias("_u")).filter(F.col("_u").isNotNull() & ~F.exists("_u", lambda x: x.isNull()))
    deal = lambda name, n: F.pmod(F.xxhash64(name, "_u"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = ready(vectors, key).select(key, "_u", F.size("_u").alias("_d"), deal(key, groups).alias("_g"), every(blocks).alias("_b"))
    right = ready(queries, "query").select("query", "_u", F.size("_u").alias("_d"), deal("query", blocks).alias("_b"), every(groups).alias("_g"))
    schema = T.StructType([T.StructField("query", queries.schema[key].dataType), T.StructField(key, vectors.schema[key].dataType), T.StructField("similarity", T.DoubleType())])

    def best(rows: pa.Table, asked: pa.Table) -> pa.Table:
        rows = rows.take(pc.sort_indices(rows, sort_keys=[(key, "ascending")], null_placement="at_start"))
        (rows, u), (asked, q) = _units(rows), _units(asked)
        whose, found, values = [], [], []
        for low in range(0, len(q) if len(u) else 0, 256):
            near = q[low : low + 256] @ u.T
            near[np.isnan(near)] = np.inf  # as in Spark, NaN is above all numbers
            for at, row in enumerate(near, start=low):
                bound = least if len(row) <= k else max(least, np.partition(row, len(row) - k)[len(row) - k])
                some = np.flatnonzero(row >= bound - 1e-9)
                exact = np.zeros(len(some))
                for i in range(u.shape[1]):
                    exact = exact + u[some, i] * q[at, i]
                order = np.argsort(np.where(np.isnan(exact), -np.inf, -exact), kind="stable")[:k]
                order = order[(exact[order] >= least) | np.isnan(exact[order])]
                whose.append(np.full(len(order), at))
                found.append(some[order])
                values.append(exact[order])
        join = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.empty(0, kind)
        names = asked.column("query").take(pa.array(join(whose, np.int64))), rows.column(key).take(pa.array(join(found, np.int64)))
        return pa.table({"query": names[0], key: names[1], "similarity": pa.array(join(values, np.float64))})

    scored = left.groupBy("_g", "_b", "_d").cogroup(right.groupBy("_g", "_b", "_d")).applyInArrow(best, schema)
    w = Window.partitionBy("query").orderBy(F.desc("similarity"), key)
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _units(rows: pa.Table) -> tuple[pa.Table, np.ndarray]:
    """Rows of equal length whose vector has a length, and their unit vectors as a matrix."""
    flat = pc.list_flatten(rows.column("_u")).to_numpy()
    x = flat.reshape(len(rows), -1) if len(flat) else np.zeros((len(rows), 0))
    square = np.zeros(len(x))
    for i in range(x.shape[1]):
        square = square + x[:, i] * x[:, i]
    some = np.flatnonzero(square != 0)
    return rows.take(pa.array(some)), x[some] / np.sqrt(square[some])[:, None]
