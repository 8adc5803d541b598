"""Assignment replay: candidate-to-object matching as joins and hash aggregations.

Tables: ``truth`` (image, gt, box, ...) and ``cands`` (image, candidate, box, ax, ay, p, ...). A state is the sparse list
of eligible pairs with overlap ``c`` and alignment ``q``; ineligible pairs have overlap and alignment zero and are never
stored. Names of the key columns are fixed by the constants below.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.boxes import alignment, ciou, directions, eligibility_box, strictly_inside, translate

IMAGE, GT, CAND = "image_id", "gt_id", "candidate"
CELL = 32.0


def _cell(c: Column, size: float) -> Column:
    return F.floor(c / F.lit(size))


def with_cells(df: DataFrame, b: Column, size: float = CELL) -> DataFrame:
    """One row per grid cell (``_cx``, ``_cy``) that a box covers."""
    xs = F.sequence(_cell(b["x1"], size), _cell(b["x2"], size))
    ys = F.sequence(_cell(b["y1"], size), _cell(b["y2"], size))
    return df.withColumn("_cx", F.explode(xs)).withColumn("_cy", F.explode(ys))


def home_cell(a: Column, b: Column, size: float = CELL) -> Column:
    """Whether the joined cell holds the lower corner of the intersection: true in one cell per intersecting pair."""
    return (_cell(F.greatest(a["x1"], b["x1"]), size) == F.col("_cx")) & (_cell(F.greatest(a["y1"], b["y1"]), size) == F.col("_cy"))


#: Candidates a task holds where tables are dealt by image; an image of more is not dealt whole.
CANDS_A_TASK = 50_000


def by_image(cands: DataFrame, *tables: DataFrame) -> list[DataFrame]:
    """``cands`` and ``tables`` dealt by image over as many tasks as the candidates need.

    Every later join, rank and sum has the image in its key and so stays in the task that holds it: pairs, which are many times
    the candidates, are never exchanged. Where one image has more candidates than a task should hold, the tables are returned as
    they came, and the joins by cell spread that image over tasks.
    """
    size = cands.groupBy(IMAGE).agg(F.count("*").alias("n")).agg(F.sum("n").alias("n"), F.max("n").alias("most")).first()
    if size.n is None or size.most > CANDS_A_TASK:
        return [cands, *tables]
    cands.sparkSession.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    tasks = max(int(cands.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size.n // CANDS_A_TASK))
    return [t.repartition(tasks, IMAGE) for t in (cands, *tables)]


def first_objects(truth: DataFrame) -> DataFrame:
    """Per image: its first object, which owns what nobody overlaps."""
    return truth.groupBy(IMAGE).agg(F.min(GT).alias("first_gt"))


def with_order(cands: DataFrame) -> DataFrame:
    """``ord``: the place of each candidate in its image, by index. It decides between zero alignments."""
    return cands.withColumn("ord", F.row_number().over(Window.partitionBy(IMAGE).orderBy(CAND)))


def eligible_boxes(truth: DataFrame, cands: DataFrame, *, extra: Sequence[str] = (), cell: float = CELL) -> DataFrame:
    """Pairs whose candidate anchor lies strictly inside the (tiny-expanded) truth box, with both boxes (``gt_box``, ``box``).

    A range join by grid cell: an anchor has one cell, a box covers a few, so each pair is met once and a crowded image
    is spread over its cells. ``extra`` names further truth columns. Spark takes exploded rows for as few as their source and
    would send a whole side to every task, so the join is asked to merge.
    """
    t = truth.select(IMAGE, GT, *extra, F.col("box").alias("gt_box"), eligibility_box(F.col("box")).alias("_eb"))
    t = with_cells(t, F.col("_eb"), cell)
    c = cands.select(IMAGE, CAND, "box", "ax", "ay", _cell(F.col("ax"), cell).alias("_cx"), _cell(F.col("ay"), cell).alias("_cy"))
    return c.hint("merge").join(t, [IMAGE, "_cx", "_cy"]).filter(strictly_inside(F.col("ax"), F.col("ay"), F.col("_eb"))).drop("_eb", "_cx", "_cy", "ax", "ay")


def eligible_pairs(truth: DataFrame, cands: DataFrame, *, base: DataFrame | None = None, extra: Sequence[str] = (), cell: float = CELL) -> DataFrame:
    """The pairs of :func:`eligible_boxes` with overlap and alignment. ``extra`` names further truth columns that belong to the
    key (direction, radius); ``base`` is the unshifted truth where ``truth`` holds shifted rows.
    """
    context = first_objects(truth if base is None else base)
    t = truth.select(IMAGE, GT, *extra, F.col("box").alias("gt_box"), eligibility_box(F.col("box")).alias("_eb")).join(context, IMAGE)
    t = with_cells(t, F.col("_eb"), cell)
    c = with_order(cands).select(IMAGE, CAND, "ord", "box", "ax", "ay", "p", _cell(F.col("ax"), cell).alias("_cx"), _cell(F.col("ay"), cell).alias("_cy"))
    pairs = c.hint("merge").join(t, [IMAGE, "_cx", "_cy"]).filter(strictly_inside(F.col("ax"), F.col("ay"), F.col("_eb")))
    return scored(pairs, extra)


def locked_pairs(base_pairs: DataFrame, moved: DataFrame, cands: DataFrame, *, extra: Sequence[str]) -> DataFrame:
    """Pairs of the moved objects under base eligibility, scored at the moved boxes."""
    held = base_pairs.select(IMAGE, GT, CAND, "ord", "first_gt").join(moved.select(IMAGE, GT, *extra, F.col("box").alias("gt_box")), [IMAGE, GT])
    return scored(held.join(cands.select(IMAGE, CAND, "box", "p"), [IMAGE, CAND]), extra)


def scored(pairs: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Overlap and alignment. The overlap is written once: later conditions use it, not its definition."""
    out = pairs.select(
        IMAGE, GT, *extra, CAND, "p", F.greatest(ciou(F.col("gt_box"), F.col("box")), F.lit(0.0)).alias("c"), "ord", "first_gt"
    )
    return out.withColumn("q", alignment(F.col("p"), F.col("c")))


def rank_pairs(pairs: DataFrame, *, extra: Sequence[str] = ()) -> DataFrame:
    """Rank of each pair of an object by alignment, and what is needed to place zero alignments. One shuffle by object,
    whose pairs are the anchors inside its box; the ranks serve every k.
    """
    obj = Window.partitionBy(IMAGE, GT, *extra)
    positive = F.col("q") > 0
    return pairs.withColumns(
        {
            "rank": F.row_number().over(obj.orderBy(F.desc("q"), CAND)),
            "n_positive": F.count_if(positive).over(obj),
            "earlier": F.count_if(positive).over(obj.orderBy(CAND).rowsBetween(Window.unboundedPreceding, -1)),
        }
    )


def flag_claims(pairs: DataFrame, k: int, *, extra: Sequence[str] = ()) -> DataFrame:
    """Mark the per-object top-k claims, stable by candidate index, among the eligible pairs.

    The ranking is over all candidates of the image. Positive alignments rank among the eligible pairs. Zero alignments
    matter only where fewer than k positives exist: the lowest-index candidates of the image fill the rest. One is filled
    in if the positives and the zero alignments up to it are no more than k.
    """
    ranked = pairs if "rank" in pairs.columns else rank_pairs(pairs, extra=extra)
    return ranked.withColumn("claimed", claimed_within(k)).drop("n_positive", "earlier")


def claimed_within(k: int) -> Column:
    """Is a pair of :func:`rank_pairs` among its object's top-k claims?"""
    filled = F.col("n_positive") + F.col("ord") - F.coalesce("earlier", F.lit(0)) <= k
    return F.when(F.col("q") > 0, F.col("rank") <= k).otherwise(filled)


def claims(pairs: DataFrame, k: int, *, extra: Sequence[str] = ()) -> DataFrame:
    return flag_claims(pairs, k, extra=extra).filter("claimed")


def owners(flagged: DataFrame, *, extra: Sequence[str] = ()) -> DataFrame:
    """One row per claimed candidate: the object that owns it after conflicts, with q and c of that pair.

    A single claimant owns its candidate. A contested one goes to the highest overlap over all objects of the image, lowest
    index on ties; if every overlap is zero, to the first object of the image. One hash aggregation by candidate.
    """
    pair = F.struct(GT, "q", "c")
    agg = flagged.groupBy(IMAGE, *extra, CAND).agg(
        F.count_if("claimed").alias("n_claims"),
        F.max_by(pair, F.struct(F.col("c"), (-F.col(GT)).alias("g"))).alias("_best"),
        F.max(F.when(F.col("claimed"), pair)).alias("_only"),
        F.min("first_gt").alias("_first"),
        F.min("ord").alias("ord"),
    )
    nobody = F.struct(F.col("_first").alias(GT), F.lit(0.0).alias("q"), F.lit(0.0).alias("c"))
    owner = F.when(F.col("n_claims") == 1, F.col("_only")).when(F.col("_best.c") > 0, F.col("_best")).otherwise(nobody)
    owned = agg.filter("n_claims > 0").withColumn("_o", owner)
    return owned.select(IMAGE, *extra, CAND, F.col(f"_o.{GT}").alias(GT), F.col("_o.q").alias("q"), F.col("_o.c").alias("c"), "n_claims", "ord")


def keep_best(owned: DataFrame, *, extra: Sequence[str] = ()) -> DataFrame:
    """Per-object top-1 of the owned candidates. With all-zero alignment only the image's first candidate can stay."""
    row = F.struct(CAND, "q", "c", "n_claims")
    best = owned.groupBy(IMAGE, GT, *extra).agg(
        F.max_by(row, F.struct(F.col("q"), (-F.col(CAND)).alias("m"))).alias("_b"), F.max(F.when(F.col("ord") == 1, row)).alias("_z")
    )
    kept = F.when(F.col("_b.q") > 0, F.col("_b")).otherwise(F.col("_z"))
    return best.withColumn("_k", kept).filter(F.col("_k").isNotNull()).select(IMAGE, GT, *extra, "_k.*")


def assign(flagged: DataFrame, *, single: bool = True, conflict: bool = True, extra: Sequence[str] = ()) -> DataFrame:
    """Assigned (object, candidate) pairs from flagged pairs: one-to-one (``single``, k=7) or one-to-many (k=10)."""
    cols = [IMAGE, *extra, GT, CAND, "q", "c", "n_claims"]
    if conflict:
        owned = owners(flagged, extra=extra)
    else:
        owned = flagged.filter("claimed").withColumn("n_claims", F.lit(1).cast("long"))
    if not single:
        return owned.select(*cols)
    kept = keep_best(owned, extra=extra)
    if not conflict:  # a candidate kept by several objects counts for the lowest index
        row = F.struct(GT, "q", "c", "n_claims")
        kept = kept.groupBy(IMAGE, *extra, CAND).agg(F.min_by(row, GT).alias("_k")).select(IMAGE, *extra, CAND, "_k.*")
    return kept.select(*cols)


def foreground(assigned: DataFrame, *, extra: Sequence[str] = ()) -> DataFrame:
    """Foreground candidates and their target object."""
    return assigned.groupBy(IMAGE, *extra, CAND).agg(F.min(GT).alias("target_gt"))


def active_margin(assigned: DataFrame, flagged: DataFrame, truth: DataFrame, *, extra: Sequence[str] = ()) -> DataFrame:
    """Active candidate per object (null unless exactly one), runner-up by positive alignment, and the relative margin.

    The runner is the best positive pair other than the active one, so the two best pairs of each object are enough.
    """
    obj = [IMAGE, GT, *extra]
    active = assigned.groupBy(*obj).agg(F.count("*").alias("_n"), F.first(CAND).alias("_a"), F.first("q").alias("_q"))
    active = active.filter("_n = 1").select(*obj, F.col("_a").alias("active"), F.col("_q").alias("q_active"))
    pair = F.struct(CAND, "q")
    two = flagged.filter("rank <= 2").groupBy(*obj).agg(
        *[F.max(F.when((F.col("rank") == i) & (F.col("q") > 0), pair)).alias(f"_r{i}") for i in (1, 2)]
    )
    out = truth.select(*obj).join(active, obj, "left").join(two, obj, "left")
    other = F.when(F.col(f"_r1.{CAND}") == F.col("active"), F.col("_r2")).otherwise(F.col("_r1"))
    out = out.withColumn("_r", F.when(F.col("q_active") > 1e-12, other))
    return out.select(
        *obj, "active", "q_active", F.col(f"_r.{CAND}").alias("runner"), F.col("_r.q").alias("q_runner"),
        ((F.col("q_active") - F.col("_r.q")) / (F.col("q_active") + F.lit(1e-12))).alias("margin"),
    )


def rank_identities(flagged: DataFrame, owned: DataFrame, truth: DataFrame, *, extra: Sequence[str] = ()) -> DataFrame:
    """Three rank identities per object (best positive, best claim, best owned) and the sorted positive set."""
    obj = [IMAGE, GT, *extra]
    order = F.struct(F.col("q"), (-F.col(CAND)).alias("m"))
    a = flagged.groupBy(*obj).agg(
        F.max_by(CAND, F.when(F.col("c") > 0, order)).alias("unrestricted"), F.max_by(CAND, F.when(F.col("claimed"), order)).alias("pre_conflict")
    )
    # A positive set is bounded by what one object can own: its k claims and the contested candidates inside its box.
    c = owned.groupBy(*obj).agg(F.max_by(CAND, order).alias("assigned"), F.sort_array(F.collect_set(CAND)).alias("positive_set"))
    out = truth.select(*obj).join(a, obj, "left").join(c, obj, "left")
    return out.withColumn("positive_set", F.coalesce("positive_set", F.array().cast("array<bigint>")))


def target_scores(assigned: DataFrame, *, extra: Sequence[str] = ()) -> DataFrame:
    """Normalised target score of each assigned pair: q times the object's best overlap over its best alignment."""
    obj = [IMAGE, GT, *extra]
    best = assigned.groupBy(*obj).agg(F.max("q").alias("_q"), F.max("c").alias("_c"))
    return assigned.join(best, obj).withColumn("target_score", F.col("q") * F.col("_c") / (F.col("_q") + F.lit(1e-9))).drop("_q", "_c")


# ---- replay under shifts -----------------------------------------------------------------------------------------


def shifted_truth(truth: DataFrame, dx: Column, dy: Column, image_w, image_h, radii: Column | None = None) -> DataFrame:
    """Every object moved in four directions (and over a radius grid); moves that leave the image drop out."""
    t = truth.withColumns({"_dx": dx, "_dy": dy}).withColumn("_d", F.explode(directions()))
    t = t.withColumn("radius_idx", F.explode(radii) if radii is not None else F.lit(1))
    moved = translate(F.col("box"), F.col("_d.ux") * F.col("_dx") * F.col("radius_idx"), F.col("_d.uy") * F.col("_dy") * F.col("radius_idx"))
    t = t.withColumns({"box": moved, "direction": F.col("_d.direction")}).drop("_d", "_dx", "_dy")
    b = F.col("box")
    return t.filter((b["x1"] >= 0) & (b["y1"] >= 0) & (b["x2"] <= image_w) & (b["y2"] <= image_h))


def candidate_summary(flagged: DataFrame) -> DataFrame:
    """Per candidate of the base state: number of claims and the two best objects by overlap.

    With the two best kept, the best object other than any focal one is known without a second pass. One shuffle: the
    ranking and the aggregation share the candidate key.
    """
    w = Window.partitionBy(IMAGE, CAND).orderBy(F.desc("c"), GT)
    best = F.struct(F.col("c"), F.col(GT).alias("g"))
    ranked = flagged.select(IMAGE, GT, CAND, "c", "claimed", F.row_number().over(w).alias("_n"))
    return ranked.groupBy(IMAGE, CAND).agg(
        F.count_if("claimed").alias("n_claims"), *[F.max(F.when(F.col("_n") == i, best)).alias(f"top{i}") for i in (1, 2)]
    )


def replay(base_flagged: DataFrame, shifted: DataFrame, *, k: int, extra: Sequence[str], single: bool) -> DataFrame:
    """Owned candidates of each moved object, with every other object at its base position.

    ``shifted`` are the pairs of the moved objects. Top-k claims of the other objects do not change, so a replay is one
    join of the moved object's pairs with the base per-candidate summary, not a full assignment per shift. The moved
    object can also win a contested candidate that it does not claim, if its overlap there is the largest.
    """
    key = [IMAGE, GT, *extra]
    mine = flag_claims(shifted, k, extra=extra)
    was = base_flagged.filter("claimed").select(IMAGE, GT, CAND, F.lit(1).alias("_was"))
    focal = mine.join(candidate_summary(base_flagged), [IMAGE, CAND], "left").join(was, [IMAGE, GT, CAND], "left")
    others = F.coalesce("n_claims", F.lit(0)) - F.coalesce("_was", F.lit(0))
    rival = F.when(F.col("top1.g") == F.col(GT), F.col("top2")).otherwise(F.col("top1"))
    focal = focal.withColumns({"_total": others + F.col("claimed").cast("int"), "_rival": rival})
    rival_c = F.coalesce(F.col("_rival.c"), F.lit(0.0))
    wins = (
        F.when((F.col("c") <= 0) & (rival_c <= 0), F.col(GT) == F.col("first_gt"))
        .when(F.col("c") != rival_c, F.col("c") > rival_c)
        .otherwise(F.col(GT) < F.col("_rival.g"))
    )
    owns = F.when(F.col("_total") == 1, F.col("claimed")).otherwise((F.col("_total") > 1) & wins)
    owned = focal.filter(owns).select(*key, CAND, "q", "c", F.col("_total").alias("n_claims"), "ord")
    return keep_best(owned, extra=extra) if single else owned


def active_of(assigned: DataFrame, keys: Sequence[str], name: str = "active") -> DataFrame:
    """The single assigned candidate per key, absent where there is none or more than one."""
    one = assigned.groupBy(*keys).agg(F.count("*").alias("_n"), F.first(CAND).alias(name))
    return one.filter("_n = 1").drop("_n")


def endpoint(moved: DataFrame, base_active: DataFrame, shifted_active: DataFrame, extra: Sequence[str]) -> DataFrame:
    """Base and shifted identity of every moved object, and the flip flag (null is a value)."""
    key = [IMAGE, GT, *extra]
    out = moved.select(*key).join(base_active.withColumnRenamed("active", "base_active"), [IMAGE, GT], "left")
    out = out.join(shifted_active.withColumnRenamed("active", "shift_active"), key, "left")
    return out.withColumn("flip", (~F.col("base_active").eqNullSafe(F.col("shift_active"))).cast("int"))


def shared_claims(claimed: DataFrame) -> DataFrame:
    """Object pairs that claim a common candidate, met candidate by candidate, so unrelated pairs never appear.

    An object has at most k claims, so it meets at most the other claimants of k candidates.
    """
    a = claimed.select(IMAGE, CAND, F.col(GT).alias("focal_gt"))
    b = claimed.select(IMAGE, CAND, F.col(GT).alias("neighbor_gt"))
    pairs = a.join(b, [IMAGE, CAND]).filter("focal_gt <> neighbor_gt")
    return pairs.groupBy(IMAGE, "focal_gt", "neighbor_gt").agg(F.count("*").alias("n_shared"))


# ---- spillover to neighbours -------------------------------------------------------------------------------------


def changed_ownership(base_flagged: DataFrame, base_owned: DataFrame, mine: DataFrame, moved: DataFrame, *, extra: Sequence[str]) -> DataFrame:
    """Candidates whose owner changes when one object moves: (image, focal gt, extra, candidate, before, after).

    Only candidates that the focal object can reach before or after the move are looked at.
    """
    key = [IMAGE, GT, *extra]
    before = base_flagged.select(IMAGE, GT, CAND, "claimed").join(moved.select(*key), [IMAGE, GT])
    before = before.select(*key, CAND, F.col("claimed").alias("_was"))
    after = mine.select(*key, CAND, "c", F.col("claimed").alias("_is"), F.lit(True).alias("_reach"))
    both = before.join(after, [*key, CAND], "full_outer").na.fill(False, ["_was", "_is", "_reach"])
    summary = candidate_summary(base_flagged)
    claim_sum = base_flagged.filter("claimed").groupBy(IMAGE, CAND).agg(F.sum(GT).alias("_gts"))
    summary = summary.join(claim_sum, [IMAGE, CAND], "left").select(IMAGE, CAND, F.col("n_claims").alias("_n"), "top1", "top2", F.coalesce("_gts", F.lit(0)).alias("_gts"))
    own = base_owned.select(IMAGE, CAND, F.col(GT).alias("before_gt"))
    first = base_flagged.groupBy(IMAGE, CAND).agg(F.min("first_gt").alias("_first"))
    rows = both.join(summary.join(first, [IMAGE, CAND]), [IMAGE, CAND], "left").join(own, [IMAGE, CAND], "left")
    focal = F.col(GT)
    others = F.coalesce("_n", F.lit(0)) - F.col("_was").cast("int")
    # With exactly one other claimant, its id is the sum of the claimants' ids less the focal one.
    other = F.coalesce("_gts", F.lit(0)) - F.when(F.col("_was"), focal).otherwise(0)
    rival = F.when(F.col("top1.g") == focal, F.col("top2")).otherwise(F.col("top1"))
    c, rival_c = F.coalesce("c", F.lit(0.0)), F.coalesce(rival["c"], F.lit(0.0))
    contested = (
        F.when((c <= 0) & (rival_c <= 0), F.coalesce("_first", focal))
        .when(c > rival_c, focal)
        .when(c < rival_c, rival["g"])
        .otherwise(F.least(focal, rival["g"]))
    )
    total = others + F.col("_is").cast("int")
    owner = F.when(total > 1, contested).when(total == 1, F.when(F.col("_is"), focal).otherwise(other))
    out = rows.withColumn("after_gt", owner)
    return out.filter(~F.col("before_gt").eqNullSafe(F.col("after_gt"))).select(*key, CAND, "before_gt", "after_gt")


def neighbour_flips(base_flagged: DataFrame, base_owned: DataFrame, base_kept: DataFrame, changes: DataFrame, *, extra: Sequence[str]) -> DataFrame:
    """Neighbours whose active candidate changes: (image, focal gt, extra, neighbor_gt). Unaffected neighbours never appear."""
    key = [IMAGE, GT, *extra]
    lost = changes.filter(F.col("before_gt").isNotNull() & (F.col("before_gt") != F.col(GT))).select(*key, F.col("before_gt").alias("neighbor_gt"), CAND, F.lit(-1).alias("_s"))
    won = changes.filter(F.col("after_gt").isNotNull() & (F.col("after_gt") != F.col(GT))).select(*key, F.col("after_gt").alias("neighbor_gt"), CAND, F.lit(1).alias("_s"))
    moves = lost.unionByName(won)
    pair = base_flagged.select(IMAGE, F.col(GT).alias("neighbor_gt"), CAND, "q", "c", "ord")
    moves = moves.join(pair, [IMAGE, "neighbor_gt", CAND], "left").withColumns({"q": F.coalesce("q", F.lit(0.0)), "c": F.coalesce("c", F.lit(0.0))})
    touched = moves.select(*key, "neighbor_gt").distinct()
    held = base_owned.select(IMAGE, F.col(GT).alias("neighbor_gt"), CAND, "q", "c", "ord")
    held = touched.join(held, [IMAGE, "neighbor_gt"]).withColumn("_s", F.lit(1))
    merged = held.unionByName(moves.select(*held.columns)).groupBy(*key, "neighbor_gt", CAND).agg(
        F.sum("_s").alias("_s"), F.max("q").alias("q"), F.max("c").alias("c"), F.min("ord").alias("ord")
    )
    left = merged.filter("_s > 0").withColumn("n_claims", F.lit(1).cast("long"))
    focal = left.withColumnRenamed(GT, "_focal").withColumnRenamed("neighbor_gt", GT)
    best = keep_best(focal, extra=["_focal", *extra]).select(IMAGE, F.col("_focal").alias(GT), *extra, F.col(GT).alias("neighbor_gt"), F.col(CAND).alias("_after"))
    was = base_kept.select(IMAGE, F.col(GT).alias("neighbor_gt"), F.col(CAND).alias("_before"))
    state = touched.join(best, [*key, "neighbor_gt"], "left").join(was, [IMAGE, "neighbor_gt"], "left")
    return state.filter(~F.col("_before").eqNullSafe(F.col("_after"))).select(*key, "neighbor_gt")


def sharing_neighbours(base_claimed: DataFrame, shift_claimed: DataFrame, moved: DataFrame, *, extra: Sequence[str]) -> DataFrame:
    """Neighbours that share a claim with the focal object before or after its move."""
    key = [IMAGE, GT, *extra]
    other = base_claimed.select(IMAGE, CAND, F.col(GT).alias("neighbor_gt"))
    base = shared_claims(base_claimed).select(IMAGE, F.col("focal_gt").alias(GT), "neighbor_gt").join(moved.select(*key), [IMAGE, GT])
    shift = shift_claimed.select(*key, CAND).join(other, [IMAGE, CAND]).filter(F.col(GT) != F.col("neighbor_gt"))
    return base.select(*key, "neighbor_gt").unionByName(shift.select(*key, "neighbor_gt")).distinct()


def local_neighbours(truth: DataFrame, threshold: float, cell: float = CELL) -> DataFrame:
    """Object pairs nearer than ``threshold`` mean equivalent sides, met in the grid cells both neighbourhoods cover."""
    b = F.col("box")
    side = F.sqrt((b["x2"] - b["x1"]) * (b["y2"] - b["y1"]))
    x, y, r = (b["x1"] + b["x2"]) / 2, (b["y1"] + b["y2"]) / 2, F.lit(threshold / 2) * side
    reach = truth.select(IMAGE, GT, x.alias("x"), y.alias("y"), side.alias("side"), F.struct((x - r).alias("x1"), (y - r).alias("y1"), (x + r).alias("x2"), (y + r).alias("y2")).alias("box"))
    reach = with_cells(reach, F.col("box"), cell)
    a = reach.select(IMAGE, "_cx", "_cy", F.col(GT).alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("side").alias("sa"), F.col("box").alias("ba"))
    c = reach.select(IMAGE, "_cx", "_cy", F.col(GT).alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"), F.col("side").alias("sb"), F.col("box").alias("bb"))
    near = F.hypot(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")) < F.lit(threshold) * (F.col("sa") + F.col("sb")) / 2
    # A pair may share several cells; it counts in one.
    home = home_cell(F.col("ba"), F.col("bb"), cell)
    return a.join(c, [IMAGE, "_cx", "_cy"]).filter((F.col("a") != F.col("b")) & near & home).select(IMAGE, F.col("a").alias(GT), F.col("b").alias("neighbor_gt"))


def spillover(events: DataFrame, truth: DataFrame, shared: DataFrame, local: DataFrame, flips: DataFrame, *, extra: Sequence[str]) -> DataFrame:
    """Neighbours and spilled neighbours of each focal event by relationship.

    ``shared``, ``local`` and ``flips`` are sparse pair lists; the distant rest is counted, never listed.
    """
    key = [IMAGE, GT, *extra]
    pairs = shared.withColumn("_sh", F.lit(1)).join(flips.withColumn("_fl", F.lit(1)), [*key, "neighbor_gt"], "full_outer")
    near = local.join(events.select(*key), [IMAGE, GT]).withColumn("_lo", F.lit(1))
    pairs = pairs.join(near, [*key, "neighbor_gt"], "full_outer").na.fill(0, ["_sh", "_fl", "_lo"])
    sh, fl, lo = (F.col(c) == 1 for c in ("_sh", "_fl", "_lo"))
    per = pairs.groupBy(*key).agg(
        F.count_if(sh).alias("shared"), F.count_if(sh & fl).alias("shared_spill"),
        F.count_if(~sh & lo).alias("local"), F.count_if(~sh & lo & fl).alias("local_spill"),
        F.count_if(~sh & ~lo & fl).alias("distant_spill"),
    )
    n = truth.groupBy(IMAGE).agg((F.count("*") - 1).alias("neighbors"))
    out = events.join(n, IMAGE).join(per, key, "left").na.fill(0, per.columns[len(key):])
    return out.withColumn("distant", F.col("neighbors") - F.col("shared") - F.col("local"))


def preresolution_flags(flagged: DataFrame, owned: DataFrame, kept: DataFrame, truth: DataFrame) -> DataFrame:
    """Per object: best claim before conflicts, active identity, whether they differ, and whether a claim was contested."""
    obj = [IMAGE, GT]
    order = F.struct(F.col("q"), (-F.col(CAND)).alias("m"))
    before = flagged.filter("claimed").groupBy(*obj).agg(F.max_by(CAND, order).alias("pre_active"))
    contested = owned.filter("n_claims > 1").select(IMAGE, CAND)
    involved = flagged.filter("claimed").join(contested, [IMAGE, CAND], "left_semi").select(*obj).distinct().withColumn("_c", F.lit(1))
    out = truth.join(before, obj, "left").join(kept.select(*obj, F.col(CAND).alias("active")), obj, "left").join(involved, obj, "left")
    return out.withColumns({"disagrees": (~F.col("pre_active").eqNullSafe(F.col("active"))).cast("int"), "in_conflict": F.coalesce("_c", F.lit(0))}).drop("_c")
