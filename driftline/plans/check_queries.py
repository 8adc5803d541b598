"""Frame and plan validation, key sets, captions, byte-order marks and differences between shift contracts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.bins import aspect_bin, direction_axis, rounded
from ..operators import checks as ck
from ..operators import estimators as es
from ..sources import annotations as an
from ..sources import tables as tb
from ..session import work_folder
from .estimate_queries import BASE, W, _ASPECT, _round_all, flips, objects
from .fixtures import KEYS, gt_boxes, rays, roster, second_rays, table
from .oracle import rnd, with_tables
from .registry import query
from .source_queries import ROSTER, _roster_rows

# Faults planted by key: a weight of zero, an outcome of 2, a missing and an infinite number, an image in two strata.
_FRAME = f"""SELECT image_id, gt_id, CASE WHEN gt_id % 41 = 0 THEN 0e0 ELSE {W} END AS w, CASE WHEN gt_id % 43 = 0 THEN 2 ELSE o2o_fragile END AS y,
 CASE WHEN gt_id % 37 = 0 THEN NULL ELSE o2o_flip_rate END AS a, CASE WHEN gt_id % 47 = 0 THEN 'Infinity'::DOUBLE WHEN gt_id % 53 = 0 THEN 'NaN'::DOUBLE ELSE o2m_flip_rate END AS b, CASE WHEN gt_id % 59 = 0 THEN 'other' ELSE stratum END AS s FROM objs"""


@query(
    "frame_validate",
    with_tables(
        """SELECT (SELECT COUNT(*) FROM frame) AS n_rows, (SELECT COUNT(DISTINCT image_id) FROM frame) AS n_images, (SELECT COUNT(*) FROM (SELECT image_id FROM frame GROUP BY 1 HAVING COUNT(DISTINCT s) > 1) x) AS images_in_many_strata,
 (SELECT COUNT(*) FROM frame WHERE w IS NULL OR NOT w > 0) AS bad_weights, (SELECT COUNT(*) FROM frame WHERE y NOT IN (0, 1)) AS bad_outcomes, (SELECT (MAX(y) <> MIN(y))::INT FROM frame) AS both_outcomes,
 (SELECT COUNT(*) FROM frame WHERE a IS NULL OR NOT isfinite(a)) AS bad_a, (SELECT COUNT(*) FROM frame WHERE b IS NULL OR NOT isfinite(b)) AS bad_b""",
        **BASE, frame=_FRAME,
    ),
)
def frame_validate(spark, sf):
    """Analysis-frame validation over objects with planted faults of every kind."""
    g = F.col("gt_id")
    frame = objects(spark, sf).select(
        "image_id", F.when(g % 41 == 0, 0.0).otherwise(F.col(W)).alias("w"), F.when(g % 43 == 0, 2).otherwise(F.col("o2o_fragile")).alias("y"),
        F.when(g % 37 != 0, F.col("o2o_flip_rate")).alias("a"), F.when(g % 47 == 0, float("inf")).when(g % 53 == 0, float("nan")).otherwise(F.col("o2m_flip_rate")).alias("b"),
        F.when(g % 59 == 0, "other").otherwise(F.col("stratum")).alias("s"),
    )
    return ck.frame_report(frame, ["a", "b"], "w", "y", "image_id", "s")


_NATIONS = "(SELECT n.n_name AS id, r.r_name AS grp, CASE WHEN n.n_nationkey % 3 = 0 THEN 'secondary' ELSE 'primary' END AS family, CASE WHEN n.n_nationkey % 7 = 6 THEN 'both' WHEN n.n_nationkey % 2 = 0 THEN 'greater' ELSE 'less' END AS direction, CASE WHEN n.n_nationkey % 11 = 10 THEN 0.1e0 ELSE 0.05e0 END AS alpha FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey) p"


@query(
    "plan_validate",
    f"""SELECT grp, COUNT(id) = COUNT(DISTINCT id) AS ids_unique, LEN(LIST_FILTER(['CHINA', 'FRANCE', 'KENYA'], lambda x: NOT LIST_CONTAINS(LIST(id), x)))::INT AS n_missing, BOOL_AND(direction IN ('greater', 'less')) AS directions_valid,
 BOOL_AND(ABS(alpha - 0.05e0) < 1e-12) AS alpha_matches, COUNT(*) FILTER (WHERE family = 'secondary') <= 2 AS secondary_within_limit FROM {_NATIONS} GROUP BY grp""",
)
def plan_validate(spark, sf):
    """Hypothesis-plan constraints of five plans, one for each region, its nations as hypotheses."""
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    k = F.col("n_nationkey")
    plan = n.join(r, n.n_regionkey == r.r_regionkey).select(
        F.col("n_name").alias("id"), F.col("r_name").alias("grp"), F.when(k % 3 == 0, "secondary").otherwise("primary").alias("family"),
        F.when(k % 7 == 6, "both").when(k % 2 == 0, "greater").otherwise("less").alias("direction"), F.when(k % 11 == 10, 0.1).otherwise(0.05).alias("alpha"),
    )
    out = ck.plan_reports(plan, ["CHINA", "FRANCE", "KENYA"], 0.05, by=["grp"])
    return out.withColumn("n_missing", F.size("missing_ids")).drop("missing_ids")


@query(
    "key_sets",
    with_tables(
        """SELECT 'both' AS side, COUNT(*) AS n, MIN(gt_id) AS lowest, MAX(gt_id) AS highest FROM (SELECT image_id, gt_id, direction FROM fx_rays WHERE o2o_event_observed = 1 INTERSECT SELECT image_id, gt_id, direction FROM fx_rays2 WHERE o2o_event_observed = 1) a
 UNION ALL SELECT 'first_only', COUNT(*), MIN(gt_id), MAX(gt_id) FROM (SELECT image_id, gt_id, direction FROM fx_rays WHERE o2o_event_observed = 1 EXCEPT SELECT image_id, gt_id, direction FROM fx_rays2 WHERE o2o_event_observed = 1) b
 UNION ALL SELECT 'second_only', COUNT(*), MIN(gt_id), MAX(gt_id) FROM (SELECT image_id, gt_id, direction FROM fx_rays2 WHERE o2m_event_observed = 1 EXCEPT SELECT image_id, gt_id, direction FROM fx_rays WHERE o2o_event_observed = 1) c"""
    ),
)
def key_sets(spark, sf):
    """Intersection and both differences of the keys of two event tables."""
    first = rays(spark, sf).filter("o2o_event_observed = 1").select(*KEYS)
    again = second_rays(spark, sf)
    second, many = again.filter("o2o_event_observed = 1").select(*KEYS), again.filter("o2m_event_observed = 1").select(*KEYS)
    sides = {"both": first.intersect(second), "first_only": first.subtract(second), "second_only": many.subtract(first)}
    out = None
    for name, keys in sides.items():
        one = keys.agg(F.count("*").alias("n"), F.min("gt_id").alias("lowest"), F.max("gt_id").alias("highest")).withColumn("side", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out.select("side", "n", "lowest", "highest")


_CAPTION = "'A Red Car near two  boats'"


@query(
    "grounding",
    with_tables(
        f"""SELECT image_id, (DENSE_RANK() OVER (PARTITION BY image_id ORDER BY first) - 1)::INT AS cls, text, COUNT(*) AS n, {rnd('SUM(cx)', 6, 'sum_cx')}, {rnd('SUM(w)', 6, 'sum_w')} FROM (SELECT image_id, text, cx, cy, w, h, MIN(first) AS first FROM (
 SELECT image_id, text, (gx1 + (gx2 - gx1) / 2) / 800 AS cx, (gy1 + (gy2 - gy1) / 2) / 600 AS cy, (gx2 - gx1) / 800 AS w, (gy2 - gy1) / 600 AS h, MIN(gt_id) OVER (PARTITION BY image_id, text) AS first FROM (
 SELECT *, CASE gt_id % 4 WHEN 0 THEN 'red car' WHEN 1 THEN 'boats' WHEN 2 THEN 'red boats' ELSE '' END AS text FROM fx_box WHERE gt_id % 13 <> 0) a WHERE text <> '') b GROUP BY ALL) c GROUP BY image_id, first, text""",
    ),
)
def grounding(spark, sf):
    """Grounded boxes: class text cut from the caption by token spans; crowds and empty texts leave, classes by first appearance."""
    g = F.col("gt_id")
    b = gt_boxes(spark, sf)
    images = b.select("image_id").distinct().select("image_id", F.concat(F.lit("f"), "image_id").alias("file_name"), F.lit(800).alias("width"), F.lit(600).alias("height"), F.lit("A Red Car near two  boats").alias("caption"))
    span = lambda *s: F.array(*[F.array(F.lit(a), F.lit(z)) for a, z in s])
    tokens = F.when(g % 4 == 0, span((2, 9))).when(g % 4 == 1, span((20, 25))).when(g % 4 == 2, span((2, 5), (20, 25))).otherwise(span((18, 20)))
    x = F.col("box")
    notes = b.select("image_id", g.alias("id"), F.array(x["x1"], x["y1"], x["x2"] - x["x1"], x["y2"] - x["y1"]).alias("bbox"), tokens.alias("tokens_positive"), (g % 13 == 0).cast("int").alias("iscrowd"))
    rows = an.grounding_rows(images, notes)
    return rows.groupBy("image_id", "cls", "text").agg(F.count("*").alias("n"), rounded(F.sum("cx"), 6).alias("sum_cx"), rounded(F.sum("w"), 6).alias("sum_w"))


@query("csv_with_mark", ROSTER)
def csv_with_mark(spark, sf):
    """The roster as CSV whose files begin with a byte-order mark, read back by name."""
    folder = work_folder(spark)
    rows = roster(spark, sf)
    rows.select(*[F.col(c).alias("﻿" + c if i == 0 else c) for i, c in enumerate(rows.columns)]).write.option("header", True).csv(folder)
    return _roster_rows(tb.read_table(spark, folder, tb.SELECTED_IMAGES, label="roster"))


# Two contracts: a change within 0.125 of the equivalent side, or of the box's own side along the axis.
_AXIS_FLIP = "CASE WHEN o2o_event_observed = 1 AND o2o_radius <= 0.125e0 * (CASE WHEN direction IN ('left', 'right') THEN w ELSE h END) / SQRT(CAST(w * h AS DOUBLE)) THEN 1 ELSE 0 END"


@query(
    "axis_minus_equivalent",
    with_tables(
        f"""SELECT axis, {rnd('MAX(CASE WHEN contract = 2 THEN crude END) - MAX(CASE WHEN contract = 1 THEN crude END)', 9, 'crude_gap')}, {rnd('MAX(CASE WHEN contract = 2 THEN stand END) - MAX(CASE WHEN contract = 1 THEN stand END)', 9, 'standard_gap')} FROM (
 SELECT contract, axis, SUM(nt) / SUM(dt) - SUM(ns) / SUM(ds) AS crude, SUM(CASE WHEN dt > 0 AND ds > 0 THEN (dt + ds) * (nt / dt - ns / ds) END) / SUM(CASE WHEN dt > 0 AND ds > 0 THEN dt + ds END) AS stand FROM (
 SELECT contract, axis, aspect, SUM(CASE WHEN size_bin = 't_8_16' THEN {W} * f ELSE 0 END) AS nt, SUM(CASE WHEN size_bin = 't_8_16' THEN {W} ELSE 0 END) AS dt, SUM(CASE WHEN size_bin = 's_16_32' THEN {W} * f ELSE 0 END) AS ns, SUM(CASE WHEN size_bin = 's_16_32' THEN {W} ELSE 0 END) AS ds
 FROM (SELECT *, {_ASPECT} AS aspect, CASE WHEN direction IN ('left', 'right') THEN 'horizontal' ELSE 'vertical' END AS axis, c.contract, CASE c.contract WHEN 1 THEN o2o_flip ELSE {_AXIS_FLIP} END AS f FROM dirs CROSS JOIN (SELECT UNNEST([1, 2]) AS contract) c) x GROUP BY ALL) y GROUP BY contract, axis) z GROUP BY axis""",
        **BASE,
    ),
)
def axis_minus_equivalent(spark, sf):
    """Size gaps under axis-normalised shifts less those under equivalent-side shifts, crude and aspect-standardised, per axis."""
    side = F.when(F.col("direction").isin("left", "right"), F.col("w")).otherwise(F.col("h"))
    reach = F.lit(0.125) * side / F.sqrt((F.col("w") * F.col("h")).cast("double"))
    axis_flip = ((F.col("o2o_event_observed") == 1) & (F.col("o2o_radius") <= reach)).cast("int")
    r = flips(rays(spark, sf)).withColumns({"aspect": aspect_bin(F.col("w"), F.col("h")), "axis": direction_axis(F.col("direction"))})
    both = F.array(F.struct(F.lit("equivalent_area_side").alias("contract"), F.col("o2o_flip").alias("f")), F.struct(F.lit("axis_normalised").alias("contract"), axis_flip.alias("f")))
    cells = es.standard_cells(r.withColumn("_c", F.explode(both)).withColumns({"contract": F.col("_c.contract"), "f": F.col("_c.f")}), ["contract", "axis"], "aspect", F.col("f"))
    gaps = es.standardised(cells, ["contract", "axis"], "aspect")
    return _round_all(es.contract_difference(gaps, ["axis"], "contract", "axis_normalised", "equivalent_area_side", ["crude_gap", "standard_gap"]))
