"""Group folds, out-of-fold logistic models and the spline's gain over a straight line."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import crossfit as cf
from ..operators import models as md
from ..operators import replicates as rp
from ..operators import resample as rs
from ..session import shared, written
from .curve_queries import IMAGE
from .estimate_queries import BASE, W, _round_all, objects
from .fixtures import rays
from .oracle import rnd, with_tables
from .registry import query
from .resample_queries import REPS, SEED, draw_sql

FOLDS = 5
_FOLDS = f"""SELECT image_id, n_rows, n_positive, CAST((ROW_NUMBER() OVER (ORDER BY n_positive DESC, n_rows DESC, {draw_sql(f'{SEED}, image_id', 15)}, image_id) - 1) % {FOLDS} AS INT) AS fold
 FROM (SELECT image_id, COUNT(*) AS n_rows, CAST(SUM(o2o_fragile) AS BIGINT) AS n_positive FROM objs GROUP BY image_id) c"""


@query("group_folds", with_tables("SELECT * FROM folds", **BASE, folds=_FOLDS))
def group_folds(spark, sf):
    """Five folds of whole images, balanced by their fragile objects."""
    return cf.stratified_folds(objects(spark, sf), IMAGE, "o2o_fragile", FOLDS, SEED)


def framed(spark, sf) -> DataFrame:
    """Objects with outcome, covariates, mean margin and the fold of their image."""
    margin = rays(spark, sf).groupBy(IMAGE, "gt_id").agg(F.avg("margin").alias("margin"))
    obj = objects(spark, sf).join(margin, [IMAGE, "gt_id"])
    rows = obj.select(IMAGE, "gt_id", "stratum", W, F.col("o2o_fragile").alias("y"), F.ln((F.col("w") * F.col("h")).cast("double")).alias("log_area"), F.col("o2m_flip_rate").cast("double").alias("flip_rate"), "margin")
    folds = cf.stratified_folds(rows, IMAGE, "y", FOLDS, SEED).select(IMAGE, "fold")
    return written(rows.join(folds, IMAGE))


MODELS = {"size_only": ["log_area"], "size_and_flip": ["log_area", "flip_rate"]}
STEPS, RIDGE = 12, "1e-6"


def _newton_sql() -> dict[str, str]:
    """Newton's method unrolled: one step a table, for two and for three coefficients (by Cramer's rule)."""
    train = f"SELECT r.f, o.y, o.{W} AS w, (o.log_area - m1) / s1 AS z1, (o.flip_rate - m2) / s2 AS z2 FROM rows_ o JOIN scales r ON o.fold <> r.f"
    out = {
        "rows_": f"SELECT o.image_id, o.gt_id, o.{W}, o.o2o_fragile::DOUBLE AS y, LN(CAST(o.w * o.h AS DOUBLE)) AS log_area, o.o2m_flip_rate::DOUBLE AS flip_rate, fold FROM objs o JOIN folds USING (image_id)",
        "scales": f"""SELECT f, m1, m2, SQRT(GREATEST(q1 - m1 * m1, 1e-12)) AS s1, SQRT(GREATEST(q2 - m2 * m2, 1e-12)) AS s2 FROM (SELECT f, SUM({W} * log_area) / SUM({W}) AS m1, SUM({W} * log_area * log_area) / SUM({W}) AS q1,
 SUM({W} * flip_rate) / SUM({W}) AS m2, SUM({W} * flip_rate * flip_rate) / SUM({W}) AS q2 FROM rows_ JOIN (SELECT UNNEST(RANGE({FOLDS})) AS f) x ON fold <> f GROUP BY f) a""",
        "train": train,
        "a0": f"SELECT UNNEST(RANGE({FOLDS})) AS f, 0e0 AS b0, 0e0 AS b1",
        "c0": f"SELECT UNNEST(RANGE({FOLDS})) AS f, 0e0 AS b0, 0e0 AS b1, 0e0 AS b2",
    }
    for i in range(1, STEPS + 1):
        out[f"ag{i}"] = f"""SELECT f, ANY_VALUE(b0) AS b0, ANY_VALUE(b1) AS b1, SUM(w * (y - p)) AS g0, SUM(w * (y - p) * z1) - {RIDGE} * ANY_VALUE(b1) AS g1, SUM(w * p * (1 - p)) AS h00, SUM(w * p * (1 - p) * z1) AS h01, SUM(w * p * (1 - p) * z1 * z1) + {RIDGE} AS h11
 FROM (SELECT t.*, b0, b1, 1 / (1 + EXP(-(b0 + b1 * z1))) AS p FROM train t JOIN a{i - 1} USING (f)) x GROUP BY f"""
        out[f"a{i}"] = f"SELECT f, b0 + (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01) AS b0, b1 + (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) AS b1 FROM ag{i}"
        out[f"cg{i}"] = f"""SELECT f, ANY_VALUE(b0) AS b0, ANY_VALUE(b1) AS b1, ANY_VALUE(b2) AS b2, SUM(w * (y - p)) AS g0, SUM(w * (y - p) * z1) - {RIDGE} * ANY_VALUE(b1) AS g1, SUM(w * (y - p) * z2) - {RIDGE} * ANY_VALUE(b2) AS g2,
 SUM(w * p * (1 - p)) AS a, SUM(w * p * (1 - p) * z1) AS b, SUM(w * p * (1 - p) * z2) AS c, SUM(w * p * (1 - p) * z1 * z1) + {RIDGE} AS d, SUM(w * p * (1 - p) * z1 * z2) AS e, SUM(w * p * (1 - p) * z2 * z2) + {RIDGE} AS k
 FROM (SELECT t.*, b0, b1, b2, 1 / (1 + EXP(-(b0 + b1 * z1 + b2 * z2))) AS p FROM train t JOIN c{i - 1} USING (f)) x GROUP BY f"""
        out[f"c{i}"] = f"""SELECT f, b0 + ((d * k - e * e) * g0 + (c * e - b * k) * g1 + (b * e - c * d) * g2) / det AS b0, b1 + ((c * e - b * k) * g0 + (a * k - c * c) * g1 + (b * c - a * e) * g2) / det AS b1,
 b2 + ((b * e - c * d) * g0 + (b * c - a * e) * g1 + (a * d - b * b) * g2) / det AS b2 FROM (SELECT *, a * (d * k - e * e) - b * (b * k - c * e) + c * (b * e - c * d) AS det FROM cg{i}) x"""
    held = "FROM rows_ o JOIN scales r ON o.fold = r.f JOIN {} b ON b.f = o.fold"
    out["probs"] = f"""SELECT 'size_only' AS model, o.fold, y, o.{W} AS w, 1 / (1 + EXP(-(b0 + b1 * (log_area - m1) / s1))) AS p {held.format(f'a{STEPS}')}
 UNION ALL SELECT 'size_and_flip', o.fold, y, o.{W}, 1 / (1 + EXP(-(b0 + b1 * (log_area - m1) / s1 + b2 * (flip_rate - m2) / s2))) {held.format(f'c{STEPS}')}"""
    out["points"] = "SELECT model, fold, ROUND(p, 9) AS p, SUM(w * y) AS wp, SUM(w * (1 - y)) AS wn FROM probs GROUP BY ALL"
    out["areas"] = """SELECT model, fold, SUM(wp) AS tp, SUM(wn) AS tn, SUM(wn * (cp - wp / 2)) AS area, SUM(wp * cp / NULLIF(cw, 0)) AS ap FROM (SELECT *, SUM(wp) OVER o AS cp, SUM(wp + wn) OVER o AS cw FROM points WINDOW o AS (PARTITION BY model, fold ORDER BY p DESC)) x GROUP BY ALL"""
    out["losses"] = "SELECT model, fold, -SUM(w * (y * LN(p) + (1 - y) * LN(1 - p))) AS ll, SUM(w * (p - y) * (p - y)) AS br FROM probs GROUP BY ALL"
    return out


@query(
    "oof_logit",
    with_tables(
        f"""SELECT model, {rnd('SUM((tp + tn) * area / (tp * tn)) / SUM(tp + tn)', 6, 'roc_auc')}, {rnd('SUM((tp + tn) * ap / tp) / SUM(tp + tn)', 6, 'pr_auc')}, {rnd('SUM(ll) / SUM(tp + tn)', 6, 'log_loss')}, {rnd('SUM(br) / SUM(tp + tn)', 6, 'brier')}
 FROM areas JOIN losses USING (model, fold) GROUP BY model""",
        **BASE, folds=_FOLDS, **_newton_sql(),
    ),
)
def oof_logit(spark, sf):
    """Out-of-fold ROC, PR, log-loss and Brier of nested logistic models over five stratified folds of whole images."""
    rows = framed(spark, sf)
    scored = cf.predicted(rows, cf.fit(rows, MODELS, "y", W, "fold", FOLDS))
    longer = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("score")) for m in MODELS])).alias("_m")
    # Scores that differ by rounding only count as ties.
    each = shared(scored.select("fold", "y", W, longer).select("fold", "y", W, "_m.model", F.round("_m.score", 9).alias("tied"), "_m.score"))
    ranks = md.score_metrics(each, ["fold", "model"], "y", "tied", W, block=8).select("fold", "model", "roc_auc", "pr_auc")
    losses = md.score_metrics(each, ["fold", "model"], "y", "score", W, block=8).select("fold", "model", "log_loss", "brier")
    share = rows.groupBy("fold").agg(F.sum(W).alias("fold_weight"))
    names = ("roc_auc", "pr_auc", "log_loss", "brier")
    out = md.foldwise(ranks.join(losses, ["fold", "model"]), share, ["model"], names)
    return out.select("model", *[(F.round(c, 6) + F.lit(0.0)).alias(c) for c in names])


LINE, CURVE = "linear_margin", "spline_margin"


def margin_metrics(spark, sf, reps: int = REPS) -> DataFrame:
    """(model, metric, values): fold-wise metrics of both margin models, images resampled within fold and stratum."""
    rows = framed(spark, sf)
    knots = cf.training_knots(rows, "margin", W, "fold", FOLDS, 5)
    base = ["log_area", "flip_rate"]
    models = {LINE: [*base, "margin"], CURVE: [*base, cf.Spline("margin", knots)]}
    scored = cf.predicted(rows, cf.fit(rows, models, "y", W, "fold", FOLDS))
    longer = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.round(m, 9).alias("score")) for m in models])).alias("_m")
    each = written(scored.select(IMAGE, "stratum", "fold", "y", W, longer).select(IMAGE, "stratum", "fold", "y", W, "_m.*"))
    cell = F.concat_ws("/", F.col("fold").cast("string"), "stratum")
    clusters = rs.numbered_clusters(rows.select(IMAGE, cell.alias("cell")).distinct(), "cell", IMAGE, IMAGE, block=None)
    drawn = written(rp.copies(clusters, "cell", IMAGE, reps, SEED + 1000, packed=True))
    w, y, s = F.col(W), F.col("y"), F.least(F.greatest(F.col("score"), F.lit(1e-15)), F.lit(1 - 1e-15))
    key = ["model", "fold"]
    points = each.groupBy(IMAGE, *key, "score").agg(F.sum(w * y).alias("p"), F.sum(w * (1 - y)).alias("n"))
    areas = cf.resampled_areas(points, key, "score", drawn, "cell", IMAGE)
    loss = each.groupBy(IMAGE, *key).agg(F.sum(-w * (y * F.ln(s) + (1 - y) * F.ln(1 - s))).alias("loss"))
    losses = rp.resampled_sums(loss, key, ["loss"], drawn, "cell", IMAGE)
    return written(cf.foldwise(written(areas), losses, ["model"]))


@query("spline_deltas")
def spline_deltas(spark, sf):
    """Out-of-fold metrics of a straight and a spline margin term, and the spline's gain, with bootstrap intervals and the 99 % rule."""
    values = margin_metrics(spark, sf)
    line, curve = (values.filter(F.col("model") == m).select("metric", F.col("values").alias(n)) for m, n in ((LINE, "a"), (CURVE, "b")))
    gain = rp.combined(line.join(curve, "metric").select("metric", "a", "b").withColumnRenamed("metric", "of"), ["of"], {"gain": lambda v: v["b"] - v["a"]})
    gain = gain.select(F.lit("spline_minus_linear").alias("model"), F.col("of").alias("metric"), "values")
    out = _round_all(rp.intervals(values.unionByName(gain), ["model", "metric"]))
    return out.withColumn("enough_valid", F.col("n_valid") >= F.lit(int(0.99 * REPS)))


@query("likelihood_ratio")
def likelihood_ratio(spark, sf):
    """Weighted likelihood-ratio test of the margin beside the covariates."""
    rows = framed(spark, sf)
    return _round_all(cf.likelihood_ratio(rows, ["log_area", "flip_rate"], ["log_area", "flip_rate", "margin"], "y", W))
