"""Folds, fits and fold-wise replicate metrics against NumPy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.operators import crossfit as cf
from driftline.operators import replicates as rp
from driftline.operators import resample as rs
from driftline.plans import model_queries

W, K = "w", 3


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    out = []
    for k in range(420):
        x, m = rng.normal(), round(float(rng.random()), 3)
        p = 1 / (1 + math.exp(-(0.4 * x + 3 * math.sin(4 * m) - 1)))
        out.append((f"i{k % 70}", ["a", "b"][k % 70 % 2], x, m, float(rng.uniform(0.5, 3)), int(rng.random() < p)))
    return out


@pytest.fixture(scope="module")
def frame(spark, rows):
    df = spark.createDataFrame(rows, "image_id string, stratum string, x double, margin double, w double, y int")
    return df.join(cf.stratified_folds(df, "image_id", "y", K, 9).select("image_id", "fold"), "image_id").cache()


def newton(x, y, w, ridge=1e-6):
    mean = np.average(x, axis=0, weights=w)
    scale = np.sqrt(np.average((x - mean) ** 2, axis=0, weights=w))
    z = np.concatenate([np.ones((len(x), 1)), (x - mean) / scale], axis=1)
    b, lam = np.zeros(z.shape[1]), np.array([0.0] + [ridge] * x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-z @ b))
        b = b + np.linalg.solve((z.T * (w * p * (1 - p))) @ z + np.diag(lam), z.T @ (w * (y - p)) - lam * b)
    return lambda v: 1 / (1 + np.exp(-(np.concatenate([np.ones((len(v), 1)), (v - mean) / scale], axis=1) @ b)))


def columns(df, *names):
    data = df.select(*names).toPandas()
    return [data[n].to_numpy() for n in names]


def test_folds_hold_whole_clusters_and_equal_shares(spark):
    rng = np.random.default_rng(1)
    data = [(int(c), int(rng.random() < 0.3)) for c in range(500) for _ in range(int(rng.integers(1, 8)))] + [(1000, 1)] * 30
    df = spark.createDataFrame(data, "c long, y int")
    got = cf.stratified_folds(df, "c", "y", 5, 3).collect()
    assert sorted(r.c for r in got) == sorted({c for c, _ in data})
    positives = [sum(r.n_positive for r in got if r.fold == f) for f in range(5)]
    clusters = [sum(r.fold == f for r in got) for f in range(5)]
    assert max(positives) - min(positives) <= 30 and max(clusters) - min(clusters) <= 1
    assert cf.stratified_folds(df.filter("false"), "c", "y", 5, 3).count() == 0


def test_fits_match_numpy(frame):
    knots = cf.training_knots(frame, "margin", W, "fold", K, 4)
    spline = cf.Spline("margin", knots)
    models = {"line": ["x", "margin"], "curve": ["x", spline]}
    scored = cf.predicted(frame, cf.fit(frame, models, "y", W, "fold", K))
    x, m, w, y, fold, line, curve = columns(scored, "x", "margin", W, "y", "fold", "line", "curve")
    for f in range(K):
        order = np.argsort(m[fold != f])
        cum = np.cumsum(w[fold != f][order])
        inner = [m[fold != f][order][np.searchsorted(cum, p * cum[-1] - 1e-9)] for p in (1 / 3, 2 / 3, 1.0)]
        assert knots[f] == [m[fold != f].min(), *inner]
        for name, got, design in (("line", line, np.stack([x, m], 1)), ("curve", curve, np.stack([x, *spline.columns(m, f)], 1))):
            model = newton(design[fold != f], y[fold != f], w[fold != f])
            assert np.allclose(got[fold == f], model(design[fold == f]), atol=1e-8), name


def test_spline_is_straight_outside_its_knots():
    s = cf.Spline("v", {0: [0.2, 0.4, 0.7, 0.9]})
    v = np.array([-1.0, -0.5, 0.0, 0.2, 0.9, 1.0, 1.5, 2.0])
    for c in s.columns(v, 0):
        assert abs((c[1] - c[0]) - (c[2] - c[1])) < 1e-12 and abs((c[6] - c[5]) - (c[7] - c[6])) < 1e-9


def test_knots_that_coincide_and_separated_outcomes_raise(spark, frame):
    flat = frame.withColumn("margin", F.lit(0.5))
    with pytest.raises(ValueError, match="coincide"):
        cf.training_knots(flat, "margin", W, "fold", K, 4)
    apart = frame.withColumn("y", (F.col("x") > 0).cast("int"))
    with pytest.raises((RuntimeError, np.linalg.LinAlgError)):
        cf.fit(apart, {"m": ["x"]}, "y", W, most=8)


def test_likelihood_ratio(frame):
    got = cf.likelihood_ratio(frame, ["x"], ["x", "margin"], "y", W).first()
    x, m, w, y = columns(frame, "x", "margin", W, "y")
    w = w / w.mean()
    like = lambda d: (lambda p: (w * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum())(newton(d, y, w)(d))
    a, b = like(x[:, None]), like(np.stack([x, m], 1))
    assert abs(got.ll_small - a) < 1e-6 and abs(got.statistic - 2 * (b - a)) < 1e-6 and abs(got.p_value - math.erfc(math.sqrt(b - a))) < 1e-6


def test_foldwise_metrics_in_every_replicate(frame):
    reps = 25
    scored = frame.withColumn("score", F.round(F.least(F.greatest(F.col("margin"), F.lit(0.01)), F.lit(0.99)), 2)).withColumn("model", F.lit("m"))
    cell = F.concat_ws("/", F.col("fold").cast("string"), "stratum")
    clusters = rs.numbered_clusters(scored.select("image_id", cell.alias("cell")).distinct(), "cell", "image_id", "image_id", block=None)
    drawn = rp.copies(clusters, "cell", "image_id", reps, 7).cache()
    w, y, s = F.col(W), F.col("y"), F.col("score")
    points = scored.groupBy("image_id", "model", "fold", "score").agg(F.sum(w * y).alias("p"), F.sum(w * (1 - y)).alias("n"))
    areas = cf.ranked_areas(rp.resampled_sums(points, ["model", "fold", "score"], ["p", "n"], drawn, "cell", "image_id"), ["model", "fold"], "score", F.floor(F.col("score") * 5))
    loss = scored.groupBy("image_id", "model", "fold").agg(F.sum(-w * (y * F.ln(s) + (1 - y) * F.ln(1 - s))).alias("loss"))
    losses = rp.resampled_sums(loss, ["model", "fold"], ["loss"], drawn, "cell", "image_id")
    got = {r.metric: np.frombuffer(r["values"]) for r in cf.foldwise(areas, losses, ["model"]).collect()}
    mult = {r.image_id: np.frombuffer(r.copies, np.int16) for r in drawn.collect()}
    image, fold, score, weight, label = columns(scored, "image_id", "fold", "score", W, "y")
    for rep in (0, 3, reps):
        want, total = np.zeros(3), 0.0
        for f in range(K):
            at = fold == f
            w1, s1, y1 = weight[at] * np.array([mult[i][rep] for i in image[at]]), score[at], label[at]
            wp, wn = w1 * y1, w1 * (1 - y1)
            area = sum(wn[j] * (wp[s1 > s1[j]].sum() + wp[s1 == s1[j]].sum() / 2) for j in range(len(s1))) / (wp.sum() * wn.sum())
            ap = sum(wp[j] * wp[s1 >= s1[j]].sum() / w1[s1 >= s1[j]].sum() for j in range(len(s1)) if wp[j]) / wp.sum()
            ll = -(w1 * (y1 * np.log(s1) + (1 - y1) * np.log(1 - s1))).sum()
            want += np.array([area * w1.sum(), ap * w1.sum(), ll])
            total += w1.sum()
        assert np.allclose([got[m][rep] for m in ("roc_auc", "pr_auc", "log_loss")], want / total)


@pytest.mark.parametrize("blocks,most", [(4, 3), (2, 128)])
def test_areas_are_read_in_order_of_scores(frame, blocks, most):
    """Points of one score lie in several slices; the sums equal those of stored cells."""
    scored = frame.withColumn("score", F.round(F.least(F.greatest(F.col("margin"), F.lit(0.01)), F.lit(0.99)), 1)).withColumn("model", F.lit("m"))
    cell = F.concat_ws("/", F.col("fold").cast("string"), "stratum")
    clusters = rs.numbered_clusters(scored.select("image_id", cell.alias("cell")).distinct(), "cell", "image_id", "image_id", block=None)
    drawn = rp.copies(clusters, "cell", "image_id", 9, 7).cache()
    w, y, by = F.col(W), F.col("y"), ["model", "fold"]
    points = scored.groupBy("image_id", *by, "score").agg(F.sum(w * y).alias("p"), F.sum(w * (1 - y)).alias("n"))
    plain = cf.ranked_areas(rp.resampled_sums(points, [*by, "score"], ["p", "n"], drawn, "cell", "image_id"), by, "score", F.floor(F.col("score") * 5))
    told = cf.resampled_areas(points, by, "score", drawn, "cell", "image_id", blocks=blocks, most=most)
    a, b = ({r.fold: r for r in df.collect()} for df in (plain, told))
    assert len(a) == K and a.keys() == b.keys()
    for fold, r in a.items():
        for c in ("tp", "tn", "area", "ap"):
            assert np.allclose(np.frombuffer(r[c]), np.frombuffer(b[fold][c]), rtol=1e-9)


def test_no_replicate_sums_by_score(spark, sf, monkeypatch):
    """A thousand sums are kept for a fold or a piece of it, not for every distinct score."""
    seen, plain = [], rp.resampled_sums
    for module in (rp, cf):
        monkeypatch.setattr(module, "resampled_sums", lambda stats, by, *a: seen.append(list(by)) or plain(stats, by, *a), raising=False)
    model_queries.margin_metrics(spark, sf, 5)
    assert len(seen) == 2 and not any("score" in by for by in seen)
