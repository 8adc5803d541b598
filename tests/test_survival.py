"""Hand-computed survival answers and invariants."""

import math

import pytest
from pyspark.sql import functions as F

from driftline.operators import estimators as es
from driftline.operators import ordered
from driftline.operators import survival as sv

CAUSES = ["eligibility", "within_set"]


@pytest.fixture(scope="module")
def events(spark):
    rows = [("a", 1.0, 1, 1, 0.25, None, "eligibility"), ("b", 1.0, 1, 1, 0.5, None, "within_set"), ("c", 1.0, 1, 0, None, 1.0, None), ("d", 1.0, 1, 1, 0.75, None, "eligibility"), ("e", 1.0, None, 1, 0.1, None, "eligibility")]
    return spark.createDataFrame(rows, "image_id string, sampling_weight double, base int, obs int, radius double, censor double, label string").withColumn("g", F.lit("all"))


def table(events, block=None, grid=(0.0, 1.0)):
    risk = sv.durations(events, "base", F.col("obs") == 1, "radius", "censor", F.col("label"))
    counts = sv.with_grid(sv.time_counts(risk, ["g"], CAUSES), ["g"], grid, CAUSES)
    return sv.life_table(counts, ["g"], CAUSES, block=block)


def test_known_curve(events):
    rows = {r["time"]: r for r in table(events).collect()}
    assert [round(rows[t]["survival"], 9) for t in (0.25, 0.5, 0.75, 1.0)] == [0.75, 0.5, 0.25, 0.25]
    assert [round(rows[t]["cif_eligibility"], 9) for t in (0.25, 0.5, 0.75, 1.0)] == [0.25, 0.25, 0.5, 0.5]
    assert [round(rows[t]["cif_within_set"], 9) for t in (0.25, 0.5, 0.75, 1.0)] == [0.0, 0.25, 0.25, 0.25]


def test_restricted_mean(events):
    out = {r["tau"]: r["restricted_mean"] for r in sv.restricted_mean(table(events), ["g"], [0.1, 1.0]).collect()}
    assert out[1.0] == pytest.approx(0.625)
    assert out[0.1] == pytest.approx(0.1)


def test_blocks_give_the_same_table(events):
    cols = ["time", "survival", "cif_eligibility"]
    plain = sorted(tuple(round(x, 12) for x in r) for r in table(events).select(*cols).collect())
    cut = sorted(tuple(round(x, 12) for x in r) for r in table(events, F.floor(F.col("time") * 3)).select(*cols).collect())
    assert plain == cut


def test_survival_and_incidence_sum_to_one(spark, sf):
    from driftline.functions.bins import CAUSE_NAMES, cause_of
    from driftline.plans.survival_queries import long_events

    rows = long_events(spark, sf).filter("estimand = 'o2o'")
    risk = sv.durations(rows, "base", F.col("observed"), "radius", "censor", cause_of(F.col("label")))
    t = sv.life_table(sv.time_counts(risk, ["size_bin"], CAUSE_NAMES), ["size_bin"], CAUSE_NAMES)
    total = F.col("survival") + sum((F.col(f"cif_{c}") for c in CAUSE_NAMES), F.lit(0.0))
    assert t.agg(F.max(F.abs(total - 1))).first()[0] < 1e-9


def test_curve_that_ends_at_zero(spark):
    rows = [("a", 1.0, 1, 1, 0.5, None), ("b", 1.0, 1, 1, 0.5, None)]
    df = spark.createDataFrame(rows, "image_id string, sampling_weight double, base int, obs int, radius double, censor double").withColumn("g", F.lit("x"))
    risk = sv.durations(df, "base", F.col("obs") == 1, "radius", "censor")
    t = sv.life_table(sv.time_counts(risk, ["g"], ["identity_change"]), ["g"], ["identity_change"])
    assert t.first()["survival"] == 0.0
    assert sv.restricted_mean(t, ["g"], [1.0]).first()["restricted_mean"] == pytest.approx(0.5)


def test_bad_duration_is_refused(spark):
    df = spark.createDataFrame([(1, 1, None, None, 1.0)], "base int, obs int, radius double, censor double, sampling_weight double")
    with pytest.raises(Exception, match="invalid event"):
        sv.durations(df, "base", F.col("obs") == 1, "radius", "censor").collect()


def test_spearman_known_and_constant(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0, 1.0), ("a", 2.0, 4.0, 1.0), ("a", 3.0, 8.0, 1.0), ("b", 1.0, 1.0, 1.0), ("b", 1.0, 2.0, 1.0), ("b", 1.0, 3.0, 1.0)], "g string, x double, y double, w double")
    out = {r["g"]: r["correlation"] for r in es.weighted_spearman(df, ["g"], "x", "y", "w").collect()}
    assert out["a"] == pytest.approx(1.0) and out["b"] is None


@pytest.mark.parametrize("by", [[], ["g"]])
def test_running_sums_in_blocks_with_a_hot_value(spark, by):
    df = spark.range(3000).select(
        "id", F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 7).alias("g"),
        F.when(F.col("id") % 3 == 1, 5.0).otherwise(F.col("id") * 7919 % 400 / 10.0).alias("x"),
    )
    a = ordered.running_sums(df, by, "x", {"s": F.col("id"), "n": F.lit(1)}, block=8, tie="id", tie_block=4)
    b = ordered.running_sums(df, by, "x", {"s": F.col("id"), "n": F.lit(1)}, tie="id")
    assert a.exceptAll(b).count() == 0 and a.count() == 3000


def test_previous_row_in_blocks(spark):
    df = spark.range(2000).select("id", (F.col("id") % 5).alias("g")).filter("id % 11 <> 3")
    a = ordered.previous_row(df, ["g"], "id", ["id"], block=F.floor(F.col("id") / 64))
    b = ordered.previous_row(df, ["g"], "id", ["id"])
    assert a.exceptAll(b).count() == 0


def test_weighted_quantiles(spark):
    df = spark.createDataFrame([(float(i), 1.0 if i < 5 else 5.0) for i in range(10)], "v double, w double")
    for block in (None, 3):
        r = es.weighted_quantiles(df, [], "v", "w", (0.1, 0.5, 0.9), block=block).first()
        assert (r["q10"], r["q50"], r["q90"]) == (2.0, 6.0, 9.0)


def test_whole_share_despite_rounding(spark):
    """Running sums of large weights end above or below the total of the same weights."""
    df = spark.range(60_000).select((F.col("id") % 300).alias("g"), F.floor(F.col("id") / 300).cast("double").alias("v"), (F.rand(1) * 1e9 + 1).alias("w"))
    df = df.unionByName(df.select("g", F.lit(500.0).alias("v"), F.lit(0.0).alias("w"))).cache()
    for block in (None, 3):
        got = {r["q100"] for r in es.weighted_quantiles(df, ["g"], "v", "w", (0.5, 1.0), block=block).collect()}
        assert got == {199.0}


def test_wls_against_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    x = rng.normal(size=(200, 2))
    w = rng.uniform(0.5, 2, 200)
    y = 1 + x @ [2.0, -3.0] + rng.normal(size=200)
    df = spark.createDataFrame([(float(a), float(b), float(c), float(d), "g") for (a, b), c, d in zip(x, y, w)], "a double, b double, y double, w double, g string")
    fit = es.solve_gram(es.gram(df, ["g"], ["a", "b"], "y", "w"), ["g"], ["a", "b"]).first()
    design = np.column_stack([np.ones(200), x])
    beta = np.linalg.solve(design.T @ (design * w[:, None]), design.T @ (w * y))
    assert [fit["intercept"], fit["a"], fit["b"]] == pytest.approx(list(beta))
    assert math.isfinite(fit["a"])
