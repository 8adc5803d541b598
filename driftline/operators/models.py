"""Score metrics, out-of-fold logistic models and likelihood-ratio tests on pyspark.ml."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.text import draw32
from ..session import shared
from .ordered import running_sums


def score_metrics(df: DataFrame, by: Sequence[str], outcome: str, score: str, weight: str, *, block: Column | int | None = None) -> DataFrame:
    """Weighted ROC-AUC (ties count half), average precision, log-loss and Brier score per group.

    Rows are reduced to distinct scores first; long score orders run in blocks. ``block`` as a column must be
    non-decreasing in the negated score.
    """
    by = list(by)
    y, w = F.col(outcome).cast("double"), F.col(weight)
    s = F.least(F.greatest(F.col(score), F.lit(1e-15)), F.lit(1 - 1e-15))
    loss = -w * (y * F.ln(s) + (F.lit(1.0) - y) * F.ln(F.lit(1.0) - s))
    points = df.groupBy(*by, score).agg(
        F.sum(w * y).alias("_p"),
        F.sum(w * (F.lit(1.0) - y)).alias("_n"),
        F.sum(loss).alias("_loss"),
        F.sum(w * (F.col(score) - y) * (F.col(score) - y)).alias("_brier"),
    )
    points = points.withColumn("_down", -F.col(score))
    cum = running_sums(points, by, "_down", {"_cp": F.col("_p"), "_cw": F.col("_p") + F.col("_n")}, block=block)
    out = cum.groupBy(*by).agg(
        F.sum("_p").alias("_tp"),
        F.sum("_n").alias("_tn"),
        F.sum(F.col("_n") * (F.col("_cp") - F.col("_p") + F.lit(0.5) * F.col("_p"))).alias("_area"),
        F.sum(F.col("_p") * F.col("_cp") / F.col("_cw")).alias("_ap"),
        F.sum("_loss").alias("_loss"),
        F.sum("_brier").alias("_brier"),
    )
    tp, tn = F.col("_tp"), F.col("_tn")
    return out.select(
        *by,
        F.when((tp > 0) & (tn > 0), F.col("_area") / (tp * tn)).alias("roc_auc"),
        F.when(tp > 0, F.col("_ap") / tp).alias("pr_auc"),
        (F.col("_loss") / (tp + tn)).alias("log_loss"),
        (F.col("_brier") / (tp + tn)).alias("brier"),
    )


def with_fold(df: DataFrame, cluster: str, folds: int, seed: int) -> DataFrame:
    """Fold of a cluster by hash: all rows of an image share a fold."""
    return df.withColumn("fold", (draw32(seed, F.col(cluster)) % folds).cast("int"))


def standardise(df: DataFrame, features: Sequence[str], weight: str, train: Column) -> DataFrame:
    """Weighted z-scores with mean and variance of the training rows only."""
    w = F.when(train, F.col(weight)).otherwise(0.0)
    stats = df.agg(*[F.struct((F.sum(w * F.col(f)) / F.sum(w)).alias("m"), (F.sum(w * F.col(f) * F.col(f)) / F.sum(w)).alias("q")).alias(f) for f in features])
    packed = df.withColumn("_s", stats.select(F.struct(*features)).scalar())

    def z(f):
        m = F.col("_s")[f]["m"]
        sd = F.sqrt(F.greatest(F.col("_s")[f]["q"] - m * m, F.lit(0.0)))
        return (F.col(f) - m) / F.when(sd > 0, sd).otherwise(1.0)

    return packed.withColumns({f"z_{f}": z(f) for f in features}).drop("_s")


def spline_basis(value: Column, knots: Sequence[Column], degree: int = 3) -> list[Column]:
    """Truncated-power spline basis, linear beyond the outer knots. Knots are columns (weighted quantiles)."""
    lo, hi = knots[0], knots[-1]
    inside = F.least(F.greatest(value, lo), hi)
    basis = []
    for d in range(1, degree + 1):
        slope_lo, slope_hi = d * F.pow(lo, F.lit(d - 1)), d * F.pow(hi, F.lit(d - 1))
        basis.append(F.pow(inside, F.lit(d)) + F.least(value - lo, F.lit(0.0)) * slope_lo + F.greatest(value - hi, F.lit(0.0)) * slope_hi)
    for k in knots[1:-1]:
        bump = F.pow(F.greatest(inside - k, F.lit(0.0)), F.lit(degree))
        slope = degree * F.pow(F.greatest(hi - k, F.lit(0.0)), F.lit(degree - 1))
        basis.append(bump + F.greatest(value - hi, F.lit(0.0)) * slope)
    return basis


def fit_logit(train: DataFrame, features: Sequence[str], outcome: str, weight: str, max_iter: int = 50):
    """Weighted logistic regression (pyspark.ml); returns a fitted pipeline."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    stages = [
        VectorAssembler(inputCols=list(features), outputCol="_features"),
        LogisticRegression(featuresCol="_features", labelCol=outcome, weightCol=weight, maxIter=max_iter, probabilityCol="_prob", rawPredictionCol="_raw", predictionCol="_pred"),
    ]
    return Pipeline(stages=stages).fit(train)


def out_of_fold(df: DataFrame, models: Mapping[str, Sequence[str]], outcome: str, weight: str, folds: int) -> DataFrame:
    """Out-of-fold probability of each model. One distributed fit per (fold, model); features are z-scored on the training rows."""
    from pyspark.ml.functions import vector_to_array

    every = sorted({f for fs in models.values() for f in fs})
    df = shared(df)  # every fit iterates over it
    out = None
    for fold in range(folds):
        scored = standardise(df, every, weight, F.col("fold") != fold)
        train = scored.filter(F.col("fold") != fold)
        held = scored.filter(F.col("fold") == fold)
        for name, fs in models.items():
            held = fit_logit(train, [f"z_{f}" for f in fs], outcome, weight).transform(held)
            held = held.withColumn(name, vector_to_array("_prob")[1]).drop("_features", "_prob", "_raw", "_pred")
        held = held.drop(*[f"z_{f}" for f in every])
        out = held if out is None else out.unionByName(held)
    return out


def foldwise(metrics: DataFrame, weights: DataFrame, by: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Fold metrics averaged by the fold's share of weight."""
    joined = metrics.join(weights, "fold")
    return joined.groupBy(*by).agg(*[(F.sum(F.col("fold_weight") * F.col(n)) / F.sum("fold_weight")).alias(n) for n in names])


def log_likelihood(df: DataFrame, outcome: str, prob: str, weight: str) -> Column:
    p = F.least(F.greatest(F.col(prob), F.lit(1e-15)), F.lit(1 - 1e-15))
    y = F.col(outcome).cast("double")
    return F.sum(F.col(weight) * (y * F.ln(p) + (F.lit(1.0) - y) * F.ln(F.lit(1.0) - p)))


@F.pandas_udf(DoubleType())
def chi2_tail_one(stat: pd.Series) -> pd.Series:
    """Upper tail of chi-square with one degree of freedom (one-row results)."""
    return stat.map(lambda s: math.erfc(math.sqrt(max(s, 0.0) / 2)))


def likelihood_ratio(df: DataFrame, small: Sequence[str], large: Sequence[str], outcome: str, weight: str) -> DataFrame:
    """Nested weighted likelihood-ratio test of models that differ by one feature. One row.

    Weights are scaled to mean one, so that the statistic does not depend on their unit.
    """
    from pyspark.ml.functions import vector_to_array

    if len(large) != len(small) + 1:
        raise ValueError("the nested models must differ by one feature")
    mean = df.agg(F.avg(weight).alias("m")).scalar()
    rows = df.withColumn("_m", mean).withColumn("_w", F.col(weight) / F.col("_m"))
    for name, fs in (("_p0", small), ("_p1", large)):
        fitted = fit_logit(rows, fs, outcome, "_w")
        rows = fitted.transform(rows).withColumn(name, vector_to_array("_prob")[1]).drop("_features", "_prob", "_raw", "_pred")
    one = rows.agg(log_likelihood(rows, outcome, "_p0", "_w").alias("ll_small"), log_likelihood(rows, outcome, "_p1", "_w").alias("ll_large"))
    one = one.withColumn("statistic", F.lit(2.0) * (F.col("ll_large") - F.col("ll_small")))
    return one.withColumn("p_value", chi2_tail_one("statistic"))
