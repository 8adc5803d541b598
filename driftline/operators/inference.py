"""Bootstrap tests, bounds and multiplicity control. Inputs are replicate values or one row per hypothesis."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared


def one_sided(values: DataFrame, plan: DataFrame, alpha: float = 0.05) -> DataFrame:
    """One-sided bootstrap p = (opposite + 1)/(B + 1) and confidence bound per hypothesis.

    ``values``: (id, rep, value) with replicate 0 the point; ``plan``: (id, direction). A plan is a handful of rows.
    """
    joined = values.join(plan, "id")
    boot = (F.col("rep") > 0) & F.col("value").isNotNull() & ~F.isnan("value")
    opposite = F.when(F.col("direction") == "greater", F.col("value") <= 0).otherwise(F.col("value") >= 0)
    bounds = F.percentile(F.when(boot, F.col("value")), F.array(F.lit(alpha), F.lit(1 - alpha)))
    out = joined.groupBy("id", "direction").agg(
        F.max(F.when(F.col("rep") == 0, F.col("value"))).alias("estimate"),
        F.count_if(boot).alias("n_valid"),
        F.count_if(boot & opposite).alias("_opposite"),
        bounds.alias("_b"),
    )
    bound = F.when(F.col("direction") == "greater", F.col("_b")[0]).otherwise(F.col("_b")[1])
    p = (F.col("_opposite") + 1) / (F.col("n_valid") + 1)
    clear = F.when(F.col("direction") == "greater", bound > 0).otherwise(bound < 0)
    return out.select("id", "direction", "estimate", "n_valid", p.alias("p"), bound.alias("bound"), clear.alias("bound_clear"))


def gatekeeping(tests: DataFrame, order: Sequence[str], alpha: float = 0.05) -> DataFrame:
    """Fixed-sequence testing: a hypothesis is confirmatory only while all earlier ones passed."""
    rank = F.array_position(F.array(*[F.lit(i) for i in order]), F.col("id"))
    gated = tests.withColumn("rank", rank).filter("rank > 0").withColumn("raw_pass", F.col("p") <= alpha)
    w = Window.partitionBy(F.lit(1)).orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    opened = F.coalesce(F.min(F.col("raw_pass").cast("int")).over(w), F.lit(1)) == 1
    status = F.when(~opened, "descriptive").when(F.col("raw_pass"), "pass").otherwise("fail")
    return gated.withColumn("status", status)


def holm(tests: DataFrame, ids: Sequence[str], alpha: float = 0.05) -> DataFrame:
    """Holm-adjusted p (running maximum of (m - i) p) and step-down rejection."""
    family = tests.filter(F.col("id").isin(*ids))
    m = len(ids)
    by_p = Window.partitionBy(F.lit(1)).orderBy("p", "id")
    so_far = by_p.rowsBetween(Window.unboundedPreceding, 0)
    stepped = family.withColumn("_i", F.row_number().over(by_p))
    stepped = stepped.withColumn("_scaled", F.least(F.lit(1.0), (F.lit(m) - F.col("_i") + 1) * F.col("p")))
    return stepped.withColumn("adjusted_p", F.max("_scaled").over(so_far)).withColumn(
        "rejected", F.min((F.col("p") <= F.lit(alpha) / (F.lit(m) - F.col("_i") + 1)).cast("int")).over(so_far) == 1
    ).drop("_i", "_scaled")


def evaluate(tests: DataFrame, gated: Sequence[str], family: Sequence[str], alpha: float = 0.05) -> DataFrame:
    """Gatekeeping for the first family, Holm for the second, in one table."""
    cols = ["id", "direction", "estimate", "n_valid", "p", "bound"]
    tests = shared(tests)  # one row per hypothesis, read by both procedures
    a = gatekeeping(tests, gated, alpha).select(*cols, F.lit("gatekeeping").alias("procedure"), F.col("p").alias("adjusted_p"), "status")
    b = holm(tests, family, alpha).select(
        *cols, F.lit("holm").alias("procedure"), "adjusted_p", F.when(F.col("rejected"), "pass").otherwise("fail").alias("status")
    )
    return a.unionByName(b)
