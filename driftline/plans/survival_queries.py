"""Survival, incidence, restricted means and risk counts over the rays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bins import CAUSE_NAMES, cause_of, rounded
from ..operators import survival as sv
from .fixtures import rays
from .oracle import rnd, with_tables
from .registry import query

TAU = 0.125
RADII = (0.03125, 0.0625, 0.125)
TAUS = (0.05, 0.0625, 0.10, 0.125, 0.20, 0.25)
ESTIMANDS = ("o2o", "o2m")


def long_events(spark, sf) -> DataFrame:
    """One row per (ray, estimand)."""
    r = rays(spark, sf)
    keep = ["image_id", "gt_id", "direction", "stratum", "sampling_weight", "size_bin"]
    arm = lambda name, base, label: F.struct(
        F.lit(name).alias("estimand"),
        F.col(base).alias("base"),
        (F.col(f"{name}_event_observed") == 1).alias("observed"),
        F.col(f"{name}_radius").alias("radius"),
        F.col(f"{name}_censor_radius").alias("censor"),
        label.alias("label"),
    )
    arms = F.array(
        arm("o2o", "o2o_base_active", F.col("o2o_first_divergence")), arm("o2m", "o2m_base", F.lit("identity_change"))
    )
    return r.select(*keep, F.explode(arms).alias("_a")).select(*keep, "_a.*")


def one_cause(df: DataFrame) -> DataFrame:
    return sv.durations(df, "base", F.col("observed"), "radius", "censor")


def km_table(spark, sf, grid=()) -> DataFrame:
    by = ["size_group", "estimand"]
    counts = sv.time_counts(one_cause(long_events(spark, sf).withColumnRenamed("size_bin", "size_group")), by, ["identity_change"])
    counts = sv.with_margin(counts, "size_group")
    if grid:
        counts = sv.with_grid(counts, by, grid, ["identity_change"])
    return sv.life_table(counts, by, ["identity_change"])


_SIZED = "SELECT l.*, u.size_group FROM fx_long l CROSS JOIN LATERAL (SELECT UNNEST(['all', l.size_bin]) AS size_group) u WHERE base IS NOT NULL"
_TIMES = """SELECT size_group, estimand, time, SUM(sampling_weight) AS leaving, SUM(sampling_weight * observed) AS d FROM (
  SELECT size_group, estimand, sampling_weight, observed, COALESCE(radius, censor) AS time FROM sized) q GROUP BY ALL"""
_RISK = """SELECT *, SUM(leaving) OVER (PARTITION BY size_group, estimand ORDER BY time ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS risk FROM times"""
_KM = """SELECT *, CASE WHEN MAX(h) OVER w >= 1 - 1e-12 THEN 0e0 ELSE EXP(SUM(LN(1 - LEAST(h, 0.9999999999999e0))) OVER w) END AS s FROM (
  SELECT *, CASE WHEN d > 0 THEN d / GREATEST(risk, d) ELSE 0e0 END AS h FROM risk_rows) q
  WINDOW w AS (PARTITION BY size_group, estimand ORDER BY time ROWS UNBOUNDED PRECEDING)"""
_KMPREV = "SELECT *, COALESCE(LAG(s) OVER (PARTITION BY size_group, estimand ORDER BY time), 1e0) AS s0 FROM km"
STEPS = {"sized": _SIZED, "times": _TIMES, "risk_rows": _RISK, "km": _KM, "kmp": _KMPREV}


@query(
    "km_survival",
    with_tables(
        f"""SELECT size_group, estimand, time AS radius, {rnd('s', 9, 'survival')} FROM km WHERE time <= 0.125 + 1e-12 AND (d > 0 OR on_grid = 1)""",
        **{
            **STEPS,
            "times": _TIMES.replace("AS d FROM", "AS d, 0 AS on_grid FROM"),
            "grid": """SELECT size_group, estimand, time, SUM(leaving) AS leaving, SUM(d) AS d, MAX(on_grid) AS on_grid FROM (
  SELECT * FROM times UNION ALL SELECT DISTINCT size_group, estimand, g, 0e0, 0e0, 1 FROM times CROSS JOIN (SELECT UNNEST([0e0, 0.03125e0, 0.0625e0, 0.125e0]) AS g) x) u GROUP BY ALL""",
            "risk_rows": _RISK.replace("FROM times", "FROM grid"),
        },
    ),
)
def km_survival(spark, sf):
    """Weighted Kaplan-Meier curve per size group and estimand, at event radii and evaluation radii."""
    table = sv.survival_at(km_table(spark, sf, [0.0, TAU, *RADII]), TAU)
    return table.select("size_group", "estimand", F.col("time").alias("radius"), rounded(F.col("survival")).alias("survival"))


_CAUSE = "CASE label " + " ".join(
    f"WHEN '{k}' THEN '{v}'"
    for k, v in {
        "eligibility_boundary": "eligibility", "topk_membership_transition": "topk", "conflict_reassignment": "conflict",
        "within_set_geometry_rank_reversal": "within_set",
    }.items()
) + " ELSE 'other' END"


@query(
    "aj_cif",
    with_tables(
        f"""SELECT size_group, cause, radius, {rnd('COALESCE(SUM(CASE WHEN time <= radius + 1e-12 THEN s0 * dc / GREATEST(risk, d) ELSE 0 END), 0)', 9, 'cif')}
FROM (SELECT k.*, c.cause, c.dc FROM kmp k JOIN causes c ON k.size_group = c.size_group AND k.time = c.time WHERE k.estimand = 'o2o') j
CROSS JOIN (SELECT UNNEST([0.03125e0, 0.0625e0, 0.125e0]) AS radius) g GROUP BY size_group, cause, radius""",
        **STEPS,
        causes=f"""SELECT size_group, time, cause, SUM(sampling_weight) AS dc FROM (
  SELECT size_group, radius AS time, sampling_weight, {_CAUSE} AS cause FROM sized WHERE estimand = 'o2o' AND observed = 1) q GROUP BY ALL""",
    ),
)
def aj_cif(spark, sf):
    """Weighted Aalen-Johansen incidence of each first-divergence cause at the evaluation radii."""
    by = ["size_group"]
    rows = long_events(spark, sf).filter("estimand = 'o2o'").withColumnRenamed("size_bin", "size_group")
    risk = sv.durations(rows, "base", F.col("observed"), "radius", "censor", cause_of(F.col("label")))
    counts = sv.with_grid(sv.with_margin(sv.time_counts(risk, by, CAUSE_NAMES), "size_group"), by, RADII, CAUSE_NAMES)
    table = sv.life_table(counts, by, CAUSE_NAMES).filter((F.col("on_grid") > 0) & F.col("time").isin(*RADII))
    causes = F.array(*[F.struct(F.lit(c).alias("cause"), F.col(f"cif_{c}").alias("cif")) for c in CAUSE_NAMES])
    out = table.select("size_group", F.col("time").alias("radius"), F.explode(causes).alias("_c"))
    return out.select("size_group", "_c.cause", "radius", rounded(F.col("_c.cif")).alias("cif"))


def rmean_table(spark, sf, taus=TAUS) -> DataFrame:
    by = ["size_group", "estimand"]
    return sv.restricted_mean(km_table(spark, sf), by, taus)


@query(
    "restricted_mean",
    with_tables(
        f"""SELECT size_group, tau, {rnd("MAX(CASE WHEN estimand = 'o2o' THEN m END)", 9, 'o2o')}, {rnd("MAX(CASE WHEN estimand = 'o2m' THEN m END)", 9, 'o2m')},
 {rnd("MAX(CASE WHEN estimand = 'o2o' THEN m END) - MAX(CASE WHEN estimand = 'o2m' THEN m END)", 9, 'difference')},
 SUM(CASE WHEN estimand = 'o2o' THEN n END)::BIGINT AS n_o2o, SUM(CASE WHEN estimand = 'o2m' THEN n END)::BIGINT AS n_o2m
FROM (SELECT a.*, b.n FROM area a JOIN (SELECT size_group, estimand, COUNT(*) AS n FROM sized GROUP BY ALL) b USING (size_group, estimand)) q GROUP BY ALL""",
        **STEPS,
        area="""SELECT size_group, estimand, tau, SUM(s0 * (LEAST(time, tau) - LEAST(t0, tau))) + MAX(tail) AS m FROM (
  SELECT *, CASE WHEN last_t < tau THEN last_s * (tau - last_t) ELSE 0 END AS tail FROM (
  SELECT k.*, tau, COALESCE(LAG(time) OVER w, 0e0) AS t0, LAST_VALUE(time) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_t,
         LAST_VALUE(s) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_s
  FROM kmp k CROSS JOIN (SELECT UNNEST([0.05e0, 0.0625e0, 0.10e0, 0.125e0, 0.20e0, 0.25e0]) AS tau) t
  WINDOW w AS (PARTITION BY size_group, estimand, tau ORDER BY time)) q) q2 GROUP BY ALL""",
    ),
)
def restricted_mean(spark, sf):
    """Restricted mean radius for six taus in one pass, with the one-to-one minus one-to-many difference."""
    rows = long_events(spark, sf).filter(F.col("base").isNotNull())
    n = sv.with_margin(rows.groupBy("size_bin", "estimand").agg(F.count("*").alias("n")).withColumnRenamed("size_bin", "size_group"), "size_group")
    n = n.groupBy("size_group").agg(*[F.sum(F.when(F.col("estimand") == e, F.col("n"))).alias(f"n_{e}") for e in ESTIMANDS])
    wide = rmean_table(spark, sf).groupBy("size_group", "tau").agg(
        *[F.max(F.when(F.col("estimand") == e, F.col("restricted_mean"))).alias(e) for e in ESTIMANDS]
    )
    return wide.join(n, "size_group").select(
        "size_group", "tau", rounded(F.col("o2o")).alias("o2o"), rounded(F.col("o2m")).alias("o2m"),
        rounded(F.col("o2o") - F.col("o2m")).alias("difference"), "n_o2o", "n_o2m",
    )


@query(
    "risk_counts",
    with_tables(
        f"""SELECT size_group, estimand, support, tau, COUNT(*) AS n_rows, COUNT(base) AS n_defined,
 COUNT(*) FILTER (WHERE base IS NOT NULL AND observed = 1 AND radius <= tau + 1e-12) AS n_event,
 COUNT(*) FILTER (WHERE base IS NOT NULL AND observed = 0 AND censor < tau - 1e-12 AND censor < 0.25 - 1e-12) AS n_geometric_censor,
 COUNT(*) FILTER (WHERE base IS NOT NULL AND observed = 0 AND censor < tau - 1e-12 AND NOT (censor < 0.25 - 1e-12)) AS n_administrative_censor,
 COUNT(*) FILTER (WHERE base IS NOT NULL AND NOT (observed = 1 AND radius <= tau + 1e-12) AND NOT (observed = 0 AND censor < tau - 1e-12)) AS n_observable_event_free,
 {rnd('SUM(CASE WHEN base IS NOT NULL THEN sampling_weight ELSE 0 END)', 6, 'weight_defined')}
FROM (SELECT l.*, u.size_group, s.support FROM fx_long l JOIN (SELECT image_id, gt_id, direction, o2o_base_active IS NOT NULL AND o2m_base IS NOT NULL AS both_ok FROM fx_rays) b USING (image_id, gt_id, direction)
  CROSS JOIN LATERAL (SELECT UNNEST(['all', l.size_bin]) AS size_group) u CROSS JOIN (SELECT UNNEST(['own', 'common']) AS support) s WHERE s.support = 'own' OR both_ok) q
CROSS JOIN (SELECT UNNEST([0.0625e0, 0.125e0, 0.25e0]) AS tau) t GROUP BY size_group, estimand, support, tau"""
    ),
)
def risk_counts(spark, sf):
    """Risk-set composition per size, estimand and tau, on each estimand's own support and on the common one."""
    common = rays(spark, sf).select(
        "image_id", "gt_id", "direction", (F.col("o2o_base_active").isNotNull() & F.col("o2m_base").isNotNull()).alias("_both")
    )
    rows = long_events(spark, sf).join(common, ["image_id", "gt_id", "direction"])
    own = F.array(F.lit("own"), F.lit("common"))
    rows = rows.withColumn("support", F.explode(F.when(F.col("_both"), own).otherwise(F.array(F.lit("own")))))
    # Counts are additive: reduce to the single sizes, then add the pooled group.
    counts = sv.risk_counts(rows.withColumnRenamed("size_bin", "size_group"), ["size_group", "estimand", "support"], (0.0625, 0.125, 0.25), 0.25)
    keys = ["size_group", "estimand", "support", "tau"]
    values = [c for c in counts.columns if c not in keys]
    out = sv.with_margin(counts, "size_group").groupBy(*keys).agg(*[F.sum(v).alias(v) for v in values])
    return out.withColumn("weight_defined", rounded(F.col("weight_defined"), 6))
