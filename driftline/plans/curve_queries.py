"""Bootstrap of whole curves, of contrasts within replicates, of rank correlations and of two supports on one draw."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bins import CAUSE_NAMES, cause_of
from ..operators import estimators as es
from ..operators import replicates as rp
from ..operators import resample as rs
from ..operators import survival as sv
from ..session import shared
from .estimate_queries import BASE, W, _round_all, objects
from .fixtures import rays, roster
from .oracle import rnd, with_tables
from .registry import query
from .resample_queries import REPS, SEED, interval_sql, mult_sql
from .survival_queries import _CAUSE, RADII, STEPS, TAU, long_events

STRATUM, IMAGE = "stratum", "image_id"


def drawn(spark, sf, reps: int = REPS, seed: int = SEED) -> DataFrame:
    """Multiplicities of every image as one array, read by all statistics of a query."""
    clusters = rs.numbered_clusters(roster(spark, sf), STRATUM, IMAGE, "dataset_index", block=F.floor(F.col("dataset_index") / 4096))
    return shared(rp.copies(clusters, STRATUM, IMAGE, reps, seed, packed=True))


def replicated_curves(spark, sf, causes, cause, grid, taus, estimands=("o2o", "o2m")) -> DataFrame:
    """(size_group, estimand, metric, radius, values): curves of the pooled and of each size group in every replicate."""
    by = ["size_group", "estimand"]
    events = long_events(spark, sf).withColumnRenamed("size_bin", "size_group").filter(F.col("estimand").isin(*estimands))
    risk = sv.durations(events, "base", F.col("observed"), "radius", "censor", cause)
    stats = sv.with_margin(sv.time_counts(risk, [IMAGE, *by], causes), "size_group")
    sums = rp.resampled_sums(stats, [*by, "time"], ["leaving", *[f"d_{c}" for c in causes]], drawn(spark, sf), STRATUM, IMAGE)
    return rp.curves(sums, by, causes, grid, taus)


_REPLICATE = {k: v.replace("size_group, estimand", "rep, size_group, estimand") for k, v in STEPS.items() if k in ("risk_rows", "km", "kmp")}
_TIMES = """SELECT rep, size_group, estimand, COALESCE(radius, censor) AS time, SUM(copies * sampling_weight) AS leaving, SUM(copies * sampling_weight * observed) AS d
 FROM sized JOIN mult USING (image_id) GROUP BY ALL"""
_MEANS = "SELECT rep, size_group, estimand, {tau}e0 - SUM(CASE WHEN time <= {tau} + 1e-12 THEN (s0 - s) * ({tau}e0 - time) ELSE 0 END) AS value FROM kmp GROUP BY ALL"
_CURVE = {**mult_sql(REPS), **_REPLICATE, "sized": STEPS["sized"], "times": _TIMES}


@query("bootstrap_km", with_tables(interval_sql("vals", "size_group, estimand"), **_CURVE, vals=_MEANS.format(tau=0.125)))
def bootstrap_km(spark, sf):
    """Bootstrap interval of the restricted mean per size and estimand."""
    means = replicated_curves(spark, sf, ["identity_change"], None, [], [TAU])
    return _round_all(rp.intervals(means, ["size_group", "estimand"]))


_GRID = "(SELECT UNNEST([" + ", ".join(f"{r!r}e0" for r in RADII) + "]) AS radius) g"


@query(
    "bootstrap_curves",
    with_tables(
        interval_sql("vals", "size_group, metric, radius"),
        **{**_CURVE, "sized": STEPS["sized"] + " AND estimand = 'o2o'"},
        causes=f"SELECT rep, size_group, radius AS time, {_CAUSE} AS cause, SUM(copies * sampling_weight) AS dc FROM sized JOIN mult USING (image_id) WHERE observed = 1 GROUP BY ALL",
        falls="SELECT k.rep, k.size_group, k.time, c.cause, k.s0 * c.dc / GREATEST(k.risk, k.d) AS mass FROM kmp k JOIN causes c USING (rep, size_group, time)",
        vals=f"""SELECT rep, size_group, 'survival' AS metric, radius, COALESCE(ARG_MAX(s, time) FILTER (WHERE time <= radius + 1e-12), 1e0) AS value FROM kmp CROSS JOIN {_GRID} GROUP BY ALL
 UNION ALL SELECT a.rep, a.size_group, 'cif_' || a.cause, a.radius, COALESCE(SUM(f.mass), 0e0) FROM (SELECT DISTINCT rep, size_group, cause, radius FROM (SELECT DISTINCT rep, size_group FROM kmp) k CROSS JOIN (SELECT UNNEST({list(CAUSE_NAMES)}) AS cause) c CROSS JOIN {_GRID}) a
 LEFT JOIN falls f ON f.rep = a.rep AND f.size_group = a.size_group AND f.cause = a.cause AND f.time <= a.radius + 1e-12 GROUP BY ALL""",
    ),
)
def bootstrap_curves(spark, sf):
    """Bootstrap intervals of the survival curve and of every cause's incidence at the evaluation radii."""
    curves = replicated_curves(spark, sf, CAUSE_NAMES, cause_of(F.col("label")), RADII, [], ["o2o"])
    return _round_all(rp.intervals(curves, ["size_group", "metric", "radius"]))


@query(
    "bootstrap_mean_contrasts",
    with_tables(
        interval_sql("vals", "size_group, contrast, tau"),
        **_CURVE,
        means="\nUNION ALL ".join(f"SELECT *, {tau}e0 AS tau FROM ({_MEANS.format(tau=tau)}) m" for tau in (0.0625, 0.125)),
        vals="SELECT rep, size_group, tau, 'o2o_minus_o2m' AS contrast, a.value - b.value AS value FROM means a JOIN means b USING (rep, size_group, tau) WHERE a.estimand = 'o2o' AND b.estimand = 'o2m'",
    ),
)
def bootstrap_mean_contrasts(spark, sf):
    """Restricted mean of the one-to-one less the one-to-many identity, within each replicate, at two taus."""
    means = shared(replicated_curves(spark, sf, ["identity_change"], None, [], [0.0625, TAU]))
    one, many = (means.filter(F.col("estimand") == e).select("size_group", F.col("radius").alias("tau"), F.col("values").alias(e)) for e in ("o2o", "o2m"))
    both = one.join(many, ["size_group", "tau"])
    out = rp.combined(both, ["size_group", "tau"], {"o2o_minus_o2m": lambda v: v["o2o"] - v["o2m"]})
    return _round_all(rp.intervals(out.withColumnRenamed("metric", "contrast"), ["size_group", "contrast", "tau"]))


@query(
    "bootstrap_spearman",
    with_tables(
        interval_sql("vals", "size_bin"),
        **mult_sql(REPS),
        cells="SELECT m.rep, size_bin, margin, o2o_radius, SUM(sampling_weight * copies) AS w FROM fx_rays JOIN mult m USING (image_id) WHERE o2o_event_observed = 1 GROUP BY ALL",
        rx_="SELECT rep, size_bin, margin, SUM(w) OVER (PARTITION BY rep, size_bin ORDER BY margin) - 0.5e0 * w AS rx FROM (SELECT rep, size_bin, margin, SUM(w) AS w FROM cells GROUP BY ALL) a",
        ry_="SELECT rep, size_bin, o2o_radius, SUM(w) OVER (PARTITION BY rep, size_bin ORDER BY o2o_radius) - 0.5e0 * w AS ry FROM (SELECT rep, size_bin, o2o_radius, SUM(w) AS w FROM cells GROUP BY ALL) a",
        sums_="SELECT rep, size_bin, SUM(w) AS t, SUM(w * rx) AS x, SUM(w * ry) AS y, SUM(w * rx * rx) AS xx, SUM(w * ry * ry) AS yy, SUM(w * rx * ry) AS xy FROM cells JOIN rx_ USING (rep, size_bin, margin) JOIN ry_ USING (rep, size_bin, o2o_radius) GROUP BY ALL",
        vals="SELECT rep, size_bin, (xy / t - x / t * y / t) / SQRT((xx / t - x / t * x / t) * (yy / t - y / t * y / t)) AS value FROM sums_",
    ),
)
def bootstrap_spearman(spark, sf):
    """Bootstrap interval of the weighted rank correlation; weights times copies are re-ranked in every replicate."""
    by = ["size_bin", "margin", "o2o_radius"]
    stats = rays(spark, sf).filter("o2o_event_observed = 1").groupBy(IMAGE, *by).agg(F.sum(W).alias("w"))
    values = rp.resampled_spearman(shared(stats), ["size_bin"], "margin", "o2o_radius", "w", drawn(spark, sf), STRATUM, IMAGE, F.floor(F.col("margin") * 16))
    return _round_all(rp.intervals(values, ["size_bin"]))


_ARMS, _SIZES = ("o2o", "o2m"), (("tiny", es.TINY), ("small", es.SMALL))
_FOUR = "n_legal = 4"  # all four directions can be scanned up to 0.15


def _pair_sql() -> str:
    parts = []
    for support, where in (("all", "TRUE"), ("full", _FOUR)):
        for a in _ARMS:
            for k, s in _SIZES:
                on = f"size_bin = '{s}' AND {where}"
                parts.append(f"SUM(CASE WHEN {on} THEN copies * {W} * {a}_fragile ELSE 0 END) / NULLIF(SUM(CASE WHEN {on} THEN copies * {W} ELSE 0 END), 0) AS {a}_{k}_{support}")
    gap = lambda a, u: f"({a}_tiny_{u} - {a}_small_{u})"
    rows = []
    for name in ("o2o_gap", "o2m_gap", "paired_gap"):
        value = {u: gap(name[:3], u) if name != "paired_gap" else f"({gap('o2o', u)} - {gap('o2m', u)})" for u in ("all", "full")}
        rows += [f"SELECT rep, '{name}' AS metric, 'all' AS support, {value['all']} AS value FROM wide", f"SELECT rep, '{name}', 'full', {value['full']} FROM wide", f"SELECT rep, '{name}', 'full_minus_all', {value['full']} - {value['all']} FROM wide"]
    return f"SELECT rep, {', '.join(parts)} FROM supported JOIN mult USING (image_id) GROUP BY rep", "\nUNION ALL ".join(rows)


@query(
    "paired_supports",
    with_tables(
        interval_sql("vals", "metric, support"),
        **BASE, **mult_sql(REPS),
        supported="SELECT objs.*, n.n_legal FROM objs JOIN (SELECT image_id, gt_id, COUNT(*) FILTER (WHERE scan_limit >= 0.15e0) AS n_legal FROM fx_rays GROUP BY ALL) n USING (image_id, gt_id)",
        wide=_pair_sql()[0], vals=_pair_sql()[1],
    ),
)
def paired_supports(spark, sf):
    """Size gaps of both assignments on all objects and on those with all their directions, and the difference, on one draw."""
    legal = rays(spark, sf).groupBy(IMAGE, "gt_id").agg(F.count_if(F.col("scan_limit") >= 0.15).alias("n_legal"))
    rows = objects(spark, sf).join(legal, [IMAGE, "gt_id"])
    full = F.expr(_FOUR)
    sums = {}
    for support, on in (("all", F.lit(True)), ("full", full)):
        for k, s in _SIZES:
            here = on & (F.col("size_bin") == s)
            sums[f"den_{k}_{support}"] = F.sum(F.when(here, F.col(W)).otherwise(0.0))
            sums |= {f"{a}_{k}_{support}": F.sum(F.when(here, F.col(W) * F.col(f"{a}_fragile")).otherwise(0.0)) for a in _ARMS}
    stats = rows.groupBy(IMAGE).agg(*[v.cast("double").alias(n) for n, v in sums.items()])
    one = rp.resampled_sums(stats.withColumn("everything", F.lit(1)), ["everything"], list(sums), drawn(spark, sf), STRATUM, IMAGE)
    rate = lambda v, a, k, u: v[f"{a}_{k}_{u}"] / v[f"den_{k}_{u}"]
    gap = lambda v, a, u: rate(v, a, "tiny", u) - rate(v, a, "small", u)
    metrics = {"o2o_gap": lambda v, u: gap(v, "o2o", u), "o2m_gap": lambda v, u: gap(v, "o2m", u), "paired_gap": lambda v, u: gap(v, "o2o", u) - gap(v, "o2m", u)}
    formulas = {}
    for name, of in metrics.items():
        formulas[f"{name}/all"] = lambda v, of=of: of(v, "all")
        formulas[f"{name}/full"] = lambda v, of=of: of(v, "full")
        formulas[f"{name}/full_minus_all"] = lambda v, of=of: of(v, "full") - of(v, "all")
    out = rp.combined(one, [], formulas)
    named = out.select(F.split_part("metric", F.lit("/"), F.lit(1)).alias("metric"), F.split_part("metric", F.lit("/"), F.lit(2)).alias("support"), "values")
    return _round_all(rp.intervals(named, ["metric", "support"]))
