"""Weighted rates, contrasts, standardisation, rank correlation and quantiles over the rays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bins import aspect_bin, cause_of, evaluable, event_state, rounded
from ..operators import estimators as es
from ..operators import survival as sv
from ..operators import trajectory as tr
from .fixtures import curve, ray_sets, rays, second_rays, table
from .oracle import rnd, with_tables
from .registry import query
from .survival_queries import STEPS, _CAUSE, long_events

KAPPA = 0.125
OBJECT = ["image_id", "gt_id"]
CARRY = ["stratum", "sampling_weight", "size_bin", "w", "h"]


def flips(r: DataFrame, radius: float = KAPPA) -> DataFrame:
    """Directional flip flags at a radius."""
    hit = lambda a: ((F.col(f"{a}_event_observed") == 1) & F.coalesce(F.col(f"{a}_radius") <= radius, F.lit(False))).cast("int")
    cols = {"o2o_flip": hit("o2o")}
    if "o2m_event_observed" in r.columns:
        cols["o2m_flip"] = hit("o2m")
    return r.withColumns(cols)


def objects(spark, sf) -> DataFrame:
    return es.object_fragility(flips(rays(spark, sf)), OBJECT, ["o2o", "o2m"], CARRY)


DIRS = """SELECT *, CASE WHEN o2o_event_observed = 1 AND o2o_radius <= 0.125 THEN 1 ELSE 0 END AS o2o_flip,
 CASE WHEN o2m_event_observed = 1 AND o2m_radius <= 0.125 THEN 1 ELSE 0 END AS o2m_flip FROM fx_rays"""
OBJS = """SELECT image_id, gt_id, stratum, sampling_weight, size_bin, w, h, COUNT(*) AS legal_directions, MAX(o2o_flip) AS o2o_fragile,
 MAX(o2m_flip) AS o2m_fragile, AVG(o2o_flip) AS o2o_flip_rate, AVG(o2m_flip) AS o2m_flip_rate FROM dirs GROUP BY ALL"""
BASE = {"dirs": DIRS, "objs": OBJS}
W = "sampling_weight"


def wm(x: str, cond: str = "TRUE") -> str:
    return f"SUM(CASE WHEN {cond} THEN {W} * {x} END) / SUM(CASE WHEN {cond} THEN {W} END)"


_T, _S = "size_bin = 't_8_16'", "size_bin = 's_16_32'"


@query(
    "weighted_contrasts",
    with_tables(
        f"""SELECT stratum_group, n, {rnd('a', 9, 'o2o_tiny')}, {rnd('b', 9, 'o2o_small')}, {rnd('c', 9, 'o2m_tiny')}, {rnd('d', 9, 'o2m_small')},
 {rnd('a - b', 9, 'o2o_gap')}, {rnd('c - d', 9, 'o2m_gap')}, {rnd('(a - b) - (c - d)', 9, 'paired_difference')}, {rnd('f', 9, 'o2o_flip_rate')} FROM (
 SELECT u.stratum_group, COUNT(*) AS n, {wm('o2o_fragile', _T)} AS a, {wm('o2o_fragile', _S)} AS b, {wm('o2m_fragile', _T)} AS c, {wm('o2m_fragile', _S)} AS d,
 {wm('o2o_flip_rate')} AS f FROM objs CROSS JOIN LATERAL (SELECT UNNEST(['all', stratum]) AS stratum_group) u GROUP BY ALL) q""",
        **BASE,
    ),
)
def weighted_contrasts(spark, sf):
    """Fragility per size, size gaps and their paired difference, pooled and per stratum."""
    obj = objects(spark, sf)
    stats = es.cluster_stats(
        obj,
        ["stratum"],
        {f"{a}_{n}": (F.col(f"{a}_fragile"), F.col("size_bin") == s) for a in ("o2o", "o2m") for n, s in (("tiny", es.TINY), ("small", es.SMALL))}
        | {"o2o_flip_rate": (F.col("o2o_flip_rate"), F.lit(True)), "n": (F.lit(1.0) / F.col(W), F.lit(True))},
    )
    # Sums per stratum are additive, so the pooled row needs no second pass over the objects.
    stats = sv.with_margin(stats, "stratum").withColumnRenamed("stratum", "stratum_group")
    wide = stats.groupBy("stratum_group").agg(
        *[
            es.ratio(F.sum(F.when(F.col("metric") == m, F.col("num"))), F.sum(F.when(F.col("metric") == m, F.col("den")))).alias(m)
            for m in ("o2o_tiny", "o2o_small", "o2m_tiny", "o2m_small", "o2o_flip_rate")
        ],
        F.round(F.sum(F.when(F.col("metric") == "n", F.col("num")))).cast("long").alias("n"),
    )
    c = F.col
    return wide.select(
        "stratum_group", "n", *[rounded(c(m)).alias(m) for m in ("o2o_tiny", "o2o_small", "o2m_tiny", "o2m_small", "o2o_flip_rate")],
        rounded(c("o2o_tiny") - c("o2o_small")).alias("o2o_gap"), rounded(c("o2m_tiny") - c("o2m_small")).alias("o2m_gap"),
        rounded((c("o2o_tiny") - c("o2o_small")) - (c("o2m_tiny") - c("o2m_small"))).alias("paired_difference"),
    )


_SUP = """SELECT *, o2o_ok AS o2o_natural, o2m_ok AS o2m_natural, o2o_ok AND o2m_ok AS both_state_common FROM (
 SELECT o.*, v.o2o_ok, v.o2m_ok FROM objs o JOIN (SELECT image_id, gt_id, BOOL_AND(o2o_base_active IS NOT NULL) AS o2o_ok, BOOL_AND(o2m_base IS NOT NULL) AS o2m_ok FROM fx_rays GROUP BY ALL) v USING (image_id, gt_id)) q"""


@query(
    "support_sensitivity",
    with_tables(
        f"""SELECT support, size_group, n_rows, {rnd('a', 9, 'o2o_rate')}, {rnd('b', 9, 'o2m_rate')}, {rnd('m', 9, 'restricted_mean')} FROM (
 SELECT support, size_group, COUNT(*) AS n_rows, {wm('o2o_fragile')} AS a, {wm('o2m_fragile')} AS b FROM members GROUP BY ALL) e
 JOIN area USING (support, size_group)""",
        **BASE,
        supp=_SUP,
        members="""SELECT s.*, u.size_group, x.support FROM supp s CROSS JOIN LATERAL (SELECT UNNEST(['all', size_bin]) AS size_group) u
 CROSS JOIN LATERAL (SELECT UNNEST(CASE WHEN both_state_common THEN ['o2o_natural', 'o2m_natural', 'both_state_common', 'competition_defined_common'] WHEN o2o_natural THEN ['o2o_natural'] WHEN o2m_natural THEN ['o2m_natural'] ELSE [] END) AS support) x""",
        times="""SELECT support, size_group, COALESCE(o2o_radius, o2o_censor_radius) AS time, SUM(r.sampling_weight) AS leaving, SUM(r.sampling_weight * o2o_event_observed) AS d
 FROM fx_rays r JOIN (SELECT image_id, gt_id, support, size_group FROM members) m USING (image_id, gt_id) WHERE o2o_base_active IS NOT NULL GROUP BY ALL""",
        risk_rows="""SELECT *, SUM(leaving) OVER (PARTITION BY support, size_group ORDER BY time ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS risk FROM times""",
        km="""SELECT *, CASE WHEN MAX(h) OVER w >= 1 - 1e-12 THEN 0e0 ELSE EXP(SUM(LN(1 - LEAST(h, 0.9999999999999e0))) OVER w) END AS s FROM (
  SELECT *, CASE WHEN d > 0 THEN d / GREATEST(risk, d) ELSE 0e0 END AS h FROM risk_rows) q WINDOW w AS (PARTITION BY support, size_group ORDER BY time ROWS UNBOUNDED PRECEDING)""",
        area="""SELECT support, size_group, 0.125e0 - SUM(CASE WHEN time <= 0.125 + 1e-12 THEN (s0 - s) * (0.125e0 - time) ELSE 0 END) AS m FROM (
  SELECT *, COALESCE(LAG(s) OVER (PARTITION BY support, size_group ORDER BY time), 1e0) AS s0 FROM km) q GROUP BY ALL""",
    ),
)
def support_sensitivity(spark, sf):
    """Rates and restricted means under four supports, pooled and by size."""
    r = rays(spark, sf)
    ok = r.groupBy(*OBJECT).agg(
        F.bool_and(F.col("o2o_base_active").isNotNull()).alias("o2o_ok"), F.bool_and(F.col("o2m_base").isNotNull()).alias("o2m_ok")
    )
    from ..functions.bins import supports

    s = supports(F.col("o2o_ok"), F.col("o2m_ok"))
    names = ("o2o_natural", "o2m_natural", "both_state_common", "competition_defined_common")
    held = F.filter(F.array(*[F.when(F.col("_s")[n], n) for n in names]), lambda x: x.isNotNull())
    members = ok.withColumn("_s", s).select(*OBJECT, F.explode(held).alias("support"))
    rates = objects(spark, sf).join(members, OBJECT)
    cells = rates.groupBy("support", "size_bin").agg(
        F.count("*").alias("n_rows"), F.sum(W).alias("den"), *[F.sum(F.col(W) * F.col(f"{a}_fragile")).alias(a) for a in ("o2o", "o2m")]
    )
    rates = sv.with_margin(cells.withColumnRenamed("size_bin", "size_group"), "size_group").groupBy("support", "size_group").agg(
        F.sum("n_rows").alias("n_rows"), *[es.ratio(F.sum(a), F.sum("den")).alias(f"{a}_rate") for a in ("o2o", "o2m")]
    )
    by = ["support", "size_group"]
    risk = sv.durations(r.join(members, OBJECT), "o2o_base_active", F.col("o2o_event_observed") == 1, "o2o_radius", "o2o_censor_radius")
    counts = sv.with_margin(sv.time_counts(risk.withColumnRenamed("size_bin", "size_group"), by, ["identity_change"]), "size_group")
    means = sv.restricted_mean(sv.life_table(counts, by, ["identity_change"]), by, [KAPPA])
    return rates.join(means, by).select(
        *by, "n_rows", *[rounded(F.col(c)).alias(c) for c in ("o2o_rate", "o2m_rate", "restricted_mean")]
    )


def pathway(r: DataFrame) -> DataFrame:
    flipped = flips(r).filter("o2o_flip = 1").withColumn("cause", cause_of(F.col("o2o_first_divergence")))
    cells = flipped.groupBy("size_bin", "cause").agg(F.sum(W).alias("w"))
    return sv.with_margin(cells.withColumnRenamed("size_bin", "size_group"), "size_group").groupBy("size_group", "cause").agg(F.sum("w").alias("w"))


_PATH = f"""SELECT size_group, cause, w / SUM(w) OVER (PARTITION BY size_group) AS f FROM (SELECT u.size_group, {_CAUSE.replace('label', 'o2o_first_divergence')} AS cause, SUM({W}) AS w
 FROM SRC CROSS JOIN LATERAL (SELECT UNNEST(['all', size_bin]) AS size_group) u WHERE o2o_event_observed = 1 AND o2o_radius <= 0.125 GROUP BY ALL) q"""


@query(
    "pathway_mix",
    with_tables(
        f"""SELECT size_group, cause, {rnd('COALESCE(a.f, 0)', 9, 'first_fraction')}, {rnd('COALESCE(b.f, 0)', 9, 'second_fraction')}, {rnd('COALESCE(b.f, 0) - COALESCE(a.f, 0)', 9, 'difference')}
 FROM pa a FULL OUTER JOIN pb b USING (size_group, cause)""",
        pa=_PATH.replace("SRC", "fx_rays"),
        pb=_PATH.replace("SRC", "fx_rays2"),
    ),
)
def pathway_mix(spark, sf):
    """Cause fractions among flips in two result sets and their difference (full outer, missing is zero)."""

    def fractions(r, name):
        cells = pathway(r)
        total = cells.groupBy("size_group").agg(F.sum("w").alias("t"))
        return cells.join(total, "size_group").select("size_group", "cause", (F.col("w") / F.col("t")).alias(name))

    both = fractions(rays(spark, sf), "a").join(fractions(second_rays(spark, sf), "b"), ["size_group", "cause"], "full_outer").na.fill(0.0, ["a", "b"])
    return both.select(
        "size_group", "cause", rounded(F.col("a")).alias("first_fraction"), rounded(F.col("b")).alias("second_fraction"),
        rounded(F.col("b") - F.col("a")).alias("difference"),
    )


FLAGS = ("eligibility", "topk", "conflict", "reversal")
_MODS = dict(zip(FLAGS, (2, 3, 5, 7)))
_PAIRS = [f"{a}+{b}" for i, a in enumerate(FLAGS) for b in FLAGS[i + 1:]]


@query(
    "cooccurrence",
    with_tables(
        "UNPIVOT (SELECT size_bin, "
        + ", ".join(
            [rnd(wm("1", "n >= 1") + " * SUM(CASE WHEN n >= 1 THEN sampling_weight ELSE 0 END) / SUM(sampling_weight)", 9, '"any"'),
             rnd("SUM(CASE WHEN n >= 2 THEN sampling_weight ELSE 0 END) / SUM(sampling_weight)", 9, "multiple")]
            + [rnd(f"SUM(CASE WHEN {p.split('+')[0]} = 1 AND {p.split('+')[1]} = 1 THEN sampling_weight ELSE 0 END) / SUM(sampling_weight)", 9, f'"{p}"') for p in _PAIRS]
        )
        + " FROM (SELECT *, eligibility + topk + conflict + reversal AS n FROM flagged) q GROUP BY size_bin) ON COLUMNS(* EXCLUDE size_bin) INTO NAME flags VALUE rate",
        flagged="SELECT size_bin, sampling_weight, "
        + ", ".join(f"CASE WHEN ok % {m} = 0 THEN 1 ELSE 0 END AS {f}" for f, m in _MODS.items())
        + " FROM fx_rays WHERE o2o_event_observed = 1",
    ),
)
def cooccurrence(spark, sf):
    """Rates of any, several and each pair of stage flags among events, by size."""
    r = rays(spark, sf).filter("o2o_event_observed = 1")
    flagged = r.select("size_bin", W, *[(F.col("ok") % m == 0).cast("int").alias(f) for f, m in _MODS.items()])
    return es.cooccurrence(flagged, ["size_bin"], FLAGS).withColumn("rate", rounded(F.col("rate")))


_OVER = """SELECT *, LEN(LIST_INTERSECT(base_ids, shift_ids)) AS ni, LEN(LIST_DISTINCT(LIST_CONCAT(base_ids, shift_ids))) AS nu,
 CASE WHEN LEN(base_ids) = 0 AND LEN(shift_ids) = 0 THEN 'empty_empty' WHEN LEN(base_ids) = 0 THEN 'empty_to_nonempty' WHEN LEN(shift_ids) = 0 THEN 'nonempty_to_empty' ELSE 'nonempty_nonempty' END AS state FROM fx_raysets"""


@query(
    "structural_states",
    with_tables(
        f"""SELECT size_bin, state, n_rows, {rnd('w / SUM(w) OVER (PARTITION BY size_bin)', 9, 'share')} FROM (
 SELECT size_bin, state, COUNT(*) AS n_rows, SUM({W}) AS w FROM overlap GROUP BY ALL) q""",
        overlap=_OVER,
    ),
)
def structural_states(spark, sf):
    """Weighted share of the four empty/non-empty set transitions per size."""
    r = tr.with_overlap(ray_sets(spark, sf), "base_ids", "shift_ids")
    return es.shares(r, ["size_bin"], "structural_state").withColumnRenamed("structural_state", "state").withColumn("share", rounded(F.col("share")))


def _standard_sql(stratum: str, src: str, value: str, least: int, group: str | None = None) -> str:
    g, gs = (f"{group}, ", f"{group}") if group else ("", "1")
    tail = f"GROUP BY {group}" if group else ""
    cells = f"""SELECT {g}{stratum} AS k, SUM(CASE WHEN {_T} THEN {W} * {value} ELSE 0 END) AS nt, SUM(CASE WHEN {_T} THEN {W} ELSE 0 END) AS dt,
 SUM(CASE WHEN {_S} THEN {W} * {value} ELSE 0 END) AS ns, SUM(CASE WHEN {_S} THEN {W} ELSE 0 END) AS ds,
 COUNT(*) FILTER (WHERE {_T}) >= {least} AND COUNT(*) FILTER (WHERE {_S}) >= {least} AS sup FROM {src} GROUP BY ALL"""
    ct, cs = "SUM(nt) / SUM(dt)", "SUM(ns) / SUM(ds)"
    st = "SUM(CASE WHEN sup THEN (dt + ds) * nt / dt ELSE 0 END) / SUM(CASE WHEN sup THEN dt + ds ELSE 0 END)"
    ss = st.replace("nt / dt", "ns / ds")
    return f"""SELECT {g}{rnd(ct, 9, 'crude_tiny')}, {rnd(cs, 9, 'crude_small')}, {rnd(st, 9, 'standard_tiny')}, {rnd(ss, 9, 'standard_small')},
 {rnd('SUM(CASE WHEN sup THEN dt + ds ELSE 0 END) / SUM(dt + ds)', 9, 'coverage')}, COUNT(*) FILTER (WHERE sup) AS n_supported,
 {rnd(f'{ct} - {cs}', 9, 'crude_gap')}, {rnd(f'{st} - {ss}', 9, 'standard_gap')} FROM ({cells}) q {tail}"""


def _round_all(df: DataFrame, skip=("n_supported",)) -> DataFrame:
    return df.select(*[rounded(F.col(n)).alias(n) if t == "double" and n not in skip else F.col(n) for n, t in df.dtypes])


@query(
    "count_standardise",
    with_tables(
        _standard_sql("LEN(base_ids)", "(SELECT * FROM fx_raysets JOIN (SELECT image_id, gt_id, direction, o2o_flip FROM dirs) d USING (image_id, gt_id, direction)) z", "o2o_flip", 5).strip(),
        **BASE,
    ),
)
def count_standardise(spark, sf):
    """Flip rates standardised to the pooled distribution of the positive count, over adequately filled counts."""
    r = flips(ray_sets(spark, sf)).withColumn("positive_count", F.size("base_ids"))
    cells = es.standard_cells(r, [], "positive_count", F.col("o2o_flip"))
    return _round_all(es.standardised(cells, [], "positive_count", least=5))


_ASPECT = "CASE WHEN GREATEST(w::DOUBLE / h, h::DOUBLE / w) <= 1.5 THEN 'le_1_5' WHEN GREATEST(w::DOUBLE / h, h::DOUBLE / w) <= 2.5 THEN '1_5_to_2_5' ELSE 'gt_2_5' END"


@query(
    "aspect_standardise",
    with_tables(
        _standard_sql("aspect", f"(SELECT *, {_ASPECT} AS aspect, CASE WHEN direction IN ('left', 'right') THEN 'horizontal' ELSE 'vertical' END AS axis FROM dirs) z", "o2o_flip", 1, "axis"),
        **BASE,
    ),
)
def aspect_standardise(spark, sf):
    """Flip rates per shift axis, standardised to the pooled aspect distribution."""
    from ..functions.bins import direction_axis

    r = flips(rays(spark, sf)).withColumns({"aspect": aspect_bin(F.col("w"), F.col("h")), "axis": direction_axis(F.col("direction"))})
    cells = es.standard_cells(r, ["axis"], "aspect", F.col("o2o_flip"))
    return _round_all(es.standardised(cells, ["axis"], "aspect"))


def _cut(a, k):
    return wm(f"{a}_fragile", f"side {'<' if k == 'lower' else '>='} cutpoint")


@query(
    "cutpoints",
    with_tables(
        "SELECT cutpoint, "
        + ", ".join(rnd(_cut(a, k), 9, f"{a}_{k}") for a in ("o2o", "o2m") for k in ("lower", "upper"))
        + ", "
        + ", ".join(rnd(f"({_cut(a, 'lower')}) - ({_cut(a, 'upper')})", 9, f"{a}_gap") for a in ("o2o", "o2m"))
        + ", "
        + rnd(f"(({_cut('o2o', 'lower')}) - ({_cut('o2o', 'upper')})) - (({_cut('o2m', 'lower')}) - ({_cut('o2m', 'upper')}))", 9, "paired")
        + " FROM (SELECT *, SQRT(CAST(w * h AS DOUBLE)) AS side FROM objs) o CROSS JOIN (SELECT UNNEST([14e0, 16e0, 18e0]) AS cutpoint) c GROUP BY cutpoint",
        **BASE,
    ),
)
def cutpoints(spark, sf):
    """Size gaps under cuts of 14, 16 and 18 pixels."""
    return _round_all(es.cutpoint_rates(objects(spark, sf), F.sqrt((F.col("w") * F.col("h")).cast("double")), (14, 16, 18), ("o2o", "o2m")), ("cutpoint",))


@query(
    "stable_subset",
    with_tables(
        f"""SELECT subset, size_bin, COUNT(*) AS n_objects, {rnd(wm('o2o_fragile'), 9, 'rate')}, {rnd(f'SUM({W}) / MAX(total)', 9, 'retention')} FROM (
 SELECT o.*, x.subset, SUM(CASE WHEN x.subset = 'all_legal' THEN {W} ELSE 0 END) OVER (PARTITION BY size_bin) AS total FROM sobj o
 CROSS JOIN LATERAL (SELECT UNNEST(LIST_FILTER(['all_legal', CASE WHEN stable THEN 'eligibility_stable' END, CASE WHEN legal_directions = 4 THEN 'four_valid' END], lambda z: z IS NOT NULL)) AS subset) x) q GROUP BY subset, size_bin""",
        **BASE,
        sobj="""SELECT image_id, gt_id, size_bin, sampling_weight, COUNT(*) AS legal_directions, MAX(o2o_flip) AS o2o_fragile,
 BOOL_AND(NOT (o2o_flip = 1 AND o2o_first_divergence = 'eligibility_boundary')) AS stable FROM dirs WHERE ok % 17 <> 0 GROUP BY ALL""",
    ),
)
def stable_subset(spark, sf):
    """Fragility among all objects, those with unchanged eligibility and those with four valid directions."""
    d = flips(rays(spark, sf)).filter("ok % 17 <> 0")
    changed = (F.col("o2o_flip") == 1) & (F.col("o2o_first_divergence") == "eligibility_boundary")
    obj = es.stable_objects(d, OBJECT, changed, ["size_bin", W, "o2o_flip"]).withColumnRenamed("o2o_flip", "o2o_fragile")
    kept = F.filter(
        F.array(F.lit("all_legal"), F.when(F.col("stable"), "eligibility_stable"), F.when(F.col("legal_directions") == 4, "four_valid")),
        lambda x: x.isNotNull(),
    )
    out = obj.withColumn("subset", F.explode(kept)).groupBy("subset", "size_bin").agg(
        F.count("*").alias("n_objects"), es.weighted_mean(F.col("o2o_fragile"), F.col(W)).alias("rate"), F.sum(W).alias("w")
    )
    total = obj.groupBy("size_bin").agg(F.sum(W).alias("t"))
    return out.join(total, "size_bin").select(
        "subset", "size_bin", "n_objects", rounded(F.col("rate")).alias("rate"), rounded(F.col("w") / F.col("t")).alias("retention")
    )


@query(
    "status_shares",
    with_tables(
        f"""SELECT size_group, status, n_rows, CASE WHEN status NOT LIKE 'undefined_reason%' THEN {rnd('w / t')} END AS share FROM (
 SELECT size_group, status, COUNT(*) AS n_rows, SUM({W}) AS w, MAX(t) AS t FROM (
 SELECT x.*, UNNEST(CASE WHEN st = 'undefined' THEN ['undefined', 'undefined_reason:' || COALESCE(rho_reason, 'unspecified')] ELSE [st] END) AS status FROM (
 SELECT r.*, u.size_group, SUM({W}) OVER (PARTITION BY u.size_group) AS t, CASE WHEN rho_observed = 1 THEN 'observed' WHEN rho_competing = 1 THEN 'competing_censored' WHEN rho_right = 1 THEN 'right_censored' ELSE 'undefined' END AS st
 FROM fx_rays r CROSS JOIN LATERAL (SELECT UNNEST(['all', size_bin]) AS size_group) u) x) y GROUP BY ALL) z"""
    ),
)
def status_shares(spark, sf):
    """Weighted shares of the rank-crossing states, and counts of the undefined reasons."""
    state = event_state(F.col("rho_observed") == 1, F.col("rho_competing") == 1, F.col("rho_right") == 1)
    r = rays(spark, sf).withColumn("_state", F.when(state == "other_censored", "undefined").otherwise(state))
    reason = F.concat(F.lit("undefined_reason:"), F.coalesce("rho_reason", F.lit("unspecified")))
    cells = r.groupBy("size_bin", "_state", F.when(F.col("_state") == "undefined", reason).alias("_reason")).agg(
        F.count("*").alias("n_rows"), F.sum(W).alias("w")
    )
    cells = sv.with_margin(cells.withColumnRenamed("size_bin", "size_group"), "size_group")
    labels = F.filter(F.array("_state", "_reason"), lambda x: x.isNotNull())
    total = cells.groupBy("size_group").agg(F.sum("w").alias("t"))
    out = cells.withColumn("status", F.explode(labels)).groupBy("size_group", "status").agg(F.sum("n_rows").alias("n_rows"), F.sum("w").alias("w"))
    return out.join(total, "size_group").select(
        "size_group", "status", "n_rows", F.when(~F.col("status").startswith("undefined_reason"), rounded(F.col("w") / F.col("t"))).alias("share")
    )


@query(
    "rank_set_endpoint",
    with_tables(
        f"""SELECT size_group, {rnd(wm('rk'), 9, 'rank_changed_rate')}, {rnd(wm('sc'), 9, 'set_exact_changed_rate')}, {rnd(wm('rk * (1 - sc)'), 9, 'rank_changed_set_same_rate')},
 {rnd(wm('(rk - sc)'), 9, 'rank_minus_set_rate')}, {rnd(wm('jac', 'jac IS NOT NULL'), 9, 'mean_jaccard')}, {rnd(wm('ret', 'ret IS NOT NULL'), 9, 'mean_retention')},
 {rnd(wm('jac', 'jac IS NOT NULL AND rk = 1'), 9, 'mean_jaccard_among_rank_changed')}, {rnd(wm('ret', 'ret IS NOT NULL AND rk = 1'), 9, 'mean_retention_among_rank_changed')}
 FROM (SELECT *, CASE WHEN base_ids[1] IS DISTINCT FROM shift_ids[1] THEN 1 ELSE 0 END AS rk, CASE WHEN base_ids <> shift_ids THEN 1 ELSE 0 END AS sc,
 CASE WHEN nu > 0 THEN ni::DOUBLE / nu END AS jac, CASE WHEN LEN(base_ids) > 0 THEN ni::DOUBLE / LEN(base_ids) END AS ret FROM overlap) q
 CROSS JOIN LATERAL (SELECT UNNEST(['all', size_bin]) AS size_group) u WHERE o2m_base IS NOT NULL GROUP BY size_group""",
        overlap=_OVER,
    ),
)
def rank_set_endpoint(spark, sf):
    """Rank and set change metrics with their conditional denominators, pooled and by size."""
    r = tr.with_overlap(ray_sets(spark, sf).filter("o2m_base IS NOT NULL"), "base_ids", "shift_ids")
    first = lambda c: F.get(F.col(c), F.lit(0))
    r = r.withColumn("rank_changed", (~first("base_ids").eqNullSafe(first("shift_ids"))).cast("int"))
    stats = es.cluster_stats(r, ["size_bin"], tr.rank_set_metrics("rank_changed"))
    pooled = es.pooled(sv.with_margin(stats.withColumnRenamed("size_bin", "size_group"), "size_group"), ["size_group", "metric"])
    names = list(tr.rank_set_metrics("rank_changed"))
    return pooled.groupBy("size_group").agg(*[rounded(F.max(F.when(F.col("metric") == m, F.col("estimate")))).alias(m) for m in names])


_CUM = "SELECT margin, w, SUM(w) OVER (ORDER BY margin ROWS UNBOUNDED PRECEDING) AS cum, SUM(w) OVER () AS tot FROM (SELECT margin, SUM(sampling_weight) AS w FROM fx_rays GROUP BY margin) q"


@query(
    "weighted_quintiles",
    with_tables(
        f"""SELECT size_bin, quintile, COUNT(*) AS n_rows, {rnd(f'SUM({W})', 6, 'weight')}, {rnd(wm('o2o_flip'), 9, 'rate')}, {rnd('MIN(margin)', 9, 'lowest')} FROM (
 SELECT d.*, 1 + (margin >= q1)::INT + (margin >= q2)::INT + (margin >= q3)::INT + (margin >= q4)::INT AS quintile FROM dirs d CROSS JOIN cuts) z GROUP BY size_bin, quintile""",
        **BASE,
        cum=_CUM,
        cuts="SELECT " + ", ".join(f"MIN(CASE WHEN cum >= {p}e0 * tot - 1e-9 THEN margin END) AS q{i}" for i, p in enumerate((0.2, 0.4, 0.6, 0.8), 1)) + " FROM cum",
    ),
)
def weighted_quintiles(spark, sf):
    """Flip rate by weighted quintile of the margin; a boundary value enters the higher bin."""
    r = flips(rays(spark, sf))
    # Quantiles are one row: attached as scalar values, not by a join.
    cuts = es.weighted_quantiles(r, [], "margin", W, (0.2, 0.4, 0.6, 0.8), block=16)
    packed = cuts.select(F.array("q20", "q40", "q60", "q80").alias("c")).scalar()
    r = r.withColumn("_cuts", packed).withColumn("quintile", es.quintile(F.col("margin"), [F.col("_cuts")[i] for i in range(4)]))
    return r.groupBy("size_bin", "quintile").agg(
        F.count("*").alias("n_rows"), rounded(F.sum(W), 6).alias("weight"),
        rounded(es.weighted_mean(F.col("o2o_flip"), F.col(W))).alias("rate"), rounded(F.min("margin")).alias("lowest"),
    )


@query(
    "weighted_spearman",
    with_tables(
        f"""SELECT size_group, n AS n_rows, {rnd('(xy / t - x / t * y / t) / SQRT((xx / t - x / t * x / t) * (yy / t - y / t * y / t))', 9, 'correlation')} FROM (
 SELECT size_group, COUNT(*) AS n, SUM({W}) AS t, SUM({W} * rx) AS x, SUM({W} * ry) AS y, SUM({W} * rx * rx) AS xx, SUM({W} * ry * ry) AS yy, SUM({W} * rx * ry) AS xy FROM (
 SELECT *, SUM({W}) OVER (PARTITION BY size_group ORDER BY margin RANGE UNBOUNDED PRECEDING) - 0.5e0 * SUM({W}) OVER (PARTITION BY size_group, margin) AS rx,
 SUM({W}) OVER (PARTITION BY size_group ORDER BY o2o_radius RANGE UNBOUNDED PRECEDING) - 0.5e0 * SUM({W}) OVER (PARTITION BY size_group, o2o_radius) AS ry
 FROM (SELECT r.*, u.size_group FROM fx_rays r CROSS JOIN LATERAL (SELECT UNNEST(['all', size_bin]) AS size_group) u WHERE o2o_event_observed = 1) a) b GROUP BY size_group) c"""
    ),
)
def weighted_spearman(spark, sf):
    """Weighted rank correlation of margin and radius among observed events, pooled and by size."""
    r = rays(spark, sf).filter("o2o_event_observed = 1").withColumn("size_group", F.explode(F.array(F.lit("all"), F.col("size_bin"))))
    out = es.weighted_spearman(
        r, ["size_group"], "margin", "o2o_radius", W, blocks={"margin": F.floor(F.col("margin") * 16), "o2o_radius": F.floor(F.col("o2o_radius") * 64)}
    )
    return out.withColumn("correlation", rounded(F.col("correlation")))


@query("wls_log_area")
def wls_log_area(spark, sf):
    """Linear probability model of the flip on log area, positive count and direction, with the area-doubling effect."""
    r = flips(ray_sets(spark, sf)).filter(evaluable(F.col("scan_limit"), F.col("o2o_event_observed") == 1, F.col("o2o_radius"), KAPPA))
    r = r.withColumns({"log_area": F.ln(F.col("w") * F.col("h")), "positives": F.size("base_ids")})
    r = es.centred(r, ["size_bin"], ["log_area", "positives"], W)
    r, names = es.dummies(r, "direction", ["down", "left", "right", "up"])
    features = ["log_area", "positives", *names]
    fit = es.solve_gram(es.gram(r, ["size_bin"], features, "o2o_flip", W), ["size_bin"], features)
    return _round_all(fit.withColumn("area_doubling", F.col("log_area") * F.ln(F.lit(2.0))))


@query(
    "equal_seed_mean",
    with_tables(
        f"""SELECT size_bin, {rnd('AVG(rate)', 9, 'estimate')}, COUNT(rate) AS n_seeds, SUM(n)::BIGINT AS n_rows FROM (
 SELECT size_bin, seed, {wm('o2o_flip')} AS rate, COUNT(*) AS n FROM seeded WHERE (image_id, gt_id) IN (SELECT (image_id, gt_id) FROM seeded GROUP BY image_id, gt_id HAVING COUNT(DISTINCT seed) = 3) GROUP BY ALL) q GROUP BY size_bin""",
        **BASE,
        seeded="SELECT *, ok % 3 AS seed FROM dirs",
    ),
)
def equal_seed_mean(spark, sf):
    """Mean of per-seed rates over the objects that all three seeds share."""
    d = flips(rays(spark, sf)).withColumn("seed", F.col("ok") % 3)
    out = es.equal_seed_mean(d, OBJECT, "seed", 3, "o2o_flip", W, ["size_bin"])
    return out.withColumn("estimate", rounded(F.col("estimate")))


@query(
    "endpoint_diagnostics",
    with_tables(
        "SELECT size_bin, radius, COUNT(*) AS n_rows, "
        + ", ".join(rnd(wm(e), 9, n) for n, e in {"ever_rate": "ever", "endpoint_changed_rate": "chg", "both_rate": "ever * chg", "returned_rate": "ever * (1 - chg)", "unrecorded_rate": "(1 - ever) * chg"}.items())
        + """ FROM (SELECT c.size_bin, c.radius, c.sampling_weight, CASE WHEN r.o2o_event_observed = 1 AND r.o2o_radius <= c.radius + 1e-12 THEN 1 ELSE 0 END AS ever,
 CASE WHEN r.o2o_base_active IS DISTINCT FROM c.o2o_active THEN 1 ELSE 0 END AS chg FROM fx_curve c JOIN fx_rays r USING (image_id, gt_id, direction)
 WHERE c.radius IN (0.03125, 0.0625, 0.125) AND r.o2o_base_active IS NOT NULL) q GROUP BY size_bin, radius"""
    ),
)
def endpoint_diagnostics(spark, sf):
    """Ever-changed, changed at the endpoint, both, returned and unrecorded rates at exact radii."""
    ev = rays(spark, sf).select("image_id", "gt_id", "direction", "o2o_base_active", "o2o_event_observed", "o2o_radius")
    at = tr.exact_endpoint(curve(spark, sf), "radius", (0.03125, 0.0625, 0.125))
    flagged = tr.endpoint_flags(at.join(ev, ["image_id", "gt_id", "direction"]).filter("o2o_base_active IS NOT NULL"), "o2o_base_active", "o2o_active", "o2o_event_observed", "o2o_radius", "radius")
    metrics = tr.endpoint_metrics()
    stats = es.cluster_stats(flagged, ["size_bin", "radius"], metrics)
    wide = stats.groupBy("size_bin", "radius").agg(
        *[rounded(es.ratio(F.sum(F.when(F.col("metric") == m, F.col("num"))), F.sum(F.when(F.col("metric") == m, F.col("den"))))).alias(m) for m in metrics]
    )
    return wide.join(flagged.groupBy("size_bin", "radius").agg(F.count("*").alias("n_rows")), ["size_bin", "radius"])


@query(
    "weighted_auc",
    with_tables(
        f"""SELECT g AS source_group, {rnd('auc', 9, 'roc_auc')}, {rnd('ap', 9, 'pr_auc')}, {rnd('ll', 9, 'log_loss')}, {rnd('br', 9, 'brier')} FROM (
 SELECT g, SUM(neg * (cum_p_above + 0.5e0 * pos)) / NULLIF(MAX(tp) * MAX(tn), 0) AS auc, SUM(pos / tp * cum_p / cum_w) AS ap, SUM(ll) / MAX(tp + tn) AS ll, SUM(br) / MAX(tp + tn) AS br FROM (
 SELECT *, SUM(pos) OVER w AS cum_p, SUM(pos) OVER w - pos AS cum_p_above, SUM(pos + neg) OVER w AS cum_w, SUM(pos) OVER (PARTITION BY g) AS tp, SUM(neg) OVER (PARTITION BY g) AS tn
 FROM scored WINDOW w AS (PARTITION BY g ORDER BY s DESC ROWS UNBOUNDED PRECEDING)) q GROUP BY g) z""",
        scored="""SELECT g, s, SUM(CASE WHEN quality = 1 THEN wt ELSE 0 END) AS pos, SUM(CASE WHEN quality = 0 THEN wt ELSE 0 END) AS neg,
 SUM(-wt * (quality * LN(s) + (1 - quality) * LN(1 - s))) AS ll, SUM(wt * (s - quality) * (s - quality)) AS br FROM (
 SELECT UNNEST(['all', lang]) AS g, quality, n_chars::DOUBLE / (n_chars + 2000e0) AS s, 1 + doc_id % 3 AS wt FROM documents JOIN labels USING (doc_id)) x GROUP BY g, s""",
    ),
)
def weighted_auc(spark, sf):
    """Weighted ROC-AUC, average precision, log-loss and Brier score of a length score, pooled and per language."""
    from ..operators.models import score_metrics

    d = table(spark, sf, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id")
    d = d.select(
        F.explode(F.array(F.lit("all"), F.col("lang"))).alias("source_group"), "quality",
        (F.col("n_chars") / (F.col("n_chars") + 2000.0)).alias("score"), (1 + F.col("doc_id") % 3).cast("double").alias("weight"),
    )
    return _round_all(score_metrics(d, ["source_group"], "quality", "score", "weight", block=F.floor(F.col("score") * -32)))


def _gap_of(a: str) -> str:
    return f"({wm(f'{a}_fragile', _T)}) - ({wm(f'{a}_fragile', _S)})"


@query(
    "stress_matrix",
    with_tables(
        f"""SELECT stratum, kappa, {rnd(wm('o2o_fragile', _T), 9, 'o2o_tiny')}, {rnd(wm('o2o_fragile', _S), 9, 'o2o_small')}, {rnd(wm('o2m_fragile', _T), 9, 'o2m_tiny')}, {rnd(wm('o2m_fragile', _S), 9, 'o2m_small')},
 {rnd(_gap_of('o2o'), 9, 'o2o_gap')}, {rnd(_gap_of('o2m'), 9, 'o2m_gap')}, {rnd(f"({_gap_of('o2o')}) - ({_gap_of('o2m')})", 9, 'paired_difference')} FROM (
 SELECT stratum, kappa, image_id, gt_id, size_bin, sampling_weight, MAX(CASE WHEN o2o_event_observed = 1 AND o2o_radius <= kappa + 1e-12 THEN 1 ELSE 0 END) AS o2o_fragile, MAX(CASE WHEN o2m_event_observed = 1 AND o2m_radius <= kappa + 1e-12 THEN 1 ELSE 0 END) AS o2m_fragile
 FROM fx_rays CROSS JOIN (SELECT UNNEST([0.05e0, 0.1e0, 0.15e0, 0.2e0]) AS kappa) k GROUP BY ALL) q GROUP BY stratum, kappa"""
    ),
)
def stress_matrix(spark, sf):
    """Size contrasts per stratum and shift strength."""
    return _round_all(es.stress_matrix(rays(spark, sf), (0.05, 0.1, 0.15, 0.2), "stratum", OBJECT, ("o2o", "o2m"), ["size_bin", W]), ("kappa",))


@query(
    "same_stride",
    with_tables(
        f"""SELECT size_bin, COUNT(*) AS n_objects, {rnd(wm('1e0', 'same') + f' * SUM(CASE WHEN same THEN {W} ELSE 0 END) / SUM({W})', 9, 'retention')}, {rnd(wm('fragile', 'same'), 9, 'rate')}, SUM(nc)::BIGINT AS n_cross, SUM(nm)::BIGINT AS n_missing FROM (
 SELECT size_bin, image_id, gt_id, sampling_weight, BOOL_AND(COALESCE(sh = ba, FALSE)) AS same, COUNT(*) FILTER (WHERE sh <> ba) AS nc, COUNT(*) FILTER (WHERE sh IS NULL) AS nm, MAX(o2o_flip) AS fragile FROM (
 SELECT *, [8, 16, 32][1 + gt_id % 3] AS ba, CASE WHEN ok % 13 = 0 THEN NULL WHEN ok % 7 = 0 THEN [8, 16, 32][1 + (gt_id + 1) % 3] ELSE [8, 16, 32][1 + gt_id % 3] END AS sh FROM dirs) a GROUP BY ALL) b GROUP BY size_bin""",
        **BASE,
    ),
)
def same_stride(spark, sf):
    """Fragility of the objects whose every replay stays on the base stride, with retention."""
    strides = F.array(F.lit(8), F.lit(16), F.lit(32))
    base = F.element_at(strides, (F.col("gt_id") % 3 + 1).cast("int"))
    moved = F.element_at(strides, ((F.col("gt_id") + 1) % 3 + 1).cast("int"))
    shifted = F.when(F.col("ok") % 13 == 0, None).when(F.col("ok") % 7 == 0, moved).otherwise(base)
    obj = es.same_stride(flips(rays(spark, sf)), OBJECT, base, shifted, "o2o_flip", ["size_bin", W])
    w = F.col(W)
    out = obj.groupBy("size_bin").agg(
        F.count("*").alias("n_objects"), (F.sum(F.when(F.col("same_stride"), w).otherwise(0.0)) / F.sum(w)).alias("retention"),
        es.weighted_mean(F.col("fragile"), w, F.col("same_stride")).alias("rate"), F.sum("n_cross").alias("n_cross"), F.sum("n_missing").alias("n_missing"),
    )
    return _round_all(out)


@query(
    "event_counts",
    with_tables("SELECT size_bin, o2o_first_divergence, COUNT(*) AS n_events, COUNT(DISTINCT (image_id, gt_id)) AS n_objects FROM fx_rays GROUP BY ALL"),
)
def event_counts(spark, sf):
    """Events and objects per size and divergence label."""
    per = rays(spark, sf).groupBy("size_bin", "o2o_first_divergence", *OBJECT).agg(F.count("*").alias("_n"))
    return per.groupBy("size_bin", "o2o_first_divergence").agg(F.sum("_n").alias("n_events"), F.count("*").alias("n_objects"))


@query(
    "gap_quartiles",
    with_tables(
        "SELECT size_bin, " + ", ".join(rnd(f"QUANTILE_CONT({v}::DOUBLE, {q})", 9, f"{v}_{n}") for v in ("margin", "o2o_radius") for q, n in ((0.25, "q25"), (0.5, "median"), (0.75, "q75"))) + " FROM fx_rays WHERE o2o_event_observed = 1 GROUP BY size_bin"
    ),
)
def gap_quartiles(spark, sf):
    """Quartiles of margin and radius among events, by size."""
    return _round_all(es.quantile_summary(rays(spark, sf).filter("o2o_event_observed = 1"), ["size_bin"], ["margin", "o2o_radius"]))
