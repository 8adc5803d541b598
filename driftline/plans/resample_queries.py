"""Sampling, bootstrap, precision and confirmatory tests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bins import cause_of, rounded
from ..functions.text import hash_selected
from ..operators import estimators as es
from ..operators import inference as inf
from ..operators import reconcile as rc
from ..operators import replicates as rp
from ..operators import resample as rs
from ..session import shared
from .estimate_queries import BASE, CARRY, OBJECT, W, _round_all, flips, objects, wm
from .fixtures import gt, rays, roster, second_rays, table
from .oracle import rnd, with_tables
from .registry import query

SEED = 20260901


def draw_sql(parts: str, digits: int = 8) -> str:
    return f"CAST('0x' || SUBSTR(MD5(CONCAT_WS('|', {parts})), 1, {digits}) AS BIGINT)"


def mult_sql(reps: int, seed: int = SEED, name: str = "") -> dict[str, str]:
    return {
        f"slots{name}": "SELECT image_id, stratum, ROW_NUMBER() OVER (PARTITION BY stratum ORDER BY dataset_index) - 1 AS slot, COUNT(*) OVER (PARTITION BY stratum) AS n_h FROM fx_roster",
        f"draws{name}": f"SELECT rep, stratum, {draw_sql(f'{seed}, rep, stratum, slot')} % n_h AS slot, COUNT(*) AS copies FROM slots{name} CROSS JOIN (SELECT UNNEST(RANGE(1, {reps + 1})) AS rep) r GROUP BY ALL",
        f"mult{name}": f"SELECT rep, image_id, copies FROM draws{name} JOIN slots{name} USING (stratum, slot) UNION ALL SELECT 0, image_id, 1 FROM slots{name}",
    }


def drawn(spark, sf, reps: int, seed: int = SEED) -> DataFrame:
    """Multiplicities of every image as one array."""
    clusters = rs.numbered_clusters(roster(spark, sf), "stratum", "image_id", "dataset_index", block=F.floor(F.col("dataset_index") / 4096))
    return shared(rp.copies(clusters, "stratum", "image_id", reps, seed, packed=True))


def resampled_ratios(stats: DataFrame, multiplicity: DataFrame, by) -> DataFrame:
    return rp.ratios(stats, by, multiplicity, "stratum", "image_id")


ALLOC = """SELECT *, fl + CASE WHEN ROW_NUMBER() OVER (PARTITION BY budget ORDER BY ex - fl DESC, n_total DESC, stratum DESC) <= take - SUM(fl) OVER (PARTITION BY budget) THEN 1 ELSE 0 END AS n_sample FROM (
 SELECT *, CAST(FLOOR(ex) AS BIGINT) AS fl FROM (SELECT budget, stratum, n_total, LEAST(budget, SUM(n_total) OVER (PARTITION BY budget)) AS take,
 LEAST(budget, SUM(n_total) OVER (PARTITION BY budget)) * n_total::DOUBLE / SUM(n_total) OVER (PARTITION BY budget) AS ex FROM POP) a) b"""
_POP = "(SELECT c_mktsegment AS stratum, COUNT(*) AS n_total, 500 AS budget FROM customer GROUP BY c_mktsegment) p"


@query("allocate_strata", with_tables("SELECT stratum, n_total, n_sample::BIGINT AS n_sample FROM alloc", alloc=ALLOC.replace("POP", _POP)))
def allocate_strata(spark, sf):
    """Proportional allocation of 500 images over the segments by largest remainder."""
    counts = table(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("stratum")).agg(F.count("*").alias("n_total"))
    return rs.allocation(counts, 500).select("stratum", "n_total", F.col("n_sample").cast("long").alias("n_sample"))


@query(
    "sample_stratified",
    with_tables(
        f"""SELECT c_custkey, stratum, {rnd('n_sample::DOUBLE / n_total', 9, 'inclusion_probability')}, {rnd('n_total::DOUBLE / n_sample', 9, 'sampling_weight')} FROM (
 SELECT c_custkey, stratum, n_total, n_sample, ROW_NUMBER() OVER (PARTITION BY stratum ORDER BY {draw_sql(f'{SEED}, c_custkey', 15)}, c_custkey) AS pos
 FROM customer c JOIN alloc a ON c.c_mktsegment = a.stratum) q WHERE pos <= n_sample""",
        alloc=ALLOC.replace("POP", _POP),
    ),
)
def sample_stratified(spark, sf):
    """Stratified sample without replacement: the smallest draws of each stratum, with weights."""
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("stratum"))
    sizes = rs.allocation(c.groupBy("stratum").agg(F.count("*").alias("n_total")), 500)
    out = rs.stratified_sample(c, sizes, "stratum", "c_custkey", SEED)
    return out.select("c_custkey", "stratum", rounded(F.col("inclusion_probability")).alias("inclusion_probability"), rounded(F.col("sampling_weight")).alias("sampling_weight"))


@query(
    "hash_sample",
    with_tables(
        f"SELECT image_id, gt_id, direction FROM fx_rays WHERE CAST('0x' || SUBSTR(SHA256(CONCAT_WS('|', '{SEED}', image_id, gt_id, direction)), 1, 16) AS UBIGINT) % 100 < 20"
    ),
)
def hash_sample(spark, sf):
    """SHA-256 sample of the rays at 20 in 100."""
    keys = [F.col(k) for k in ("image_id", "gt_id", "direction")]
    return rays(spark, sf).filter(hash_selected(SEED, keys, 100, 20)).select("image_id", "gt_id", "direction")


@query("hash_subset", with_tables(f"SELECT image_id, stratum, SHA256('{SEED}|' || image_id) AS digest FROM fx_roster ORDER BY digest, image_id LIMIT 100"))
def hash_subset(spark, sf):
    """The 100 images with the lowest seeded SHA-256."""
    return rs.hash_subset(roster(spark, sf), "image_id", 100, SEED).select("image_id", "stratum", "digest")


@query(
    "roster_contract",
    with_tables("SELECT stratum, COUNT(*) AS n_images, COUNT(DISTINCT image_id) = COUNT(*) AS unique_ids FROM fx_roster GROUP BY stratum"),
)
def roster_contract(spark, sf):
    """Eligible-population contract: count and uniqueness per stratum."""
    per_id = roster(spark, sf).groupBy("stratum", "image_id").agg(F.count("*").alias("n"))
    return per_id.groupBy("stratum").agg(F.sum("n").alias("n_images"), (F.max("n") == 1).alias("unique_ids"))


REPS = 1000
_STATS = f"""SELECT image_id, size_bin, m.metric, SUM({W} * m.v) AS num, SUM({W}) AS den FROM objs CROSS JOIN LATERAL (
 SELECT UNNEST([{{'metric': 'o2o', 'v': o2o_fragile}}, {{'metric': 'o2m', 'v': o2m_fragile}}]) AS m) x GROUP BY ALL"""


def object_stats(spark, sf) -> DataFrame:
    yes = F.lit(True)
    return es.cluster_stats(objects(spark, sf), ["image_id", "size_bin"], {"o2o": (F.col("o2o_fragile"), yes), "o2m": (F.col("o2m_fragile"), yes)})


def interval_sql(src: str, keys: str, level_low: str = "0.025", level_high: str = "0.975") -> str:
    return f"""SELECT {keys}, {rnd('MAX(CASE WHEN rep = 0 THEN value END)', 9, 'estimate')}, {rnd(f'QUANTILE_CONT(CASE WHEN rep > 0 THEN value::DOUBLE END, {level_low})', 9, 'ci_low')},
 {rnd(f'QUANTILE_CONT(CASE WHEN rep > 0 THEN value::DOUBLE END, {level_high})', 9, 'ci_high')}, COUNT(CASE WHEN rep > 0 THEN value END) AS n_valid FROM {src} GROUP BY {keys}"""


@query(
    "bootstrap_ratio",
    with_tables(
        interval_sql("vals", "metric, size_bin"),
        **BASE, **mult_sql(REPS), stats=_STATS,
        vals="SELECT rep, metric, size_bin, SUM(copies * num) / SUM(copies * den) AS value FROM mult JOIN stats USING (image_id) GROUP BY ALL",
    ),
)
def bootstrap_ratio(spark, sf):
    """Stratified cluster bootstrap of the fragility rates; replicate 0 is the identity draw."""
    values = resampled_ratios(object_stats(spark, sf), drawn(spark, sf, REPS), ["metric", "size_bin"])
    return _round_all(rs.interval(values, ["metric", "size_bin"]))


BUDGETS, REPEATS = (100, 300), 20


_GAP = "SUM(CASE WHEN size_bin = 't_8_16' THEN {w} * o2o_fragile END) / SUM(CASE WHEN size_bin = 't_8_16' THEN {w} END) - SUM(CASE WHEN size_bin = 's_16_32' THEN {w} * o2o_fragile END) / SUM(CASE WHEN size_bin = 's_16_32' THEN {w} END)"
_FOUR = [(arm, size, bin_) for arm in ("o2o", "o2m") for size, bin_ in (("t", "t_8_16"), ("s", "s_16_32"))]
_RATES = ", ".join(f"SUM(CASE WHEN size_bin = '{b}' THEN {{w}} * {a}_fragile END) / SUM(CASE WHEN size_bin = '{b}' THEN {{w}} END) AS {a}_{k}" for a, k, b in _FOUR)


def _rank_sql(of: str) -> list[str]:
    """Mid-ranks of the four rates of a row; rates that differ by rounding only are ties."""
    names = [f"ROUND({of}.{a}_{k}, 12)" for a, k, _ in _FOUR]
    return ["(1 + " + " + ".join(f"CASE WHEN {o} < {n} THEN 1e0 WHEN {o} = {n} THEN 0.5e0 ELSE 0e0 END" for o in names) + " - 0.5e0)" for n in names]


def _rho_sql() -> str:
    a, b = _rank_sql("q"), _rank_sql("full_")
    cov, va, vb = (" + ".join(f"({x} - 2.5e0) * ({y} - 2.5e0)" for x, y in zip(*p)) for p in ((a, b), (a, a), (b, b)))
    return f"({cov}) / NULLIF(SQRT(({va}) * ({vb})), 0)"


@query(
    "budget_efficiency",
    with_tables(
        f"""SELECT budget, COUNT(gap) AS n_valid, {rnd('QUANTILE_CONT(ABS(gap - f), 0.5)', 9, 'median_error')}, {rnd('QUANTILE_CONT(ABS(gap - f), 0.95)', 9, 'p95_error')},
 {rnd('AVG(CASE WHEN SIGN(gap) = SIGN(f) THEN 1e0 ELSE 0e0 END)', 9, 'sign_consistency')}, {rnd('AVG(CASE WHEN o2o_t - o2o_s > o2m_t - o2m_s THEN 1e0 ELSE 0e0 END)', 9, 'order_consistency')}, {rnd('QUANTILE_CONT(rho, 0.5)', 9, 'median_rank_correlation')} FROM (
 SELECT q.*, full_.f, {_rho_sql()} AS rho FROM (
 SELECT budget, repeat, {_GAP.format(w='wt')} AS gap, {_RATES.format(w='wt')} FROM (SELECT p.budget, p.repeat, o.size_bin, o.o2o_fragile, o.o2m_fragile, o.sampling_weight * p.factor AS wt FROM picks p JOIN objs o USING (image_id)) z GROUP BY ALL) q
 CROSS JOIN (SELECT {_GAP.format(w='sampling_weight')} AS f, {_RATES.format(w='sampling_weight')} FROM objs) full_ WHERE gap IS NOT NULL) y GROUP BY budget""",
        **BASE,
        alloc=ALLOC.replace("POP", "(SELECT stratum, COUNT(*) AS n_total, budget FROM fx_roster CROSS JOIN (SELECT UNNEST([100, 300]) AS budget) b GROUP BY ALL) p"),
        picks=f"""SELECT budget, repeat, image_id, n_total::DOUBLE / n_sample AS factor FROM (SELECT a.*, r.image_id, x.repeat,
 ROW_NUMBER() OVER (PARTITION BY a.budget, x.repeat, a.stratum ORDER BY {draw_sql(f'{SEED}, a.budget, x.repeat, r.image_id', 15)}, r.image_id) AS pos
 FROM fx_roster r JOIN alloc a USING (stratum) CROSS JOIN (SELECT UNNEST(RANGE(1, {REPEATS + 1})) AS repeat) x) q WHERE pos <= n_sample""",
    ),
)
def budget_efficiency(spark, sf):
    """Error and sign of the size gap under image budgets, order of the branches and rank correlation of the four rates, against the full sample."""
    obj = objects(spark, sf)
    picks = rs.budget_draws(roster(spark, sf), "stratum", "image_id", BUDGETS, REPEATS, SEED)
    sub = picks.join(obj, "image_id").withColumn("_wt", F.col(W) * F.col("factor"))
    rates = lambda w: [es.weighted_mean(F.col(f"{a}_fragile"), F.col(w), F.col("size_bin") == b).alias(f"{a}_{k}") for a, k, b in _FOUR]
    names = [f"{a}_{k}" for a, k, _ in _FOUR]
    whole = obj.agg(*rates(W)).select(F.struct(*names)).scalar()
    part = sub.groupBy("budget", "repeat").agg(*rates("_wt")).withColumn("_full", whole)
    return _round_all(rs.budget_summary(part, ["budget"], names, "_full"))


HYPOTHESES = {"H1": "greater", "H2": "greater", "H3": "less", "H4": "greater", "H5": "less"}


def hypothesis_values(rates: DataFrame) -> DataFrame:
    """H1-H3 from the fragility gaps, H4-H5 from pathway fractions. ``rates``: (rep, metric, value)."""
    names = ("o2o_t", "o2o_s", "o2m_t", "o2m_s", "elig_t", "elig_s", "conf_t", "conf_s")
    wide = rates.groupBy("rep").agg(*[F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in names])
    c = F.col
    gap_o, gap_m = c("o2o_t") - c("o2o_s"), c("o2m_t") - c("o2m_s")
    exprs = {"H1": gap_o, "H2": gap_m, "H3": gap_o - gap_m, "H4": c("elig_t") - c("elig_s"), "H5": c("conf_t") - c("conf_s")}
    rows = F.array(*[F.struct(F.lit(k).alias("id"), v.alias("value")) for k, v in exprs.items()])
    return wide.select("rep", F.explode(rows).alias("_h")).select("rep", "_h.*")


def plan(spark) -> DataFrame:
    return spark.createDataFrame(list(HYPOTHESES.items()), "id string, direction string")


def branch_stats(obj: DataFrame) -> DataFrame:
    sizes = (("t", es.TINY), ("s", es.SMALL))
    return es.cluster_stats(obj, ["image_id"], {f"{a}_{k}": (F.col(f"{a}_fragile"), F.col("size_bin") == s) for a in ("o2o", "o2m") for k, s in sizes})


def pathway_stats(r: DataFrame) -> DataFrame:
    """Cause fractions among flips, per image."""
    f = flips(r).withColumn("_c", cause_of(F.col("o2o_first_divergence")))
    hit = lambda c: (F.col("_c") == c).cast("int")
    sizes = (("t", es.TINY), ("s", es.SMALL))
    return es.cluster_stats(
        f, ["image_id"], {f"{n}_{k}": (hit(c), (F.col("o2o_flip") == 1) & (F.col("size_bin") == s)) for n, c in (("elig", "eligibility"), ("conf", "conflict")) for k, s in sizes}
    )


def _metric_sql(src_obj="objs", src_dir="dirs", name="") -> dict[str, str]:
    o = "\nUNION ALL ".join(
        f"SELECT image_id, '{a}_{k}' AS metric, SUM({W} * {a}_fragile) AS num, SUM({W}) AS den FROM {src_obj} WHERE size_bin = '{s}' GROUP BY image_id"
        for a in ("o2o", "o2m") for k, s in (("t", "t_8_16"), ("s", "s_16_32"))
    )
    p = "\nUNION ALL ".join(
        f"SELECT image_id, '{n}_{k}' AS metric, SUM(CASE WHEN o2o_first_divergence = '{c}' THEN {W} ELSE 0 END) AS num, SUM({W}) AS den FROM {src_dir} WHERE o2o_flip = 1 AND size_bin = '{s}' GROUP BY image_id"
        for n, c in (("elig", "eligibility_boundary"), ("conf", "conflict_reassignment")) for k, s in (("t", "t_8_16"), ("s", "s_16_32"))
    )
    return {f"branch{name}": o, f"path{name}": p}


_HYP = """SELECT rep, id, CASE id WHEN 'H1' THEN o2o_t - o2o_s WHEN 'H2' THEN o2m_t - o2m_s WHEN 'H3' THEN (o2o_t - o2o_s) - (o2m_t - o2m_s) WHEN 'H4' THEN elig_t - elig_s ELSE conf_t - conf_s END AS value,
 CASE WHEN id IN ('H3', 'H5') THEN 'less' ELSE 'greater' END AS direction FROM (SELECT rep, """ + ", ".join(
    f"MAX(CASE WHEN metric = '{m}' THEN value END) AS {m}" for m in ("o2o_t", "o2o_s", "o2m_t", "o2m_s", "elig_t", "elig_s", "conf_t", "conf_s")
) + " FROM vals GROUP BY rep) w CROSS JOIN (SELECT UNNEST(['H1', 'H2', 'H3', 'H4', 'H5']) AS id) h"
_TESTS = """SELECT id, direction, MAX(CASE WHEN rep = 0 THEN value END) AS estimate, COUNT(CASE WHEN rep > 0 THEN value END) AS n_valid,
 (COUNT(*) FILTER (WHERE rep > 0 AND (CASE WHEN direction = 'greater' THEN value <= 0 ELSE value >= 0 END)) + 1)::DOUBLE / (COUNT(CASE WHEN rep > 0 THEN value END) + 1) AS p,
 CASE WHEN direction = 'greater' THEN QUANTILE_CONT(CASE WHEN rep > 0 THEN value::DOUBLE END, 0.05) ELSE QUANTILE_CONT(CASE WHEN rep > 0 THEN value::DOUBLE END, 0.95) END AS bound FROM hyp GROUP BY id, direction"""
_VERDICT = f"""SELECT id, direction, {rnd('estimate', 9, 'estimate')}, n_valid, {rnd('p', 9, 'p')}, {rnd('bound', 9, 'bound')}, procedure, {rnd('ap', 9, 'adjusted_p')}, status FROM (
 SELECT *, 'gatekeeping' AS procedure, p AS ap, CASE WHEN COALESCE(MIN((p <= 0.05)::INT) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) = 0 THEN 'descriptive' WHEN p <= 0.05 THEN 'pass' ELSE 'fail' END AS status
 FROM tests WHERE id IN ('H1', 'H2', 'H3') UNION ALL
 SELECT * EXCLUDE (i), 'holm', MAX(LEAST(1e0, (3 - i) * p)) OVER (ORDER BY i), CASE WHEN MIN((p <= 0.05e0 / (3 - i))::INT) OVER (ORDER BY i) = 1 THEN 'pass' ELSE 'fail' END
 FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY p, id) AS i FROM tests WHERE id IN ('H4', 'H5')) h) v"""


@query(
    "holm_gate",
    with_tables(
        _VERDICT, **BASE, **mult_sql(REPS), **_metric_sql(),
        vals="SELECT rep, metric, SUM(copies * num) / SUM(copies * den) AS value FROM mult JOIN (SELECT * FROM branch UNION ALL SELECT * FROM path) s USING (image_id) GROUP BY ALL",
        hyp=_HYP, tests=_TESTS,
    ),
)
def holm_gate(spark, sf):
    """Bootstrap p-values of five hypotheses: fixed-sequence gate for three, Holm for two."""
    stats = branch_stats(objects(spark, sf)).unionByName(pathway_stats(rays(spark, sf)))
    rates = resampled_ratios(stats, drawn(spark, sf, REPS), ["metric"])
    tests = inf.one_sided(hypothesis_values(rates), plan(spark))
    return _round_all(inf.evaluate(tests, ("H1", "H2", "H3"), ("H4", "H5")))


@query(
    "precision_plan",
    with_tables(
        f"""SELECT id, {rnd('MAX(pt)', 9, 'point')}, {rnd('AVG(value)', 9, 'boot_mean')}, {rnd('STDDEV_SAMP(value)', 9, 'boot_sd')}, {rnd('1.959963984540054e0 * STDDEV_SAMP(value)', 9, 'normal_half_width')},
 {rnd('(QUANTILE_CONT(value::DOUBLE, 0.975) - QUANTILE_CONT(value::DOUBLE, 0.025)) / 2', 9, 'percentile_half_width')}, {rnd('AVG(CASE WHEN SIGN(value) = SIGN(pt) THEN 1e0 ELSE 0e0 END)', 9, 'direction_recovery')}
 FROM (SELECT h.*, p.value AS pt FROM hyp h JOIN (SELECT id, value FROM hyp WHERE rep = 0) p USING (id) WHERE h.rep > 0) q GROUP BY id""",
        **BASE, **mult_sql(REPS, SEED + 1), **_metric_sql(),
        vals="SELECT rep, metric, SUM(copies * num) / SUM(copies * den) AS value FROM mult JOIN (SELECT * FROM branch UNION ALL SELECT * FROM path) s USING (image_id) GROUP BY ALL",
        hyp=_HYP,
    ),
)
def precision_plan(spark, sf):
    """Bootstrap spread, half widths and direction recovery of the five contrasts."""
    stats = branch_stats(objects(spark, sf)).unionByName(pathway_stats(rays(spark, sf)))
    rates = resampled_ratios(stats, drawn(spark, sf, REPS, SEED + 1), ["metric"])
    return _round_all(rs.precision(hypothesis_values(rates), ["id"]))


@query(
    "confirmatory",
    with_tables(
        _VERDICT, **BASE, **mult_sql(REPS, SEED, "_b"), **mult_sql(REPS, SEED + 7, "_p"),
        dirs2="SELECT *, CASE WHEN o2o_event_observed = 1 AND o2o_radius <= 0.125 THEN 1 ELSE 0 END AS o2o_flip, CASE WHEN o2m_event_observed = 1 AND o2m_radius <= 0.125 THEN 1 ELSE 0 END AS o2m_flip FROM fx_rays2",
        objs2=BASE["objs"].replace("FROM dirs", "FROM dirs2"),
        both_="SELECT b.* FROM objs a JOIN objs2 b ON a.image_id = b.image_id AND a.gt_id = b.gt_id AND a.size_bin = b.size_bin",
        **{k: v for k, v in _metric_sql("both_", "dirs2", "2").items()},
        vals="""SELECT rep, metric, SUM(copies * num) / SUM(copies * den) AS value FROM mult_b JOIN branch2 USING (image_id) GROUP BY ALL
 UNION ALL SELECT rep, metric, SUM(copies * num) / SUM(copies * den) AS value FROM mult_p JOIN path2 USING (image_id) GROUP BY ALL""",
        hyp=_HYP, tests=_TESTS,
    ),
)
def confirmatory(spark, sf):
    """Five-hypothesis evaluation: one-to-one join of two contracts, independent branch and pathway draws, verdict."""
    first, second = objects(spark, sf), es.object_fragility(flips(second_rays(spark, sf)), OBJECT, ["o2o", "o2m"], CARRY)
    joined = rc.paired_join(first, second, OBJECT, same=["size_bin", "stratum", W], suffixes=("_fixed", "_norm"))
    norm = joined.select(*OBJECT, *[F.col(f"{c}_norm").alias(c) for c in ("o2o_fragile", "o2m_fragile")], "size_bin", W)
    branch = resampled_ratios(branch_stats(norm), drawn(spark, sf, REPS), ["metric"])
    path = resampled_ratios(pathway_stats(second_rays(spark, sf)), drawn(spark, sf, REPS, SEED + 7), ["metric"])
    tests = inf.one_sided(hypothesis_values(branch.unionByName(path)), plan(spark))
    return _round_all(inf.evaluate(tests, ("H1", "H2", "H3"), ("H4", "H5")))


_U = f"({draw_sql(f'{SEED}, image_id')} / 4294967296e0)"


@query(
    "split_assign",
    with_tables(
        f"""SELECT split, COUNT(*) AS n_objects, COUNT(DISTINCT image_id) AS n_images FROM (SELECT image_id, CASE WHEN {_U} < 0.8e0 THEN 'train' WHEN {_U} < 0.9e0 THEN 'val' ELSE 'test' END AS split FROM fx_gt) q GROUP BY split"""
    ),
)
def split_assign(spark, sf):
    """Hash split of the images 80/10/10, counted."""
    per_image = gt(spark, sf).groupBy("image_id").agg(F.count("*").alias("n"))
    out = rs.split_assign(per_image, F.col("image_id"), (0.8, 0.1, 0.1), SEED)
    return out.groupBy("split").agg(F.sum("n").alias("n_objects"), F.count("*").alias("n_images"))
