"""Reconciliation of two result sets, curve validation, merges, ledgers and label checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bins import cause_of, event_state, rounded
from ..operators import checks as ck
from ..operators import dataset as ds
from ..operators import estimators as es
from ..operators import reconcile as rc
from ..operators import survival as sv
from ..operators import trajectory as tr
from .estimate_queries import W, _round_all, flips, wm
from .fixtures import KEYS, curve, gt, rays, roster, second_rays, table
from .oracle import rnd, with_tables
from .registry import query
from .survival_queries import _CAUSE
from .trajectory_queries import FIRST

_K = "image_id, gt_id, direction"


@query(
    "key_audit",
    with_tables(
        f"""SELECT COUNT(*) FILTER (WHERE l IS NOT NULL AND r IS NOT NULL) AS n_shared, COUNT(*) FILTER (WHERE r IS NULL) AS n_left_only, COUNT(*) FILTER (WHERE l IS NULL) AS n_right_only,
 COUNT(*) FILTER (WHERE l > 1) AS n_left_duplicated, COUNT(*) FILTER (WHERE r > 1) AS n_right_duplicated
 FROM (SELECT {_K}, COUNT(*) AS l FROM fx_rays WHERE ok % 103 <> 4 GROUP BY ALL) a FULL OUTER JOIN (SELECT {_K}, COUNT(*) AS r FROM (SELECT {_K} FROM fx_rays2 UNION ALL SELECT {_K} FROM fx_rays2 WHERE ok % 101 = 9) u GROUP BY ALL) b USING ({_K})"""
    ),
)
def key_audit(spark, sf):
    """Shared, one-sided and duplicated keys of two event tables."""
    second = second_rays(spark, sf)
    return rc.key_audit(rays(spark, sf).filter("ok % 103 <> 4"), second.unionByName(second.filter("ok % 101 = 9")), KEYS)


def grid_events(c: DataFrame) -> DataFrame:
    ev = tr.first_change(c, KEYS, "radius", "o2o_active", carry=["ok"])
    seen = F.col("event_observed") == 1
    return ev.select(
        *KEYS, "ok", F.lit("o2o").alias("estimand"), F.when(seen, "observed").otherwise("right_censored").alias("state"),
        F.when(seen, "identity_change").otherwise("rmax").alias("type"), F.coalesce("event_radius", "censor_radius").alias("distance"),
    )


_GRID = f"SELECT {_K}, ok, ev IS NOT NULL AS seen, CASE WHEN ev IS NOT NULL THEN 'identity_change' ELSE 'rmax' END AS ty, COALESCE(ev, lim) AS d FROM "
_CATS = {
    "state_mismatch": ("a.seen <> b.seen", True), "type_mismatch": ("a.seen = b.seen AND a.ty <> b.ty", True),
    "same_sample": ("a.seen AND b.seen AND ABS(a.d - b.d) <= tol", False), "fine_half_step_localization": ("a.seen AND b.seen AND a.d - b.d > tol AND a.d - b.d <= step + tol", False),
    "coarse_missed_earlier_transition": ("a.seen AND b.seen AND a.d - b.d > step + tol", True), "fine_event_later_nesting_violation": ("a.seen AND b.seen AND a.d - b.d < -tol", True),
    "censor_distance_changed": ("NOT a.seen AND NOT b.seen AND ABS(a.d - b.d) > tol", True), "same_censor_distance": ("NOT a.seen AND NOT b.seen AND ABS(a.d - b.d) <= tol", False),
    "one_missing_distance": ("a.seen = b.seen AND (a.d IS NULL) <> (b.d IS NULL)", True),
}


@query(
    "grid_convergence",
    with_tables(
        "\nUNION ALL ".join(
            f"""SELECT 'o2o' AS estimand, COUNT(*) AS denominator, '{n}' AS category, {str(m).upper()} AS material, COUNT(*) FILTER (WHERE {c.replace('tol', '7.8125e-10').replace('step', '0.0078125e0')}) AS count,
 CASE WHEN {str(m).upper()} AND COUNT(*) FILTER (WHERE {c.replace('tol', '7.8125e-10').replace('step', '0.0078125e0')}) > 0 THEN 'FAIL' ELSE 'PASS' END AS decision FROM coarse_ a JOIN fine_ b USING ({_K})"""
            for n, (c, m) in _CATS.items()
        ),
        first_=FIRST, first16=FIRST.replace("FROM fx_curve", "FROM fx_curve WHERE radius_idx % 16 = 0"),
        coarse_=_GRID + "first16", fine_=_GRID + "first_",
    ),
)
def grid_convergence(spark, sf):
    """Convergence gate between a 16/1024 and an 8/1024 grid."""
    c = curve(spark, sf)
    coarse, fine = grid_events(c.filter("radius_idx % 16 = 0")), grid_events(c)
    return rc.convergence_gate(rc.grid_differences(coarse, fine, KEYS, 8 / 1024))


@query(
    "curve_validate",
    with_tables(
        f"""SELECT COUNT(ne) AS n_event_keys, SUM(np)::BIGINT AS n_curve_rows, COUNT(*) FILTER (WHERE np IS NULL) AS event_only, COUNT(*) FILTER (WHERE ne IS NULL) AS curve_only, COUNT(*) FILTER (WHERE ne > 1) AS duplicate_event_key,
 COUNT(*) FILTER (WHERE fr <> 0) AS not_starting_at_zero, COUNT(*) FILTER (WHERE nd < np) AS radius_repeated FROM (SELECT {_K}, COUNT(*) AS ne FROM fx_rays WHERE ok % 79 <> 2 GROUP BY ALL) e
 FULL OUTER JOIN (SELECT {_K}, COUNT(*) AS np, MIN(radius) AS fr, COUNT(DISTINCT radius_idx) AS nd FROM faulty GROUP BY ALL) c USING ({_K})""",
        faulty="SELECT * FROM fx_curve WHERE NOT (ok % 89 = 5 AND radius_idx = 0) AND ok % 83 <> 6 UNION ALL SELECT * FROM fx_curve WHERE ok % 97 = 3 AND radius_idx = 16 AND ok % 83 <> 6",
    ),
)
def curve_validate(spark, sf):
    """Faults of a curve table against its event table (faults injected)."""
    c = curve(spark, sf)
    sound = c.filter("NOT (ok % 89 = 5 AND radius_idx = 0) AND ok % 83 <> 6")
    faulty = sound.unionByName(c.filter("ok % 97 = 3 AND radius_idx = 16 AND ok % 83 <> 6"))
    return ck.curve_report(faulty, rays(spark, sf).filter("ok % 79 <> 2"), KEYS, "radius")


@query(
    "shard_merge_audit",
    with_tables(
        f"""SELECT COUNT(*) FILTER (WHERE nw IS NOT NULL AND li IS NOT NULL) AS n_covered, COUNT(*) FILTER (WHERE nw > 1) AS n_in_several_workers, COUNT(*) FILTER (WHERE li IS NULL) AS n_unknown, COUNT(*) FILTER (WHERE nw IS NULL) AS n_missing,
 COALESCE(SUM(nr), 0)::BIGINT AS n_rows, COALESCE(SUM(nr - nk), 0)::BIGINT AS n_duplicate_rows FROM (SELECT image_id, COUNT(DISTINCT worker) AS nw, SUM(r) AS nr, SUM(k) AS nk FROM (
 SELECT worker, image_id, COUNT(*) AS r, COUNT(DISTINCT (gt_id, direction)) AS k FROM merged GROUP BY ALL) a GROUP BY image_id) b FULL OUTER JOIN (SELECT image_id, 1 AS li FROM fx_roster WHERE dataset_index % 10 <> 4) c USING (image_id)""",
        merged=f"SELECT image_id, gt_id, direction, CASE WHEN ok % 101 = 7 THEN 9 ELSE CAST(image_id AS BIGINT) % 3 END AS worker FROM fx_rays WHERE CAST(image_id AS BIGINT) % 37 <> 1 UNION ALL SELECT image_id, gt_id, direction, CAST(image_id AS BIGINT) % 3 FROM fx_rays WHERE ok % 61 = 8 AND ok % 101 <> 7 AND CAST(image_id AS BIGINT) % 37 <> 1",
    ),
)
def shard_merge_audit(spark, sf):
    """Audit of worker shards against the roster (double assignment and duplicates injected)."""
    img = F.col("image_id").cast("long")
    r = rays(spark, sf).filter(img % 37 != 1)
    first = r.withColumn("worker", F.when(F.col("ok") % 101 == 7, 9).otherwise(img % 3))
    again = r.filter("ok % 61 = 8 AND ok % 101 <> 7").withColumn("worker", img % 3)
    per_key = first.unionByName(again).groupBy("worker", "image_id", "gt_id", "direction").agg(F.count("*").alias("_n"))
    shards = per_key.groupBy("worker", "image_id").agg(F.sum("_n").alias("n_rows"), F.count("*").alias("n_keys"))
    return rc.merge_audit(shards, roster(spark, sf).filter("dataset_index % 10 <> 4"), "worker", "image_id")


_VALS = ("o2o_radius", "o2o_event_observed", "o2o_first_divergence")


@query(
    "table_diff",
    with_tables(
        "SELECT side, \"column\", COUNT(*) AS n_rows FROM (SELECT "
        + f"CASE WHEN b.gt_id IS NULL THEN 'left_only' WHEN a.gt_id IS NULL THEN 'right_only' ELSE 'both' END AS side, UNNEST(CASE WHEN a.gt_id IS NULL OR b.gt_id IS NULL THEN ['*'] ELSE LIST_FILTER(["
        + ", ".join(f"CASE WHEN a.{v} IS DISTINCT FROM b.{v} THEN '{v}' END" for v in _VALS)
        + "], lambda z: z IS NOT NULL) END) AS \"column\" FROM fx_rays a FULL OUTER JOIN fx_rays2 b ON a.image_id = b.image_id AND a.gt_id = b.gt_id AND a.direction = b.direction) q GROUP BY ALL"
    ),
)
def table_diff(spark, sf):
    """Value differences of two event tables by column."""
    diff = rc.table_diff(rays(spark, sf), second_rays(spark, sf), KEYS, _VALS)
    return diff.groupBy("side", "column").agg(F.count("*").alias("n_rows"))


def _rmean_sql(src: str, name: str) -> dict[str, str]:
    return {
        f"rm_t{name}": f"SELECT size_bin, COALESCE(o2o_radius, o2o_censor_radius) AS time, SUM({W}) AS leaving, SUM({W} * o2o_event_observed) AS d FROM {src} WHERE o2o_base_active IS NOT NULL GROUP BY ALL",
        f"rm_k{name}": f"""SELECT *, CASE WHEN MAX(h) OVER w >= 1 - 1e-12 THEN 0e0 ELSE EXP(SUM(LN(1 - LEAST(h, 0.9999999999999e0))) OVER w) END AS s FROM (
 SELECT *, CASE WHEN d > 0 THEN d / GREATEST(SUM(leaving) OVER (PARTITION BY size_bin ORDER BY time ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), d) ELSE 0e0 END AS h FROM rm_t{name}) q WINDOW w AS (PARTITION BY size_bin ORDER BY time ROWS UNBOUNDED PRECEDING)""",
        f"rm_m{name}": f"""SELECT size_bin, tau, tau - SUM(CASE WHEN time <= tau + 1e-12 THEN (s0 - s) * (tau - time) ELSE 0 END) AS m FROM (SELECT *, COALESCE(LAG(s) OVER (PARTITION BY size_bin ORDER BY time), 1e0) AS s0 FROM rm_k{name}) q CROSS JOIN (SELECT UNNEST([0.0625e0, 0.125e0, 0.25e0]) AS tau) t GROUP BY size_bin, tau""",
        f"rm_s{name}": f"""SELECT scope, 'size_structure' AS name, CASE WHEN x > 0 THEN 'positive' WHEN x < 0 THEN 'negative' ELSE 'zero' END AS signature FROM (SELECT CAST(tau AS VARCHAR) AS scope, MAX(CASE WHEN size_bin = 't_8_16' THEN m END) - MAX(CASE WHEN size_bin = 's_16_32' THEN m END) AS x FROM rm_m{name} GROUP BY tau) q
 UNION ALL SELECT size_bin, 'dominant_cause', ARG_MAX(cause, (w, cause)) FROM (SELECT size_bin, {_CAUSE.replace('label', 'o2o_first_divergence')} AS cause, SUM({W}) AS w FROM {src} WHERE o2o_event_observed = 1 AND o2o_base_active IS NOT NULL GROUP BY ALL) c GROUP BY size_bin
 UNION ALL SELECT 'all', 'margin_sign', CASE WHEN CORR(margin, o2o_radius) > 0 THEN 'positive' ELSE 'negative' END FROM {src} WHERE o2o_event_observed = 1""",
    }


@query(
    "freeze_signature",
    with_tables(
        "SELECT scope, name, a.signature AS first, b.signature AS second, CASE WHEN a.signature IS NOT DISTINCT FROM b.signature THEN 'KEEP' ELSE 'CHANGED' END AS verdict FROM rm_s1 a FULL OUTER JOIN rm_s2 b USING (scope, name)",
        **_rmean_sql("fx_rays", "1"), **_rmean_sql("fx_rays2", "2"),
    ),
)
def freeze_signature(spark, sf):
    """KEEP or CHANGED per sign, order and dominant-cause signature of two result sets."""

    def signatures(r):
        by = ["size_bin"]
        risk = sv.durations(r, "o2o_base_active", F.col("o2o_event_observed") == 1, "o2o_radius", "o2o_censor_radius")
        means = sv.restricted_mean(sv.life_table(sv.time_counts(risk, by, ["identity_change"]), by, ["identity_change"]), by, [0.0625, 0.125, 0.25])
        side = lambda s: F.max(F.when(F.col("size_bin") == s, F.col("restricted_mean")))
        size = means.groupBy(F.col("tau").cast("string").alias("scope")).agg(rc.sign_label(side(es.TINY) - side(es.SMALL)).alias("signature"))
        events = r.filter("o2o_event_observed = 1 AND o2o_base_active IS NOT NULL").withColumn("cause", cause_of(F.col("o2o_first_divergence")))
        causes = events.groupBy("size_bin", "cause").agg(F.sum(W).alias("w"))
        top = causes.groupBy(F.col("size_bin").alias("scope")).agg(F.max_by("cause", F.struct("w", "cause")).alias("signature"))
        corr = r.filter("o2o_event_observed = 1").agg(rc.sign_label(F.corr("margin", "o2o_radius")).alias("signature")).withColumn("scope", F.lit("all"))
        parts = [size.withColumn("name", F.lit("size_structure")), top.withColumn("name", F.lit("dominant_cause")), corr.withColumn("name", F.lit("margin_sign"))]
        return parts[0].unionByName(parts[1]).unionByName(parts[2])

    return rc.verdicts(signatures(rays(spark, sf)), signatures(second_rays(spark, sf)), ["scope"])


@query(
    "published_parity",
    with_tables(
        f"""SELECT COUNT(*) AS n_rows, COUNT(*) FILTER (WHERE s.n IS DISTINCT FROM 1) AS n_not_unique, {rnd('MAX(CASE WHEN s.n = 1 THEN ABS(100 * p.rate - 100 * s.rate) END)', 6, 'max_abs_diff')}, COUNT(*) FILTER (WHERE s.n = 1 AND ABS(100 * p.rate - 100 * s.rate) <= 1e-9) AS n_match FROM (
 SELECT stratum, size_bin, {wm('o2o_flip')} AS rate FROM (SELECT *, CASE WHEN o2o_event_observed = 1 AND o2o_radius <= 0.125 THEN 1 ELSE 0 END AS o2o_flip FROM fx_rays) a GROUP BY ALL) p
 LEFT JOIN (SELECT stratum, size_bin, 1 AS n, {wm('o2o_flip')} AS rate FROM (SELECT *, CASE WHEN o2o_event_observed = 1 AND o2o_radius <= 0.125 THEN 1 ELSE 0 END AS o2o_flip FROM fx_rays2 WHERE stratum <> 'BUILDING') b GROUP BY ALL) s USING (stratum, size_bin)"""
    ),
)
def published_parity(spark, sf):
    """Published percentages against their source rates."""
    rate = lambda r: flips(r).groupBy("stratum", "size_bin").agg(es.weighted_mean(F.col("o2o_flip"), F.col(W)).alias("rate"))
    published = rate(rays(spark, sf)).withColumn("rate", F.col("rate") * 100)
    out = rc.parity(published, rate(second_rays(spark, sf).filter("stratum <> 'BUILDING'")), ["stratum", "size_bin"], ["rate"], 100.0, 1e-9)
    return out.withColumn("max_abs_diff", rounded(F.col("max_abs_diff"), 6))


_REQ = ("id", "claim", "date", "hash")


@query(
    "ledger_check",
    """WITH e AS (SELECT doc_id, 'E' || CAST(doc_id % 900 AS VARCHAR) AS evidence_id, CASE WHEN doc_id % 50 = 0 THEN 'X' ELSE 'E' || CAST(doc_id % 900 AS VARCHAR) END AS claim_id,
 CASE WHEN doc_id % 40 = 1 THEN UPPER(SHA256(text)) ELSE SHA256(text) END AS h, doc_id % 60 = 3 AS other_name, doc_id % 70 = 5 AS smoke, doc_id % 30 = 2 AS short, text, lang FROM documents),
 r AS (SELECT UNNEST(LIST_FILTER([CASE WHEN short THEN 'missing_key' END, CASE WHEN COUNT(*) OVER (PARTITION BY evidence_id) > 1 THEN 'duplicate_id' END, CASE WHEN evidence_id <> claim_id THEN 'id_differs_from_claim' END,
  CASE WHEN NOT REGEXP_FULL_MATCH(h, '[0-9a-f]{64}') THEN 'bad_hash' END, CASE WHEN other_name THEN 'hash_and_path_names_differ' END, CASE WHEN smoke THEN 'smoke_entry' END], lambda z: z IS NOT NULL)) AS rule FROM e
  UNION ALL SELECT CASE WHEN doc_id % 45 = 7 THEN 'artifact_missing' ELSE 'artifact_hash_differs' END FROM e WHERE doc_id % 45 = 7 OR other_name OR h <> CASE WHEN doc_id % 35 = 9 THEN SHA256(lang) ELSE SHA256(text) END)
 SELECT rule, COUNT(*) AS n FROM r GROUP BY rule""",
)
def ledger_check(spark, sf):
    """Rule breaks of a ledger derived from the documents (breaks injected), counted by rule."""
    d = table(spark, sf, "documents").select("doc_id", "text", "lang")
    i = F.col("doc_id")
    eid = F.concat(F.lit("E"), (i % 900).cast("string"))
    digest = F.sha2("text", 256)
    path = F.concat(F.lit("p"), i.cast("string"))
    keys = F.when(i % 30 == 2, F.array(F.lit("id"), F.lit("claim"), F.lit("hash"))).otherwise(F.array(*[F.lit(k) for k in _REQ]))
    entries = d.select(
        eid.alias("evidence_id"), F.when(i % 50 == 0, "X").otherwise(eid).alias("claim_id"), F.when(i % 70 == 5, "smoke").otherwise("final").alias("status"),
        F.create_map(F.lit("text"), F.when(i % 40 == 1, F.upper(digest)).otherwise(digest)).alias("hashes"),
        F.create_map(F.when(i % 60 == 3, "txt").otherwise("text"), path).alias("paths"), keys.alias("keys"),
    )
    artifacts = d.filter(i % 45 != 7).select(path.alias("path"), F.when(i % 35 == 9, F.sha2("lang", 256)).otherwise(digest).alias("sha256"))
    return rc.ledger_violations(entries, _REQ, artifacts).groupBy("rule").agg(F.count("*").alias("n"))


_LAB = """SELECT image_id, gt_id % 3 AS cls, cx / 800e0 + CASE WHEN gt_id % 29 = 0 THEN 1e0 ELSE 0e0 END AS cx, cy / 800e0 AS cy, w / 800e0 AS w, h / 800e0 - CASE WHEN gt_id % 37 = 1 THEN 1e0 ELSE 0e0 END AS h, gt_id FROM fx_gt WHERE gt_id % 11 <> 3"""


@query(
    "label_qa",
    with_tables(
        """SELECT status, fault, COUNT(*) AS n_images, SUM(n_rows)::BIGINT AS n_rows, SUM(n_duplicates)::BIGINT AS n_duplicates FROM (SELECT i.image_id, CASE WHEN l.image_id IS NULL THEN 'missing' WHEN fault IS NOT NULL THEN 'corrupt' ELSE 'found' END AS status, COALESCE(n, 0) AS n_rows, COALESCE(n - nd, 0) AS n_duplicates, fault
 FROM (SELECT CAST(c_custkey AS VARCHAR) AS image_id FROM customer) i LEFT JOIN (SELECT image_id, COUNT(*) AS n, COUNT(DISTINCT (cls, cx, cy, w, h)) AS nd, MIN(CASE WHEN GREATEST(cx, cy, w, h) > 1.01 THEN 'out_of_bounds' WHEN LEAST(cls, cx, cy, w, h) < -0.01 THEN 'negative' WHEN cls >= 3 THEN 'class_out_of_range' END) AS fault FROM lab2 GROUP BY image_id) l USING (image_id)) q GROUP BY ALL""",
        lab=_LAB, lab2="SELECT * FROM lab UNION ALL SELECT * FROM lab WHERE gt_id % 31 = 0",
    ),
)
def label_qa(spark, sf):
    """Label-file states and faults (out-of-range and duplicate rows injected)."""
    i = F.col("gt_id")
    lab = gt(spark, sf).filter(i % 11 != 3).select(
        "image_id", "gt_id", (i % 3).cast("int").alias("cls"), (F.col("cx") / 800.0 + F.when(i % 29 == 0, 1.0).otherwise(0.0)).alias("cx"), (F.col("cy") / 800.0).alias("cy"),
        (F.col("w") / 800.0).alias("w"), (F.col("h") / 800.0 - F.when(i % 37 == 1, 1.0).otherwise(0.0)).alias("h"),
    )
    images = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("image_id"))
    per = ds.label_qa(images, lab.unionByName(lab.filter(i % 31 == 0)), "image_id", 3)
    return per.groupBy("status", "fault").agg(F.count("*").alias("n_images"), F.sum("n_rows").alias("n_rows"), F.sum("n_duplicates").alias("n_duplicates"))
