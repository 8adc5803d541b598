"""Geometry, key, text, audit and assignment rules over whole derived tables, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bins, text
from ..functions import boxes as bx
from ..functions import polygons as pg
from ..functions.bins import rounded
from ..operators import assign as asg
from ..operators import checks as ck
from ..operators import dataset as ds
from ..operators import estimators as es
from ..operators import reconcile as rc
from ..operators import trajectory as tr
from .estimate_queries import W
from ..session import shared
from .fixtures import candidates, gt_boxes, rays, roster, second_rays, table
from .geometry_queries import STATE, pairs_of
from .oracle import inter_sql, rnd, with_tables
from .registry import query

OWN = "SELECT c.*, g.gx1, g.gy1, g.gx2, g.gy2, g.gt_id FROM fx_cand c JOIN fx_box g ON g.gt_id = CAST(FLOOR(c.candidate / 16) AS BIGINT)"


def own_pairs(spark, sf):
    """Every candidate with the object that it was made from."""
    g = gt_boxes(spark, sf).select("gt_id", F.col("box").alias("gt_box"))
    return candidates(spark, sf).withColumn("gt_id", F.floor(F.col("candidate") / 16).cast("long")).join(g, "gt_id")


_WT, _HT, _WP, _HP = "(gx2 - gx1)", "(gy2 - gy1)", "(x2 - x1)", "(y2 - y1)"


def _scaled(w: str, h: str) -> tuple[str, str]:
    q = f"POW(GREATEST({w} / ({h} + 1e-9), 1e-9), 0.25e0)"
    return f"({q} * {w} / 2)", f"(({h} / 2) / ({q} + 1e-9))"


(_SWT, _SHT), (_SWP, _SHP) = _scaled(_WT, _HT), _scaled(_WP, _HP)
_CENTRE = "POW((x1 + x2 - gx1 - gx2) / 2, 2) + POW((y1 + y2 - gy1 - gy2) / 2, 2)"


@query(
    "pair_geometry",
    with_tables(
        f"""SELECT candidate, {rnd(f"({inter_sql('x1 y1 x2 y2', 'gx1 gy1 gx2 gy2')}) / ({_WT} * {_HT} + 1e-7)", 9, 'ioa')},
 {rnd(f'LEAST(GREATEST(EXP(-SQRT({_CENTRE} + POW({_SWP} - {_SWT}, 2) + POW({_SHP} - {_SHT}, 2) + 1e-9) / 12e0), 0), 1)', 9, 'wasserstein')},
 {rnd(f'SQRT({_CENTRE}) / ((SQRT({_WP} * {_HP}) + SQRT({_WT} * {_HT})) / 2)', 9, 'centre_distance')},
 ax - gx1 AS l, ay - gy1 AS t, gx2 - ax AS r, gy2 - ay AS b, LEAST(GREATEST(gx2 - ax, 0e0), 9.99e0) AS r_limited
FROM own""",
        own=OWN,
    ),
)
def pair_geometry(spark, sf):
    """Area shares, Wasserstein similarity, centre distance and edge distances of each candidate and its object."""
    p = own_pairs(spark, sf)
    c, g = F.col("box"), F.col("gt_box")
    d, limited = bx.box_to_distances(F.col("ax"), F.col("ay"), g), bx.box_to_distances(F.col("ax"), F.col("ay"), g, limit=10.0)
    return p.select(
        "candidate", rounded(bx.ioa(c, g)).alias("ioa"), rounded(bx.wasserstein_similarity(g, c, F.lit(12.0))).alias("wasserstein"),
        rounded(bx.normalised_centre_distance(c, g)).alias("centre_distance"), d["l"].alias("l"), d["t"].alias("t"), d["r"].alias("r"), d["b"].alias("b"), limited["r"].alias("r_limited"),
    )


@query(
    "anchor_round_trip",
    with_tables("SELECT gt_id, COUNT(*) AS n, COUNT(*) AS n_back FROM own GROUP BY gt_id", own=OWN),
)
def anchor_round_trip(spark, sf):
    """Edge distances turned back into boxes give every object's box again."""
    p = own_pairs(spark, sf)
    x, y, g = F.col("ax"), F.col("ay"), F.col("gt_box")
    d = bx.box_to_distances(x, y, g)
    back = bx.anchor_to_box(x, y, d["l"], d["t"], d["r"], d["b"])
    same = [F.abs(back[c] - g[c]) < 1e-9 for c in ("x1", "y1", "x2", "y2")]
    return p.groupBy("gt_id").agg(F.count("*").alias("n"), F.count_if(same[0] & same[1] & same[2] & same[3]).alias("n_back"))


_GAIN = "LEAST(640e0 / 700, 640e0 / 1100)"
_PX, _PY = (f"ROUND_EVEN((640e0 - ROUND_EVEN({n} * {_GAIN}, 0)) / 2 - 0.1e0, 0)" for n in ("1100", "700"))


@query(
    "letterbox_boxes",
    with_tables(
        "SELECT gt_id, "
        + ", ".join(rnd(f"LEAST(GREATEST((g{c} - {p}) / {_GAIN}, 0e0), {top})", 6, c) for c, p, top in (("x1", _PX, "1100e0"), ("y1", _PY, "700e0"), ("x2", _PX, "1100e0"), ("y2", _PY, "700e0")))
        + f", {rnd('(gx1 + gx2) / 2 / 640', 9, 'cx')}, {rnd('(gx2 - gx1) / 640', 9, 'w')}, {rnd('gx1 / 640 * 1100', 6, 'scaled_x1')} FROM fx_box"
    ),
)
def letterbox_boxes(spark, sf):
    """Boxes of a letterboxed canvas in image coordinates, clipped; and their normalised forms."""
    g = gt_boxes(spark, sf)
    b = bx.unletterbox(F.col("box"), 640, 640, 1100, 700)
    n = bx.xyxy_to_xywhn(F.col("box"), 640, 640)
    again = bx.xywhn_to_xyxy(n["cx"], n["cy"], n["w"], n["h"], 1100, 1100)
    return g.select("gt_id", *[rounded(b[c], 6).alias(c) for c in ("x1", "y1", "x2", "y2")], rounded(n["cx"]).alias("cx"), rounded(n["w"]).alias("w"), rounded(again["x1"], 6).alias("scaled_x1"))


@query(
    "joint_angles",
    with_tables(
        f"""SELECT candidate, {rnd('CASE WHEN d > 180 THEN 360 - d ELSE d END', 6, 'angle')} FROM (
 SELECT candidate, ABS(DEGREES(ATAN2(gy2 - ay, gx2 - ax) - ATAN2(gy1 - ay, gx1 - ax))) AS d FROM own) q""",
        own=OWN,
    ),
)
def joint_angles(spark, sf):
    """Angle at each anchor between the corners of its object."""
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    g = F.col("gt_box")
    return own_pairs(spark, sf).select("candidate", rounded(pg.joint_angle(point(g["x1"], g["y1"]), point(F.col("ax"), F.col("ay")), point(g["x2"], g["y2"])), 6).alias("angle"))


GAPS = ", ".join(map(str, bins.CATEGORY_GAPS))


@query(
    "event_rules",
    with_tables(
        f"""SELECT ok, CASE WHEN ok % 13125 < 10000 THEN 8 WHEN ok % 13125 < 12500 THEN 16 ELSE 32 END AS stride, state,
 {rnd("CASE WHEN state = 'observed' THEN o2o_radius ELSE o2o_censor_radius END", 9, 'distance')},
 CASE WHEN state = 'observed' THEN o2o_first_divergence WHEN rho_reason IS NOT NULL THEN rho_reason ELSE state END AS type,
 scan_limit >= 0.2e0 - 1e-12 OR COALESCE(o2o_event_observed = 1 AND o2o_radius <= 0.2e0 + 1e-12, FALSE) AS evaluable
FROM (SELECT *, CASE WHEN rho_observed + rho_competing + rho_right > 1 THEN 'invalid_multiple_states' WHEN rho_observed = 1 THEN 'observed'
 WHEN rho_competing = 1 THEN 'competing_censored' WHEN rho_right = 1 THEN 'right_censored' ELSE 'other_censored' END AS state FROM fx_rays) q"""
    ),
)
def event_rules(spark, sf):
    """Stride, state, distance, type and evaluability of every event."""
    one = lambda c: F.col(c) == 1
    r = rays(spark, sf).withColumn("state", bins.event_state(one("rho_observed"), one("rho_competing"), one("rho_right")))
    return r.select(
        "ok", bins.decode_stride(F.col("ok") % 13125).alias("stride"), "state", rounded(bins.event_distance(F.col("state"), F.col("o2o_radius"), F.col("o2o_censor_radius"))).alias("distance"),
        bins.event_type(F.col("state"), F.col("o2o_first_divergence"), F.col("rho_reason")).alias("type"), bins.evaluable(F.col("scan_limit"), one("o2o_event_observed"), F.col("o2o_radius"), 0.2).alias("evaluable"),
    )


@query(
    "category_round_trip",
    with_tables(
        f"""SELECT cat, dense, COUNT(*) AS n, BOOL_AND(dense IS NULL OR sparse = cat) AS back FROM (
 SELECT gt_id % 95 AS cat, CASE WHEN gt_id % 95 BETWEEN 1 AND 90 AND gt_id % 95 NOT IN ({GAPS}) THEN gt_id % 95 - 1 - LEN(LIST_FILTER([{GAPS}], lambda x: x < gt_id % 95)) END AS dense, gt_id % 95 AS sparse FROM fx_gt) q
GROUP BY ALL"""
    ),
)
def category_round_trip(spark, sf):
    """Category ids to dense ids and back, for all objects."""
    g = gt_boxes(spark, sf).select((F.col("gt_id") % 95).alias("cat"))
    g = g.withColumn("dense", bins.compact_category(F.col("cat")))
    g = g.withColumn("sparse", bins.sparse_category(F.col("dense")))
    return g.groupBy("cat", "dense").agg(F.count("*").alias("n"), F.bool_and(F.col("dense").isNull() | (F.col("sparse") == F.col("cat"))).alias("back"))


@query(
    "class_filter",
    with_tables("SELECT image_id, COUNT(*) FILTER (WHERE gcls IN (0, 2)) AS n_kept, COUNT(*) AS n_single FROM fx_box GROUP BY image_id"),
)
def class_filter(spark, sf):
    """Objects of two classes, and all collapsed to one class, per image."""
    g = gt_boxes(spark, sf).withColumn("cls", (F.col("gt_id") % 3).cast("int"))
    kept = bins.filter_classes(g, [0, 2]).groupBy("image_id").agg(F.count("*").alias("n_kept"))
    single = bins.filter_classes(g, single=True).filter("cls = 0").groupBy("image_id").agg(F.count("*").alias("n_single"))
    return rc.outer_zero(kept, single, ["image_id"], ["n_kept", "n_single"])


@query(
    "text_rules",
    """SELECT o_orderkey, CONCAT_WS('/', o_orderkey, o_orderstatus, o_orderpriority) AS key, ARRAY_TO_STRING(LIST_SORT(['first', 'second', LOWER(o_orderstatus)]), '|') AS phases,
 CAST(LEAST(o_custkey, o_orderkey) AS VARCHAR) || ';' || CAST(GREATEST(o_custkey, o_orderkey) AS VARCHAR) AS ids, o_custkey + o_orderkey AS id_sum,
 'tau_' || LPAD(CAST(CAST(ROUND(o_orderkey % 997 / 1000e0 * 100000) AS BIGINT) AS VARCHAR), 5, '0') AS tau,
 REPLACE(REPLACE('{"term": "' || o_orderpriority || '"}', 'URGENT', 'HIGH'), 'HIGH', 'TOP') AS migrated, SHA256(CAST(o_orderkey AS VARCHAR)) AS hash, TRUE AS hash_ok, FALSE AS key_is_hash
FROM orders""",
)
def text_rules(spark, sf):
    """Keys, phases, id lists, labels, migrations and hashes of all orders."""
    o = table(spark, sf, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    ids = text.ids_to_text(F.array(k.cast("long"), c.cast("long")))
    back = F.aggregate(text.text_to_ids(ids), F.lit(0), lambda a, x: a + x).cast("long")
    hash_ = text.sha256(k.cast("string"))
    return o.select(
        "o_orderkey", text.key_text(k, F.col("o_orderstatus"), F.col("o_orderpriority")).alias("key"), text.phases(F.array(F.lower("o_orderstatus"), F.lit("second"), F.lit("first"))).alias("phases"),
        ids.alias("ids"), back.alias("id_sum"), text.tau_label((k % 997) / 1000.0).alias("tau"),
        text.migrate_terms(F.concat(F.lit('{"term": "'), F.col("o_orderpriority"), F.lit('"}')), {"URGENT": "HIGH", "HIGH": "TOP"}).alias("migrated"),
        hash_.alias("hash"), text.is_sha256(hash_).alias("hash_ok"), text.is_sha256(F.col("o_orderpriority")).alias("key_is_hash"),
    )


@query(
    "time_and_json_rules",
    """SELECT event_id, CAST(FLOOR(EPOCH(CAST(ts AS TIMESTAMP))) AS BIGINT) - 7200 AS seconds, TRUE AS before, CASE WHEN event_id % 2 = 0 THEN ['absent'] ELSE ['k', 'absent'] END AS missing FROM events""",
)
def time_and_json_rules(spark, sf):
    """Explicit-offset times, their order, and required JSON keys of all events."""
    e = table(spark, sf, "events").select("event_id", "ts")
    at = text.parse_utc(F.concat(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00")))
    later = text.parse_utc(F.concat(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")))
    body = F.when(F.col("event_id") % 2 == 0, F.lit('{"k": 1, "other": 2}')).otherwise(F.lit('{"other": 2}'))
    return e.select("event_id", F.unix_seconds(at).alias("seconds"), text.strictly_before(at, later).alias("before"), text.missing_keys(body, ["k", "absent"]).alias("missing"))


@query(
    "forward_radii",
    with_tables(
        f"""SELECT ok, CASE WHEN lim > k THEN CAST(CEIL((lim / 1024e0 - 1e-12 - k / 1024e0) / 0.015625e0) AS BIGINT) ELSE 0 END AS n,
 {rnd('CASE WHEN lim > k THEN k / 1024e0 + 0.015625e0 * LEAST(1, CEIL((lim / 1024e0 - 1e-12 - k / 1024e0) / 0.015625e0) - 1) + CASE WHEN CEIL((lim / 1024e0 - 1e-12 - k / 1024e0) / 0.015625e0) < 2 THEN lim / 1024e0 - k / 1024e0 ELSE 0 END END', 9, 'first')},
 {rnd('CASE WHEN lim > k THEN lim / 1024e0 END', 9, 'last')} FROM fx_rays"""
    ),
)
def forward_radii(spark, sf):
    """Radius grid from the event to the scan limit on a step of 1/64: its length and ends."""
    grid = tr.forward_grid(F.col("k") / 1024.0, F.col("lim") / 1024.0, 1 / 64)
    return rays(spark, sf).withColumn("g", grid).select("ok", F.size("g").cast("long").alias("n"), rounded(F.try_element_at("g", F.lit(1))).alias("first"), rounded(F.try_element_at("g", F.lit(-1))).alias("last"))


@query(
    "null_to_zero_joins",
    with_tables(
        """SELECT image_id, n_events, n_other, population_only FROM (
 SELECT COALESCE(a.image_id, b.image_id) AS image_id, COALESCE(n_events, 0) AS n_events, COALESCE(n_other, 0) AS n_other FROM
  (SELECT image_id, COUNT(*) AS n_events FROM fx_rays WHERE o2o_event_observed = 1 GROUP BY 1) a FULL JOIN (SELECT image_id, COUNT(*) AS n_other FROM fx_rays2 WHERE o2o_event_observed = 0 GROUP BY 1) b ON a.image_id = b.image_id) q
 CROSS JOIN (SELECT COUNT(*) AS population_only FROM customer WHERE CAST(c_custkey AS VARCHAR) NOT IN (SELECT image_id FROM fx_roster)) c"""
    ),
)
def null_to_zero_joins(spark, sf):
    """Event counts of two result sets per image, absent ones zero; and how many images the roster excludes."""
    a = rays(spark, sf).filter("o2o_event_observed = 1").groupBy("image_id").agg(F.count("*").alias("n_events"))
    b = second_rays(spark, sf).filter("o2o_event_observed = 0").groupBy("image_id").agg(F.count("*").alias("n_other"))
    outside = rc.disjoint(table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("image_id")), roster(spark, sf), ["image_id"])
    return rc.outer_zero(a, b, ["image_id"], ["n_events", "n_other"]).withColumn("population_only", outside.agg(F.count("*").alias("n")).scalar())


@query(
    "outcome_join",
    with_tables(
        f"""SELECT size_bin, missed, COUNT(*) AS n, {rnd(f'SUM({W} * o2o_event_observed) / SUM({W})', 9, 'rate')} FROM fx_rays r
 JOIN (SELECT o_orderkey AS mk, o_totalprice < 150000 AS missed FROM orders) m ON m.mk = r.ok GROUP BY ALL"""
    ),
)
def outcome_join(spark, sf):
    """Rate by size among missed and found objects: events joined one to one with an outcome table."""
    outcome = table(spark, sf, "orders").select(F.col("o_orderkey").alias("ok"), (F.col("o_totalprice") < 150000).alias("missed"))
    joined = rc.paired_join(rays(spark, sf).select("ok", "size_bin", W, "o2o_event_observed"), outcome, ["ok"], suffixes=("", ""))
    return joined.groupBy("size_bin", "missed").agg(F.count("*").alias("n"), rounded(es.weighted_mean(F.col("o2o_event_observed"), F.col(W))).alias("rate"))


@query(
    "claim_links",
    """SELECT ps.o_orderkey, CAST(e AS VARCHAR) AS evidence, e IN (SELECT c_custkey FROM customer) AS known FROM orders ps CROSS JOIN LATERAL (SELECT UNNEST([o_custkey, o_custkey + 1000000000]) AS e) u""",
)
def claim_links(spark, sf):
    """Claims with two evidence ids each, one of them unknown."""
    o = table(spark, sf, "orders").select("o_orderkey", F.concat(F.col("o_custkey").cast("string"), F.lit("; "), (F.col("o_custkey").cast("long") + 1000000000).cast("string")).alias("ids"))
    c = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("evidence"))
    return rc.claim_links(o, "o_orderkey", "ids", c, "evidence").select("o_orderkey", "evidence", "known")


@query(
    "signature_rules",
    with_tables(
        """SELECT image_id, gt_id, direction, LIST_FILTER([CASE WHEN a.k <> b.k THEN 'k' END, CASE WHEN a.o2o_first_divergence <> b.o2o_first_divergence THEN 'o2o_first_divergence' END,
 CASE WHEN a.o2o_radius IS DISTINCT FROM b.o2o_radius THEN 'o2o_radius' END], lambda x: x IS NOT NULL) AS fields
FROM fx_rays a JOIN fx_rays2 b USING (image_id, gt_id, direction) WHERE a.k <> b.k OR a.o2o_first_divergence <> b.o2o_first_divergence OR a.o2o_radius IS DISTINCT FROM b.o2o_radius"""
    ),
)
def signature_rules(spark, sf):
    """Rays whose event fields differ between two result sets, with the fields."""
    return rc.signature_mismatches(rays(spark, sf), second_rays(spark, sf), ["image_id", "gt_id", "direction"], ["k", "o2o_first_divergence", "o2o_radius"])


@query(
    "difference_examples",
    with_tables(
        """SELECT category, size_bin, ok FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY category, size_bin ORDER BY ok) AS n FROM (
 SELECT r.ok, r.size_bin, CASE WHEN r.k <> b.k THEN 'halved' WHEN r.o2o_event_observed <> b.o2o_event_observed THEN 'lost' END AS category FROM fx_rays r JOIN fx_rays2 b ON r.ok = b.ok) q WHERE category IS NOT NULL) w WHERE n <= 3"""
    ),
)
def difference_examples(spark, sf):
    """Three examples of each kind of difference and size."""
    b = second_rays(spark, sf).select("ok", F.col("k").alias("k_b"), F.col("o2o_event_observed").alias("seen_b"))
    joined = rays(spark, sf).join(b, "ok")
    category = F.when(F.col("k") != F.col("k_b"), "halved").when(F.col("o2o_event_observed") != F.col("seen_b"), "lost")
    return rc.examples(joined, category, ["size_bin"], ["ok"]).select("category", "size_bin", "ok")


@query(
    "stage_parity",
    with_tables(
        """SELECT COUNT(*) AS n_rows, COUNT(*) FILTER (WHERE a.o2o_event_observed IS DISTINCT FROM b.o2o_event_observed) AS o2o_event_observed_mismatch,
 COUNT(*) FILTER (WHERE a.o2o_radius IS DISTINCT FROM b.o2o_radius AND NOT COALESCE(ABS(a.o2o_radius - b.o2o_radius) <= 0.01, FALSE)) AS o2o_radius_mismatch FROM fx_rays a FULL JOIN fx_rays2 b ON a.ok = b.ok"""
    ),
)
def stage_parity(spark, sf):
    """Agreement of two result sets in exact flags and in radii within a tolerance."""
    return rc.stage_parity(rays(spark, sf), second_rays(spark, sf), ["ok"], ["o2o_event_observed"], {"o2o_radius": 0.01})


@query(
    "analyser_parity",
    with_tables(
        f"""SELECT size_bin, {rnd('a', 9, 'first')}, {rnd('b', 9, 'second')}, ABS(a - b) <= 0.02 AS agree FROM
 (SELECT size_bin, SUM({W} * o2o_event_observed) / SUM({W}) AS a FROM fx_rays GROUP BY 1) x JOIN (SELECT size_bin, SUM({W} * o2o_event_observed) / SUM({W}) AS b FROM fx_rays2 GROUP BY 1) y USING (size_bin)"""
    ),
)
def analyser_parity(spark, sf):
    """The same metric from two analysers, compared within a tolerance."""
    rate = lambda df, name: df.groupBy("size_bin").agg(es.weighted_mean(F.col("o2o_event_observed"), F.col(W)).alias(name))
    both = rc.paired_join(rate(rays(spark, sf), "first"), rate(second_rays(spark, sf), "second"), ["size_bin"], suffixes=("", ""))
    return both.select("size_bin", rounded(F.col("first")).alias("first"), rounded(F.col("second")).alias("second"), rc.nullable_close(F.col("first"), F.col("second"), 0.02).alias("agree"))


@query(
    "merged_totals",
    with_tables("SELECT n AS n_rows, n AS n_keys, n AS declared_rows, TRUE AS unique, TRUE AS total_matches FROM (SELECT COUNT(*) AS n FROM fx_rays) q"),
)
def merged_totals(spark, sf):
    """The merged table against its declared total."""
    r = rays(spark, sf)
    return rc.merged_report(r, rays(spark, sf).agg(F.count("*").alias("n_rows")), ["image_id", "gt_id", "direction"])


@query(
    "roster_problems",
    """SELECT CAST(c_custkey AS VARCHAR) AS image_id, 1::BIGINT AS n_rows, CASE WHEN c_custkey % 3 = 0 THEN 'unknown_image' ELSE 'stratum_drift' END AS problem FROM customer WHERE c_custkey % 3 = 0 OR (c_custkey % 10 = 1 AND c_mktsegment <> 'BUILDING')""",
)
def roster_problems(spark, sf):
    """Images that the roster does not know or knows under another stratum; one in ten is marked with another stratum."""
    k = F.col("c_custkey")
    raw = table(spark, sf, "customer").select(k.cast("string").alias("image_id"), F.when(k % 10 == 1, "BUILDING").otherwise(F.col("c_mktsegment")).alias("stratum"))
    return ck.roster_report(raw, roster(spark, sf).select("image_id", "stratum"), "image_id", "stratum")


@query(
    "single_row",
    "SELECT c_custkey, c_name FROM customer WHERE c_custkey = (SELECT MAX(c_custkey) FROM customer)",
)
def single_row(spark, sf):
    """The one row of the greatest key; none or several would fail."""
    c = table(spark, sf, "customer").select("c_custkey", "c_name")
    return ck.unique_row(c.withColumn("_top", c.agg(F.max("c_custkey").alias("m")).scalar()), F.col("c_custkey") == F.col("_top")).drop("_top")


@query(
    "file_fixity",
    """SELECT 'p/' || o_orderkey AS path, CASE o_orderkey % 7 WHEN 0 THEN 'missing' WHEN 1 THEN 'unlisted' WHEN 2 THEN 'size_differs' WHEN 3 THEN 'hash_differs' ELSE 'ok' END AS status FROM orders""",
)
def file_fixity(spark, sf):
    """A manifest of all orders as files against a scan in which known sevenths differ."""
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    listed = o.select(F.concat(F.lit("p/"), k).alias("path"), (k * 3).alias("size"), F.sha2(k.cast("string"), 256).alias("sha256"), (k % 7).alias("m"))
    found = listed.withColumns({"size": F.when(F.col("m") == 2, F.col("size") + 1).otherwise(F.col("size")), "sha256": F.when(F.col("m") == 3, F.lit("0")).otherwise(F.col("sha256"))})
    return rc.fixity(listed.filter("m <> 1"), found.filter("m <> 0"))


@query(
    "panel_sources",
    """SELECT o_custkey AS panel, COUNT(*) AS n_sources, COUNT(*) FILTER (WHERE o_orderkey % 5 > 1) AS n_pass, COUNT(*) FILTER (WHERE o_orderkey % 5 = 0) AS n_missing,
 COUNT(*) FILTER (WHERE o_orderkey % 5 = 1) AS n_conflict, COUNT(*) FILTER (WHERE o_orderkey % 4 = 0) AS n_unregistered FROM orders GROUP BY 1""",
)
def panel_sources(spark, sf):
    """Hash and registry state of the sources of each panel."""
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("panel"), "o_orderkey", F.concat(F.lit("s/"), F.col("o_orderkey")).alias("path"))
    panels = o.groupBy("panel").agg(F.collect_list(F.struct("path", F.lit("aa").alias("sha256"))).alias("sources"))
    k = F.col("o_orderkey")
    files = o.filter(k % 5 != 0).select("path", F.when(k % 5 == 1, "bb").otherwise("aa").alias("sha256"))
    return rc.source_audit(panels, files, o.filter(k % 4 != 0).select("path", F.lit("listed").alias("status")))


@query(
    "instance_counts",
    """SELECT c_mktsegment, n AS n_rows, n + CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END AS expected, c_mktsegment <> 'BUILDING' AS matches FROM (SELECT c_mktsegment, COUNT(*) AS n FROM customer GROUP BY 1) q""",
)
def instance_counts(spark, sf):
    """Row counts per name against expected ones; one expectation is off by one."""
    c = table(spark, sf, "customer")
    wanted = c.groupBy("c_mktsegment").agg((F.count("*") + F.when(F.col("c_mktsegment") == "BUILDING", 1).otherwise(0)).alias("expected"))
    return rc.expected_counts(c, "c_mktsegment", wanted)


@query(
    "shard_progress",
    with_tables(
        f"""SELECT COUNT(*) AS n_total, COUNT(s) AS n_done, {rnd('SUM(s)', 6, 'seconds')}, COUNT(*) - COUNT(s) AS n_pending, {rnd('SUM(s) / COUNT(s) * (COUNT(*) - COUNT(s))', 6, 'eta_seconds')}
 FROM (SELECT CASE WHEN dataset_index % 4 <> 0 THEN dataset_index % 17 / 4e0 END AS s FROM fx_roster) q"""
    ),
)
def shard_progress(spark, sf):
    """Finished and pending shards and the remaining time at the mean pace; three in four are finished."""
    r = roster(spark, sf)
    done = r.filter(F.col("dataset_index") % 4 != 0).select("image_id", (F.col("dataset_index") % 17 / 4.0).alias("seconds"))
    out = rc.progress(r.select("image_id"), done, "image_id")
    return out.select("n_total", "n_done", rounded(F.col("seconds"), 6).alias("seconds"), "n_pending", rounded(F.col("eta_seconds"), 6).alias("eta_seconds"))


@query(
    "dataset_identity",
    """SELECT total_size, SHA256(CAST(total_size AS VARCHAR) || p) AS digest FROM (SELECT SUM(s)::BIGINT AS total_size, SHA256(STRING_AGG(h, '' ORDER BY b)) AS p FROM (
 SELECT SUBSTRING(SHA256('p/' || o_orderkey), 1, 3) AS b, SUM(o_custkey)::BIGINT AS s, SHA256(STRING_AGG('p/' || o_orderkey, '' ORDER BY 'p/' || o_orderkey)) AS h FROM orders GROUP BY 1) q) r""",
)
def dataset_identity(spark, sf):
    """Total size and two-level digest over all paths."""
    files = table(spark, sf, "orders").select(F.concat(F.lit("p/"), F.col("o_orderkey")).alias("path"), F.col("o_custkey").cast("long").alias("size"))
    return ds.dataset_digest(files)


@query(
    "assignment_targets",
    with_tables(
        f"""SELECT image_id, candidate, gt_id AS target_gt, {rnd('k.q * mc / (mq + 1e-9)', 9, 'target_score')} FROM owned10 k JOIN (SELECT image_id, gt_id, MAX(q) AS mq, MAX(c) AS mc FROM owned10 GROUP BY ALL) m USING (image_id, gt_id)""",
        **STATE,
    ),
)
def assignment_targets(spark, sf):
    """Foreground candidates with their target object and normalised score, one-to-many."""
    assigned = shared(asg.assign(asg.flag_claims(pairs_of(spark, sf), 10), single=False))  # read three times
    scored = asg.target_scores(assigned)
    fore = asg.foreground(assigned)
    return fore.join(scored, ["image_id", "candidate"]).filter("gt_id = target_gt").select("image_id", "candidate", "target_gt", rounded(F.col("target_score")).alias("target_score"))


@query(
    "conflict_off",
    with_tables("SELECT image_id, gt_id, COUNT(*) AS n_claims FROM claims7 GROUP BY ALL", **STATE),
)
def conflict_off(spark, sf):
    """Claims per object when conflicts are left unresolved."""
    kept = asg.assign(asg.flag_claims(pairs_of(spark, sf), 7), single=False, conflict=False)
    return kept.groupBy("image_id", "gt_id").agg(F.count("*").alias("n_claims"))


@query(
    "wls_line",
    with_tables(
        f"""SELECT size_bin, n AS n_rows, {rnd('swy / sw', 9, 'intercept')}, {rnd('(swxy - swx * swy / sw) / (swxx - swx * swx / sw)', 9, 'log_area')}, {rnd('(swxy - swx * swy / sw) / (swxx - swx * swx / sw) * LN(2e0)', 9, 'area_doubling')} FROM (
 SELECT size_bin, COUNT(*) AS n, SUM({W}) AS sw, SUM({W} * x) AS swx, SUM({W} * y) AS swy, SUM({W} * x * x) AS swxx, SUM({W} * x * y) AS swxy FROM (SELECT *, LN(CAST(w * h AS DOUBLE)) AS x, o2o_event_observed AS y FROM fx_rays) a GROUP BY size_bin) b"""
    ),
)
def wls_line(spark, sf):
    """Weighted line of the event on centred log area per size group, with the area-doubling effect."""
    r = rays(spark, sf).withColumn("log_area", F.ln((F.col("w") * F.col("h")).cast("double")))
    r = es.centred(r, ["size_bin"], ["log_area"], W)
    fit = es.solve_gram(es.gram(r, ["size_bin"], ["log_area"], "o2o_event_observed", W), ["size_bin"], ["log_area"])
    return fit.select("size_bin", "n_rows", rounded(F.col("intercept")).alias("intercept"), rounded(F.col("log_area")).alias("log_area"), rounded(F.col("log_area") * F.ln(F.lit(2.0))).alias("area_doubling"))
