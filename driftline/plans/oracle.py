"""SQL text of the derived tables, in the dialect of the checking engine."""

from __future__ import annotations

import re

TABLES = {
    "fx_gt": """
SELECT gt_id, gt_id % n AS img, CAST(gt_id % n AS VARCHAR) AS image_id,
       8 + gt_id * 13 % 24 AS w, 8 + gt_id * 7 % 24 AS h,
       CAST(100 + FLOOR(gt_id / n) * 6 AS DOUBLE) AS cx, CAST(100 + gt_id % n * 53 % 600 AS DOUBLE) AS cy
FROM (SELECT DISTINCT CAST(FLOOR(o_orderkey / 4) AS BIGINT) AS gt_id FROM orders) g
CROSS JOIN (SELECT COUNT(*) AS n FROM customer) c""",
    "fx_box": """
SELECT img, image_id, gt_id, w, h, cx - w / 2e0 AS gx1, cy - h / 2e0 AS gy1, cx + w / 2e0 AS gx2, cy + h / 2e0 AS gy2,
       gt_id % 3 AS gcls FROM fx_gt""",
    "fx_roster": """
SELECT CAST(c_custkey AS VARCHAR) AS image_id, c_custkey AS dataset_index, c_mktsegment AS stratum,
       CAST(1.0 AS DOUBLE) / inclusion_probability AS sampling_weight, inclusion_probability
FROM (SELECT *, CAST(SUM(CASE WHEN c_custkey % 3 <> 0 THEN 1 ELSE 0 END) OVER (PARTITION BY c_mktsegment) AS DOUBLE)
             / COUNT(*) OVER (PARTITION BY c_mktsegment) AS inclusion_probability FROM customer) x
WHERE c_custkey % 3 <> 0""",
    "fx_rays": """
SELECT g.image_id, r.gt_id, d AS direction, s.stratum, s.sampling_weight, g.w, g.h,
       CASE WHEN SQRT(CAST(g.w * g.h AS DOUBLE)) < 16 THEN 't_8_16' ELSE 's_16_32' END AS size_bin,
       lim / 1024e0 AS scan_limit,
       CASE WHEN ok % 41 = 0 THEN NULL ELSE gt_id_mod END AS o2o_base_active,
       CASE WHEN st = 'F' AND k <= lim THEN 1 ELSE 0 END AS o2o_event_observed,
       CASE WHEN st = 'F' AND k <= lim THEN k / 1024e0 END AS o2o_radius,
       CASE WHEN NOT (st = 'F' AND k <= lim) THEN lim / 1024e0 END AS o2o_censor_radius,
       CASE WHEN NOT (st = 'F' AND k <= lim) THEN 'right_censored'
            WHEN pr = '1-URGENT' THEN 'eligibility_boundary' WHEN pr = '2-HIGH' THEN 'topk_membership_transition'
            WHEN pr = '3-MEDIUM' THEN 'conflict_reassignment' WHEN pr = '4-NOT SPECIFIED' THEN 'within_set_geometry_rank_reversal'
            ELSE 'active_disappearance' END AS o2o_first_divergence,
       CASE WHEN ok % 37 = 0 THEN NULL ELSE gt_id_mod END AS o2m_base,
       CASE WHEN st <> 'P' AND k2 <= lim THEN 1 ELSE 0 END AS o2m_event_observed,
       CASE WHEN st <> 'P' AND k2 <= lim THEN k2 / 1024e0 END AS o2m_radius,
       CASE WHEN NOT (st <> 'P' AND k2 <= lim) THEN lim / 1024e0 END AS o2m_censor_radius, k, lim, ok,
       (1 + ok * 37 % 1000) / 1000e0 AS margin,
       CASE WHEN st = 'F' AND k <= lim AND ok % 3 = 0 THEN 1 ELSE 0 END AS rho_observed,
       CASE WHEN st = 'F' AND k <= lim AND ok % 3 <> 0 THEN 1 ELSE 0 END AS rho_competing,
       CASE WHEN NOT (st = 'F' AND k <= lim) AND ok % 5 <> 0 THEN 1 ELSE 0 END AS rho_right,
       CASE WHEN NOT (st = 'F' AND k <= lim) AND ok % 5 = 0
            THEN CASE WHEN ok % 2 = 0 THEN 'base_runner_missing' ELSE 'base_pair_tie' END END AS rho_reason
FROM (SELECT o_orderkey AS ok, CAST(FLOOR(o_orderkey / 4) AS BIGINT) AS gt_id, CAST(FLOOR(o_orderkey / 4) AS BIGINT) % 97 AS gt_id_mod,
             o_orderkey % 4 AS dn, o_orderstatus AS st, o_orderpriority AS pr,
             CASE o_orderkey % 4 WHEN 0 THEN 'left' WHEN 1 THEN 'right' WHEN 2 THEN 'up' ELSE 'down' END AS d,
             1 + CAST(FLOOR(o_totalprice) AS BIGINT) % 256 AS k, 1 + CAST(FLOOR(o_totalprice) AS BIGINT) * 3 % 256 AS k2,
             128 + o_orderkey * 31 % 129 AS lim FROM orders) r
JOIN fx_gt g ON r.gt_id = g.gt_id JOIN fx_roster s ON g.image_id = s.image_id""",
    "fx_rays2": """
SELECT * REPLACE (hk AS k, CASE WHEN obs THEN 1 ELSE 0 END AS o2o_event_observed, CASE WHEN obs THEN hk / 1024e0 END AS o2o_radius,
       CASE WHEN NOT obs THEN lim / 1024e0 END AS o2o_censor_radius,
       CASE WHEN obs THEN o2o_first_divergence ELSE 'right_censored' END AS o2o_first_divergence)
FROM (SELECT *, CASE WHEN ok % 11 = 0 THEN CAST(FLOOR((k + 1) / 2) AS BIGINT) ELSE k END AS hk,
             o2o_event_observed = 1 AND ok % 53 <> 0 AS obs FROM fx_rays WHERE ok % 101 NOT IN (7, 8)) q""",
    "fx_long": """
SELECT image_id, gt_id, direction, stratum, sampling_weight, size_bin, 'o2o' AS estimand, o2o_base_active AS base,
       o2o_event_observed AS observed, o2o_radius AS radius, o2o_censor_radius AS censor, o2o_first_divergence AS label FROM fx_rays
UNION ALL SELECT image_id, gt_id, direction, stratum, sampling_weight, size_bin, 'o2m', o2m_base, o2m_event_observed, o2m_radius,
       o2m_censor_radius, 'identity_change' FROM fx_rays""",
    "fx_curve": """
SELECT image_id, gt_id, direction, size_bin, stratum, sampling_weight, j * 8 AS radius_idx, j * 8 / 1024e0 AS radius,
       CASE WHEN o2o_base_active IS NULL THEN NULL
            WHEN j * 8 >= k AND NOT (ok % 5 = 0 AND j * 8 >= k + 64) THEN o2o_base_active + 1 ELSE o2o_base_active END AS o2o_active, ok
FROM fx_rays CROSS JOIN (SELECT UNNEST(RANGE(33)) AS j) n WHERE j * 8 <= lim""",
    "fx_cand": """
SELECT g.img, g.image_id, g.gt_id * 16 + j AS candidate, g.cx + (j % 4 - 1.5e0) * 3 - g.w / 2e0 AS x1,
       g.cy + (FLOOR(j / 4) - 1.5e0) * 3 - g.h / 2e0 AS y1, g.cx + (j % 4 - 1.5e0) * 3 + g.w / 2e0 AS x2,
       g.cy + (FLOOR(j / 4) - 1.5e0) * 3 + g.h / 2e0 AS y2, g.cx + (j % 4 - 1.5e0) * 3 AS ax, g.cy + (FLOOR(j / 4) - 1.5e0) * 3 AS ay,
       (5 + (g.gt_id * 31 + j * 17) % 90) / 1e2 AS p, g.gt_id % 3 AS cls
FROM fx_gt g CROSS JOIN (SELECT UNNEST(RANGE(16)) AS j) n""",
    "fx_sets": """
SELECT l_orderkey AS ok,
       COALESCE(LIST_SORT(LIST(DISTINCT CAST(l_partkey % 16 AS INT)) FILTER (WHERE l_linenumber <= 4)), CAST([] AS INT[])) AS base_ids,
       COALESCE(LIST_SORT(LIST(DISTINCT CAST(l_partkey % 16 AS INT)) FILTER (WHERE l_linenumber >= 3)), CAST([] AS INT[])) AS shift_ids
FROM lineitem GROUP BY l_orderkey""",
    "fx_raysets": """SELECT r.*, s.base_ids, s.shift_ids FROM fx_rays r JOIN fx_sets s ON r.ok = s.ok""",
    "fx_tracks": """
SELECT user_id % 16 AS video_id, user_id AS track_id, ts, event_type AS cls, value AS cx, CAST(props->>'$.k' AS DOUBLE) AS cy,
       ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS frame FROM events""",
}

_NAME = re.compile(r"\bfx_\w+")


def with_tables(body: str, **more: str) -> str:
    """Prefix ``body`` with the derived tables it names, in dependency order. ``more`` adds further named steps."""
    known = {**TABLES, **more}
    done: list[str] = []

    def visit(text: str) -> None:
        for name in dict.fromkeys(re.findall(r"\b\w+\b", text)):
            if name in known and name not in done and name not in stack:
                stack.append(name)
                visit(known[name])
                stack.remove(name)
                done.append(name)

    stack: list[str] = []
    visit(body)
    if not done:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({known[n].strip()})" for n in done) + "\n" + body.strip()


def held(sql: str) -> str:
    """``sql`` with every derived table worked out once, so that no join order is chosen across them."""
    return re.sub(r"(^WITH |,\n)(\w+) AS \(", r"\1\2 AS MATERIALIZED (", sql)


def rnd(expr: str, digits: int = 9, name: str | None = None) -> str:
    text = f"ROUND(CAST({expr} AS DOUBLE), {digits}) + 0e0"
    return f"{text} AS {name}" if name else text


def iou_sql(a: str = "gx1 gy1 gx2 gy2", b: str = "x1 y1 x2 y2") -> str:
    (a1, a2, a3, a4), (b1, b2, b3, b4) = a.split(), b.split()
    inter = inter_sql(a, b)
    return f"(({inter}) / (({a3}-{a1})*({a4}-{a2}) + ({b3}-{b1})*({b4}-{b2}) - ({inter}) + 1e-7))"


def inter_sql(a: str, b: str) -> str:
    (a1, a2, a3, a4), (b1, b2, b3, b4) = a.split(), b.split()
    return f"GREATEST(LEAST({a3},{b3})-GREATEST({a1},{b1}),0e0)*GREATEST(LEAST({a4},{b4})-GREATEST({a2},{b2}),0e0)"


def padded_iou_sql(a: str, b: str) -> tuple[str, str]:
    (a1, a2, a3, a4), (b1, b2, b3, b4) = a.split(), b.split()
    inter = inter_sql(a, b)
    union = f"(({a3}-{a1})*({a4}-{a2}+1e-7) + ({b3}-{b1})*({b4}-{b2}+1e-7) - ({inter}) + 1e-7)"
    return f"(({inter}) / {union})", union


def centre_sql(a: str, b: str) -> str:
    (a1, a2, a3, a4), (b1, b2, b3, b4) = a.split(), b.split()
    cw, ch = f"(GREATEST({a3},{b3})-LEAST({a1},{b1}))", f"(GREATEST({a4},{b4})-LEAST({a2},{b2}))"
    dx, dy = f"({b1}+{b3}-{a1}-{a3})", f"({b2}+{b4}-{a2}-{a4})"
    return f"((({dx}*{dx}+{dy}*{dy})/4e0)/({cw}*{cw}+{ch}*{ch}+1e-7))"


def ciou_sql(a: str = "gx1 gy1 gx2 gy2", b: str = "x1 y1 x2 y2") -> str:
    (a1, a2, a3, a4), (b1, b2, b3, b4) = a.split(), b.split()
    overlap, _ = padded_iou_sql(a, b)
    d = f"(ATAN(({b3}-{b1})/({b4}-{b2}+1e-7)) - ATAN(({a3}-{a1})/({a4}-{a2}+1e-7)))"
    v = f"((4e0/(PI()*PI()))*{d}*{d})"
    return f"({overlap} - ({centre_sql(a, b)} + {v}*({v}/({v} - {overlap} + 1.0000001e0))))"
