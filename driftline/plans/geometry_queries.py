"""Box geometry, rosters, shifts and assignment replay."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import boxes as bx
from ..functions.bins import image_strata, rounded, size_bin
from ..operators import assign as asg
from ..operators import estimators as es
from ..session import shared
from .estimate_queries import W, _round_all, wm
from .fixtures import candidates, gt_boxes, roster
from .oracle import centre_sql, ciou_sql, held, iou_sql, padded_iou_sql, rnd, with_tables
from .registry import query

IMAGE_SIDE = 2048


def dealt_tables(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Truth boxes and candidates, dealt by image."""
    c, g = asg.by_image(candidates(spark, sf), gt_boxes(spark, sf))
    return g, c


def pairs_of(spark, sf) -> DataFrame:
    return asg.eligible_pairs(*dealt_tables(spark, sf))


def boxed_pairs(spark, sf) -> DataFrame:
    """Eligible pairs with both boxes, ``a`` the object's and ``b`` the candidate's: no join back to the tables they come from."""
    pairs = asg.eligible_boxes(gt_boxes(spark, sf), candidates(spark, sf))
    return pairs.select("gt_id", "candidate", F.col("gt_box").alias("a"), F.col("box").alias("b"))


def inside_sql(p: str) -> str:
    """Anchor strictly inside the truth box, whose sides below 8 count as 16 (a shifted side of 8 can round below 8)."""
    w, h = (f"CASE WHEN {p}gx2 - {p}gx1 < 8 THEN 16e0 ELSE {p}gx2 - {p}gx1 END", f"CASE WHEN {p}gy2 - {p}gy1 < 8 THEN 16e0 ELSE {p}gy2 - {p}gy1 END")
    cx, cy = f"({p}gx1 + {p}gx2) / 2", f"({p}gy1 + {p}gy2) / 2"
    return f"LEAST(ax - ({cx} - ({w}) / 2), ay - ({cy} - ({h}) / 2), {cx} + ({w}) / 2 - ax, {cy} + ({h}) / 2 - ay) > 1e-9"


ELIG = f"""SELECT c.image_id, g.gt_id, c.candidate, c.p, GREATEST({ciou_sql()}, 0e0) AS c, g.gx1, g.gy1, g.gx2, g.gy2, c.x1, c.y1, c.x2, c.y2
 FROM fx_box g JOIN fx_cand c ON g.img = c.img WHERE {inside_sql("g.")}"""
PAIRS = "SELECT *, SQRT(p) * ((c * c * c) * (c * c * c)) AS q FROM elig"


# Candidates here are at least 8 wide around their anchor, so an eligible pair overlaps; zero alignments are tested by brute force.
def claims_sql(k: int, src: str = "pairs", key: str = "image_id, gt_id") -> str:
    return f"SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY {key} ORDER BY q DESC, candidate) AS rk FROM {src}) r WHERE rk <= {k}"


OWNERS = """SELECT image_id, candidate, n_claims, CASE WHEN n_claims = 1 THEN only_gt ELSE best_gt END AS gt_id FROM (
 SELECT p.image_id, p.candidate, COUNT(cl.gt_id) AS n_claims, MAX(cl.gt_id) AS only_gt, ARG_MAX(p.gt_id, (p.c, -p.gt_id)) AS best_gt
 FROM pairs p LEFT JOIN {claims} cl USING (image_id, gt_id, candidate) GROUP BY ALL) q WHERE n_claims > 0"""
OWNED = "SELECT o.*, p.q, p.c FROM {owners} o JOIN pairs p USING (image_id, gt_id, candidate)"
KEPT = "SELECT image_id, gt_id, candidate, q, c, n_claims FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY image_id, gt_id ORDER BY q DESC, candidate) AS r FROM {owned}) x WHERE r = 1"
STATE = {
    "elig": ELIG, "pairs": PAIRS,
    "claims7": claims_sql(7), "owners7": OWNERS.format(claims="claims7"), "owned7": OWNED.format(owners="owners7"), "kept7": KEPT.format(owned="owned7"),
    "claims10": claims_sql(10), "owners10": OWNERS.format(claims="claims10"), "owned10": OWNED.format(owners="owners10"),
}


@query(
    "roster_stratify",
    with_tables(
        """SELECT image_id, CASE WHEN tiny AND small THEN 't_and_s' WHEN tiny THEN 't_only' WHEN small THEN 's_only' END AS stratum, n AS n_boxes,
 CASE WHEN n < 32 THEN 'low' WHEN n < 128 THEN 'medium' ELSE 'high' END AS density, vt, t, s, m FROM (
 SELECT image_id, COUNT(*) AS n, BOOL_OR(side >= 8 AND side < 16) AS tiny, BOOL_OR(side >= 16 AND side < 32) AS small, COUNT(*) FILTER (WHERE side < 8) AS vt,
 COUNT(*) FILTER (WHERE side >= 8 AND side < 16) AS t, COUNT(*) FILTER (WHERE side >= 16 AND side < 32) AS s, COUNT(*) FILTER (WHERE side >= 32) AS m
 FROM (SELECT image_id, SQRT(CAST(w * h AS DOUBLE)) AS side FROM fx_gt) a GROUP BY image_id) b"""
    ),
)
def roster_stratify(spark, sf):
    """Image strata from object sides, density labels and size-bin counts."""
    g = gt_boxes(spark, sf)
    area = F.col("w") * F.col("h")
    strata = image_strata(g, "image_id", F.sqrt(area.cast("double")))
    bins = g.groupBy("image_id").agg(*[F.count_if(size_bin(area) == b).alias(n) for n, b in (("vt", "vt_lt8"), ("t", "t_8_16"), ("s", "s_16_32"), ("m", "m_ge32"))])
    return strata.join(bins, "image_id")


KAPPA = 0.1


def _moves_sql(kx: str, ky: str) -> str:
    return f"""SELECT image_id, img, gt_id, direction, gx1 + ux * {kx} AS gx1, gy1 + uy * {ky} AS gy1, gx2 + ux * {kx} AS gx2, gy2 + uy * {ky} AS gy2 FROM fx_box
 CROSS JOIN (VALUES ('left', -1e0, 0e0), ('right', 1e0, 0e0), ('up', 0e0, -1e0), ('down', 0e0, 1e0)) d(direction, ux, uy)"""


@query(
    "shift_boxes",
    with_tables(
        f"""SELECT gt_id, direction, {rnd('gx1')} AS x1, {rnd('gy1')} AS y1, {rnd('gx2')} AS x2, {rnd('gy2')} AS y2, {rnd('lim')} AS scan_limit, reason FROM (
 SELECT m.*, LEAST(0.25e0, edge) AS lim, CASE WHEN 0.25e0 <= edge + 1e-12 THEN 'rmax' ELSE 'image_boundary' END AS reason FROM moves m JOIN (
 SELECT gt_id, direction, GREATEST(0e0, CASE direction WHEN 'left' THEN gx1 WHEN 'right' THEN 620 - gx2 WHEN 'up' THEN gy1 ELSE 620 - gy2 END / SQRT(CAST(w * h AS DOUBLE))) AS edge
 FROM fx_box CROSS JOIN (SELECT UNNEST(['left', 'right', 'up', 'down']) AS direction) d) e USING (gt_id, direction)) q WHERE gx1 >= 0 AND gy1 >= 0 AND gx2 <= 620 AND gy2 <= 620""",
        moves=_moves_sql("(0.1e0 * SQRT(CAST(w * h AS DOUBLE)))", "(0.1e0 * SQRT(CAST(w * h AS DOUBLE)))"),
    ),
)
def shift_boxes(spark, sf):
    """Legal equivalent-side shifts in four directions, with scan limit and reason, in a 620-pixel image."""
    g = gt_boxes(spark, sf).withColumn("_d", F.explode(bx.directions()))
    delta = bx.shift_delta("equivalent_side", KAPPA, F.col("w").cast("double"), F.col("h").cast("double"))
    moved = bx.legal_shift(F.col("box"), F.col("_d.ux") * delta["dx"], F.col("_d.uy") * delta["dy"], 620, 620)
    side = F.sqrt((F.col("w") * F.col("h")).cast("double"))
    limit = bx.scan_limit(F.col("box"), F.col("_d.direction"), F.col("_d.ux"), F.col("_d.uy"), 620, 620, side, 0.25)
    out = g.withColumns({"m": moved, "l": limit}).filter("m IS NOT NULL")
    return out.select(
        "gt_id", F.col("_d.direction").alias("direction"), *[rounded(F.col(f"m.{c}")).alias(c) for c in ("x1", "y1", "x2", "y2")],
        rounded(F.col("l.limit")).alias("scan_limit"), F.col("l.reason").alias("reason"),
    )


_A, _B = "gx1 gy1 gx2 gy2", "x1 y1 x2 y2"
_OV, _UN = padded_iou_sql(_A, _B)
_HULL = "((GREATEST(gx2, x2) - LEAST(gx1, x1)) * (GREATEST(gy2, y2) - LEAST(gy1, y1)) + 1e-7)"


@query(
    "iou_family",
    with_tables(
        f"""SELECT gt_id, candidate, {rnd(iou_sql(), 9, 'iou')}, {rnd(f'{_OV} - ({_HULL} - {_UN}) / {_HULL}', 9, 'giou')}, {rnd(f'{_OV} - {centre_sql(_A, _B)}', 9, 'diou')}, {rnd(ciou_sql(), 9, 'ciou')} FROM elig""",
        elig=ELIG,
    ),
)
def iou_family(spark, sf):
    """IoU, GIoU, DIoU and CIoU of every eligible pair."""
    both = boxed_pairs(spark, sf)
    fns = {"iou": bx.iou, "giou": bx.giou, "diou": bx.diou, "ciou": bx.ciou}
    return both.select("gt_id", "candidate", *[rounded(f(F.col("a"), F.col("b"))).alias(n) for n, f in fns.items()])


def _gauss(w, h, r):
    a, b = f"({w}*{w}/12e0)", f"({h}*{h}/12e0)"
    return f"({a}*COS({r})*COS({r})+{b}*SIN({r})*SIN({r}))", f"({a}*SIN({r})*SIN({r})+{b}*COS({r})*COS({r}))", f"(({a}-{b})*COS({r})*SIN({r}))"


def probiou_sql(x: str, y: str) -> str:
    """Probabilistic IoU of two rotated boxes given as ``cx cy w h r`` column names."""
    (x1, y1, w1, h1, r1), (x2, y2, w2, h2, r2) = x.split(), y.split()
    (a1, b1, c1), (a2, b2, c2) = _gauss(w1, h1, r1), _gauss(w2, h2, r2)
    det = f"(({a1}+{a2})*({b1}+{b2}) - ({c1}+{c2})*({c1}+{c2}))"
    t1 = f"((({a1}+{a2})*({y1}-{y2})*({y1}-{y2}) + ({b1}+{b2})*({x1}-{x2})*({x1}-{x2})) / ({det}+1e-7) * 0.25e0)"
    t2 = f"((({c1}+{c2})*({x2}-{x1})*({y1}-{y2})) / ({det}+1e-7) * 0.5e0)"
    own = f"(GREATEST({a1}*{b1}-{c1}*{c1},0e0)*GREATEST({a2}*{b2}-{c2}*{c2},0e0))"
    t3 = f"(LN({det}/(4e0*SQRT({own})+1e-7)+1e-7)*0.5e0)"
    return f"(1e0 - SQRT(1e0 - EXP(-LEAST(GREATEST({t1}+{t2}+{t3},1e-7),100e0)) + 1e-7))"


@query(
    "probiou",
    with_tables(
        f"""SELECT gt_id, candidate, {rnd(probiou_sql('acx acy aw ah ar', 'bcx bcy bw bh br'), 9, 'probiou')} FROM (
 SELECT gt_id, candidate, (gx1+gx2)/2 AS acx, (gy1+gy2)/2 AS acy, gx2-gx1 AS aw, gy2-gy1 AS ah, (gt_id % 7) / 5e0 AS ar, (x1+x2)/2 AS bcx, (y1+y2)/2 AS bcy, x2-x1 AS bw, y2-y1 AS bh, (candidate % 11) / 9e0 AS br FROM elig) e""",
        elig=ELIG,
    ),
)
def probiou(spark, sf):
    """Probabilistic IoU of eligible pairs, boxes rotated by an id-dependent angle."""

    def rotated(box, key, k, d):
        b = bx.xyxy_to_xywh(F.col(box))
        return F.struct(b["cx"].alias("cx"), b["cy"].alias("cy"), b["w"].alias("w"), b["h"].alias("h"), ((F.col(key) % k) / float(d)).alias("r"))

    both = boxed_pairs(spark, sf).select("gt_id", "candidate", rotated("a", "gt_id", 7, 5).alias("a"), rotated("b", "candidate", 11, 9).alias("b"))
    return both.select("gt_id", "candidate", rounded(bx.probiou(F.col("a"), F.col("b"))).alias("probiou"))


# Keypoint scales of the four synthetic keypoints.
SIGMAS = (0.026, 0.079, 0.062, 0.107)
_PTS = [(0.25, 0.25), (0.75, 0.25), (0.5, 0.5), (0.5, 0.9)]
_VIS = lambda i: f"(gt_id + {i}) % 3 <> 0"


def oks_sql(area="((gx2-gx1)*(gy2-gy1)*0.53e0)") -> str:
    terms, seen = [], []
    for i, ((fx, fy), s) in enumerate(zip(_PTS, SIGMAS)):
        dx = f"((gx1+{fx}*(gx2-gx1)) - (x1+{fx}*(x2-x1)))"
        dy = f"((gy1+{fy}*(gy2-gy1)) - (y1+{fy}*(y2-y1)))"
        terms.append(f"CASE WHEN {_VIS(i)} THEN EXP(-(({dx}*{dx}+{dy}*{dy}) / ({(2 * s) ** 2!r}e0 * ({area} + 1e-7) * 2e0))) ELSE 0e0 END")
        seen.append(f"CASE WHEN {_VIS(i)} THEN 1e0 ELSE 0e0 END")
    return f"(({' + '.join(terms)}) / ({' + '.join(seen)} + 1e-7))"


def keypoints(b, visible=None):
    return F.array(
        *[
            F.struct((b["x1"] + F.lit(fx) * bx.width(b)).alias("x"), (b["y1"] + F.lit(fy) * bx.height(b)).alias("y"), (visible(i) if visible else F.lit(1)).cast("int").alias("v"))
            for i, (fx, fy) in enumerate(_PTS)
        ]
    )


def visible(i):
    return (F.col("gt_id") + i) % 3 != 0


@query("oks", with_tables(f"SELECT gt_id, candidate, {rnd(oks_sql(), 9, 'oks')} FROM elig", elig=ELIG).replace("e-05e0", "e-05").replace("e-06e0", "e-06"))
def oks(spark, sf):
    """Keypoint similarity of eligible pairs from four derived keypoints with varying visibility."""
    both = boxed_pairs(spark, sf).withColumns({"ka": keypoints(F.col("a"), visible), "kb": keypoints(F.col("b"))})
    value = bx.keypoint_similarity(F.col("ka"), F.col("kb"), bx.area(F.col("a")) * F.lit(0.53), SIGMAS)
    return both.select("gt_id", "candidate", rounded(value).alias("oks"))


@query("eligible_pairs", with_tables(f"SELECT image_id, gt_id, candidate, {rnd('c', 9, 'overlap')}, {rnd('q', 9, 'alignment')} FROM pairs", elig=ELIG, pairs=PAIRS))
def eligible_pairs(spark, sf):
    """Object-candidate pairs with the anchor strictly inside, with overlap and alignment."""
    return pairs_of(spark, sf).select("image_id", "gt_id", "candidate", rounded(F.col("c")).alias("overlap"), rounded(F.col("q")).alias("alignment"))


@query("topk_claims", with_tables("SELECT image_id, gt_id, candidate FROM claims7", **STATE))
def topk_claims(spark, sf):
    """Top-7 claims of each object."""
    return asg.claims(pairs_of(spark, sf), 7).select("image_id", "gt_id", "candidate")


@query(
    "resolve_conflicts",
    held(with_tables(
        f"""SELECT image_id, candidate, gt_id, n_claims, {rnd('q', 9, 'alignment')}, k.best IS NOT NULL AS kept FROM owned7 LEFT JOIN (SELECT DISTINCT image_id AS i, gt_id AS g, candidate AS best FROM kept7) k ON i = image_id AND g = gt_id AND best = candidate""",
        **STATE,
    )),
)
def resolve_conflicts(spark, sf):
    """Owner of every claimed candidate after conflicts, and whether it survives the per-object top-1."""
    owned = shared(asg.owners(asg.flag_claims(pairs_of(spark, sf), 7)))
    kept = asg.keep_best(owned).select("image_id", "gt_id", F.col("candidate").alias("best"))
    out = owned.join(kept, ["image_id", "gt_id"], "left")
    flag = F.coalesce(F.col("best") == F.col("candidate"), F.lit(False))
    return out.select("image_id", "candidate", "gt_id", "n_claims", rounded(F.col("q")).alias("alignment"), flag.alias("kept"))


ACTIVE = """SELECT g.image_id, g.gt_id, k.candidate AS active, k.q AS qa, r.candidate AS runner, r.q AS qr FROM fx_box g LEFT JOIN kept7 k USING (image_id, gt_id)
 LEFT JOIN (SELECT p.image_id, p.gt_id, ARG_MAX(p.candidate, (p.q, -p.candidate)) AS candidate, MAX(p.q) AS q FROM pairs p JOIN kept7 k USING (image_id, gt_id)
  WHERE p.q > 0 AND p.candidate <> k.candidate AND k.q > 1e-12 GROUP BY ALL) r USING (image_id, gt_id)"""


@query("active_margin", with_tables(f"SELECT image_id, gt_id, active, runner, {rnd('(qa - qr) / (qa + 1e-12)', 6, 'margin')} FROM act", **STATE, act=ACTIVE))
def active_margin(spark, sf):
    """Active candidate, runner-up and relative margin of every object."""
    flagged = shared(asg.flag_claims(pairs_of(spark, sf), 7))
    out = asg.active_margin(asg.assign(flagged), flagged, gt_boxes(spark, sf))
    return out.select("image_id", "gt_id", "active", "runner", rounded(F.col("margin"), 6).alias("margin"))


@query(
    "rank_identities",
    with_tables(
        """SELECT g.image_id, g.gt_id, a.x AS unrestricted, b.x AS pre_conflict, o.x AS assigned, COALESCE(o.s, CAST([] AS BIGINT[])) AS positive_set FROM fx_box g
 LEFT JOIN (SELECT gt_id, ARG_MAX(candidate, (q, -candidate)) AS x FROM pairs WHERE q > 0 GROUP BY gt_id) a USING (gt_id)
 LEFT JOIN (SELECT gt_id, ARG_MAX(candidate, (q, -candidate)) AS x FROM claims10 GROUP BY gt_id) b USING (gt_id)
 LEFT JOIN (SELECT gt_id, ARG_MAX(candidate, (q, -candidate)) AS x, LIST_SORT(LIST(candidate)) AS s FROM owned10 GROUP BY gt_id) o USING (gt_id)""",
        **STATE,
    ),
)
def rank_identities(spark, sf):
    """Unrestricted, pre-conflict and assigned identities, and the positive set, of the one-to-many assignment."""
    flagged = shared(asg.flag_claims(pairs_of(spark, sf), 10))
    return asg.rank_identities(flagged, asg.owners(flagged), gt_boxes(spark, sf))


def _replay_sql(k: int, lock: bool, single: bool, tag: str) -> dict[str, str]:
    """Independent form: the whole assignment per shifted object, other objects at base."""
    inside = (
        f"JOIN pairs b ON b.gt_id = m.gt_id AND b.candidate = c.candidate" if lock else ""
    )
    where = "" if lock else "WHERE " + inside_sql("m.")
    c = ciou_sql("m.gx1 m.gy1 m.gx2 m.gy2", "c.x1 c.y1 c.x2 c.y2")
    steps = {
        f"sp{tag}": f"""SELECT m.image_id, m.gt_id, m.direction, c.candidate, c.p, GREATEST({c}, 0e0) AS c FROM moves m JOIN fx_cand c ON m.img = c.img {inside} {where}""",
        f"sq{tag}": f"SELECT *, SQRT(p) * ((c * c * c) * (c * c * c)) AS q FROM sp{tag}",
        f"sc{tag}": claims_sql(k, f"sq{tag}", "image_id, gt_id, direction"),
        # Per shifted object and candidate: its own row beside the rows of every other object at base.
        f"so{tag}": f"""SELECT f.image_id, f.gt_id, f.direction, f.candidate, f.q FROM sq{tag} f
 LEFT JOIN sc{tag} mine USING (image_id, gt_id, direction, candidate)
 LEFT JOIN (SELECT f2.gt_id, f2.direction, f2.candidate, COUNT(cl.gt_id) AS n, ARG_MAX(o.gt_id, (o.c, -o.gt_id)) AS bg, MAX(o.c) AS bc FROM sq{tag} f2 JOIN pairs o ON o.candidate = f2.candidate AND o.gt_id <> f2.gt_id
   LEFT JOIN claims{k} cl ON cl.gt_id = o.gt_id AND cl.candidate = o.candidate GROUP BY ALL) r ON r.gt_id = f.gt_id AND r.direction = f.direction AND r.candidate = f.candidate
 WHERE CASE WHEN COALESCE(r.n, 0) + (mine.gt_id IS NOT NULL)::INT = 1 THEN mine.gt_id IS NOT NULL WHEN COALESCE(r.n, 0) + (mine.gt_id IS NOT NULL)::INT > 1 THEN r.bc IS NULL OR f.c > r.bc OR (f.c = r.bc AND f.gt_id < r.bg) ELSE FALSE END""",
        f"sk{tag}": f"SELECT image_id, gt_id, direction, ARG_MAX(candidate, (q, -candidate)) AS active FROM so{tag} GROUP BY ALL",
    }
    return steps


_MOVES = _moves_sql("(0.1e0 * SQRT(CAST(w * h AS DOUBLE)))", "(0.1e0 * SQRT(CAST(w * h AS DOUBLE)))") + f" WHERE gx1 + ux * (0.1e0 * SQRT(CAST(w * h AS DOUBLE))) >= 0 AND gy1 + uy * (0.1e0 * SQRT(CAST(w * h AS DOUBLE))) >= 0 AND gx2 + ux * (0.1e0 * SQRT(CAST(w * h AS DOUBLE))) <= {IMAGE_SIDE} AND gy2 + uy * (0.1e0 * SQRT(CAST(w * h AS DOUBLE))) <= {IMAGE_SIDE}"


def moved_boxes(g: DataFrame) -> DataFrame:
    delta = F.lit(KAPPA) * F.sqrt((F.col("w") * F.col("h")).cast("double"))
    return asg.shifted_truth(g, delta, delta, IMAGE_SIDE, IMAGE_SIDE)


def moved_truth(spark, sf) -> DataFrame:
    return moved_boxes(gt_boxes(spark, sf))


def replay_inputs(spark, sf, lock=False):
    """Moved objects and the ranked pairs of base and moved boxes. The base pairs are stored; those of the moved boxes, four
    times as many, are made again where two branches need them.
    """
    g, c = dealt_tables(spark, sf)
    m = moved_boxes(g)
    pairs = shared(asg.rank_pairs(asg.eligible_pairs(g, c)))
    native = asg.rank_pairs(asg.eligible_pairs(m, c, base=g, extra=["direction"]), extra=["direction"])
    locked = asg.rank_pairs(asg.locked_pairs(pairs, m, c, extra=["direction"]), extra=["direction"]) if lock else None
    return m, pairs, native, locked


def endpoint_rows(moved, pairs, shifted, many=False) -> DataFrame:
    """Base and shifted one-to-one identity (or one-to-many rank) of each object and direction."""
    extra = ["direction"]
    obj, key = ["image_id", "gt_id"], ["image_id", "gt_id", *extra]
    flagged = asg.flag_claims(pairs, 10 if many else 7)
    if many:
        base = _best(asg.owners(flagged), obj)
        after = _best(asg.replay(flagged, shifted, k=10, extra=extra, single=False), key)
    else:
        base = asg.active_of(asg.assign(flagged), obj)
        after = asg.active_of(asg.replay(flagged, shifted, k=7, extra=extra, single=True), key)
    return asg.endpoint(moved, base, after, extra)


def _best(owned, keys):
    return owned.groupBy(*keys).agg(F.max_by("candidate", F.struct(F.col("q"), (-F.col("candidate")).alias("m"))).alias("active"))


@query(
    "replay_endpoint",
    with_tables(
        """SELECT image_id, gt_id, COUNT(*) AS legal_directions, MAX(f1) AS o2o_fragile, AVG(f1) + 0e0 AS o2o_flip_rate, MAX(f2) AS o2m_fragile, AVG(f2) + 0e0 AS o2m_flip_rate FROM (
 SELECT m.image_id, m.gt_id, CASE WHEN b.candidate IS DISTINCT FROM s.active THEN 1 ELSE 0 END AS f1, CASE WHEN b2.active IS DISTINCT FROM s2.active THEN 1 ELSE 0 END AS f2
 FROM moves m LEFT JOIN kept7 b USING (image_id, gt_id) LEFT JOIN ska s USING (image_id, gt_id, direction)
 LEFT JOIN (SELECT image_id, gt_id, ARG_MAX(candidate, (q, -candidate)) AS active FROM owned10 GROUP BY ALL) b2 USING (image_id, gt_id) LEFT JOIN skb s2 USING (image_id, gt_id, direction)) q GROUP BY ALL""",
        **STATE, moves=_MOVES, **_replay_sql(7, False, True, "a"), **_replay_sql(10, False, False, "b"),
    ),
)
def replay_endpoint(spark, sf):
    """Any-direction fragility and flip rate of both assignments under a 0.1 equivalent-side shift."""
    moved, pairs, native, _ = replay_inputs(spark, sf)
    one = endpoint_rows(moved, pairs, native).select("image_id", "gt_id", "direction", F.col("flip").alias("o2o_flip"))
    many = endpoint_rows(moved, pairs, native, many=True).select("image_id", "gt_id", "direction", F.col("flip").alias("o2m_flip"))
    return es.object_fragility(one.join(many, ["image_id", "gt_id", "direction"]), ["image_id", "gt_id"], ["o2o", "o2m"])


@query(
    "eligibility_lock",
    with_tables(
        f"""SELECT *, {rnd('native_gap - lock_gap', 9, 'gap_reduction')}, {rnd('(native_gap - lock_gap) / NULLIF(native_gap, 0)', 6, 'fraction_removed')} FROM (SELECT {rnd('nt', 9, 'native_tiny')}, {rnd('ns', 9, 'native_small')}, {rnd('lt', 9, 'lock_tiny')}, {rnd('ls', 9, 'lock_small')}, {rnd('nt - ns', 9, 'native_gap')}, {rnd('lt - ls', 9, 'lock_gap')} FROM (
 SELECT {wm('f1', "size_bin = 't_8_16'")} AS nt, {wm('f1', "size_bin = 's_16_32'")} AS ns, {wm('f2', "size_bin = 't_8_16'")} AS lt, {wm('f2', "size_bin = 's_16_32'")} AS ls FROM (
 SELECT m.gt_id, ANY_VALUE(r.sampling_weight) AS sampling_weight, ANY_VALUE(CASE WHEN SQRT(CAST(g.w * g.h AS DOUBLE)) < 16 THEN 't_8_16' ELSE 's_16_32' END) AS size_bin,
 MAX(CASE WHEN b.candidate IS DISTINCT FROM s.active THEN 1 ELSE 0 END) AS f1, MAX(CASE WHEN b.candidate IS DISTINCT FROM s2.active THEN 1 ELSE 0 END) AS f2
 FROM moves m JOIN fx_roster r USING (image_id) JOIN fx_gt g USING (gt_id) LEFT JOIN kept7 b USING (gt_id) LEFT JOIN ska s USING (gt_id, direction) LEFT JOIN skl s2 USING (gt_id, direction) GROUP BY m.gt_id) q) z) y""",
        **STATE, moves=_MOVES, **_replay_sql(7, False, True, "a"), **_replay_sql(7, True, True, "l"),
    ),
)
def eligibility_lock(spark, sf):
    """Native against eligibility-locked fragility: size gaps, reduction and fraction removed."""
    key = ["image_id", "gt_id", "direction"]
    moved, pairs, shifted, locked = replay_inputs(spark, sf, lock=True)
    native = endpoint_rows(moved, pairs, shifted).select(*key, F.col("flip").alias("o2o_flip"))
    lock = endpoint_rows(moved, pairs, locked).select(*key, F.col("flip").alias("o2m_flip"))
    obj = es.object_fragility(native.join(lock, key), ["image_id", "gt_id"], ["o2o", "o2m"])
    g = gt_boxes(spark, sf).select("image_id", "gt_id", size_bin(F.col("w") * F.col("h")).alias("size_bin"))
    obj = obj.join(g, ["image_id", "gt_id"]).join(roster(spark, sf).select("image_id", W), "image_id")
    r = es.size_contrasts(obj, [])
    out = r.select(
        *[rounded(F.col(f"{a}_{s}")).alias(f"{n}_{s}") for a, n in (("o2o", "native"), ("o2m", "lock")) for s in ("tiny", "small", "gap")]
    )
    cut = F.col("native_gap") - F.col("lock_gap")
    return out.select("*", rounded(cut).alias("gap_reduction"), rounded(cut / F.nullif(F.col("native_gap"), F.lit(0.0)), 6).alias("fraction_removed"))


@query(
    "shared_claims",
    with_tables(
        """SELECT a.image_id, a.gt_id AS focal_gt, b.gt_id AS neighbor_gt, COUNT(*) AS n_shared FROM claims7 a JOIN claims7 b ON a.image_id = b.image_id AND a.candidate = b.candidate AND a.gt_id <> b.gt_id GROUP BY ALL""",
        **STATE,
    ),
)
def shared_claims(spark, sf):
    """Object pairs that claim a common candidate before conflicts."""
    return asg.shared_claims(asg.claims(pairs_of(spark, sf), 7))
