"""Suppression, matching, evaluation, annotation and vector queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import boxes as bx
from ..functions.bins import rounded
from ..functions.boxes import keypoint_similarity
from ..operators import dataset as ds
from ..operators import detection as dt
from ..operators import resample as rs
from ..session import shared
from .estimate_queries import _round_all
from .fixtures import candidates, gt_boxes, table
from .geometry_queries import SIGMAS, keypoints, oks_sql, probiou_sql, visible
from .oracle import held, inter_sql, iou_sql, rnd, with_tables
from .registry import query
from .resample_queries import SEED, draw_sql


def detections(spark, sf) -> DataFrame:
    return candidates(spark, sf).select("image_id", F.col("candidate").alias("det"), "cls", F.col("p").alias("conf"), "box")


def truth(spark, sf) -> DataFrame:
    return gt_boxes(spark, sf).withColumn("cls", (F.col("gt_id") % 3).cast("int"))


DET = "SELECT image_id, img, candidate AS det, cls, p AS conf, x1, y1, x2, y2 FROM fx_cand"
_SELF = iou_sql("o.x1 o.y1 o.x2 o.y2", "d.x1 d.y1 d.x2 d.y2")


@query(
    "nms_fast",
    with_tables(
        f"SELECT d.image_id, d.cls, d.det, {rnd('d.conf', 9, 'conf')} FROM det d WHERE NOT EXISTS (SELECT 1 FROM det o WHERE o.img = d.img AND o.cls = d.cls AND (o.conf > d.conf OR (o.conf = d.conf AND o.det < d.det)) AND {_SELF} >= 0.7)",
        det=DET,
    ),
)
def nms_fast(spark, sf):
    """Fast suppression at 0.7."""
    return dt.fast_nms(detections(spark, sf), 0.7).select("image_id", "cls", "det", rounded(F.col("conf")).alias("conf"))


@query(
    "nms_greedy",
    held(with_tables(
        f"""SELECT image_id, cls, det, {rnd('conf', 9, 'conf')} FROM kept""",
        det=DET,
        ranked="SELECT *, ROW_NUMBER() OVER (PARTITION BY image_id, cls ORDER BY conf DESC, det) AS r FROM det",
        edges=f"SELECT d.image_id, d.cls, d.r, LIST(o.r) AS above FROM ranked d JOIN ranked o ON o.img = d.img AND o.cls = d.cls AND o.r < d.r AND ({inter_sql('o.x1 o.y1 o.x2 o.y2', 'd.x1 d.y1 d.x2 d.y2')}) / ((o.x2-o.x1)*(o.y2-o.y1) + (d.x2-d.x1)*(d.y2-d.y1) - ({inter_sql('o.x1 o.y1 o.x2 o.y2', 'd.x1 d.y1 d.x2 d.y2')})) > 0.6 GROUP BY ALL",
        seq="SELECT image_id, cls, LIST({'r': r, 'above': COALESCE(above, CAST([] AS BIGINT[]))} ORDER BY r) AS s FROM ranked LEFT JOIN edges USING (image_id, cls, r) GROUP BY ALL",
        fold="SELECT image_id, cls, UNNEST(LIST_REDUCE(s, lambda acc, x: CASE WHEN LIST_HAS_ANY(acc, x.above) THEN acc ELSE LIST_APPEND(acc, x.r) END, CAST([] AS BIGINT[]))) AS r FROM seq",
        kept="SELECT k.* FROM ranked k JOIN fold USING (image_id, cls, r)",
    )),
)
def nms_greedy(spark, sf):
    """Greedy suppression at 0.6 per image and class."""
    return dt.greedy_nms(detections(spark, sf), 0.6).select("image_id", "cls", "det", rounded(F.col("conf")).alias("conf"))


PAIR = f"SELECT d.image_id, d.det, d.conf, d.cls, g.gt_id, g.gcls, {iou_sql('g.gx1 g.gy1 g.gx2 g.gy2', 'd.x1 d.y1 d.x2 d.y2')} AS sim FROM det d JOIN fx_box g ON g.img = d.img"
MATCH = """SELECT gt_id, image_id, threshold, det FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY gt_id, threshold ORDER BY conf DESC, det) AS r2 FROM (
 SELECT p.*, t.threshold, ROW_NUMBER() OVER (PARTITION BY det, threshold ORDER BY sim DESC, gt_id) AS r1 FROM PAIRS p CROSS JOIN (SELECT UNNEST(RANGE(50, 100, 5)) AS threshold) t WHERE sim >= threshold / 100e0) a WHERE r1 = 1) b WHERE r2 = 1"""
EVAL = {"det": DET, "pair": PAIR, "cpair": "SELECT * FROM pair WHERE cls = gcls AND sim >= 0.5", "tpm": MATCH.replace("PAIRS", "cpair")}


def matches(spark, sf) -> DataFrame:
    return dt.match(dt.overlap_pairs(detections(spark, sf), truth(spark, sf), 0.5))


@query("match_tp", with_tables("SELECT gt_id, threshold, det FROM tpm", **EVAL))
def match_tp(spark, sf):
    """True positives at ten thresholds."""
    return matches(spark, sf).select("gt_id", "threshold", "det")


@query(
    "confusion",
    with_tables(
        """SELECT predicted, actual, COUNT(*) AS n FROM (SELECT COALESCE(m.cls, 3) AS predicted, g.gcls AS actual FROM fx_box g LEFT JOIN cm m USING (gt_id)
 UNION ALL SELECT d.cls, 3 FROM det d WHERE conf > 0.25 AND NOT EXISTS (SELECT 1 FROM cm m WHERE m.det = d.det)) q GROUP BY ALL""",
        **EVAL,
        cm="""SELECT gt_id, det, cls FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY gt_id ORDER BY sim DESC, det) AS r2 FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY det ORDER BY sim DESC, gt_id) AS r1 FROM pair WHERE conf > 0.25 AND sim > 0.45) a WHERE r1 = 1) b WHERE r2 = 1""",
    ),
)
def confusion(spark, sf):
    """Confusion matrix with background row and column."""
    return dt.confusion(detections(spark, sf), truth(spark, sf), 3)


CUM = """SELECT d.cls, t.threshold, d.conf, ROW_NUMBER() OVER w AS rn, SUM(CASE WHEN m.det IS NOT NULL THEN 1 ELSE 0 END) OVER w AS tpc, n.n FROM det d CROSS JOIN (SELECT UNNEST(THR) AS threshold) t
 LEFT JOIN tpm m ON m.det = d.det AND m.threshold = t.threshold JOIN (SELECT gcls AS cls, COUNT(*) AS n FROM fx_box GROUP BY gcls) n ON n.cls = d.cls WINDOW w AS (PARTITION BY d.cls, t.threshold ORDER BY d.conf DESC, d.det ROWS UNBOUNDED PRECEDING)"""


@query(
    "average_precision",
    with_tables(
        f"""SELECT cls, threshold, {rnd('0.01e0 * SUM(y * CASE WHEN i IN (0, 100) THEN 0.5e0 ELSE 1e0 END)', 9, 'ap')} FROM (
 SELECT g.cls, g.threshold, g.i, CASE WHEN a.nxt IS NULL THEN 0e0 ELSE a.env + (g.i / 100e0 - a.t / a.n::DOUBLE) * a.n * (a.nxt - a.env) END AS y FROM (SELECT DISTINCT cls, threshold, n, i FROM cum CROSS JOIN (SELECT UNNEST(RANGE(101)) AS i) z) g
 LEFT JOIN steps a ON a.cls = g.cls AND a.threshold = g.threshold AND a.t = CAST(FLOOR(g.i * g.n / 100) AS BIGINT)) q GROUP BY cls, threshold""",
        **EVAL, cum=CUM.replace("THR", "RANGE(50, 100, 5)"),
        env="SELECT *, MAX(tpc::DOUBLE / rn) OVER (PARTITION BY cls, threshold ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS e FROM (SELECT * FROM cum UNION ALL SELECT DISTINCT cls, threshold, 2e0, 0, 0, n FROM cum) u WHERE rn > 0",
        steps="""SELECT cls, threshold, t, n, env, LEAD(hi) OVER (PARTITION BY cls, threshold ORDER BY t) AS nxt FROM (
 SELECT cls, threshold, tpc AS t, n, ARG_MAX(e, rn) AS env, MAX(e) AS hi FROM (SELECT cls, threshold, tpc, rn, n, e FROM env UNION ALL SELECT DISTINCT cls, threshold, 0::HUGEINT, 0, n, 1e0 FROM cum) v GROUP BY ALL) s""",
    ),
)
def average_precision(spark, sf):
    """Interpolated average precision per class and threshold."""
    d, t = detections(spark, sf), truth(spark, sf)
    scored = shared(dt.scored_detections(d, matches(spark, sf)))
    return _round_all(dt.average_precision(scored, t))


@query(
    "f1_threshold",
    with_tables(
        f"""SELECT c.cls, {rnd('c.i / 999e0', 9, 'confidence')}, {rnd('p', 9, 'precision')}, {rnd('r', 9, 'recall')}, {rnd('f1', 9, 'f1')}, CAST(ROUND_EVEN(r * n, 0) AS BIGINT) AS tp, CAST(ROUND_EVEN(ROUND_EVEN(r * n, 0) / (p + 1e-16) - ROUND_EVEN(r * n, 0), 0) AS BIGINT) AS fp
 FROM curves c JOIN (SELECT ARG_MAX(i, (sm, -i)) AS i FROM smooth_) b USING (i)""",
        **EVAL, cum=CUM.replace("THR", "[50]"),
        ties="SELECT cls, n, conf, ARG_MIN({'r': rn, 's': tpc}, rn) AS f, ARG_MAX({'r': rn, 's': tpc}, rn) AS l FROM cum GROUP BY ALL",
        grid="SELECT cls, n, i, i / 999e0 AS x FROM (SELECT DISTINCT cls, n FROM cum) c CROSS JOIN (SELECT UNNEST(RANGE(1000)) AS i) g",
        near="""SELECT g.cls, g.n, g.i, g.x, a.conf AS ca, a.l.s / a.l.r::DOUBLE AS pa, a.l.s / g.n::DOUBLE AS ra, b.conf AS cb, b.f.s / b.f.r::DOUBLE AS pb, b.f.s / g.n::DOUBLE AS rb FROM grid g
 LEFT JOIN ties a ON a.cls = g.cls AND a.conf = (SELECT MIN(conf) FROM ties z WHERE z.cls = g.cls AND FLOOR(z.conf * 999) >= g.i) LEFT JOIN ties b ON b.cls = g.cls AND b.conf = (SELECT MAX(conf) FROM ties z WHERE z.cls = g.cls AND FLOOR(z.conf * 999) < g.i)""",
        curves="""SELECT *, 2e0 * p * r / (p + r + 1e-16) AS f1 FROM (SELECT cls, n, i, CASE WHEN ca IS NULL THEN 1e0 WHEN cb IS NULL THEN pa ELSE pa + (ca - x) / (ca - cb) * (pb - pa) END AS p, CASE WHEN ca IS NULL THEN 0e0 WHEN cb IS NULL THEN ra ELSE ra + (ca - x) / (ca - cb) * (rb - ra) END AS r FROM near) q""",
        mean_="SELECT i, AVG(f1) AS f1 FROM curves GROUP BY i",
        smooth_="""SELECT a.i, ROUND(SUM(b.f1) / 101, 9) AS sm FROM mean_ a CROSS JOIN (SELECT UNNEST(RANGE(-50, 51)) AS k) k JOIN mean_ b ON b.i = LEAST(GREATEST(a.i + k.k, 0), 999) GROUP BY a.i""",
    ),
)
def f1_threshold(spark, sf):
    """Confidence that maximises the smoothed mean F1, with class metrics there."""
    d, t = detections(spark, sf), truth(spark, sf)
    scored = dt.scored_detections(d, matches(spark, sf), [50])
    return _round_all(dt.best_confidence(shared(dt.confidence_curves(scored, t))))


@query(
    "image_prf",
    with_tables(
        f"""SELECT image_id, {rnd('CASE WHEN pr = 0 AND ta = 0 THEN 1e0 ELSE p END', 9, 'precision')}, {rnd('CASE WHEN pr = 0 AND ta = 0 THEN 1e0 ELSE r END', 9, 'recall')}, {rnd('CASE WHEN pr = 0 AND ta = 0 THEN 1e0 WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0e0 END', 9, 'f1')}, tp, pr - tp AS fp, ta - tp AS fn FROM (
 SELECT *, CASE WHEN pr > 0 THEN tp::DOUBLE / pr ELSE 0e0 END AS p, CASE WHEN ta > 0 THEN tp::DOUBLE / ta ELSE 0e0 END AS r FROM (
 SELECT CAST(c_custkey AS VARCHAR) AS image_id, COALESCE(d.n, 0) AS pr, COALESCE(g.n, 0) AS ta, COALESCE(m.n, 0) AS tp FROM customer c
 LEFT JOIN (SELECT image_id, COUNT(*) AS n FROM det GROUP BY ALL) d ON d.image_id = CAST(c_custkey AS VARCHAR) LEFT JOIN (SELECT image_id, COUNT(*) AS n FROM fx_box WHERE gt_id % 5 <> 0 GROUP BY ALL) g ON g.image_id = CAST(c_custkey AS VARCHAR)
 LEFT JOIN (SELECT image_id, COUNT(*) AS n FROM tpm WHERE threshold = 50 GROUP BY ALL) m ON m.image_id = CAST(c_custkey AS VARCHAR)) a) b""",
        det=DET + " WHERE candidate % 7 <> 0", pair=PAIR + " WHERE g.gt_id % 5 <> 0", cpair=EVAL["cpair"], tpm=EVAL["tpm"],
    ),
)
def image_prf(spark, sf):
    """Per-image precision, recall and F1 at 0.5."""
    d, t = detections(spark, sf).filter("det % 7 <> 0"), truth(spark, sf).filter("gt_id % 5 <> 0")
    m = dt.match(dt.overlap_pairs(d, t, 0.5), [50])
    images = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("image_id"))
    return _round_all(dt.image_prf(d, t, m, images))


@query(
    "topk_accuracy",
    f"""SELECT o_orderstatus, COUNT(*) AS n, {rnd('AVG(CASE WHEN pos = 1 THEN 1e0 ELSE 0e0 END)', 9, 'top1')}, {rnd('AVG(CASE WHEN pos BETWEEN 1 AND 5 THEN 1e0 ELSE 0e0 END)', 9, 'topk')} FROM (
 SELECT o_orderstatus, LIST_POSITION(LIST_TRANSFORM(RANGE(10), lambda i: (o_orderkey * 7 + i * 3) % 10), o_custkey % 10) AS pos FROM orders) q GROUP BY o_orderstatus""",
)
def topk_accuracy(spark, sf):
    """Top-1 and top-5 accuracy of ranked class arrays derived from the orders."""
    ranked = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: (F.col("o_orderkey") * 7 + i * 3) % 10)
    o = table(spark, sf, "orders").select("o_orderstatus", (F.col("o_custkey") % 10).alias("target"), ranked.alias("ranked"))
    return _round_all(dt.topk_accuracy(o, "target", "ranked", ["o_orderstatus"]))


# The numbers missing from the 1..90 category ids.
_GAPS = "[12, 26, 29, 30, 45, 66, 68, 69, 71, 83]"


@query(
    "coco_to_labels",
    with_tables(
        f"""SELECT DISTINCT image_id, cls, {rnd('cx', 9, 'cx')}, {rnd('cy', 9, 'cy')}, {rnd('w', 9, 'w')}, {rnd('h', 9, 'h')} FROM (
 SELECT image_id, cat - 1 - LEN(LIST_FILTER({_GAPS}, lambda g: g < cat)) AS cls, (l + bw / 2) / 1024e0 AS cx, (t + bh / 2) / 768e0 AS cy, bw / 1024e0 AS w, bh / 768e0 AS h FROM (
 SELECT image_id, [1, 11, 13, 25, 27, 44, 67, 90][1 + gt_id % 8] AS cat, cx - w / 2e0 AS l, cy - h / 2e0 AS t, w - CASE WHEN gt_id % 19 = 0 THEN w ELSE 0 END::DOUBLE AS bw, h::DOUBLE AS bh FROM fx_gt WHERE gt_id % 23 <> 0) a) b WHERE w > 0 AND h > 0"""
    ),
)
def coco_to_labels(spark, sf):
    """Normalised label rows from annotations (crowds, empty boxes and duplicates injected)."""
    i = F.col("gt_id")
    cats = F.array(*[F.lit(c) for c in (1, 11, 13, 25, 27, 44, 67, 90)])
    g = gt_boxes(spark, sf)
    width = F.when(i % 19 == 0, 0.0).otherwise(F.col("w").cast("double"))
    ann = g.select(
        "image_id", F.element_at(cats, (i % 8 + 1).cast("int")).alias("category_id"), (i % 23 == 0).cast("int").alias("iscrowd"),
        F.array(F.col("box.x1"), F.col("box.y1"), width, F.col("h").cast("double")).alias("bbox"), "gt_id",
    )
    ann = ann.unionByName(ann.filter(i % 31 == 0)).drop("gt_id")
    images = g.select("image_id").distinct().withColumns({"width": F.lit(1024.0), "height": F.lit(768.0)})
    return _round_all(ds.coco_to_labels(images, ann))


def sized_images(spark, sf) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(k.cast("string").alias("image_id"), (500 + k % 5 * 190).cast("int").alias("width"), (450 + k % 7 * 150).cast("int").alias("height"))


WIN = """SELECT image_id, x AS x_start, y AS y_start, x + 512 AS x_stop, y + 512 AS y_stop, rate FROM (SELECT *, MAX(rate) OVER (PARTITION BY image_id) AS best FROM (
 SELECT *, (LEAST(x + 512, w) - x) * (LEAST(y + 512, h) - y) / 262144e0 AS rate FROM (SELECT image_id, w, h,
 CASE WHEN i = xn - 1 AND xn > 1 AND i * 412 + 512 > w THEN w - 512 ELSE i * 412 END AS x, CASE WHEN j = yn - 1 AND yn > 1 AND j * 412 + 512 > h THEN h - 512 ELSE j * 412 END AS y FROM (
 SELECT *, UNNEST(RANGE(yn)) AS j FROM (SELECT *, UNNEST(RANGE(xn)) AS i FROM (SELECT *, CASE WHEN w <= 512 THEN 1 ELSE CAST(CEIL((w - 512) / 412e0 + 1) AS BIGINT) END AS xn, CASE WHEN h <= 512 THEN 1 ELSE CAST(CEIL((h - 512) / 412e0 + 1) AS BIGINT) END AS yn FROM (
 SELECT CAST(c_custkey AS VARCHAR) AS image_id, 500 + c_custkey % 5 * 190 AS w, 450 + c_custkey % 7 * 150 AS h FROM customer) a) b) c) d) e) f) g WHERE CASE WHEN best > 0.6 THEN rate > 0.6 ELSE ABS(rate - best) < 0.01 END"""
_WIN_INTER = inter_sql("b.gx1 b.gy1 b.gx2 b.gy2", "win.x_start win.y_start win.x_stop win.y_stop")


@query(
    "tile_windows",
    with_tables(
        f"""SELECT image_id, x_start, y_start, {rnd('rate', 9, 'rate')}, COUNT(gt_id) AS n_objects, {rnd('COALESCE(SUM(gx1 - x_start), 0)', 6, 'sum_x')} FROM (
 SELECT win.*, b.gt_id, b.gx1 FROM win LEFT JOIN fx_box b ON b.image_id = win.image_id AND ({_WIN_INTER}) / ((b.gx2 - b.gx1) * (b.gy2 - b.gy1)) >= 0.7) q GROUP BY image_id, x_start, y_start, rate""",
        win=WIN,
    ),
)
def tile_windows(spark, sf):
    """Crop windows per image with the objects assigned to each."""
    wins = ds.windows(sized_images(spark, sf), 512, 100)
    objs = ds.window_objects(gt_boxes(spark, sf), wins, 512)
    per = objs.groupBy("image_id", "x_start", "y_start").agg(F.count("*").alias("n_objects"), F.sum("x1").alias("sum_x"))
    out = wins.join(per, ["image_id", "x_start", "y_start"], "left").na.fill(0, ["n_objects"]).na.fill(0.0, ["sum_x"])
    return out.select("image_id", "x_start", "y_start", rounded(F.col("rate")).alias("rate"), "n_objects", rounded(F.col("sum_x"), 6).alias("sum_x"))


@query(
    "tile_merge",
    with_tables(
        f"SELECT d.image_id, d.cls, d.det FROM merged d WHERE NOT EXISTS (SELECT 1 FROM merged o WHERE o.image_id = d.image_id AND o.cls = d.cls AND (o.conf > d.conf OR (o.conf = d.conf AND o.det < d.det)) AND {probiou_sql('o.cx o.cy o.w o.h o.r', 'd.cx d.cy d.w d.h d.r')} >= 0.3)",
        merged="""SELECT image_id, candidate AS det, cls, p AS conf, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy, x2 - x1 AS w, y2 - y1 AS h, (candidate % 8) / 7e0 AS r FROM fx_cand""",
    ),
)
def tile_merge(spark, sf):
    """Tile detections moved back by their tile names and merged by rotated fast suppression."""
    d = detections(spark, sf)
    ox, oy = F.floor(F.col("box.x1") / 100).cast("int") * 100, F.floor(F.col("box.y1") / 100).cast("int") * 100
    b = bx.xyxy_to_xywh(F.col("box"))
    rot = F.struct((b["cx"] - ox).alias("cx"), (b["cy"] - oy).alias("cy"), b["w"].alias("w"), b["h"].alias("h"), ((F.col("det") % 8) / 7.0).alias("r"))
    tiles = d.select(F.format_string("%s__512__%d___%d", "image_id", ox, oy).alias("tile"), "det", "cls", "conf", rot.alias("rot"))
    return dt.tile_merge(tiles, "tile").select("image_id", "cls", "det")


_OKS_PAIR = f"SELECT d.image_id, d.det, d.conf, d.cls, g.gt_id, g.gcls, {oks_sql()} AS sim FROM det d JOIN fx_box g ON g.img = d.img"


@query(
    "match_oks",
    with_tables("SELECT gt_id, threshold, det FROM tpm", det=DET, pair=_OKS_PAIR, cpair=EVAL["cpair"], tpm=EVAL["tpm"]),
)
def match_oks(spark, sf):
    """True positives by keypoint similarity at ten thresholds."""
    d = candidates(spark, sf).select("image_id", F.col("candidate").alias("det"), "cls", F.col("p").alias("conf"), keypoints(F.col("box")).alias("kpts"))
    t = truth(spark, sf).select("image_id", "gt_id", "cls", keypoints(F.col("box"), visible).alias("kpts"), (bx.area(F.col("box")) * F.lit(0.53)).alias("area"))
    pairs = dt.keypoint_pairs(d, t, 0.5, keypoint_similarity, SIGMAS)
    return dt.match(pairs).select("gt_id", "threshold", "det")


@query(
    "vector_topk",
    """WITH v AS (SELECT vec_id, LIST_TRANSFORM(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), u AS (SELECT vec_id, LIST_TRANSFORM(e, lambda x: x / SQRT(LIST_SUM(LIST_TRANSFORM(e, lambda y: y * y)))) AS n FROM v),
 s AS (SELECT q.vec_id AS query, u.vec_id, LIST_SUM(LIST_TRANSFORM(RANGE(1, 65), lambda i: u.n[i] * q.n[i])) AS sim FROM u CROSS JOIN (SELECT * FROM u WHERE vec_id % 100 = 0) q)
 SELECT query, vec_id, ROUND(sim, 6) + 0e0 AS similarity, r AS rank FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY query ORDER BY sim DESC, vec_id) AS r FROM s WHERE sim >= 0.1) z WHERE r <= 10""",
)
def vector_topk(spark, sf):
    """Ten nearest vectors by cosine for every hundredth vector."""
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    out = dt.vector_topk(e, e.filter("vec_id % 100 = 0"), "vec_id", "embedding", 10, 0.1)
    return out.select("query", "vec_id", rounded(F.col("similarity"), 6).alias("similarity"), "rank")


_U = f"({draw_sql(f'{SEED}, image_id')} / 4294967296e0)"


@query(
    "dataset_stats",
    with_tables(
        """SELECT split, cls, COUNT(*) AS instances, COUNT(DISTINCT image_id) AS images FROM lab GROUP BY ALL
 UNION ALL SELECT split, -1, 0, COUNT(*) FILTER (WHERE image_id NOT IN (SELECT image_id FROM lab)) FROM img GROUP BY split""",
        img=f"SELECT image_id, CASE WHEN {_U} < 0.9e0 THEN 'train' ELSE 'val' END AS split FROM (SELECT CAST(c_custkey AS VARCHAR) AS image_id FROM customer) c",
        lab="SELECT g.image_id, split, gt_id % 3 AS cls FROM fx_gt g JOIN img USING (image_id) WHERE gt_id % 4 <> 1",
    ),
)
def dataset_stats(spark, sf):
    """Instances and images per split and class; class -1 counts the unlabelled images."""
    images = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("image_id"))
    images = rs.split_assign(images, F.col("image_id"), (0.9, 0.1), SEED, ("train", "val"))
    labels = truth(spark, sf).filter("gt_id % 4 <> 1").select("image_id", "cls").join(images, "image_id")
    per = ds.class_statistics(labels, "split", "cls", "image_id")
    none = ds.split_statistics(images, labels, "split", "image_id").select(
        "split", F.lit(-1).alias("cls"), F.lit(0).cast("long").alias("instances"), F.col("unlabelled").alias("images")
    )
    return per.unionByName(none)


@query(
    "category_frequency",
    "SELECT name, COUNT(*) AS frequency FROM (SELECT TRIM(UNNEST(STRING_SPLIT(REPLACE(p_name, ' ', '/'), '/'))) AS name FROM part) q GROUP BY name",
)
def category_frequency(spark, sf):
    """Frequency of the words of slash-separated part names."""
    p = table(spark, sf, "part").select(F.regexp_replace("p_name", " ", "/").alias("names"))
    return ds.category_frequency(p, "names")
