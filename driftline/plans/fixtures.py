"""Derived tables: objects, roster, rays, curves, candidates, sets and tracks, built by Spark from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.boxes import box
from ..operators.ordered import positions

GRID_STEP = 1024.0
KEYS = ["image_id", "gt_id", "direction"]
RAYS_A_TASK = 50_000


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def gt(spark: SparkSession, sf: str) -> DataFrame:
    """Truth boxes. Objects of one image overlap, so that candidates are contested."""
    n = table(spark, sf, "customer").agg(F.count("*").alias("n")).scalar()
    ids = table(spark, sf, "orders").select(F.floor(F.col("o_orderkey") / 4).cast("long").alias("gt_id")).distinct()
    g = F.col("gt_id")
    return ids.withColumn("_n", n).select(
        "gt_id",
        (g % F.col("_n")).alias("img"),
        (g % F.col("_n")).cast("string").alias("image_id"),
        (8 + g * 13 % 24).alias("w"),
        (8 + g * 7 % 24).alias("h"),
        (100 + F.floor(g / F.col("_n")) * 6).cast("double").alias("cx"),
        (100 + g % F.col("_n") * 53 % 600).cast("double").alias("cy"),
    )


def gt_boxes(spark: SparkSession, sf: str) -> DataFrame:
    """Truth boxes as structs."""
    half_w, half_h = F.col("w") / 2.0, F.col("h") / 2.0
    return gt(spark, sf).select(
        "img",
        "image_id",
        "gt_id",
        "w",
        "h",
        box(F.col("cx") - half_w, F.col("cy") - half_h, F.col("cx") + half_w, F.col("cy") + half_h).alias("box"),
    )


def roster(spark: SparkSession, sf: str) -> DataFrame:
    """Sampling roster: two thirds of the customers, sampled within segment, weight 1/p."""
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    taken = F.col("c_custkey") % 3 != 0
    share = c.groupBy("c_mktsegment").agg((F.count_if(taken).cast("double") / F.count("*")).alias("inclusion_probability"))
    return c.filter(taken).join(share, "c_mktsegment").select(
        F.col("c_custkey").cast("string").alias("image_id"),
        F.col("c_custkey").alias("dataset_index"),
        F.col("c_mktsegment").alias("stratum"),
        (F.lit(1.0) / F.col("inclusion_probability")).alias("sampling_weight"),
        "inclusion_probability",
    )


def rays(spark: SparkSession, sf: str) -> DataFrame:
    """First-change events, one row per (image, object, direction)."""
    o = table(spark, sf, "orders")
    ok = F.col("o_orderkey")
    price = F.floor(F.col("o_totalprice")).cast("long")
    raw = o.select(
        ok.alias("ok"),
        F.floor(ok / 4).cast("long").alias("gt_id"),
        (F.floor(ok / 4).cast("long") % 97).alias("gt_id_mod"),
        F.col("o_orderstatus").alias("st"),
        F.col("o_orderpriority").alias("pr"),
        F.element_at(F.array(*[F.lit(d) for d in ("left", "right", "up", "down")]), (ok % 4 + 1).cast("int")).alias("direction"),
        (1 + price % 256).alias("k"),
        (1 + price * 3 % 256).alias("k2"),
        (128 + ok * 31 % 129).alias("lim"),
    )
    r = raw.join(gt(spark, sf).select("gt_id", "image_id", "w", "h"), "gt_id").join(
        roster(spark, sf).select("image_id", "stratum", "sampling_weight"), "image_id"
    )
    ok, k, k2, lim = F.col("ok"), F.col("k"), F.col("k2"), F.col("lim")
    one = (F.col("st") == "F") & (k <= lim)
    many = (F.col("st") != "P") & (k2 <= lim)
    label = (
        F.when(~one, "right_censored")
        .when(F.col("pr") == "1-URGENT", "eligibility_boundary")
        .when(F.col("pr") == "2-HIGH", "topk_membership_transition")
        .when(F.col("pr") == "3-MEDIUM", "conflict_reassignment")
        .when(F.col("pr") == "4-NOT SPECIFIED", "within_set_geometry_rank_reversal")
        .otherwise("active_disappearance")
    )
    base = F.when(ok % 41 != 0, F.col("gt_id_mod"))
    return r.select(
        "image_id",
        "gt_id",
        "direction",
        "stratum",
        "sampling_weight",
        "w",
        "h",
        F.when(F.sqrt((F.col("w") * F.col("h")).cast("double")) < 16, "t_8_16").otherwise("s_16_32").alias("size_bin"),
        (lim / GRID_STEP).alias("scan_limit"),
        base.alias("o2o_base_active"),
        one.cast("int").alias("o2o_event_observed"),
        F.when(one, k / GRID_STEP).alias("o2o_radius"),
        F.when(~one, lim / GRID_STEP).alias("o2o_censor_radius"),
        label.alias("o2o_first_divergence"),
        F.when(ok % 37 != 0, F.col("gt_id_mod")).alias("o2m_base"),
        many.cast("int").alias("o2m_event_observed"),
        F.when(many, k2 / GRID_STEP).alias("o2m_radius"),
        F.when(~many, lim / GRID_STEP).alias("o2m_censor_radius"),
        "k",
        "lim",
        "ok",
        ((1 + ok * 37 % 1000) / 1000.0).alias("margin"),
        (one & (ok % 3 == 0)).cast("int").alias("rho_observed"),
        (one & (ok % 3 != 0)).cast("int").alias("rho_competing"),
        (~one & (ok % 5 != 0)).cast("int").alias("rho_right"),
        F.when(~one & (ok % 5 == 0), F.when(ok % 2 == 0, "base_runner_missing").otherwise("base_pair_tie")).alias("rho_reason"),
    )


def second_rays(spark: SparkSession, sf: str) -> DataFrame:
    """A second result set of the same rays: the radius is halved on every eleventh, two residues are missing."""
    ok = F.col("ok")
    halved = F.when(ok % 11 == 0, F.floor((F.col("k") + 1) / 2).cast("long")).otherwise(F.col("k"))
    r = rays(spark, sf).filter(~(ok % 101).isin(7, 8))
    observed = (F.col("o2o_event_observed") == 1) & (ok % 53 != 0)
    return r.withColumns(
        {
            "k": halved,
            "o2o_event_observed": observed.cast("int"),
            "o2o_radius": F.when(observed, halved / GRID_STEP),
            "o2o_censor_radius": F.when(~observed, F.col("lim") / GRID_STEP),
            "o2o_first_divergence": F.when(observed, F.col("o2o_first_divergence")).otherwise("right_censored"),
        }
    )


def curve(spark: SparkSession, sf: str) -> DataFrame:
    """Radius curve on a step of 8/1024; one ray in five returns to its base."""
    # A ray becomes up to 33 rows, and what follows groups by ray: the number of tasks follows that of the orders.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), table(spark, sf, "orders").count() // RAYS_A_TASK)
    r = rays(spark, sf).repartition(tasks, *KEYS).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(32))))
    idx = F.col("j") * 8
    changed = (idx >= F.col("k")) & ~((F.col("ok") % 5 == 0) & (idx >= F.col("k") + 64))
    return r.filter(idx <= F.col("lim")).select(
        *KEYS,
        "size_bin",
        "stratum",
        "sampling_weight",
        idx.alias("radius_idx"),
        (idx / GRID_STEP).alias("radius"),
        F.when(changed, F.col("o2o_base_active") + 1).otherwise(F.col("o2o_base_active")).alias("o2o_active"),
        "ok",
    )


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Sixteen candidates per object, with anchor and score."""
    g = gt(spark, sf).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(15))))
    ax = F.col("cx") + (F.col("j") % 4 - 1.5) * 3
    ay = F.col("cy") + (F.floor(F.col("j") / 4) - 1.5) * 3
    half_w, half_h = F.col("w") / 2.0, F.col("h") / 2.0
    return g.select(
        "img",
        "image_id",
        (F.col("gt_id") * 16 + F.col("j")).alias("candidate"),
        box(ax - half_w, ay - half_h, ax + half_w, ay + half_h).alias("box"),
        ax.alias("ax"),
        ay.alias("ay"),
        ((5 + (F.col("gt_id") * 31 + F.col("j") * 17) % 90) / 100.0).alias("p"),
        (F.col("gt_id") % 3).cast("int").alias("cls"),
    )


def sets(spark: SparkSession, sf: str) -> DataFrame:
    """Positive id sets before and after a shift, from the lines of each order. Ids are below 16, so sets are small."""
    line = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    ids = (F.col("l_partkey") % 16).cast("int")
    return line.groupBy(F.col("l_orderkey").alias("ok")).agg(
        F.sort_array(F.collect_set(F.when(F.col("l_linenumber") <= 4, ids))).alias("base_ids"),
        F.sort_array(F.collect_set(F.when(F.col("l_linenumber") >= 3, ids))).alias("shift_ids"),
    )


def ray_sets(spark: SparkSession, sf: str) -> DataFrame:
    return rays(spark, sf).join(sets(spark, sf), "ok")


def tracks(spark: SparkSession, sf: str) -> DataFrame:
    """Track points from the event stream; days are the blocks in which a long track is numbered."""
    e = table(spark, sf, "events").select(
        (F.col("user_id") % 16).alias("video_id"),
        F.col("user_id").alias("track_id"),
        "ts",
        F.col("event_type").alias("cls"),
        F.col("value").alias("cx"),
        F.get_json_object("props", "$.k").cast("double").alias("cy"),
        F.struct("ts", "event_id").alias("_order"),
    )
    day = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 86400)
    return positions(e, ["track_id"], "_order", "frame", block=day).drop("_order")


FRAME_BLOCK = 4096


def frame_block():
    """Blocks for lag over a long track."""
    return F.floor(F.col("frame") / FRAME_BLOCK)
