"""Derived labels, states and flags used across the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Divergence label -> cause family; anything unmapped is "other".
CAUSES = {
    "eligibility_boundary": "eligibility",
    "topk_membership_transition": "topk",
    "conflict_reassignment": "conflict",
    "within_set_geometry_rank_reversal": "within_set",
    "active_disappearance": "other",
    "compound_or_other": "other",
}
CAUSE_NAMES = ("eligibility", "topk", "conflict", "within_set", "other")
SIZE_GROUPS = ("t_8_16", "s_16_32")

# The numbers missing from the 1..90 category ids of the 80-class set.
CATEGORY_GAPS = (12, 26, 29, 30, 45, 66, 68, 69, 71, 83)


def size_bin(area: Column) -> Column:
    side = F.sqrt(F.greatest(area.cast("double"), F.lit(0.0)))
    return F.when(side < 8, "vt_lt8").when(side < 16, "t_8_16").when(side < 32, "s_16_32").otherwise("m_ge32")


def density_label(n: Column) -> Column:
    return F.when(n < 32, "low").when(n < 128, "medium").otherwise("high")


def aspect_bin(w: Column, h: Column) -> Column:
    ratio = F.greatest(w / h, h / w)
    return F.when(ratio <= 1.5, "le_1_5").when(ratio <= 2.5, "1_5_to_2_5").otherwise("gt_2_5")


def direction_axis(direction: Column) -> Column:
    return F.when(direction.isin("left", "right"), "horizontal").otherwise("vertical")


def decode_stride(candidate: Column) -> Column:
    """Stride of a candidate on the 800-pixel grid of three levels (100x100, 50x50, 25x25 cells)."""
    return (
        F.when((candidate >= 0) & (candidate < 10000), 8)
        .when((candidate >= 10000) & (candidate < 12500), 16)
        .when((candidate >= 12500) & (candidate < 13125), 32)
        .otherwise(F.raise_error(F.lit("candidate index outside the grid")).cast("int"))
    )


def cause_of(label: Column) -> Column:
    expr = F
    for raw, cause in CAUSES.items():
        expr = expr.when(label == raw, cause)
    return expr.otherwise("other")


def flag(c: Column) -> Column:
    """0/1 number or "1" text to boolean; null and blank are false."""
    return F.coalesce(F.trim(c.cast("string")) == "1", F.lit(False))


def event_state(observed: Column, competing: Column, right: Column) -> Column:
    total = observed.cast("int") + competing.cast("int") + right.cast("int")
    return (
        F.when(total > 1, "invalid_multiple_states")
        .when(observed, "observed")
        .when(competing, "competing_censored")
        .when(right, "right_censored")
        .otherwise("other_censored")
    )


def event_distance(state: Column, radius: Column, censor: Column) -> Column:
    return F.when(state == "observed", radius).otherwise(censor)


def event_type(state: Column, observed_label: Column, censor_reason: Column) -> Column:
    """Label of the event, or the censor reason, or the state itself."""
    return F.when(
        state == "observed", F.coalesce(F.nullif(F.trim(observed_label), F.lit("")), F.lit("observed_unspecified"))
    ).otherwise(F.coalesce(F.nullif(F.trim(censor_reason), F.lit("")), state))


def duration(observed: Column, radius: Column, censor: Column) -> Column:
    """Observed radius or censoring radius; refuses missing, negative and non-finite values."""
    value = F.when(observed, radius).otherwise(censor).cast("double")
    bad = value.isNull() | F.isnan(value) | (value < 0) | (value == float("inf"))
    return F.when(bad, F.raise_error(F.lit("invalid event or censor duration")).cast("double")).otherwise(value)


def radius_key(radius: Column) -> Column:
    """Exact integer key of a radius, at 1e-12 resolution."""
    return F.round(radius * F.lit(1e12)).cast("long")


def letterbox_ratio(h: Column, w: Column, imgsz: float) -> Column:
    return F.least(F.lit(float(imgsz)) / F.greatest(h, F.lit(1.0)), F.lit(float(imgsz)) / F.greatest(w, F.lit(1.0)))


def image_strata(boxes: DataFrame, image: str, side: Column) -> DataFrame:
    """Stratum of each image from its object sides: tiny only, small only, both, or null."""
    tiny, small = (side >= 8) & (side < 16), (side >= 16) & (side < 32)
    flags = boxes.groupBy(image).agg(F.max(tiny).alias("_tiny"), F.max(small).alias("_small"), F.count("*").alias("n_boxes"))
    label = F.when(F.col("_tiny") & F.col("_small"), "t_and_s").when(F.col("_tiny"), "t_only").when(F.col("_small"), "s_only")
    return flags.select(image, label.alias("stratum"), "n_boxes", density_label(F.col("n_boxes")).alias("density"))


def supports(o2o_valid: Column, o2m_valid: Column, stored_common: Column | None = None) -> Column:
    """Four analysis supports as a struct; a stored flag must agree with the recomputed one."""
    both = o2o_valid & o2m_valid
    common = both
    if stored_common is not None:
        common = F.when(both == stored_common, both).otherwise(
            F.raise_error(F.lit("stored common-support flag disagrees")).cast("boolean")
        )
    return F.struct(
        o2o_valid.alias("o2o_natural"),
        o2m_valid.alias("o2m_natural"),
        both.alias("both_state_common"),
        common.alias("competition_defined_common"),
    )


def evaluable(limit: Column, observed: Column, radius: Column, tau: float) -> Column:
    """Rows whose status at ``tau`` is known: scanned far enough, or the event came first."""
    return (limit >= F.lit(tau - 1e-12)) | F.coalesce(observed & (radius <= F.lit(tau + 1e-12)), F.lit(False))


def filter_classes(labels: DataFrame, classes: list[int] | None = None, single: bool = False, cls: str = "cls") -> DataFrame:
    out = labels if classes is None else labels.filter(F.col(cls).isin(classes))
    return out.withColumn(cls, F.lit(0)) if single else out


def compact_category(category: Column) -> Column:
    """1..90 category id to the dense 0..79 id; null for the unused numbers."""
    shift = sum(((category > g).cast("int") for g in CATEGORY_GAPS), F.lit(0))
    return F.when(category.isin(*CATEGORY_GAPS) | (category < 1) | (category > 90), None).otherwise(category - 1 - shift)


def sparse_category(dense: Column) -> Column:
    """Dense 0..79 id back to the 1..90 category id."""
    value = dense + 1
    for g in CATEGORY_GAPS:
        value = value + (value >= g).cast("int")
    return F.when(dense.between(0, 79), value)


def rounded(c: Column, digits: int = 9) -> Column:
    """Rounded double without a negative zero."""
    return F.round(c.cast("double"), digits) + F.lit(0.0)
