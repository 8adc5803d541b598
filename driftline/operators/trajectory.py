"""Trajectory extraction: first changes, returns, fixed-pair crossings, set turnover and endpoint states."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIVERGENCE_PRIORITY = ("eligibility_boundary", "topk_membership_transition", "conflict_reassignment", "within_set_geometry_rank_reversal")


def forward_grid(start: Column, stop: Column, step: float) -> Column:
    """Increasing radii in (start, stop], always ending at stop; empty if stop <= start."""
    n = F.ceil((stop - F.lit(1e-12) - start) / F.lit(step)) - 1
    inner = F.when(n >= 1, F.transform(F.sequence(F.lit(1).cast("long"), n), lambda i: start + i * F.lit(step))).otherwise(
        F.array().cast("array<double>")
    )
    return F.when(stop > start, F.concat(inner, F.array(stop))).otherwise(F.array().cast("array<double>"))


def first_change(curve: DataFrame, keys: Sequence[str], radius: str, identity: str, *, carry: Sequence[str] = ()) -> DataFrame:
    """First radius whose identity differs from the one at radius 0 (null is a value), with its bracket.

    Two hash aggregations by trajectory, no sort: the base is read at the smallest radius, then the first differing radius
    and the last radius before it follow from conditional minima.
    """
    w = Window.partitionBy(*keys)
    # min_by keeps null identities; the window is per trajectory, which is as long as the radius grid.
    based = curve.withColumn("_base", F.min_by(F.struct(F.col(identity).alias("v")), F.col(radius)).over(w))
    based = based.withColumn("_event", F.min(F.when(~F.col(identity).eqNullSafe(F.col("_base.v")), F.col(radius))).over(w))
    low = F.max(F.when(F.col(radius) < F.col("_event"), F.col(radius)))
    out = based.groupBy(*keys).agg(
        F.min(F.col("_base.v")).alias("base_identity"),
        F.max("_event").alias("event_radius"),
        low.alias("bracket_low"),
        F.max(radius).alias("scan_limit"),
        *[F.first(c).alias(c) for c in carry],
    )
    seen = F.col("event_radius").isNotNull()
    return out.select(
        *keys, *carry, "base_identity", seen.cast("int").alias("event_observed"), "event_radius",
        F.when(~seen, F.col("scan_limit")).alias("censor_radius"), "bracket_low", F.when(seen, F.col("event_radius")).alias("bracket_high"),
    )


def coarse_to_fine(curve: DataFrame, keys: Sequence[str], index: str, identity: str, step: int) -> DataFrame:
    """First change as a two-resolution search sees it: coarse grid first, then the fine radii inside the bracket.

    A change that comes and goes between two coarse radii is missed, unlike in :func:`first_change`.
    """
    w = Window.partitionBy(*keys)
    based = curve.withColumn("_base", F.min_by(F.struct(F.col(identity).alias("v")), F.col(index)).over(w))
    last = F.max(index).over(w)
    based = based.withColumns({"_differs": ~F.col(identity).eqNullSafe(F.col("_base.v")), "_last": last})
    on_coarse = (F.col(index) % step == 0) | (F.col(index) == F.col("_last"))
    based = based.withColumn("_high", F.min(F.when(on_coarse & F.col("_differs"), F.col(index))).over(w))
    based = based.withColumn("_low", F.max(F.when(on_coarse & (F.col(index) < F.col("_high")), F.col(index))).over(w))
    fine = F.when(F.col("_differs") & (F.col(index) > F.col("_low")) & (F.col(index) <= F.col("_high")), F.col(index))
    return based.groupBy(*keys).agg(
        F.max("_high").alias("coarse_index"), F.min(fine).alias("fine_index"), F.min(F.when(F.col("_differs"), F.col(index))).alias("full_index")
    )


def pair_changed(base: Column, shifted: Column) -> Column:
    """Whether a stage flag of a candidate differs between the two states (a missing candidate changes nothing)."""
    return F.coalesce(base != shifted, F.lit(False))


def divergence_label(eligibility: Column, topk: Column, conflict: Column, reversal: Column, shifted_active: Column) -> Column:
    """First-divergence label in strict stage order."""
    return (
        F.when(eligibility, DIVERGENCE_PRIORITY[0])
        .when(topk, DIVERGENCE_PRIORITY[1])
        .when(conflict, DIVERGENCE_PRIORITY[2])
        .when(reversal, DIVERGENCE_PRIORITY[3])
        .when(shifted_active.isNull(), "active_disappearance")
        .otherwise("compound_or_other")
    )


def comparability_reason(active: Column, runner: Column, eligibility: Column, topk: Column, conflict: Column) -> Column:
    """Why a fixed base pair cannot be compared at a radius, null if it can."""
    return (
        F.when(active.isNull() | runner.isNull() | (active == runner), "base_pair_undefined")
        .when(~eligibility, "eligibility_boundary")
        .when(~topk, "topk_membership_transition")
        .when(~conflict, "conflict_reassignment")
    )


def rank_crossing(
    series: DataFrame, keys: Sequence[str], radius: str, gap: str, reason: str, active: str, runner: str, *, base_gap: str = "base_gap"
) -> DataFrame:
    """First fixed-pair crossing; loss of comparability competes and wins at the same radius.

    ``series`` is the curve beyond radius 0 with the base pair and base gap repeated on each row.
    """
    stop = F.col(reason).isNotNull() | (F.col(gap) <= 0)
    first = series.groupBy(*keys).agg(
        F.min_by(F.struct(F.col(reason).alias("reason")), F.when(stop, F.col(radius))).alias("_at"),
        F.min(F.when(stop, F.col(radius))).alias("_stop"),
        F.max(radius).alias("_limit"),
        F.first(active).alias("_active"),
        F.first(runner).alias("_runner"),
        F.first(base_gap).alias("_gap"),
    )
    undefined = (
        F.when(F.col("_active").isNull(), "base_active_missing")
        .when(F.col("_runner").isNull(), "base_runner_missing")
        .when(F.col("_gap") == 0, "base_pair_tie")
        .when(F.col("_gap").isNull() | (F.col("_gap") < 0), "base_order_not_active_over_runner")
    )
    first = first.withColumn("_undefined", undefined)
    why = F.col("_at.reason")
    defined = F.col("_undefined").isNull()
    observed = defined & F.col("_stop").isNotNull() & why.isNull()
    competing = defined & F.col("_stop").isNotNull() & why.isNotNull()
    right = defined & F.col("_stop").isNull()
    return first.select(
        *keys,
        observed.cast("int").alias("event_observed"),
        competing.cast("int").alias("competing_censored"),
        right.cast("int").alias("right_censored"),
        F.when(observed, F.col("_stop")).alias("radius"),
        F.when(competing, F.col("_stop")).when(right, F.col("_limit")).alias("censor_radius"),
        F.coalesce(F.col("_undefined"), F.when(competing, why), F.when(right, F.lit("rmax"))).alias("censor_reason"),
    )


def with_overlap(df: DataFrame, base: str, shifted: str) -> DataFrame:
    """Overlap of two id sets: counts, Jaccard, retention, structural state, exact change. Undefined stays null."""
    b, s = F.col(base), F.col(shifted)
    nb, ns = F.size(b), F.size(s)
    inter, union = F.size(F.array_intersect(b, s)), F.size(F.array_union(b, s))
    state = (
        F.when((nb == 0) & (ns == 0), "empty_empty")
        .when(nb == 0, "empty_to_nonempty")
        .when(ns == 0, "nonempty_to_empty")
        .otherwise("nonempty_nonempty")
    )
    return df.withColumns(
        {
            "base_size": nb,
            "shift_size": ns,
            "intersection_size": inter,
            "union_size": union,
            "jaccard": F.when(union > 0, inter / union),
            "retention": F.when(nb > 0, inter / nb),
            "structural_state": state,
            "set_changed": (F.array_sort(b) != F.array_sort(s)).cast("int"),
        }
    )


def exact_class(rank_changed: Column, set_changed: Column) -> Column:
    return (
        F.when((rank_changed == 0) & (set_changed == 0), "stable")
        .when(set_changed == 0, "rank_only_exchange")
        .when(rank_changed == 1, "turnover_with_rank_exchange")
        .otherwise("turnover_without_rank_exchange")
    )


def rank_set_metrics(rank: str) -> Mapping[str, tuple[Column, Column]]:
    """Endpoint metrics and their denominators, for :func:`estimators.cluster_stats`."""
    r, s, yes = F.col(rank), F.col("set_changed"), F.lit(True)
    return {
        "rank_changed_rate": (r, yes),
        "set_exact_changed_rate": (s, yes),
        "rank_changed_set_same_rate": (r * (1 - s), yes),
        "rank_minus_set_rate": (r - s, yes),
        "mean_jaccard": (F.col("jaccard"), yes),
        "mean_retention": (F.col("retention"), yes),
        "mean_jaccard_among_rank_changed": (F.col("jaccard"), r == 1),
        "mean_retention_among_rank_changed": (F.col("retention"), r == 1),
    }


def return_signature(curve: DataFrame, keys: Sequence[str], order: str, states: Sequence[str], skip: Mapping[str, Column] | None = None) -> DataFrame:
    """never_changed / changed_no_return / changed_then_returned per trajectory and state.

    A row of ``skip`` is passed over for that state. Returned means the base value occurs after the first change, which
    is a comparison of two radii, so no running window is needed.
    """
    skip = skip or {}
    w = Window.partitionBy(*keys)
    base = curve.withColumn("_base", F.min_by(F.struct(*states), F.col(order)).over(w))
    aggs = []
    for s in states:
        counted = ~skip[s] if s in skip else F.lit(True)
        differs = ~F.col(s).eqNullSafe(F.col("_base")[s])
        aggs.append(F.min(F.when(counted & differs, F.col(order))).alias(f"_c_{s}"))
        aggs.append(F.max(F.when(counted & ~differs, F.col(order))).alias(f"_s_{s}"))
    out = base.groupBy(*keys).agg(*aggs)
    label = lambda s: (
        F.when(F.col(f"_c_{s}").isNull(), "never_changed")
        .when(F.col(f"_s_{s}") > F.col(f"_c_{s}"), "changed_then_returned")
        .otherwise("changed_no_return")
    )
    return out.select(*keys, *[label(s).alias(s) for s in states])


def order_state(comparable: Column, gap: Column) -> Column:
    return (
        F.when(~comparable, "not_comparable").when(gap.isNull(), "undefined").when(gap > 0, "positive").when(gap < 0, "negative").otherwise("tie")
    )


def exact_endpoint(curve: DataFrame, radius: str, radii: Sequence[float]) -> DataFrame:
    """Curve rows at exact radii (no interpolation). The plain interval filter reaches the scan."""
    near = None
    for r in radii:
        hit = F.col(radius).between(r - 1e-12, r + 1e-12)
        near = hit if near is None else near | hit
    return curve.filter(near)


def endpoint_flags(df: DataFrame, base: str, endpoint: str, observed: str, event_radius: str, radius: str) -> DataFrame:
    ever = (F.col(observed) == 1) & (F.col(event_radius) <= F.col(radius) + F.lit(1e-12))
    return df.withColumns(
        {"ever": F.coalesce(ever, F.lit(False)).cast("int"), "changed": (~F.col(base).eqNullSafe(F.col(endpoint))).cast("int")}
    )


def endpoint_metrics() -> Mapping[str, tuple[Column, Column]]:
    e, c, yes = F.col("ever"), F.col("changed"), F.lit(True)
    return {
        "ever_rate": (e, yes),
        "endpoint_changed_rate": (c, yes),
        "both_rate": (e * c, yes),
        "returned_rate": (e * (1 - c), yes),
        "unrecorded_rate": ((1 - e) * c, yes),
    }


def log_gap_terms(p_a: Column, p_b: Column, c_a: Column, c_b: Column, alpha: float = 0.5, beta: float = 6.0) -> Column:
    """Class offset and geometry gap of a log alignment difference; null where an overlap is not positive."""
    ok = (p_a > 0) & (p_b > 0) & (c_a > 0) & (c_b > 0)
    offset = F.lit(alpha) * (F.ln(p_a) - F.ln(p_b))
    geometry = F.lit(beta) * (F.ln(c_a) - F.ln(c_b))
    return F.struct(
        F.when(ok, offset).alias("class_offset"), F.when(ok, geometry).alias("geometry_gap"), F.when(ok, offset + geometry).alias("log_gap"), (~ok).alias("clipped")
    )


def gap_changes(flips: DataFrame, base: DataFrame, shifted: DataFrame, direction: str) -> DataFrame:
    """Log alignment gap of the identities before (a) and after (b) a shift, at both states, split into the fixed class offset and
    the geometry gap; ``residual_change`` is what the split leaves of the change. Null where an overlap is not positive at a state.

    ``flips``: (image_id, gt_id, direction, base_active, shift_active); ``base`` and ``shifted`` hold the pairs of both states.
    """
    obj = ["image_id", "gt_id"]
    both = F.array(F.struct(F.lit("a").alias("who"), F.col("base_active").alias("candidate")), F.struct(F.lit("b").alias("who"), F.col("shift_active").alias("candidate")))
    long = flips.select(*obj, direction, F.explode(both).alias("_w")).select(*obj, direction, "_w.*")
    long = long.join(base.select(*obj, "candidate", F.col("p").alias("p0"), F.col("c").alias("c0"), F.col("q").alias("q0")), [*obj, "candidate"], "left")
    long = long.join(shifted.select(*obj, direction, "candidate", F.col("c").alias("c1"), F.col("q").alias("q1")), [*obj, direction, "candidate"], "left")
    pick = lambda who, c: F.max(F.when(F.col("who") == who, F.col(c))).alias(f"{c}_{who}")
    wide = long.groupBy(*obj, direction).agg(*[pick(w, c) for w in "ab" for c in ("c0", "c1", "q0", "q1")])
    ok = F.lit(True)
    for c in ("c0_a", "c0_b", "c1_a", "c1_b"):
        ok = ok & (F.coalesce(F.col(c), F.lit(0.0)) > 0)
    geometry = F.lit(6.0) * (F.ln(F.col("c1_a") / F.col("c1_b")) - F.ln(F.col("c0_a") / F.col("c0_b")))
    change = F.ln(F.col("q1_a") / F.col("q1_b")) - F.ln(F.col("q0_a") / F.col("q0_b"))
    return wide.select(
        *obj, direction, (~ok).alias("clipped"), F.when(ok, geometry).alias("delta_geometry"), F.when(ok, change).alias("delta_log_gap"), F.when(ok, change - geometry).alias("residual_change")
    )


def fixed_sets(base: DataFrame, shifted: DataFrame, moved: DataFrame, k: int, direction: str = "direction") -> DataFrame:
    """The ``k`` best positive candidates of each object at base and after each shift, compared: sizes, intersection, Jaccard."""
    obj = ["image_id", "gt_id"]

    def best(pairs, keys, name):
        w = Window.partitionBy(*keys).orderBy(F.desc("q"), "candidate")
        top = pairs.filter("q > 0").withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k)
        return top.groupBy(*keys).agg(F.collect_set("candidate").alias(name))

    out = moved.select(*obj, direction).join(best(base, obj, "_a"), obj, "left").join(best(shifted, [*obj, direction], "_b"), [*obj, direction], "left")
    none = F.array().cast("array<bigint>")
    out = out.withColumns({"_a": F.coalesce("_a", none), "_b": F.coalesce("_b", none)})
    both = F.size(F.array_intersect("_a", "_b"))
    union = F.size("_a") + F.size("_b") - both
    return out.select(*obj, direction, F.size("_a").alias("base_size"), F.size("_b").alias("shift_size"), both.alias("intersection"), F.when(union > 0, both / union).alias("jaccard"))


def case_rows(df: DataFrame, margin: str, fragile: str, runner: str, keys: Sequence[str], direction: str) -> DataFrame:
    """Largest-margin stable object, smallest-margin fragile object and first runner-less object, each in its first direction.

    Three aggregates and three lookups; no sort of the table.
    """
    key = F.struct(*keys, direction)
    low = F.struct(F.col(margin).alias("m"), key.alias("k"))
    high = F.struct((-F.col(margin)).alias("m"), key.alias("k"))
    has = F.col(margin).isNotNull()
    picked = df.agg(
        F.min(F.when(has & (F.col(fragile) == 0), high)).alias("stable_largest_margin"),
        F.min(F.when(has & (F.col(fragile) == 1), low)).alias("fragile_smallest_margin"),
        F.min(F.when(F.col(runner).isNull(), F.struct(F.lit(0.0).alias("m"), key.alias("k")))).alias("without_runner"),
    )
    names = picked.columns
    rows = F.array(*[F.struct(F.lit(n).alias("case"), F.col(n)["k"].alias("k")) for n in names])
    cases = picked.select(F.explode(rows).alias("_c")).select("_c.case", "_c.k.*")
    return cases.filter(F.col(keys[0]).isNotNull()).join(df, [*keys, direction])


def rank_correlation(pairs: DataFrame, by: Sequence[str], base: str, shifted: str, candidate: str) -> DataFrame:
    """Correlation of candidate ranks before and after a shift, over the union support of each object."""
    wb = Window.partitionBy(*by).orderBy(F.desc(base), candidate)
    ws = Window.partitionBy(*by).orderBy(F.desc(shifted), candidate)
    ranked = pairs.filter((F.col(base) > 0) | (F.col(shifted) > 0)).withColumns({"_rb": F.row_number().over(wb), "_rs": F.row_number().over(ws)})
    return ranked.groupBy(*by).agg(F.count("*").alias("n"), F.when(F.count("*") >= 2, F.corr("_rb", "_rs")).alias("rank_corr"))


def quota(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """At most ``n`` rows per bin: a reporting cap, applied before the shuffle by Spark's group limit."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_q", F.row_number().over(w)).filter(F.col("_q") <= n).drop("_q")
