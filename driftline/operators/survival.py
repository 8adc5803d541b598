"""Weighted survival, cumulative incidence and restricted means over first-change events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bins import duration
from .ordered import running_sums


def durations(
    df: DataFrame, base: str, observed: Column, radius: str, censor: str, cause: Column | None = None, weight: str = "sampling_weight"
) -> DataFrame:
    """Risk-set rows: undefined bases leave, time is the event or censor radius, a cause marks observed events."""
    kept = df.filter(F.col(base).isNotNull())
    seen = F.coalesce(observed, F.lit(False))
    return kept.withColumns(
        {
            "time": duration(seen, F.col(radius), F.col(censor)),
            "cause": F.when(seen, cause if cause is not None else F.lit("identity_change")),
            "weight": F.col(weight).cast("double"),
        }
    )


def time_counts(risk_rows: DataFrame, by: Sequence[str], causes: Sequence[str]) -> DataFrame:
    """Weight leaving the risk set at each distinct time, and the weight of each cause. One row per (group, time)."""
    return risk_rows.groupBy(*by, "time").agg(
        F.sum("weight").alias("leaving"),
        *[F.sum(F.when(F.col("cause") == c, F.col("weight")).otherwise(0.0)).alias(f"d_{c}") for c in causes],
    )


def with_margin(counts: DataFrame, column: str, total: str = "all") -> DataFrame:
    """Add the pooled group next to each single group, after the rows were already reduced."""
    return counts.withColumn(column, F.explode(F.array(F.lit(total), F.col(column))))


def with_grid(counts: DataFrame, by: Sequence[str], grid: Sequence[float], causes: Sequence[str]) -> DataFrame:
    """Mark evaluation radii: each group gets a weightless row at every grid radius."""
    groups = counts.select(*by).distinct()
    points = groups.withColumn("time", F.explode(F.array(*[F.lit(float(g)) for g in sorted(set(grid))])))
    empty = points.withColumns({"leaving": F.lit(0.0), **{f"d_{c}": F.lit(0.0) for c in causes}})
    return counts.withColumn("on_grid", F.lit(0)).unionByName(empty.withColumn("on_grid", F.lit(1)))


def life_table(counts: DataFrame, by: Sequence[str], causes: Sequence[str], *, block: Column | None = None) -> DataFrame:
    """Risk set, hazard, survival and incidence at each time of each group.

    ``counts`` has one row per (group, time); radii lie on a grid, so a group is at most rmax/step rows and a plain window
    is bounded. For free-valued times pass ``block`` (for example ``floor(time * 64)``) to work a group in pieces.
    """
    by = list(by)
    total = [F.sum(c).alias(c) for c in ["leaving", *[f"d_{c}" for c in causes], *(["on_grid"] if "on_grid" in counts.columns else [])]]
    table = counts.groupBy(*by, "time").agg(*total)
    table = running_sums(table, by, "time", {"_gone": F.col("leaving")}, block=block)
    weight = counts.groupBy(*by).agg(F.sum("leaving").alias("_total"))
    table = table.join(weight, by)
    events = sum((F.col(f"d_{c}") for c in causes), F.lit(0.0))
    table = table.withColumn("risk", F.col("_total") - F.col("_gone") + F.col("leaving")).withColumn("events", events)
    # A risk set that is empty up to rounding has no events; one that is used up by its events ends at zero.
    hazard = F.when(F.col("events") > 0, F.col("events") / F.greatest(F.col("risk"), F.col("events"))).otherwise(0.0)
    ends = hazard >= F.lit(1.0 - 1e-12)
    logs = F.when(ends, 0.0).otherwise(F.ln(F.lit(1.0) - hazard))
    table = table.withColumn("hazard", hazard)
    table = running_sums(table, by, "time", {"_log": logs, "_ended": ends.cast("int")}, block=block)
    alive = F.when(F.col("_ended") > 0, 0.0).otherwise(F.exp("_log"))
    before = F.when(F.col("_ended") - ends.cast("int") > 0, 0.0).otherwise(F.exp(F.col("_log") - logs))
    table = table.withColumns({"survival": alive, "survival_before": before})
    used = F.greatest(F.col("risk"), F.col("events"))
    mass = {
        f"cif_{c}": F.when(F.col("events") > 0, F.col("survival_before") * F.col(f"d_{c}") / used).otherwise(0.0)
        for c in causes
    }
    table = running_sums(table, by, "time", mass, block=block)
    return table.drop("_gone", "_total", "_log", "_ended")


def restricted_mean(table: DataFrame, by: Sequence[str], taus: Sequence[float]) -> DataFrame:
    """Area under the survival curve up to each tau, all taus from one life table.

    The area is tau less each drop of the curve times its distance to tau, so no previous row is needed.
    """
    by = list(by)
    spread = table.withColumn("tau", F.explode(F.array(*[F.lit(float(t)) for t in taus])))
    lost = F.when(
        F.col("time") <= F.col("tau") + F.lit(1e-12),
        (F.col("survival_before") - F.col("survival")) * F.greatest(F.col("tau") - F.col("time"), F.lit(0.0)),
    ).otherwise(0.0)
    return spread.groupBy(*by, "tau").agg((F.col("tau") - F.sum(lost)).alias("restricted_mean"))


def survival_at(table: DataFrame, tau: float) -> DataFrame:
    """Rows of the step functions that a report lists: event times and evaluation radii up to tau."""
    grid = F.col("on_grid") > 0 if "on_grid" in table.columns else F.lit(False)
    return table.filter(((F.col("events") > 0) | grid) & (F.col("time") <= F.lit(tau + 1e-12)))


def mean_contrast(means: DataFrame, by: Sequence[str], estimand: str, first: str, others: Sequence[str]) -> DataFrame:
    """Restricted mean of one estimand less each of the others, within the same group (and replicate)."""
    wide = means.groupBy(*by).agg(
        *[F.max(F.when(F.col(estimand) == e, F.col("restricted_mean"))).alias(e) for e in (first, *others)]
    )
    pairs = F.array(*[F.struct(F.lit(f"{first}_minus_{o}").alias("contrast"), (F.col(first) - F.col(o)).alias("difference")) for o in others])
    return wide.select(*by, F.explode(pairs).alias("_p")).select(*by, "_p.*")


def risk_counts(df: DataFrame, by: Sequence[str], taus: Sequence[float], rmax: float) -> DataFrame:
    """Rows defined at the start, with an event up to tau, censored before tau by geometry or by the scan, and observable."""
    spread = df.withColumn("tau", F.explode(F.array(*[F.lit(float(t)) for t in taus])))
    t = F.col("tau") + F.lit(1e-12)
    defined = F.col("base").isNotNull()
    event = defined & F.col("observed") & (F.col("radius") <= t)
    early = defined & ~F.col("observed") & (F.col("censor") < F.col("tau") - F.lit(1e-12))
    geometric = early & (F.col("censor") < F.lit(rmax - 1e-12))
    return spread.groupBy(*by, "tau").agg(
        F.count("*").alias("n_rows"),
        F.count_if(defined).alias("n_defined"),
        F.count_if(event).alias("n_event"),
        F.count_if(geometric).alias("n_geometric_censor"),
        F.count_if(early & ~geometric).alias("n_administrative_censor"),
        F.count_if(defined & ~early & ~event).alias("n_observable_event_free"),
        F.sum(F.when(defined, F.col("sampling_weight")).otherwise(0.0)).alias("weight_defined"),
    )
