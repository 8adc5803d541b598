"""Constraint checks that run as aggregations and come back as rows or as guarded frames."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def require_columns(df: DataFrame, required: Sequence[str], label: str = "table") -> DataFrame:
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"{label} lacks columns: {', '.join(missing)}")
    return df


def require_schema(df: DataFrame, schema: StructType, label: str = "table") -> DataFrame:
    require_columns(df, schema.fieldNames(), label)
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows")).filter("n_rows > 1")


def assert_unique(df: DataFrame, keys: Sequence[str], label: str = "table") -> DataFrame:
    """The same rows; reading them fails where a key occurs twice. One shuffle, by the key."""
    one = df.groupBy(*keys).agg(F.count("*").alias("_n"), F.first(F.struct(*df.columns)).alias("_row"))
    guard = F.when(F.col("_n") == 1, F.col("_row")).otherwise(
        F.raise_error(F.concat(F.lit(f"duplicate key in {label}: "), F.concat_ws("/", *[F.col(k).cast("string") for k in keys])))
    )
    return one.select(guard.alias("_row")).select("_row.*")


def violations(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """One row: the number of rows breaking each rule (a rule is the condition that must hold)."""
    return df.agg(F.count("*").alias("n_rows"), *[F.count_if(~F.coalesce(c, F.lit(False))).alias(n) for n, c in rules.items()])


def guarded(df: DataFrame, condition: Column, message: str) -> DataFrame:
    """The same rows; reading a row that breaks ``condition`` fails."""
    ok = F.when(F.coalesce(condition, F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean"))
    return df.filter(ok)


def frame_report(df: DataFrame, numeric: Sequence[str], weight: str, outcome: str, image: str, stratum: str) -> DataFrame:
    """Analysis-frame validation: complete, finite, positive weights, both outcomes, one stratum per image."""
    per_image = df.groupBy(image).agg(
        F.min(stratum).alias("_lo"),
        F.max(stratum).alias("_hi"),
        F.count("*").alias("_n"),
        F.count_if(F.col(weight).isNull() | ~(F.col(weight) > 0)).alias("_weight"),
        F.count_if(~F.coalesce(F.col(outcome).isin(0, 1), F.lit(False))).alias("_outcome"),
        F.max(outcome).alias("_max"),
        F.min(outcome).alias("_min"),
        *[
            F.count_if(F.col(c).isNull() | F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == float("inf"))).alias(f"_x_{c}")
            for c in numeric
        ],
    )
    return per_image.agg(
        F.sum("_n").alias("n_rows"),
        F.count("*").alias("n_images"),
        F.count_if(~F.col("_lo").eqNullSafe(F.col("_hi"))).alias("images_in_many_strata"),
        F.sum("_weight").alias("bad_weights"),
        F.sum("_outcome").alias("bad_outcomes"),
        (F.max("_max") != F.min("_min")).cast("int").alias("both_outcomes"),
        *[F.sum(f"_x_{c}").alias(f"bad_{c}") for c in numeric],
    )


def unique_row(df: DataFrame, condition: Column, label: str = "lookup") -> DataFrame:
    """The single row meeting ``condition``; zero or several rows fail on read."""
    hit = df.filter(condition)
    n = hit.agg(F.count("*").alias("n"), F.first(F.struct(*df.columns)).alias("_row"))
    row = F.when(F.col("n") == 1, F.col("_row")).otherwise(
        F.raise_error(F.concat(F.lit(f"{label}: expected one row, found "), F.col("n").cast("string")))
    )
    return n.select(row.alias("_row")).select("_row.*")


def curve_report(curve: DataFrame, events: DataFrame, keys: Sequence[str], radius: str, expected: Column | None = None) -> DataFrame:
    """Per-trajectory curve faults against the event table: start, order, duplicates, missing or extra keys, count.

    Strict increase needs no ordered window: a trajectory without duplicate radii is strictly increasing once sorted.
    """
    shape = curve.groupBy(*keys).agg(
        F.count("*").alias("n_points"),
        F.min(radius).alias("_first"),
        F.count_distinct(F.col(radius)).alias("_distinct"),
    )
    listed = events.groupBy(*keys).agg(F.count("*").alias("n_events"))
    both = listed.join(shape, list(keys), "full_outer")
    flags = {
        "event_only": F.col("n_points").isNull(),
        "curve_only": F.col("n_events").isNull(),
        "duplicate_event_key": F.col("n_events") > 1,
        "not_starting_at_zero": F.col("_first") != 0,
        "radius_repeated": F.col("_distinct") < F.col("n_points"),
    }
    if expected is not None:
        flags["unexpected_point_count"] = F.col("n_points") != expected
    return both.agg(
        F.count("n_events").alias("n_event_keys"),
        F.sum("n_points").alias("n_curve_rows"),
        *[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in flags.items()],
    )


def file_order_report(curve: DataFrame, keys: Sequence[str], radius: str, row: str) -> DataFrame:
    """Rows out of order when the stored row number is the order of record."""
    w = Window.partitionBy(*keys).orderBy(row)
    stepped = curve.withColumn("_prev", F.lag(radius).over(w))
    return stepped.groupBy(*keys).agg(F.count_if(F.col("_prev") >= F.col(radius)).alias("n_not_increasing"))


def roster_report(raw: DataFrame, roster: DataFrame, image: str, stratum: str) -> DataFrame:
    """Images of a raw table that the roster does not know, or knows under another stratum."""
    seen = raw.groupBy(image).agg(F.min(stratum).alias("_lo"), F.max(stratum).alias("_hi"), F.count("*").alias("n_rows"))
    known = roster.select(image, F.col(stratum).alias("_roster_stratum"))
    problem = (
        F.when(F.col("_roster_stratum").isNull(), "unknown_image")
        .when(F.col("_lo") != F.col("_hi"), "several_strata")
        .when(F.col("_lo") != F.col("_roster_stratum"), "stratum_drift")
    )
    return seen.join(known, image, "left").select(image, "n_rows", problem.alias("problem")).filter("problem is not null")


def plan_report(plan: DataFrame, required_ids: Sequence[str], alpha: float, max_secondary: int = 2) -> DataFrame:
    """Hypothesis-plan constraints. A plan has one row per hypothesis (id, family, direction, alpha): a handful of rows."""
    return plan_reports(plan, required_ids, alpha, max_secondary)


def plan_reports(plans: DataFrame, required_ids: Sequence[str], alpha: float, max_secondary: int = 2, by: Sequence[str] = ()) -> DataFrame:
    """:func:`plan_report` for every plan of a table."""
    return plans.groupBy(*by).agg(
        (F.count("id") == F.count_distinct("id")).alias("ids_unique"),
        F.array_except(F.array(*[F.lit(i) for i in required_ids]), F.collect_set("id")).alias("missing_ids"),
        F.bool_and(F.col("direction").isin("greater", "less")).alias("directions_valid"),
        F.bool_and(F.abs(F.col("alpha") - alpha) < 1e-12).alias("alpha_matches"),
        (F.count_if(F.col("family") == "secondary") <= max_secondary).alias("secondary_within_limit"),
    )
