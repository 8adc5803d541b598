"""Table reconciliation: paired joins, key audits, grid convergence, merges, diffs, parity and fixity."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .checks import assert_unique


def paired_join(left: DataFrame, right: DataFrame, keys: Sequence[str], *, same: Sequence[str] = (), suffixes: tuple[str, str] = ("_left", "_right")) -> DataFrame:
    """Inner one-to-one join. Keys must be unique on both sides and the ``same`` columns must agree, or reading fails."""
    keys = list(keys)
    values = [c for c in left.columns if c not in keys and c not in same]
    a = assert_unique(left.select(*keys, *same, *[F.col(c).alias(c + suffixes[0]) for c in values]), keys, "left table")
    others = [c for c in right.columns if c not in keys and c not in same]
    b = assert_unique(
        right.select(*keys, *[F.col(c).alias("_same_" + c) for c in same], *[F.col(c).alias(c + suffixes[1]) for c in others]), keys, "right table"
    )
    joined = a.join(b, keys)
    for c in same:
        agree = F.col(c).eqNullSafe(F.col("_same_" + c))
        if dict(left.dtypes)[c] == "double":
            agree = agree | (F.abs(F.col(c) - F.col("_same_" + c)) <= 1e-12)
        ok = F.when(agree, F.lit(True)).otherwise(F.raise_error(F.lit(f"paired rows disagree on {c}")).cast("boolean"))
        joined = joined.filter(ok)
    return joined.drop(*["_same_" + c for c in same])


def left_zero(roster: DataFrame, stats: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Roster left join: units without rows stay, with zeros."""
    return roster.join(stats, list(keys), "left").na.fill(0, list(values))


def outer_zero(left: DataFrame, right: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    return left.join(right, list(keys), "full_outer").na.fill(0, list(values))


def disjoint(population: DataFrame, exclusion: DataFrame, keys: Sequence[str]) -> DataFrame:
    return population.join(exclusion.select(*keys).distinct(), list(keys), "left_anti")


def key_audit(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Shared, left-only and right-only keys and duplicate rows, from one full outer join of per-key counts."""
    keys = list(keys)
    a = left.groupBy(*keys).agg(F.count("*").alias("_l"))
    b = right.groupBy(*keys).agg(F.count("*").alias("_r"))
    both = a.join(b, keys, "full_outer")
    return both.agg(
        F.count_if(F.col("_l").isNotNull() & F.col("_r").isNotNull()).alias("n_shared"),
        F.count_if(F.col("_r").isNull()).alias("n_left_only"),
        F.count_if(F.col("_l").isNull()).alias("n_right_only"),
        F.count_if(F.col("_l") > 1).alias("n_left_duplicated"),
        F.count_if(F.col("_r") > 1).alias("n_right_duplicated"),
    )


def same_order(left: DataFrame, right: DataFrame, keys: Sequence[str], row: str) -> DataFrame:
    """Whether two stored orders agree: rows with the same number must hold the same key."""
    a = left.select(F.col(row).alias("_row"), F.struct(*keys).alias("_a"))
    b = right.select(F.col(row).alias("_row"), F.struct(*keys).alias("_b"))
    return a.join(b, "_row", "full_outer").agg(F.bool_and(F.col("_a").eqNullSafe(F.col("_b"))).alias("same_order"))


def compare_distance(coarse: Column, fine: Column, fine_step: float, localized: Column) -> Column:
    """Class of a two-grid distance pair, whether it is material, and the difference."""
    tol = F.lit(max(1e-12, fine_step * 1e-7))
    delta = coarse - fine
    label = (
        F.when(coarse.isNull() & fine.isNull(), "same_undefined_distance")
        .when(coarse.isNull() | fine.isNull(), "one_missing_distance")
        .when(~localized, F.when(F.abs(delta) > tol, "censor_distance_changed").otherwise("same_censor_distance"))
        .when(delta < -tol, "fine_event_later_nesting_violation")
        .when(F.abs(delta) <= tol, "same_sample")
        .when(delta <= F.lit(fine_step) + tol, "fine_half_step_localization")
        .otherwise("coarse_missed_earlier_transition")
    )
    harmless = ("same_undefined_distance", "same_censor_distance", "same_sample", "fine_half_step_localization")
    return F.struct(label.alias("label"), (~label.isin(*harmless)).alias("material"), delta.alias("delta"))


def grid_differences(coarse: DataFrame, fine: DataFrame, keys: Sequence[str], fine_step: float) -> DataFrame:
    """Joined trajectories of two grids with their state, type and distance comparisons.

    Both inputs are long: keys..., estimand, state, type, distance.
    """
    on = [*keys, "estimand"]
    rename = lambda df, p: df.select(*on, *[F.col(c).alias(f"{p}_{c}") for c in ("state", "type", "distance")])
    both = rename(coarse, "c").join(rename(fine, "f"), on)
    localized = (F.col("c_state") == "observed") & (F.col("f_state") == "observed")
    d = compare_distance(F.col("c_distance"), F.col("f_distance"), fine_step, localized)
    return both.withColumns(
        {
            "state_changed": F.col("c_state") != F.col("f_state"),
            "type_changed": (F.col("c_state") == F.col("f_state")) & ~F.col("c_type").eqNullSafe(F.col("f_type")),
            "distance": d,
        }
    )


def convergence_gate(diff: DataFrame) -> DataFrame:
    """Decision table per (category, estimand). A material category fails on any count."""
    same_state = ~F.col("state_changed")
    cats = {
        "state_mismatch": (F.col("state_changed"), True),
        "type_mismatch": (F.col("type_changed"), True),
        **{
            name: (same_state & (F.col("distance.label") == name), material)
            for name, material in (
                ("same_sample", False), ("fine_half_step_localization", False), ("coarse_missed_earlier_transition", True),
                ("fine_event_later_nesting_violation", True), ("censor_distance_changed", True), ("same_censor_distance", False), ("one_missing_distance", True),
            )
        },
    }
    wide = diff.groupBy("estimand").agg(F.count("*").alias("denominator"), *[F.count_if(c).alias(n) for n, (c, _) in cats.items()])
    rows = F.array(*[F.struct(F.lit(n).alias("category"), F.lit(m).alias("material"), F.col(n).alias("count")) for n, (_, m) in cats.items()])
    out = wide.select("estimand", "denominator", F.explode(rows).alias("_r")).select("estimand", "denominator", "_r.*")
    return out.withColumn("decision", F.when(F.col("material") & (F.col("count") > 0), "FAIL").otherwise("PASS"))


def examples(diff: DataFrame, category: Column, by: Sequence[str], order: Sequence[str], each: int = 3) -> DataFrame:
    """``each`` examples per category: a report, not a result."""
    w = Window.partitionBy("category", *by).orderBy(*order)
    tagged = diff.withColumn("category", category).filter(F.col("category").isNotNull())
    return tagged.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= each).drop("_n").orderBy("category", *by, *order)


def signature_mismatches(left: DataFrame, right: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Keys whose field tuples differ (null equals null)."""
    a = left.select(*keys, F.struct(*fields).alias("_a"))
    b = right.select(*keys, F.struct(*fields).alias("_b"))
    joined = a.join(b, list(keys))
    return joined.filter(~F.col("_a").eqNullSafe(F.col("_b"))).select(
        *keys, F.filter(F.array(*[F.when(~F.col("_a")[f].eqNullSafe(F.col("_b")[f]), F.lit(f)) for f in fields]), lambda x: x.isNotNull()).alias("fields")
    )


def merge_audit(shards: DataFrame, roster: DataFrame, worker: str, image: str) -> DataFrame:
    """Shard merge audit: double assignment, unknown and missing images, duplicate rows. ``shards`` has a row count per (worker, image)."""
    per_image = shards.groupBy(image).agg(F.count_distinct(F.col(worker)).alias("_workers"), F.sum("n_rows").alias("_rows"), F.sum("n_keys").alias("_keys"))
    both = per_image.join(roster.select(image, F.lit(1).alias("_listed")), image, "full_outer")
    return both.agg(
        F.count_if(F.col("_workers").isNotNull() & F.col("_listed").isNotNull()).alias("n_covered"),
        F.count_if(F.col("_workers") > 1).alias("n_in_several_workers"),
        F.count_if(F.col("_listed").isNull()).alias("n_unknown"),
        F.count_if(F.col("_workers").isNull()).alias("n_missing"),
        F.coalesce(F.sum("_rows"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum(F.col("_rows") - F.col("_keys")), F.lit(0)).alias("n_duplicate_rows"),
    )


def merged_report(merged: DataFrame, summary: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Final merged table against its summary row: totals and key uniqueness."""
    per_key = merged.groupBy(*keys).agg(F.count("*").alias("_n"))
    totals = per_key.agg(F.sum("_n").alias("n_rows"), F.count("*").alias("n_keys"))
    declared = summary.agg(F.first("n_rows").alias("declared")).scalar()
    return totals.withColumn("declared_rows", declared).select(
        "n_rows", "n_keys", "declared_rows", (F.col("n_rows") == F.col("n_keys")).alias("unique"), (F.col("n_rows") == F.col("declared_rows")).alias("total_matches")
    )


def table_diff(left: DataFrame, right: DataFrame, keys: Sequence[str], values: Sequence[str], tolerance: float = 0.0) -> DataFrame:
    """Value differences by key, one row per (key, column)."""
    keys = list(keys)
    a = left.select(*keys, F.struct(*values).alias("_a"))
    b = right.select(*keys, F.struct(*values).alias("_b"))
    joined = a.join(b, keys, "full_outer")
    types = dict(left.dtypes)

    def cell(c):
        x, y = F.col("_a")[c], F.col("_b")[c]
        same = x.eqNullSafe(y)
        if tolerance and types[c] in ("double", "float"):
            same = same | F.coalesce(F.abs(x - y) <= tolerance, F.lit(False))
        return F.when(~same, F.struct(F.lit(c).alias("column"), x.cast("string").alias("left_value"), y.cast("string").alias("right_value")))

    cells = F.filter(F.array(*[cell(c) for c in values]), lambda x: x.isNotNull())
    side = F.when(F.col("_b").isNull(), "left_only").when(F.col("_a").isNull(), "right_only").otherwise("both")
    # A key on one side only is reported once, not once per column.
    only = F.array(F.struct(F.lit("*").alias("column"), F.lit(None).cast("string").alias("left_value"), F.lit(None).cast("string").alias("right_value")))
    out = joined.withColumn("side", side).withColumn("_d", F.when(F.col("side") == "both", cells).otherwise(only))
    return out.select(*keys, "side", F.explode("_d").alias("_d")).select(*keys, "side", "_d.*")


def row_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Multiset difference of whole rows, both ways."""
    a = left.exceptAll(right).withColumn("side", F.lit("left_only"))
    return a.unionByName(right.exceptAll(left).withColumn("side", F.lit("right_only")))


def verdicts(first: DataFrame, second: DataFrame, keys: Sequence[str]) -> DataFrame:
    """KEEP where two signature tables agree, CHANGED elsewhere. Both have (keys..., name, signature)."""
    on = [*keys, "name"]
    joined = first.withColumnRenamed("signature", "_a").join(second.withColumnRenamed("signature", "_b"), on, "full_outer")
    return joined.select(*on, F.col("_a").alias("first"), F.col("_b").alias("second"), F.when(F.col("_a").eqNullSafe(F.col("_b")), "KEEP").otherwise("CHANGED").alias("verdict"))


def sign_label(c: Column) -> Column:
    return F.when(c.isNull(), "undefined").when(c > 0, "positive").when(c < 0, "negative").otherwise("zero")


def nullable_close(a: Column, b: Column, tolerance: float) -> Column:
    return a.eqNullSafe(b) | F.coalesce(F.abs(a - b) <= tolerance, F.lit(False))


def parity(published: DataFrame, source: DataFrame, keys: Sequence[str], values: Sequence[str], scale: float = 1.0, tolerance: float = 1e-10) -> DataFrame:
    """Published rows against their source values: match count, largest difference, and rows found other than once."""
    keys = list(keys)
    src = source.groupBy(*keys).agg(F.count("*").alias("_n"), *[F.max(v).alias("_s_" + v) for v in values])
    joined = published.join(src, keys, "left")
    diff = F.greatest(*[F.coalesce(F.abs(F.col(v) - F.lit(scale) * F.col("_s_" + v)), F.lit(float("inf"))) for v in values], F.lit(0.0))
    return joined.agg(
        F.count("*").alias("n_rows"),
        F.count_if(F.coalesce(F.col("_n"), F.lit(0)) != 1).alias("n_not_unique"),
        F.max(F.when(F.col("_n") == 1, diff)).alias("max_abs_diff"),
        F.count_if((F.col("_n") == 1) & (diff <= tolerance)).alias("n_match"),
    )


def stage_parity(left: DataFrame, right: DataFrame, keys: Sequence[str], exact: Sequence[str], close: Mapping[str, float]) -> DataFrame:
    """Agreement of two assignment outputs by stage: exact flags and values within tolerance."""
    a = left.select(*keys, *[F.col(c).alias("_a_" + c) for c in (*exact, *close)])
    b = right.select(*keys, *[F.col(c).alias("_b_" + c) for c in (*exact, *close)])
    joined = a.join(b, list(keys), "full_outer")
    return joined.agg(
        F.count("*").alias("n_rows"),
        *[F.count_if(~F.col("_a_" + c).eqNullSafe(F.col("_b_" + c))).alias(f"{c}_mismatch") for c in exact],
        *[F.count_if(~nullable_close(F.col("_a_" + c), F.col("_b_" + c), t)).alias(f"{c}_mismatch") for c, t in close.items()],
    )


def ledger_violations(entries: DataFrame, required: Sequence[str], artifacts: DataFrame) -> DataFrame:
    """Ledger rule breaks, one row per (entry, rule).

    ``entries``: evidence_id, claim_id, status, hashes MAP, paths MAP, keys ARRAY. ``artifacts``: path, sha256 of a file scan.
    """
    from ..functions.text import is_sha256, same_map_keys

    n_ids = entries.groupBy("evidence_id").agg(F.count("*").alias("_n"))
    joined = entries.join(n_ids, "evidence_id")
    rules = {
        "missing_key": F.size(F.array_except(F.array(*[F.lit(k) for k in required]), F.col("keys"))) > 0,
        "duplicate_id": F.col("_n") > 1,
        "id_differs_from_claim": ~F.col("evidence_id").eqNullSafe(F.col("claim_id")),
        "bad_hash": F.exists(F.map_values("hashes"), lambda h: ~is_sha256(h)),
        "hash_and_path_names_differ": ~same_map_keys(F.col("hashes"), F.col("paths")),
        "smoke_entry": F.col("status") == "smoke",
    }
    broken = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(True)), F.lit(n)) for n, c in rules.items()]), lambda x: x.isNotNull())
    by_rule = joined.select("evidence_id", F.explode(broken).alias("rule"))
    links = entries.select("evidence_id", "hashes", F.explode("paths").alias("name", "path")).select(
        "evidence_id", "path", F.element_at("hashes", F.col("name")).alias("_expected")
    )
    checked = links.join(artifacts.select("path", F.col("sha256").alias("_actual")), "path", "left")
    files = checked.filter(~F.col("_expected").eqNullSafe(F.col("_actual"))).select(
        "evidence_id", F.when(F.col("_actual").isNull(), "artifact_missing").otherwise("artifact_hash_differs").alias("rule")
    )
    return by_rule.unionByName(files)


def fixity(manifest: DataFrame, found: DataFrame, forbidden: str | None = None) -> DataFrame:
    """Status per path of a manifest (path, size, sha256) against a file scan (path, size, sha256)."""
    a = manifest.select("path", F.col("size").alias("_ms"), F.col("sha256").alias("_mh"))
    b = found.select("path", F.col("size").alias("_fs"), F.col("sha256").alias("_fh"))
    joined = a.join(b, "path", "full_outer")
    bad_name = F.col("path").rlike(forbidden) if forbidden else F.lit(False)
    status = (
        F.when(F.col("_fh").isNotNull() & bad_name, "forbidden")
        .when(F.col("_fh").isNull(), "missing")
        .when(F.col("_mh").isNull(), "unlisted")
        .when(F.col("_ms") != F.col("_fs"), "size_differs")
        .when(F.col("_mh") != F.col("_fh"), "hash_differs")
        .otherwise("ok")
    )
    return joined.select("path", status.alias("status"))


def claim_links(claims: DataFrame, claim: str, ids: str, evidence: DataFrame, evidence_id: str, sep: str = ";") -> DataFrame:
    """Claims to evidence rows through a separated id list; a missing id stays with a null match."""
    exploded = claims.select(claim, F.explode(F.split(ids, sep)).alias(evidence_id)).withColumn(evidence_id, F.trim(evidence_id))
    return exploded.join(evidence.withColumn("_known", F.lit(1)), evidence_id, "left").withColumn("known", F.col("_known").isNotNull()).drop("_known")


def source_audit(panels: DataFrame, files: DataFrame, registry: DataFrame) -> DataFrame:
    """Hash state and registry state of every (panel, source), rolled up per panel."""
    s = panels.select("panel", F.explode("sources").alias("_s")).select("panel", "_s.path", "_s.sha256")
    joined = s.join(files.select("path", F.col("sha256").alias("_actual")), "path", "left").join(registry.select("path", F.col("status").alias("_status")), "path", "left")
    state = F.when(F.col("_actual").isNull(), "MISSING").when(F.col("_actual") != F.col("sha256"), "CONFLICT").otherwise("PASS")
    return joined.withColumn("_state", state).groupBy("panel").agg(
        F.count("*").alias("n_sources"),
        *[F.count_if(F.col("_state") == x).alias(f"n_{x.lower()}") for x in ("PASS", "MISSING", "CONFLICT")],
        F.count_if(F.col("_status").isNull()).alias("n_unregistered"),
    )


def expected_counts(df: DataFrame, name: str, expectation: DataFrame) -> DataFrame:
    """Row count per dataset name against an expectation table (name, expected)."""
    return df.groupBy(name).agg(F.count("*").alias("n_rows")).join(expectation, name, "full_outer").withColumn(
        "matches", F.coalesce(F.col("n_rows"), F.lit(0)) == F.coalesce(F.col("expected"), F.lit(-1))
    )


def progress(roster: DataFrame, markers: DataFrame, image: str) -> DataFrame:
    """Completed and pending shards, elapsed seconds, and the remaining time at the mean pace."""
    done = roster.join(markers.select(image, "seconds"), image, "left")
    out = done.agg(F.count("*").alias("n_total"), F.count("seconds").alias("n_done"), F.coalesce(F.sum("seconds"), F.lit(0.0)).alias("seconds"))
    left = F.col("n_total") - F.col("n_done")
    return out.select("*", left.alias("n_pending"), F.when(F.col("n_done") > 0, F.col("seconds") / F.col("n_done") * left).alias("eta_seconds"))
