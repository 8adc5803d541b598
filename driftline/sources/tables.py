"""CSV, JSON and sharded tables, with declared schemas, and the sinks for results."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

from ..operators.checks import require_columns


def _schema(**fields) -> StructType:
    kinds = {"s": StringType(), "d": DoubleType(), "i": IntegerType(), "l": LongType()}
    return StructType([StructField(n, kinds[k]) for n, k in fields.items()])


SELECTED_IMAGES = _schema(dataset_index="l", image_id="s", stratum="s", inclusion_probability="d", sampling_weight="d")
KEY = {"image_id": "s", "gt_id": "l", "direction": "s"}
IDENTITIES = ("o2o", "o2m_legacy", "o2m_pre_topk", "o2m_assigned_positive")


def _event_fields(e: str) -> dict[str, str]:
    return {
        f"{e}_event_observed": "i", f"{e}_radius": "d", f"{e}_right_censored": "i", f"{e}_censor_radius": "d",
        f"{e}_censor_reason": "s", f"{e}_bracket_low": "d", f"{e}_bracket_high": "d",
    }


_events: dict[str, str] = {
    **KEY, "class_id": "i", "size_bin": "s", "width": "d", "height": "d", "area": "d", "stratum": "s", "sampling_weight": "d",
    "scan_limit": "d", "scan_limit_reason": "s", "scan_limit_float32_guard_pixels": "d", "o2o_base_active": "i", "o2o_base_runner": "i",
    "o2o_base_margin": "d", "rho_R_base_q_active": "d", "rho_R_base_q_runner": "d", "rho_R_base_q_gap": "d", "o2m_legacy_base": "i",
    "o2m_pre_topk_base": "i", "o2m_assigned_positive_base": "i", "o2m_positive_count_base": "i", "o2o_event_active": "i", "o2o_first_divergence": "s",
}
for _e in (*IDENTITIES, "rho_R"):
    _events.update(_event_fields(_e))
_events["rho_R_competing_censored"] = "i"
BOUNDARY_EVENTS = _schema(**_events)
RADIUS_CURVE = _schema(
    **KEY, radius="d", size_bin="s", stratum="s", sampling_weight="d", shift_pixels="d", evaluation_phase="s", o2o_active="i",
    o2m_legacy_rank="i", o2m_pre_topk_rank="i", o2m_assigned_positive_rank="i", o2m_positive_count="i", o2m_positive_count_base="i",
    o2m_positive_intersection_count="i", o2m_positive_union_count="i", o2m_positive_set_jaccard="d", o2m_positive_set_retention="d",
    o2m_positive_set_structural_state="s", o2m_positive_set_exact_change="i", rho_R_pair_q_gap="d", rho_R_pair_eligibility_comparable="i",
    rho_R_pair_pre_topk_comparable="i", rho_R_pair_conflict_comparable="i", rho_R_pair_comparability_reason="s",
)


def read_table(spark: SparkSession, path: str | Sequence[str], schema: StructType, required: Sequence[str] | None = None, label: str = "table") -> DataFrame:
    """CSV by column name: every field is read as text (leading zeros stay), a byte-order mark is dropped from the header,
    and the declared types are cast. Splittable, pruned to the declared columns.
    """
    raw = spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
    clean = {c: c.lstrip("﻿").strip().strip('"') for c in raw.columns}
    raw = raw.withColumnsRenamed({a: b for a, b in clean.items() if a != b})
    names = list(required) if required is not None else schema.fieldNames()
    require_columns(raw, names, label)
    return raw.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields if f.name in raw.columns])


def read_shards(spark: SparkSession, root: str, file: str, schema: StructType, roster: DataFrame | None = None, shard: str = "shard") -> DataFrame:
    """All shard files ``root/*/file`` as one table with the shard name; a roster keeps only listed shards and adds their order."""
    files = f"{root.rstrip('/')}/*/{file}"
    raw = spark.read.option("header", True).schema(StructType([StructField(f.name, StringType()) for f in schema.fields])).option("enforceSchema", False).csv(files)
    parts = F.split(F.col("_metadata.file_path"), "/")
    named = raw.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields], F.element_at(parts, -2).alias(shard))
    return named if roster is None else named.join(roster, shard)


def read_json(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """JSON documents, one row per file."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema is not None else reader).json(path)


def read_ledger(spark: SparkSession, path: str, entries: str = "entries") -> DataFrame:
    """Ledger entries, one row each, in the order of the document."""
    return read_json(spark, path).select(F.posexplode(entries).alias("position", "_e")).select("position", "_e.*")


def write_table(df: DataFrame, path: str, format: str = "csv", order: Sequence[str] = ()) -> None:
    """Write once: an existing target is an error. ``order`` sorts the output."""
    out = df.orderBy(*order) if order else df
    writer = out.write.mode("errorifexists")
    (writer.option("header", True) if format == "csv" else writer).format(format).save(path)


def bundle_manifest(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Row count and order-free content hash per table: a sum of row hashes, so no task holds a table."""
    out = None
    for name, df in tables.items():
        row = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
        digest = F.conv(F.substring(F.sha2(row, 256), 1, 15), 16, 10).cast("decimal(38,0)")
        one = df.agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(digest), F.lit(0)).cast("string").alias("_s")).select(
            F.lit(name).alias("table"), "n_rows", F.sha2(F.concat_ws("|", F.col("n_rows").cast("string"), "_s"), 256).alias("content_hash")
        )
        out = one if out is None else out.unionByName(one)
    return out


def write_bundle(tables: Mapping[str, DataFrame], path: str) -> None:
    """Every table as CSV, all of them as record lines, and a manifest of counts and hashes."""
    records = None
    for name, df in tables.items():
        write_table(df, f"{path}/{name}")
        one = df.select(F.lit(name).alias("table"), F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("record"))
        records = one if records is None else records.unionByName(one)
    records.write.mode("errorifexists").json(f"{path}/records")
    bundle_manifest(tables).write.mode("errorifexists").json(f"{path}/manifest")


def write_partitioned(df: DataFrame, path: str, by: str = "image_id") -> None:
    """Rewrite only the partitions present in ``df``; the rows of a partition are gathered before the write."""
    df.repartition(by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def pending(roster: DataFrame, done: DataFrame, key: str = "image_id", digest: str | None = None) -> DataFrame:
    """Roster units without a completed shard. With ``digest`` a shard counts only if its hash equals the roster's."""
    on = [key] if digest is None else [key, digest]
    return roster.join(done.select(*on).distinct(), on, "left_anti")


def completed(spark: SparkSession, path: str, by: str = "image_id") -> DataFrame:
    """Units already written to a partitioned table, with their row counts."""
    return spark.read.parquet(path).groupBy(by).agg(F.count("*").alias("n_rows")).withColumn(by, F.col(by).cast("string"))
