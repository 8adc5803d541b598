"""Session settings shared by the tests, the bench and user jobs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Rows here grow after a shuffle (shifts, grid cells, replicates): keep small shuffles spread over the cores.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "16k",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "driftline", memory: str = "8g") -> SparkSession:
    """A local session for tests and benches; a cluster job brings its own session."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def work_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which all executors share; below /tmp only where that is unset (local tests)."""
    top = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{top.rstrip('/')}/driftline-{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """Write to a shared folder and read again: a cut in the lineage that outlives executors, where plans on plans would grow too long."""
    path = work_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_SHARED: list[DataFrame] = []


def shared(df: DataFrame) -> DataFrame:
    """Mark an intermediate that a plan reads several times, so that it is computed once.

    Column pruning makes each use of an intermediate a different subplan, which Spark then cannot reuse by itself. The
    rows spill to disk, nothing runs before the first use, and partitions lost with an executor are computed again.
    """
    df.persist(StorageLevel.MEMORY_AND_DISK)
    _SHARED.append(df)
    return df


def release() -> None:
    """Drop all shared intermediates. Plans built on them stay valid and would compute them again."""
    while _SHARED:
        try:
            _SHARED.pop().unpersist()
        except Exception:  # the session that held it is gone
            pass
