"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TO_LOWER = str.maketrans(UPPER, LOWER)
_own: dict[str, str] = {}


def scratch(spark: SparkSession) -> str:
    """This application's folder below ``spark.checkpoint.dir``; a temporary one only where that is unset (local tests)."""
    app = spark.sparkContext.applicationId
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        top = _own.setdefault(app, tempfile.mkdtemp(prefix="spark-llm-", dir="/tmp"))
    return f"{top.rstrip('/')}/driftline-{app}"


#: Rows of megabytes: Parquet looks at a page's size after each row, not after a hundred, and a row group has few of them.
LARGE_ROWS = {"parquet.page.size.row.check.min": 1, "parquet.block.row.count.limit": 8}


def stored(df: DataFrame, codec: str = "zstd", options: Mapping[str, int] | None = None) -> DataFrame:
    """Write to the shared folder and read again: a cut in the lineage that outlives executors."""
    path = f"{scratch(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.options(compression=codec, **(options or {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def small_batches(spark: SparkSession, most: int = 8 << 20) -> Iterator[None]:
    """What runs inside sends Python batches of about ``most`` bytes, one row at least; Spark's own limit is 64 MB a task."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(most))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id's text modulo ``folds``; null ids have none."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def slices(batch: pa.RecordBatch, column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about ``most`` bytes in a text column, one row at least."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = (np.cumsum(size) - size) // most
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield batch.slice(a, b - a)
