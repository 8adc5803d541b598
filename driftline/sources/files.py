"""File scans with size and hash."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scan_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path relative to root, size, sha256) of every file. Each file is hashed by one task, where it is read."""
    base = root.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(base)
    tail = F.regexp_replace("path", f"^.*?{base}/", "")
    return files.select(tail.alias("path"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def list_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, size) only: the content column is pruned, so nothing is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return files.select("path", F.col("length").alias("size"))
