"""All registered queries and their checking SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from ..session import release

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
_MODULES = ("survival_queries", "estimate_queries", "resample_queries", "curve_queries", "model_queries", "geometry_queries", "trajectory_queries", "scan_queries", "audit_queries", "detection_queries", "track_queries", "shape_queries", "check_queries", "rule_queries", "source_queries")


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is the equivalent for the checking engine, None where SQL is no fair expression of it."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")

        @wraps(fn)
        def run(spark: SparkSession, sf: str) -> DataFrame:
            release()  # intermediates of the query before
            return fn(spark, sf)

        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def load() -> None:
    from importlib.util import find_spec

    for module in _MODULES:
        if find_spec(f"driftline.plans.{module}") is not None:
            import_module(f"driftline.plans.{module}")
