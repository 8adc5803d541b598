"""Running sums, positions and previous rows over groups of any size.

A plain window puts every row of a group into one task. Here a group is cut into ordered blocks first: blocks run as
separate tasks, and only one total per block is carried over. Small, bounded groups can still use the plain window.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_blocks(df: DataFrame, by: Sequence[str], order: str, blocks: int, name: str = "_block") -> DataFrame:
    """Number the order-preserving block of every row, about equally sized within each group."""
    cut = F.percentile_approx(F.col(order), [i / blocks for i in range(1, blocks)], 10_000)
    cuts = df.groupBy(*by).agg(cut.alias("_cuts"))
    joined = df.join(cuts, list(by)) if by else df.withColumn("_cuts", cuts.scalar())
    return joined.withColumn(name, F.size(F.filter("_cuts", lambda c: c < F.col(order)))).drop("_cuts")


def running_sums(
    df: DataFrame,
    by: Sequence[str],
    order: str,
    sums: Mapping[str, Column],
    *,
    block: Column | int | None = None,
    tie: str | None = None,
    tie_block: Column | int = 16,
) -> DataFrame:
    """Add inclusive running sums along ``order`` (ascending) within each ``by`` group.

    ``block`` is None for groups known to be small (one plain window), a column that is non-decreasing in ``order``,
    or a number of blocks to cut by percentiles. ``tie`` breaks equal order values; equal values are then also split
    along ``tie``, so that one value held by a large share of the rows does not end in one task.
    """
    by = list(by)
    sort = [order] if tie is None else [order, tie]
    if block is None:
        w = Window.partitionBy(*by).orderBy(*sort).rowsBetween(Window.unboundedPreceding, 0)
        return df.select("*", *[F.sum(c).over(w).alias(n) for n, c in sums.items()])
    part = {f"_v_{n}": c for n, c in sums.items()}
    base = df.withColumns(part)
    if isinstance(block, Column):
        base = base.withColumn("_block", block)
    else:
        base = with_blocks(base, by, order, block)
    cell = [*by, "_block"]
    if tie is not None:
        if isinstance(tie_block, Column):
            base = base.withColumn("_tblock", tie_block)
        else:
            base = with_blocks(base, by, tie, tie_block, "_tblock")
        cell = [*by, "_block", order, "_tblock"]
    totals = base.groupBy(*by, "_block").agg(*[F.sum(v).alias(v) for v in part])
    before = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*by, "_block", *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"{v}_b") for v in part])
    if tie is not None:
        cells = base.groupBy(*cell).agg(*[F.sum(v).alias(v) for v in part])
        ahead = Window.partitionBy(*by, "_block").orderBy(order, "_tblock").rowsBetween(Window.unboundedPreceding, -1)
        cells = cells.select(*cell, *[F.coalesce(F.sum(v).over(ahead), F.lit(0)).alias(f"{v}_c") for v in part])
        offsets = cells.join(offsets, [*by, "_block"]).select(
            *cell, *[(F.col(f"{v}_b") + F.col(f"{v}_c")).alias(f"{v}_b") for v in part]
        )
    inside = Window.partitionBy(*cell).orderBy(*sort).rowsBetween(Window.unboundedPreceding, 0)
    joined = base.join(offsets, cell)
    out = [(F.sum(f"_v_{n}").over(inside) + F.col(f"_v_{n}_b")).alias(n) for n in sums]
    return joined.select(*df.columns, *out)


def positions(df: DataFrame, by: Sequence[str], order: str, name: str = "position", **how) -> DataFrame:
    """One-based position of each row within its group."""
    return running_sums(df, by, order, {name: F.lit(1).cast("long")}, **how)


def previous_row(
    df: DataFrame, by: Sequence[str], order: str, cols: Sequence[str], *, block: Column | None = None, prefix: str = "prev_"
) -> DataFrame:
    """Add the previous row's values within each group.

    With ``block`` (non-decreasing in ``order``) a long group is worked in pieces: the last row of each piece is handed
    to the next one.
    """
    by = list(by)
    if block is None:
        w = Window.partitionBy(*by).orderBy(order)
        return df.select("*", *[F.lag(c).over(w).alias(prefix + c) for c in cols])
    base = df.withColumn("_block", block)
    last = base.groupBy(*by, "_block").agg(F.max_by(F.struct(*cols), order).alias("_last"))
    w = Window.partitionBy(*by).orderBy("_block")
    carried = last.select(*by, "_block", F.lag("_last").over(w).alias("_carried"))
    inside = Window.partitionBy(*by, "_block").orderBy(order)
    first = F.row_number().over(inside) == 1
    joined = base.join(carried, [*by, "_block"])
    return joined.select(
        *df.columns,
        *[F.when(first, F.col("_carried")[c]).otherwise(F.lag(c).over(inside)).alias(prefix + c) for c in cols],
    )


def nth_smallest(df: DataFrame, by: Sequence[str], order: str, wanted: str, *, tie: str, block: Column | int) -> DataFrame:
    """Keep the first ``wanted`` rows (a per-row column, equal within a group) of each group along ``order``."""
    ranked = positions(df, by, order, "_position", block=block, tie=tie)
    return ranked.filter(F.col("_position") <= F.col(wanted)).drop("_position")
