"""Sampling and resampling by hash draws: every draw is a pure function of (seed, replicate, stratum, slot)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import draw32, draw60
from ..session import shared
from .ordered import nth_smallest, positions

HASH_BITS = 60


#: Up to this many rows a group Spark applies a limit of ranks before it exchanges them.
GROUP_LIMIT = 1000


def hash_block(draw: Column, blocks: int = 64) -> Column:
    """Order-preserving block of a 60-bit draw; equal sizes by construction, so no percentile pass is needed."""
    return F.floor(draw / F.lit(float(2**HASH_BITS // blocks)))


def allocation(counts: DataFrame, requested: int, key: str = "stratum", count: str = "n_total") -> DataFrame:
    """Proportional allocation by largest remainder, order (remainder, count, key) descending. One row per stratum."""
    total = counts.agg(F.sum(count).alias("t")).scalar()
    base = counts.withColumn("_all", total).withColumn("_take", F.least(F.lit(requested), F.col("_all")))
    exact = F.col("_take") * F.col(count) / F.col("_all")
    base = base.withColumn("_exact", exact).withColumn("_floor", F.least(F.col(count), F.floor("_exact")))
    # Strata are the levels of a design variable: a handful of rows, so one window over all of them is bounded.
    everything = Window.partitionBy(F.lit(1))
    order = everything.orderBy(F.desc(F.col("_exact") - F.col("_floor")), F.desc(count), F.desc(key))
    left = F.col("_take") - F.sum("_floor").over(everything)
    extra = ((F.row_number().over(order) <= left) & (F.col("_floor") < F.col(count))).cast("long")
    return base.select(*counts.columns, (F.col("_floor") + extra).alias("n_sample"))


def stratified_sample(population: DataFrame, sizes: DataFrame, stratum: str, unit: str, seed: int) -> DataFrame:
    """Simple random sample of ``n_sample`` units per stratum, with inclusion probability and weight.

    The sample is the units with the smallest draws; strata of any size are ranked in hash blocks.
    """
    base = population.join(sizes.select(stratum, "n_total", "n_sample"), stratum)
    base = base.withColumn("_draw", draw60(seed, F.col(unit)))
    taken = nth_smallest(base, [stratum], "_draw", "n_sample", tie=unit, block=hash_block(F.col("_draw")))
    p = F.col("n_sample") / F.col("n_total")
    return taken.drop("_draw").withColumns({"inclusion_probability": p, "sampling_weight": F.lit(1.0) / p})


def hash_subset(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """The ``n`` rows with the smallest SHA-256 of the seeded key: a top-n report."""
    digest = F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")), 256)
    return df.withColumn("digest", digest).orderBy("digest", key).limit(n)


def replicates(reps: int) -> Column:
    return F.explode(F.sequence(F.lit(1), F.lit(reps))).alias("rep")


def numbered_clusters(roster: DataFrame, stratum: str, cluster: str, order: str, *, block: Column | int | None = 16) -> DataFrame:
    """Zero-based slot of each cluster within its stratum, and the stratum size."""
    slim = roster.select(stratum, cluster, *([order] if order != cluster else []))
    numbered = positions(slim, [stratum], order, "_position", block=block)
    size = roster.groupBy(stratum).agg(F.count("*").alias("n_h"))
    return numbered.join(size, stratum).select(stratum, cluster, (F.col("_position") - 1).alias("slot"), "n_h")


def multiplicities(clusters: DataFrame, stratum: str, cluster: str, reps: int, seed: int) -> DataFrame:
    """Stratified cluster bootstrap: (rep, cluster, copies) for drawn clusters only; replicate 0 is the identity draw.

    Each slot of a stratum draws one slot with replacement, so a replicate is an exact resample of n_h out of n_h.
    """
    clusters = shared(clusters)  # one row per cluster, read three times
    draws = clusters.select(stratum, "n_h", "slot", replicates(reps))
    hit = (draw32(seed, F.col("rep"), F.col(stratum), F.col("slot")) % F.col("n_h")).alias("slot")
    counted = draws.select("rep", stratum, hit).groupBy("rep", stratum, "slot").agg(F.count("*").alias("copies"))
    named = counted.join(clusters.select(stratum, "slot", cluster), [stratum, "slot"]).select("rep", cluster, "copies")
    identity = clusters.select(F.lit(0).alias("rep"), cluster, F.lit(1).cast("long").alias("copies"))
    return named.unionByName(identity)


def resampled_ratios(stats: DataFrame, mult: DataFrame, cluster: str, by: Sequence[str]) -> DataFrame:
    """Ratio of resampled sums per replicate. ``stats`` holds (cluster, by..., num, den), never raw rows."""
    joined = mult.join(stats, cluster)
    num, den = F.sum(F.col("copies") * F.col("num")), F.sum(F.col("copies") * F.col("den"))
    return joined.groupBy("rep", *by).agg(F.when(den > 0, num / den).alias("value"))


def interval(values: DataFrame, by: Sequence[str], level: float = 0.95, value: str = "value") -> DataFrame:
    """Point (replicate 0), linear-interpolation percentile interval and the number of finite replicates.

    A group is one value per replicate.
    """
    tail = (1.0 - level) / 2.0
    finite = (F.col("rep") > 0) & F.col(value).isNotNull() & ~F.isnan(value)
    ci = F.percentile(F.when(finite, F.col(value)), F.array(F.lit(tail), F.lit(1.0 - tail)))
    out = values.groupBy(*by).agg(
        F.max(F.when(F.col("rep") == 0, F.col(value))).alias("estimate"), ci.alias("_ci"), F.count_if(finite).alias("n_valid")
    )
    return out.select(*by, "estimate", F.col("_ci")[0].alias("ci_low"), F.col("_ci")[1].alias("ci_high"), "n_valid")


def budget_draws(roster: DataFrame, stratum: str, cluster: str, budgets: Sequence[int], repeats: int, seed: int) -> DataFrame:
    """Stratified subsamples of given image budgets, reweighted by n_h/m_h: (budget, repeat, cluster, factor).

    The smallest draws of each (budget, repeat, stratum) are kept. Spark limits each group to the largest budget before the
    exchange, so what is ranked follows the budgets, not the roster; budgets beyond that limit of Spark's rank in hash blocks.
    """
    size = roster.groupBy(stratum).agg(F.count("*").alias("n_total"))
    sizes = None
    for b in budgets:
        one = allocation(size, b, stratum).withColumn("budget", F.lit(b))
        sizes = one if sizes is None else sizes.unionByName(one)
    plan = sizes.withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    # The plan has a row per budget, repeat and stratum; a roster of few files is spread first, as each cluster is drawn for all of them.
    drawn = roster.select(stratum, cluster).repartition(cluster).join(F.broadcast(plan), stratum)
    drawn = drawn.withColumn("_draw", draw60(seed, F.col("budget"), F.col("repeat"), F.col(cluster)))
    if max(budgets) <= GROUP_LIMIT:
        first = Window.partitionBy("budget", "repeat", stratum).orderBy("_draw", cluster)
        kept = drawn.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= max(budgets)).filter(F.col("_n") <= F.col("n_sample"))
    else:
        kept = nth_smallest(drawn, ["budget", "repeat", stratum], "_draw", "n_sample", tie=cluster, block=hash_block(F.col("_draw"), 8))
    return kept.select("budget", "repeat", cluster, (F.col("n_total") / F.col("n_sample")).alias("factor"))


def midranks_of(values: Sequence[Column]) -> list[Column]:
    """Mid-ranks of a few columns of a row; values that differ by rounding only are ties."""
    near = [F.round(v, 12) for v in values]
    return [sum((F.when(o < n, 1.0).when(o == n, 0.5).otherwise(0.0) for o in near), F.lit(0.5)) for n in near]


def budget_summary(part: DataFrame, by: Sequence[str], rates: Sequence[str], full: str) -> DataFrame:
    """How subsamples recover the full sample: error and sign of the first branch's gap, whether the first branch's gap exceeds the
    second's, and the median rank correlation of the four rates. ``rates``: tiny and small of two branches; ``full`` a struct of them.
    """
    a, b, c, d = (F.col(r) for r in rates)
    gap, whole = a - b, F.col(full)[rates[0]] - F.col(full)[rates[1]]
    ranks, truth = midranks_of([a, b, c, d]), midranks_of([F.col(full)[r] for r in rates])
    middle = (len(rates) + 1) / 2
    dot = lambda x, y: sum(((i - middle) * (j - middle) for i, j in zip(x, y)), F.lit(0.0))
    spread = F.sqrt(dot(ranks, ranks) * dot(truth, truth))
    rows = part.select(*by, gap.alias("_gap"), whole.alias("_whole"), (a - b > c - d).alias("_order"), (dot(ranks, truth) / F.nullif(spread, F.lit(0.0))).alias("_rho")).filter("_gap IS NOT NULL")
    out = rows.groupBy(*by).agg(
        F.count("_gap").alias("n_valid"),
        F.percentile(F.abs(F.col("_gap") - F.col("_whole")), F.array(F.lit(0.5), F.lit(0.95))).alias("_e"),
        F.avg((F.signum("_gap") == F.signum("_whole")).cast("double")).alias("sign_consistency"),
        F.avg(F.coalesce(F.col("_order"), F.lit(False)).cast("double")).alias("order_consistency"),
        F.percentile("_rho", 0.5).alias("median_rank_correlation"),
    )
    return out.select(*by, "n_valid", F.col("_e")[0].alias("median_error"), F.col("_e")[1].alias("p95_error"), "sign_consistency", "order_consistency", "median_rank_correlation")


def precision(values: DataFrame, by: Sequence[str], level: float = 0.95) -> DataFrame:
    """Bootstrap mean, sd, normal and percentile half width, and how often the sign of the point is recovered."""
    point = values.filter("rep = 0").select(*by, F.col("value").alias("point"))
    tail = (1.0 - level) / 2.0
    reps = values.filter("rep > 0 AND value IS NOT NULL").join(point, list(by))
    out = reps.groupBy(*by).agg(
        F.max("point").alias("point"),
        F.avg("value").alias("boot_mean"),
        F.stddev_samp("value").alias("boot_sd"),
        F.percentile("value", F.array(F.lit(tail), F.lit(1 - tail))).alias("_ci"),
        F.avg((F.signum("value") == F.signum("point")).cast("double")).alias("direction_recovery"),
    )
    return out.select(
        *by, "point", "boot_mean", "boot_sd", (F.lit(1.959963984540054) * F.col("boot_sd")).alias("normal_half_width"),
        ((F.col("_ci")[1] - F.col("_ci")[0]) / 2).alias("percentile_half_width"), "direction_recovery",
    )


def roster_digest(df: DataFrame, order: str, buckets: Column, fields: Sequence[str]) -> DataFrame:
    """Canonical content hash of an ordered roster as a two-level hash: rows per bucket, then buckets.

    ``buckets`` must be non-decreasing in ``order`` and bounded in rows, so that no task holds the whole roster.
    """
    row = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    leaf = df.groupBy(buckets.alias("_bucket")).agg(
        F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), row.alias("r")))), lambda s: s["r"]), "\n"), 256).alias("_h"),
        F.count("*").alias("_n"),
    )
    hashes = F.transform(F.array_sort(F.collect_list(F.struct("_bucket", "_h"))), lambda s: s["_h"])
    return leaf.agg(F.sum("_n").alias("n_rows"), F.sha2(F.array_join(hashes, "\n"), 256).alias("digest"))


def split_assign(df: DataFrame, key: Column, weights: Sequence[float], seed: int, names: Sequence[str] = ("train", "val", "test")) -> DataFrame:
    """Train/val/test by hash bucket: a row's split depends on its key only, so no pass over the data is needed."""
    u = draw32(seed, key) / F.lit(float(2**32))
    total, expr, acc = sum(weights), F, 0.0
    for n, w in list(zip(names, weights))[:-1]:
        acc += w / total
        expr = expr.when(u < F.lit(acc), n)
    return df.withColumn("split", expr.otherwise(names[len(weights) - 1]))


def ratio_split(df: DataFrame, cls: str, key: str, share: float, seed: int) -> DataFrame:
    """Exact per-class train/val split: the first ``floor(share * n)`` files of each class, in hash order, are train."""
    n = df.groupBy(cls).agg(F.floor(F.count("*") * F.lit(share)).alias("_train"))
    base = df.join(n, cls).withColumn("_draw", draw60(seed, F.col(key)))
    ranked = positions(base, [cls], "_draw", "_position", block=hash_block(F.col("_draw")), tie=key)
    return ranked.withColumn("split", F.when(F.col("_position") <= F.col("_train"), "train").otherwise("val")).drop("_train", "_draw", "_position")
