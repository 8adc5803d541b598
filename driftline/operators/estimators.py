"""Weighted estimators: ratios, size contrasts, standardisation, rank correlation, quantiles and linear models.

Everything reduces to sums per group first. Cluster-level sums (``cluster_stats``) are the input of every bootstrap.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import shared
from .ordered import running_sums

TINY, SMALL = "t_8_16", "s_16_32"


def valid(x: Column, w: Column) -> Column:
    """Finite value and positive weight."""
    v = x.cast("double")
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")) & (w > 0)


def ratio(num: Column, den: Column) -> Column:
    return F.when(den > 0, num / den)


def weighted_mean(x: Column, w: Column, where: Column | None = None) -> Column:
    """Aggregate: weighted mean over valid rows, null if there are none."""
    ok = valid(x, w) if where is None else valid(x, w) & where
    return ratio(F.sum(F.when(ok, w * x.cast("double")).otherwise(0.0)), F.sum(F.when(ok, w).otherwise(0.0)))


def cluster_stats(df: DataFrame, by: Sequence[str], metrics: Mapping[str, tuple[Column, Column]], weight: str = "sampling_weight") -> DataFrame:
    """Numerator and denominator of each metric per ``by`` group (image included), long form.

    ``metrics`` maps a name to (value, condition); rows outside the condition count in neither sum.
    """
    w = F.col(weight)
    wide = df.groupBy(*by).agg(
        *[F.sum(F.when(valid(v, w) & c, w * v.cast("double")).otherwise(0.0)).alias(f"_n_{m}") for m, (v, c) in metrics.items()],
        *[F.sum(F.when(valid(v, w) & c, w).otherwise(0.0)).alias(f"_d_{m}") for m, (v, c) in metrics.items()],
    )
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"_n_{m}").alias("num"), F.col(f"_d_{m}").alias("den")) for m in metrics])
    return wide.select(*by, F.explode(pairs).alias("_m")).select(*by, "_m.*")


def pooled(stats: DataFrame, by: Sequence[str]) -> DataFrame:
    """Ratio estimates from cluster sums."""
    return stats.groupBy(*by).agg(ratio(F.sum("num"), F.sum("den")).alias("estimate"))


def object_fragility(directional: DataFrame, keys: Sequence[str], flips: Sequence[str], carry: Sequence[str] = ()) -> DataFrame:
    """Per object: any-direction fragility and flip rate of each flag, and the number of legal directions."""
    return directional.groupBy(*keys).agg(
        F.count("*").alias("legal_directions"),
        *[F.max(f"{f}_flip").alias(f"{f}_fragile") for f in flips],
        *[F.avg(f"{f}_flip").alias(f"{f}_flip_rate") for f in flips],
        *[F.first(c).alias(c) for c in carry],
    )


def size_contrasts(df: DataFrame, by: Sequence[str], arms: Sequence[str] = ("o2o", "o2m"), size: str = "size_bin", weight: str = "sampling_weight") -> DataFrame:
    """Rate per size, gap per arm and the paired difference of gaps, in one aggregation."""
    w = F.col(weight)
    rates = df.groupBy(*by).agg(
        *[weighted_mean(F.col(f"{a}_fragile"), w, F.col(size) == s).alias(f"{a}_{n}") for a in arms for n, s in (("tiny", TINY), ("small", SMALL))]
    )
    gaps = {f"{a}_gap": F.col(f"{a}_tiny") - F.col(f"{a}_small") for a in arms}
    out = rates.withColumns(gaps)
    return out.withColumn("paired_difference", F.col(f"{arms[0]}_gap") - F.col(f"{arms[1]}_gap"))


def shares(df: DataFrame, by: Sequence[str], label: str, weight: str = "sampling_weight") -> DataFrame:
    """Weighted share and row count of each label within each group."""
    cells = df.groupBy(*by, label).agg(F.sum(weight).alias("_w"), F.count("*").alias("n_rows"))
    totals = df.groupBy(*by).agg(F.sum(weight).alias("_total"))
    return cells.join(totals, list(by)).select(*by, label, "n_rows", (F.col("_w") / F.col("_total")).alias("share"))


def cooccurrence(df: DataFrame, by: Sequence[str], flags: Sequence[str], weight: str = "sampling_weight") -> DataFrame:
    """Weighted rate of rows with two or more flags and of each pair of flags, in one pass."""
    w, count = F.col(weight), sum((F.col(f).cast("int") for f in flags), F.lit(0))
    cols = {"any": count >= 1, "multiple": count >= 2}
    cols |= {f"{a}+{b}": (F.col(a) == 1) & (F.col(b) == 1) for a, b in combinations(flags, 2)}
    wide = df.groupBy(*by).agg(*[weighted_mean(c.cast("double"), w).alias(n) for n, c in cols.items()])
    pairs = F.array(*[F.struct(F.lit(n).alias("flags"), F.col(f"`{n}`").alias("rate")) for n in cols])
    return wide.select(*by, F.explode(pairs).alias("_p")).select(*by, "_p.*")


def standardised(cells: DataFrame, by: Sequence[str], stratum: str, size: str = "size_bin", least: int = 1, n: str = "n_rows") -> DataFrame:
    """Crude and directly standardised rates of tiny and small objects over the pooled stratum distribution.

    ``cells`` holds num, den and row count per (by, stratum, size): the number of cells is the number of strata, not of rows.
    A stratum is supported if both sizes have at least ``least`` rows in it.
    """
    wide = cells.groupBy(*by, stratum).agg(
        *[F.sum(F.when(F.col(size) == s, F.col(c)).otherwise(0)).alias(f"{c}_{k}") for k, s in (("t", TINY), ("s", SMALL)) for c in ("num", "den", n)]
    )
    supported = (F.col(f"{n}_t") >= least) & (F.col(f"{n}_s") >= least) & (F.col("den_t") > 0) & (F.col("den_s") > 0)
    both = F.col("den_t") + F.col("den_s")
    mass = F.when(supported, both).otherwise(0.0)
    rate = lambda k: F.when(supported, F.col(f"num_{k}") / F.col(f"den_{k}")).otherwise(0.0)
    out = wide.groupBy(*by).agg(
        ratio(F.sum("num_t"), F.sum("den_t")).alias("crude_tiny"),
        ratio(F.sum("num_s"), F.sum("den_s")).alias("crude_small"),
        ratio(F.sum(mass * rate("t")), F.sum(mass)).alias("standard_tiny"),
        ratio(F.sum(mass * rate("s")), F.sum(mass)).alias("standard_small"),
        ratio(F.sum(mass), F.sum(both)).alias("coverage"),
        F.count_if(supported).alias("n_supported"),
    )
    return out.withColumns(
        {"crude_gap": F.col("crude_tiny") - F.col("crude_small"), "standard_gap": F.col("standard_tiny") - F.col("standard_small")}
    )


def contract_difference(df: DataFrame, by: Sequence[str], contract: str, first: str, second: str, values: Sequence[str]) -> DataFrame:
    """Each value under one contract less that under another, in the same group; null where a group lacks a contract."""
    at = lambda name, v: F.max(F.when(F.col(contract) == name, F.col(v)))
    return df.groupBy(*by).agg(*[(at(first, v) - at(second, v)).alias(v) for v in values])


def standard_cells(df: DataFrame, by: Sequence[str], stratum: str, value: Column, size: str = "size_bin", weight: str = "sampling_weight") -> DataFrame:
    w = F.col(weight)
    return df.groupBy(*by, stratum, size).agg(
        F.sum(w * value.cast("double")).alias("num"), F.sum(w).alias("den"), F.count("*").alias("n_rows")
    )


def cutpoint_rates(df: DataFrame, side: Column, cuts: Sequence[float], arms: Sequence[str], weight: str = "sampling_weight") -> DataFrame:
    """Rates below and above each size cut, the gap per arm and the paired difference."""
    w = F.col(weight)
    spread = df.withColumn("_side", side).withColumn("cutpoint", F.explode(F.array(*[F.lit(float(c)) for c in cuts])))
    low = F.col("_side") < F.col("cutpoint")
    out = spread.groupBy("cutpoint").agg(
        *[weighted_mean(F.col(f"{a}_fragile"), w, c).alias(f"{a}_{k}") for a in arms for k, c in (("lower", low), ("upper", ~low))]
    )
    out = out.withColumns({f"{a}_gap": F.col(f"{a}_lower") - F.col(f"{a}_upper") for a in arms})
    return out.withColumn("paired", F.col(f"{arms[0]}_gap") - F.col(f"{arms[1]}_gap"))


def stable_objects(directional: DataFrame, keys: Sequence[str], changed: Column, carry: Sequence[str]) -> DataFrame:
    """Objects all of whose directions are unchanged."""
    return directional.groupBy(*keys).agg(
        F.bool_and(~changed).alias("stable"), F.count("*").alias("legal_directions"), *[F.max(c).alias(c) for c in carry]
    )


def weighted_quantiles(df: DataFrame, by: Sequence[str], value: str, weight: str, probs: Sequence[float], *, block: int | None = None) -> DataFrame:
    """Inverse-CDF quantiles: the first value whose cumulative weight reaches p times the total. One row per group.

    Of many rows the running sum may end below the total by rounding: a share that no value reaches then is the last value of
    positive weight.
    """
    by = list(by)
    points = df.groupBy(*by, value).agg(F.sum(weight).alias("_w"))
    cum = running_sums(points, by, value, {"_cum": F.col("_w")}, block=block)
    names = [f"q{round(p * 100):02d}" for p in probs]
    if by:
        cum = cum.join(points.groupBy(*by).agg(F.sum("_w").alias("_total")), by)
    else:
        cum = cum.withColumn("_total", points.agg(F.sum("_w").alias("_total")).scalar())
    last = F.max(F.when(F.col("_w") > 0, F.col(value)))
    return cum.groupBy(*by).agg(
        *[F.coalesce(F.min(F.when(F.col("_cum") >= F.lit(p) * F.col("_total") - F.lit(1e-9), F.col(value))), last).alias(n) for p, n in zip(probs, names)]
    )


def quintile(value: Column, cuts: Sequence[Column]) -> Column:
    """Bin number from 1; a value on a boundary enters the higher bin."""
    return sum(((value >= c).cast("int") for c in cuts), F.lit(1))


def midranks(df: DataFrame, by: Sequence[str], value: str, weight: str, name: str, *, block: Column | int | None = None) -> DataFrame:
    """Weighted mid-rank of every distinct value of each group: weight below plus half the weight at the value."""
    points = df.groupBy(*by, value).agg(F.sum(weight).alias("_w"))
    cum = running_sums(points, by, value, {"_cum": F.col("_w")}, block=block)
    return cum.select(*by, value, (F.col("_cum") - F.lit(0.5) * F.col("_w")).alias(name))


def weighted_spearman(df: DataFrame, by: Sequence[str], x: str, y: str, weight: str, *, blocks: Mapping[str, Column | int] | None = None) -> DataFrame:
    """Weighted Spearman correlation with mid-ranks; null below three rows or for a constant side.

    Rows are first reduced to distinct (x, y) cells. ``blocks`` cuts long rank orders into pieces.
    """
    by, blocks = list(by), blocks or {}
    w = F.col(weight)
    rows = df.filter(valid(F.col(x), w) & valid(F.col(y), w))
    cells = shared(rows.groupBy(*by, x, y).agg(F.sum(w).alias("_w"), F.count("*").alias("_n")))  # read three times
    rx = midranks(cells, by, x, "_w", "_rx", block=blocks.get(x))
    ry = midranks(cells, by, y, "_w", "_ry", block=blocks.get(y))
    ranked = cells.join(rx, [*by, x]).join(ry, [*by, y])
    w = F.col("_w")
    sums = ranked.groupBy(*by).agg(
        F.sum("_n").alias("n_rows"),
        F.sum(w).alias("_t"),
        (F.min(x) < F.max(x)).alias("_vx"),
        (F.min(y) < F.max(y)).alias("_vy"),
        F.sum(w * F.col("_rx")).alias("_x"),
        F.sum(w * F.col("_ry")).alias("_y"),
        F.sum(w * F.col("_rx") * F.col("_rx")).alias("_xx"),
        F.sum(w * F.col("_ry") * F.col("_ry")).alias("_yy"),
        F.sum(w * F.col("_rx") * F.col("_ry")).alias("_xy"),
    )
    t = F.col("_t")
    cov = F.col("_xy") / t - F.col("_x") / t * F.col("_y") / t
    vx = F.col("_xx") / t - F.col("_x") / t * F.col("_x") / t
    vy = F.col("_yy") / t - F.col("_y") / t * F.col("_y") / t
    ok = (F.col("n_rows") >= 3) & F.col("_vx") & F.col("_vy") & (vx > 0) & (vy > 0)
    return sums.select(*by, "n_rows", F.when(ok, cov / F.sqrt(vx * vy)).alias("correlation"))


def gram(df: DataFrame, by: Sequence[str], features: Sequence[str], outcome: str, weight: str) -> DataFrame:
    """Weighted cross-products of the design (with intercept) per group: one short array per group."""
    cols = [F.lit(1.0), *[F.col(f).cast("double") for f in features], F.col(outcome).cast("double")]
    n = len(cols)
    sums = [F.sum(F.col(weight) * cols[i] * cols[j]) for i in range(n) for j in range(i, n)]
    return df.groupBy(*by).agg(F.array(*sums).alias("gram"), F.count("*").alias("n_rows"))


def centred(df: DataFrame, by: Sequence[str], features: Sequence[str], weight: str) -> DataFrame:
    """Features less their weighted means in each fitted group. One aggregation; the join back is by the same key."""
    means = df.groupBy(*by).agg(*[weighted_mean(F.col(f), F.col(weight)).alias(f"_m_{f}") for f in features])
    joined = df.join(means, list(by))
    return joined.withColumns({f: F.col(f) - F.col(f"_m_{f}") for f in features}).drop(*[f"_m_{f}" for f in features])


def solve_gram(grams: DataFrame, by: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Minimum-norm weighted least squares from each group's cross-products. Input rows are one per group."""
    p = len(features) + 2
    names = ["intercept", *features]
    upper = np.triu_indices(p)
    schema = ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in grams.schema.fields if f.name in by], "n_rows long", *[f"`{n}` double" for n in names]])

    def solve(batches):
        for pdf in batches:
            rows = []
            for values in pdf["gram"]:
                m = np.zeros((p, p))
                m[upper] = np.asarray(values, dtype=float)
                m = m + np.triu(m, 1).T
                rows.append(np.linalg.lstsq(m[:-1, :-1], m[:-1, -1], rcond=1e-10)[0])
            out = pd.DataFrame(rows, columns=names, index=pdf.index)
            yield pd.concat([pdf[[*by, "n_rows"]], out], axis=1)

    return grams.select(*by, "n_rows", "gram").mapInPandas(solve, schema)


def dummies(df: DataFrame, column: str, levels: Sequence) -> tuple[DataFrame, list[str]]:
    """Drop-first indicator columns for a fixed list of levels."""
    names = [f"{column}_{level}" for level in levels[1:]]
    return df.withColumns({n: (F.col(column) == level).cast("double") for n, level in zip(names, levels[1:])}), names


def equal_seed_mean(df: DataFrame, keys: Sequence[str], seed: str, n_seeds: int, value: str, weight: str, by: Sequence[str]) -> DataFrame:
    """Mean over seeds of the per-seed weighted rate, on the objects that every seed has."""
    common = df.groupBy(*keys).agg(F.count_distinct(F.col(seed)).alias("_n")).filter(F.col("_n") == n_seeds).select(*keys)
    kept = df.join(common, list(keys), "left_semi")
    per_seed = kept.groupBy(*by, seed).agg(weighted_mean(F.col(value), F.col(weight)).alias("_rate"), F.count("*").alias("_rows"))
    return per_seed.groupBy(*by).agg(
        F.avg("_rate").alias("estimate"), F.count("_rate").alias("n_seeds"), F.sum("_rows").alias("n_rows")
    )


def quantile_summary(df: DataFrame, by: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Median and interquartile range. Exact percentiles of bounded groups; large groups should be reduced first."""
    cols = []
    for v in values:
        cols += [F.percentile(v, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"_{v}")]
    out = df.groupBy(*by).agg(*cols)
    return out.select(*by, *[F.col(f"_{v}")[i].alias(f"{v}_{n}") for v in values for i, n in enumerate(("q25", "median", "q75"))])


def stress_matrix(events: DataFrame, kappas: Sequence[float], dataset: str, keys: Sequence[str], arms: Sequence[str], carry: Sequence[str]) -> DataFrame:
    """Size contrasts per dataset and shift strength, all strengths from one pass over the events."""
    spread = events.withColumn("kappa", F.explode(F.array(*[F.lit(float(k)) for k in kappas])))
    hit = lambda a: F.coalesce((F.col(f"{a}_event_observed") == 1) & (F.col(f"{a}_radius") <= F.col("kappa") + F.lit(1e-12)), F.lit(False))
    per = spread.groupBy(dataset, "kappa", *keys).agg(*[F.max(hit(a).cast("int")).alias(f"{a}_fragile") for a in arms], *[F.first(c).alias(c) for c in carry])
    return size_contrasts(per, [dataset, "kappa"], arms)


def same_stride(directional: DataFrame, keys: Sequence[str], base: Column, shifted: Column, flip: str, carry: Sequence[str]) -> DataFrame:
    """Per object: whether every replay stays on the base stride, and how many directions cross or miss."""
    crossed = shifted.isNotNull() & (shifted != base)
    return directional.groupBy(*keys).agg(
        F.bool_and(F.coalesce(shifted == base, F.lit(False))).alias("same_stride"),
        F.count_if(crossed).alias("n_cross"),
        F.count_if(shifted.isNull()).alias("n_missing"),
        F.max(flip).alias("fragile"),
        F.count("*").alias("n_directions"),
        *[F.max(c).alias(c) for c in carry],
    )


def conflict_summary(df: DataFrame, by: Sequence[str], weight: str = "sampling_weight") -> DataFrame:
    """Disagreement of the pre-resolution and active identity, the share involved in conflicts, and unexplained rows."""
    w = F.col(weight)
    return df.groupBy(*by).agg(
        F.count("*").alias("n_rows"),
        weighted_mean(F.col("disagrees"), w).alias("disagreement_rate"),
        weighted_mean(F.col("in_conflict"), w).alias("conflict_rate"),
        weighted_mean(F.col("in_conflict"), w, F.col("disagrees") == 1).alias("conflict_rate_among_disagreeing"),
        F.count_if((F.col("disagrees") == 1) & (F.col("in_conflict") == 0)).alias("n_unexplained"),
    )
