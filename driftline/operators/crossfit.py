"""Cross-fitted logistic models: stratified group folds, Newton fits from summed cross-products, spline terms, fold-wise metrics.

All fits of a set (every model, every left-out fold) advance together. One pass over the rows gives each task's gradients and
cross-products, a few hundred numbers whatever the table's size; Spark adds them up and the small systems are solved on the
driver. Convergence takes about ten passes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import draw60
from ..session import shared, written
from .estimators import weighted_quantiles
from .ordered import positions, with_blocks
from .replicates import _added, _before, _rows, _schema, _table, combined, copies_of, resampled_sums
from .resample import hash_block


def stratified_folds(rows: DataFrame, cluster: str, outcome: str, folds: int, seed: int) -> DataFrame:
    """(cluster, n_rows, n_positive, fold): whole clusters dealt to folds by their counts of positives, then rows, then a hash.

    The clusters in this order go to the folds in turn. Between two folds the positives therefore differ by no more than one
    cluster's positives, the clusters by no more than one. Clusters of equal counts are exchangeable: their places come from the
    number of clusters with higher counts and the place among their own, ranked in hash blocks, so no task sorts all clusters.
    """
    counts = rows.groupBy(cluster).agg(F.count("*").alias("n_rows"), F.sum(F.col(outcome).cast("long")).alias("n_positive"))
    kinds = counts.groupBy("n_positive", "n_rows").agg(F.count("*").alias("_n"))
    # One row per pair of counts that occurs.
    before = Window.orderBy(F.desc("n_positive"), F.desc("n_rows")).rowsBetween(Window.unboundedPreceding, -1)
    kinds = kinds.select("n_positive", "n_rows", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    drawn = counts.withColumn("_draw", draw60(seed, F.col(cluster)))
    placed = positions(drawn, ["n_positive", "n_rows"], "_draw", "_place", block=hash_block(F.col("_draw")), tie=cluster, tie_block=F.lit(0))
    fold = ((F.col("_before") + F.col("_place") - 1) % folds).cast("int")
    return placed.join(kinds, ["n_positive", "n_rows"]).select(cluster, "n_rows", "n_positive", fold.alias("fold"))


@dataclass
class Spline:
    """A cubic regression spline of one column; ``knots`` by left-out fold, linear beyond the outer ones."""

    column: str
    knots: Mapping[int, Sequence[float]]
    degree: int = 3

    def columns(self, value: np.ndarray, fold: int) -> list[np.ndarray]:
        knots, degree = self.knots[fold], self.degree
        low, high = knots[0], knots[-1]
        inside = np.clip(value, low, high)
        under, over = np.minimum(value - low, 0.0), np.maximum(value - high, 0.0)
        out = [inside**d + under * d * low ** (d - 1) + over * d * high ** (d - 1) for d in range(1, degree + 1)]
        return out + [np.maximum(inside - k, 0.0) ** degree + over * degree * (high - k) ** (degree - 1) for k in knots[1:-1]]


Terms = Sequence[str | Spline]
#: The left-out fold of a fit that uses all rows.
ALL = -1


def training_knots(df: DataFrame, column: str, weight: str, fold: str, folds: int, n: int, *, block: int | None = 16) -> dict[int, list[float]]:
    """Weighted quantiles of the rows outside each fold, ``n`` a fold, ends included. Quantiles that coincide raise an error."""
    outside = df.select(column, weight, F.explode(F.array_except(F.array(*[F.lit(f) for f in range(folds)]), F.array(fold))).alias("_out"))
    probs = [i / (n - 1) for i in range(1, n)]
    inner = {r["_out"]: r for r in weighted_quantiles(outside, ["_out"], column, weight, probs, block=block).collect()}
    least = {r["_out"]: r["low"] for r in outside.groupBy("_out").agg(F.min(column).alias("low")).collect()}
    out = {f: [float(least[f]), *(float(inner[f][f"q{round(p * 100):02d}"]) for p in probs)] for f in inner}
    if any(len(set(k)) != n for k in out.values()):
        raise ValueError("a training fold has spline knots that coincide")
    return out


@dataclass
class Fits:
    """Coefficients by (model, left-out fold), on columns scaled by ``moments``."""

    models: Mapping[str, Terms]
    outcome: str
    weight: str
    fold: str
    folds: Sequence[int]
    moments: dict = field(default_factory=dict)
    coefficients: dict = field(default_factory=dict)
    log_likelihood: dict = field(default_factory=dict)

    def raw_columns(self) -> list[str]:
        return sorted({t.column if isinstance(t, Spline) else t for terms in self.models.values() for t in terms})

    def design(self, model: str, fold: int, have: Mapping[str, np.ndarray]) -> np.ndarray:
        cols: list[np.ndarray] = []
        for term in self.models[model]:
            cols += term.columns(have[term.column], fold) if isinstance(term, Spline) else [have[term]]
        return np.stack(cols, axis=1)

    def scaled(self, model: str, fold: int, have: Mapping[str, np.ndarray]) -> np.ndarray:
        mean, scale = self.moments[model, fold]
        x = (self.design(model, fold, have) - mean) / scale
        return np.concatenate([np.ones((len(x), 1)), x], axis=1)


def _summed(df: DataFrame, fits: Fits, each) -> dict[tuple[str, int], np.ndarray]:
    """Sums over all training rows of the vector that ``each(model, fold, columns, weight, outcome)`` gives for a batch."""
    raw = fits.raw_columns()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            have = {c: batch.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in raw}
            w, y, own = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in ("_w", "_y", "_f"))
            model, fold, place, value = [], [], [], []
            for name in fits.models:
                for f in fits.folds:
                    here = own != f
                    v = each(name, f, {c: x[here] for c, x in have.items()}, w[here], y[here])
                    model += [name] * len(v)
                    fold += [f] * len(v)
                    place += range(len(v))
                    value += v.tolist()
            yield pa.RecordBatch.from_arrays([pa.array(model, pa.string()), pa.array(fold, pa.int32()), pa.array(place, pa.int32()), pa.array(value, pa.float64())], names=["model", "fold", "place", "value"])

    rows = df.select(*raw, F.col(fits.weight).cast("double").alias("_w"), F.col(fits.outcome).cast("double").alias("_y"), F.col(fits.fold).cast("double").alias("_f"))
    sums = rows.mapInArrow(run, "model string, fold int, place int, value double").groupBy("model", "fold", "place").agg(F.sum("value").alias("value"))
    out: dict[tuple[str, int], dict[int, float]] = {}
    for r in sums.collect():  # models x folds x (terms squared) numbers
        out.setdefault((r.model, r.fold), {})[r.place] = r.value
    return {k: np.array([v[i] for i in range(len(v))]) for k, v in out.items()}


def fit(df: DataFrame, models: Mapping[str, Terms], outcome: str, weight: str, fold: str | None = None, folds: int = 0, *, ridge: float = 1e-6, most: int = 40, close: float = 1e-10) -> Fits:
    """Weighted logistic fits of every model, one for each left-out fold (or one on all rows without ``fold``), on weighted z-scores
    of the training rows. ``ridge`` is the penalty on the slopes. Rows must be complete; a fit that doesn't converge raises an error.
    """
    df = df if fold else df.withColumn("_none", F.lit(0))
    fits = Fits(models, outcome, weight, fold or "_none", list(range(folds)) if fold else [ALL])

    def moments(model, f, have, w, y):
        x = fits.design(model, f, have)
        return np.concatenate([[w.sum()], w @ x, w @ (x * x)])

    for key, v in _summed(df, fits, moments).items():
        p = (len(v) - 1) // 2
        mean = v[1 : p + 1] / v[0]
        fits.moments[key] = mean, np.sqrt(np.maximum(v[p + 1 :] / v[0] - mean * mean, 1e-12))
        fits.coefficients[key] = np.zeros(p + 1)

    def step(model, f, have, w, y):
        x, b = fits.scaled(model, f, have), fits.coefficients[model, f]
        z = x @ b
        p = np.where(z >= 0, 1 / (1 + np.exp(-np.abs(z))), np.exp(-np.abs(z)) / (1 + np.exp(-np.abs(z))))
        like = (w * (y * z - np.logaddexp(0, z))).sum()
        return np.concatenate([[like], x.T @ (w * (y - p)), ((x * (w * p * (1 - p))[:, None]).T @ x).ravel()])

    for _ in range(most):
        widest = 0.0
        for key, v in _summed(df, fits, step).items():
            b = fits.coefficients[key]
            penalty = np.full(len(b), ridge)
            penalty[0] = 0.0
            move = np.linalg.solve(v[1 + len(b) :].reshape(len(b), -1) + np.diag(penalty), v[1 : 1 + len(b)] - penalty * b)
            fits.log_likelihood[key] = float(v[0])
            fits.coefficients[key] = b + move
            widest = max(widest, float(np.abs(move).max()))
        if widest < close:
            return fits
    raise RuntimeError("a logistic fit did not converge; an outcome may be separated by a column")


def predicted(df: DataFrame, fits: Fits) -> DataFrame:
    """``df`` with a probability column for each model, from the fit that left the row's fold out."""
    raw = fits.raw_columns()
    single = fits.folds == [ALL]
    names = list(fits.models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            have = {c: batch.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in raw}
            own = np.full(batch.num_rows, ALL) if single else batch.column(fits.fold).to_numpy(zero_copy_only=False)
            for name in names:
                out = np.full(batch.num_rows, np.nan)
                for f in fits.folds:
                    here = own == f
                    out[here] = 1 / (1 + np.exp(-(fits.scaled(name, f, {c: x[here] for c, x in have.items()}) @ fits.coefficients[name, f])))
                batch = batch.append_column(name, pa.array(out))
            yield batch

    schema = _schema(df, df.columns, ", ".join(f"`{n}` double" for n in names))
    return df.mapInArrow(run, schema)


def likelihood_ratio(df: DataFrame, small: Terms, large: Terms, outcome: str, weight: str) -> DataFrame:
    """(ll_small, ll_large, statistic, p_value): nested weighted likelihood-ratio test for one further column, weights of mean one."""
    mean = df.agg(F.avg(weight).alias("m")).scalar()
    fits = fit(df.withColumn("_lw", F.col(weight) / mean), {"small": small, "large": large}, outcome, "_lw")
    a, b = fits.log_likelihood["small", ALL], fits.log_likelihood["large", ALL]
    stat = 2 * (b - a)
    row = [(a, b, stat, math.erfc(math.sqrt(max(stat, 0.0) / 2)))]
    return df.sparkSession.createDataFrame(row, "ll_small double, ll_large double, statistic double, p_value double")


def ranked_areas(cells: DataFrame, by: Sequence[str], score: str, block) -> DataFrame:
    """(by, tp, tn, area, ap): in every replicate the positive and negative weight, the area below ROC and below precision-recall.

    ``cells`` (by, score, p, n): resampled weights at each distinct score. ``block`` must not decrease in the score; within and
    between blocks sums run from the highest score down.
    """
    by = list(by)
    cells = cells.withColumns({"block": -block.cast("long"), "_down": -F.col(score)})
    totals = _added(cells, [*by, "block"], ["p", "n"])
    keys = [*by, "block"]
    ahead = [_before(totals, by, "block", v).select(*[F.col(c).alias(f"_{c}") for c in keys], F.col("offset").alias(f"{v}_before")) for v in ("p", "n")]
    offsets = ahead[0].join(ahead[1], [f"_{c}" for c in keys])
    sums = ("tp", "tn", "area", "ap")
    schema = _schema(cells, by, ", ".join(f"{s} binary" for s in sums))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _table({f.name: [] for f in schema.fields}, schema)
        left = left.sort_by("_down")
        p, n = _rows(left.column("p")), _rows(left.column("n"))
        cp = np.cumsum(p, axis=0) + np.frombuffer(right.column("p_before")[0].as_py())
        cn = np.cumsum(n, axis=0) + np.frombuffer(right.column("n_before")[0].as_py())
        precision = np.divide(cp, cp + cn, out=np.zeros_like(cp), where=cp + cn > 0)
        out = {"tp": p.sum(axis=0), "tn": n.sum(axis=0), "area": (n * (cp - p / 2)).sum(axis=0), "ap": (p * precision).sum(axis=0)}
        return _table({**{c: [left.column(c)[0].as_py()] for c in by}, **{k: [v.tobytes()] for k, v in out.items()}}, schema)

    parts = cells.groupBy(*keys).cogroup(offsets.groupBy(*[f"_{c}" for c in keys])).applyInArrow(run, schema)
    return _added(parts, by, sums)


#: Pieces into which the order of the scores is cut, and rows of a matrix (rows by replicates) in :func:`resampled_areas`.
PIECES, SLICE = 32, 128


def resampled_areas(points: DataFrame, by: Sequence[str], score: str, drawn: DataFrame, stratum: str, cluster: str, *, blocks: int = PIECES, most: int = SLICE) -> DataFrame:
    """(by, tp, tn, area, ap) as :func:`ranked_areas`, from ``points`` (cluster, by, score, p, n) and the draws of ``replicates.copies``.

    No sums per replicate are stored for a score: what travels with a point are its cluster's packed copies. Points lie in about
    equally large pieces of the order of scores; only the totals of a piece are added up first, then every piece is read in order,
    ``most`` rows at a time, whatever its length and however many points share a score.
    """
    by = list(by)
    keys = [*by, "block"]
    kind = "packed" if "packed" in drawn.columns else "copies"
    lying = written(with_blocks(points.select(cluster, *by, (-F.col(score)).alias("_down"), "p", "n"), by, "_down", blocks, "block"))
    totals = shared(resampled_sums(lying, keys, ["p", "n"], drawn, stratum, cluster))
    ahead = [_before(totals, by, "block", v).withColumnRenamed("offset", f"{v}_before") for v in ("p", "n")]
    none = lambda kind, *names: [F.lit(None).cast(kind).alias(c) for c in names]
    # The row of what lies before a piece comes first in it.
    heads = ahead[0].join(ahead[1], keys).select(*keys, *none("double", "_down", "p", "n"), *none("binary", kind), "p_before", "n_before")
    rows = lying.join(drawn.select(cluster, kind), cluster).select(*keys, "_down", F.col("p").cast("double").alias("p"), F.col("n").cast("double").alias("n"), kind, *none("binary", "p_before", "n_before"))
    tasks = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.unionByName(heads).repartition(tasks, *keys).sortWithinPartitions(*keys, F.asc_nulls_first("_down"))
    sums = ("tp", "tn", "area", "ap")
    schema = _schema(points, by, ", ".join(f"{s} binary" for s in sums))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = open_ = None  # the piece, and its last score with its sums, which the next rows may add to
        before: list[np.ndarray] = []
        out: dict[str, np.ndarray] = {}

        def close(p: np.ndarray, n: np.ndarray) -> None:
            cp, cn = np.cumsum(p, axis=0) + before[0], np.cumsum(n, axis=0) + before[1]
            precision = np.divide(cp, cp + cn, out=np.zeros_like(cp), where=cp + cn > 0)
            for name, part in (("tp", p), ("tn", n), ("area", n * (cp - p / 2)), ("ap", p * precision)):
                out[name] += part.sum(axis=0)
            before[:] = cp[-1], cn[-1]

        def told() -> Iterator[pa.RecordBatch]:
            if key is not None:
                if open_ is not None:
                    close(open_[1][None], open_[2][None])
                yield from _table({**{c: [v] for c, v in zip(by, key)}, **{k: [v.tobytes()] for k, v in out.items()}}, schema).to_batches()

        for batch in batches:
            names = list(zip(*[batch.column(c).to_pylist() for c in keys]))
            at = 0
            while at < len(names):
                if names[at] != key:
                    yield from told()
                    key, open_ = names[at], None
                    before = [np.frombuffer(batch.column(c)[at].as_py()) for c in ("p_before", "n_before")]
                    out = {k: np.zeros(len(before[0])) for k in sums}
                    at += 1
                    continue
                end = at + 1
                while end < min(len(names), at + most) and names[end] == key:
                    end += 1
                part = batch.slice(at, end - at)
                at = end
                down, copies = part.column("_down").to_numpy(), copies_of(part.column(kind), kind)
                edges = np.flatnonzero(np.concatenate([[True], np.diff(down) != 0]))
                p, n = (np.add.reduceat(part.column(c).to_numpy()[:, None] * copies, edges, axis=0) for c in ("p", "n"))
                if open_ is not None:
                    if open_[0] == down[0]:
                        p[0] += open_[1]
                        n[0] += open_[2]
                    else:
                        p, n = np.concatenate([open_[1][None], p]), np.concatenate([open_[2][None], n])
                if len(p) > 1:
                    close(p[:-1], n[:-1])
                open_ = down[-1], p[-1].copy(), n[-1].copy()
        yield from told()

    return _added(ordered.mapInArrow(run, schema), by, sums)


def foldwise(areas: DataFrame, losses: DataFrame, by: Sequence[str], fold: str = "fold") -> DataFrame:
    """(by, metric, values): fold metrics averaged by the fold's weight in the replicate; not a number where a fold lost a class.

    ``areas`` comes from :func:`ranked_areas` or :func:`resampled_areas`, ``losses`` (by, fold, loss) from resampled sums.
    """
    by = list(by)
    weighted = {
        "roc_auc": lambda v: (v["tp"] + v["tn"]) * v["area"] / (v["tp"] * v["tn"]),
        "pr_auc": lambda v: (v["tp"] + v["tn"]) * np.where(v["tn"] > 0, v["ap"] / v["tp"], np.nan),
        "log_loss": lambda v: np.where((v["tp"] > 0) & (v["tn"] > 0), v["loss"], np.nan),
        "weight": lambda v: v["tp"] + v["tn"],
    }
    per_fold = combined(areas.join(losses, [*by, fold]), [*by, fold], weighted)
    sums = _added(per_fold, [*by, "metric"], ["values"])
    total = sums.filter("metric = 'weight'").select(*by, F.col("values").alias("whole"))
    shares = sums.filter("metric <> 'weight'").withColumnRenamed("metric", "of").join(total, by)
    return combined(shares, [*by, "of"], {"share": lambda v: v["values"] / v["whole"]}).select(*by, F.col("of").alias("metric"), "values")
