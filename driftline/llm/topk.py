"""Exact top-k search by distributed histogram selection.

Vectors become integers, scores are integer inner products. Vectors are dealt into groups of about ``group`` rows and queries
into blocks of about ``block`` rows; each pair of a group and a block is scored in one task, a stated query set against all
rows, without pairs of vectors as rows.

The k-th score of each query is found by refining a global histogram of its scores: 2^20 wide bins first, then 2^10 wide
bins inside the bin that holds the k-th value, then single values. A task names only its best bins until they hold k
scores, since the global k-th value is never below a task's own. A last pass keeps scores above the k-th value, and of
those equal to it the k smallest ids of a task, and ranks what is left. A query with fewer than k candidates gets all.

Vectors that are null, empty, of another length than the query's, or hold null or non-finite components take no part. A
query does not find rows with its own id; null ids take no part. Repeated rows of other ids count as often as they occur;
equal scores go to the smaller id. A query id that repeats asks once, with its smallest vector. An empty table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

SHIFTS = (20, 10, 0)


def integers(vector: Column, scale: float = 256.0) -> Column:
    """floor(scale * x) of each component as doubles that hold integers."""
    return F.transform(vector.cast("array<double>"), lambda x: F.floor(x * scale).cast("double"))


def usable(vector: Column) -> Column:
    good = F.forall(vector.cast("array<double>"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & good, F.lit(False))


def _scores(left: pd.DataFrame, right: pd.DataFrame):
    """Scores of the group's rows (across) for some queries at a time; own ids and other lengths get -inf."""
    if left.empty or right.empty:
        return
    ids = left.vec_id.to_numpy()
    length = left.v.map(len).to_numpy()
    for size, part in right.groupby(right.v.map(len), sort=True):
        same = np.flatnonzero(length == size)
        if not len(same):
            continue
        rows = np.stack(left.v.to_numpy()[same])
        for at in range(0, len(part), 256):
            few = part.iloc[at : at + 256]
            score = np.stack(few.v.to_numpy()) @ rows.T
            score[few.query_id.to_numpy()[:, None] == ids[same][None, :]] = -np.inf
            yield few, ids[same], score


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, group: int = 4096, block: int = 2048, scale: float = 256.0) -> DataFrame:
    """(query_id, rank, vec_id, score) for ``vectors`` (vec_id, embedding)."""
    whole = stored(vectors.filter(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), integers(F.col("embedding"), scale).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks")))
    sizes = whole.agg(F.count("*").alias("n"), F.count_if("asks").alias("q")).first()
    groups, blocks = max(1, -(-sizes.n // group)), max(1, -(-sizes.q // block))
    # rows of one id may be many: they are dealt by id and vector
    dealt = whole.withColumn("g", F.pmod(F.xxhash64("vec_id", "v"), F.lit(groups)).cast("int")).select("vec_id", "v", "g", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"))
    asked = whole.filter("asks").groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("v")).withColumn("b", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
    spread = lambda q: q.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    state = asked.withColumns({"parent": F.lit(None).cast("long"), "need": F.lit(k).cast("long")})
    left = dealt.groupBy("g", "b")

    def bins(shift: int, above: int | None):
        def run(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
            out = []
            for few, _, score in _scores(rows, queries):
                for query, parent, need, own in zip(few.query_id, few.parent, few.need, score):
                    own = own[own > -np.inf].astype(np.int64)
                    if above is not None:
                        own = own[(own >> above) == parent]
                    if need < len(own):
                        own = own[np.argpartition(own, len(own) - int(need))[len(own) - int(need) :]]
                    names, n = np.unique(own >> shift, return_counts=True)
                    out.append((np.full(len(names), query), names, n))
            q, b, n = (np.concatenate(c) for c in zip(*out)) if out else (np.empty(0, np.int64),) * 3
            return pd.DataFrame({"query_id": q, "bin": b, "n": n})

        return run

    above = None
    for shift in SHIFTS:
        counted = left.cogroup(spread(state).groupBy("g", "b")).applyInPandas(bins(shift, above), "query_id long, bin long, n long").groupBy("query_id", "bin").agg(F.sum("n").alias("n"))
        run = F.sum("n").over(Window.partitionBy("query_id").orderBy(F.desc("bin")))  # at most k bins of each task
        reached = counted.withColumn("upto", run)
        need = state.select("query_id", "need")
        held = reached.join(need, "query_id").filter((F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("n") < F.col("need"))).select("query_id", F.col("bin").alias("parent"), (F.col("need") - (F.col("upto") - F.col("n"))).alias("need"))
        state = stored(state.drop("parent", "need").join(held, "query_id", "left").select("query_id", "v", "b", "parent", F.coalesce("need", F.lit(k).cast("long")).alias("need")))
        above = shift

    def keep(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        for few, ids, score in _scores(rows, queries):
            for query, value, own in zip(few.query_id, few.parent, score):
                if pd.isna(value):  # fewer than k candidates in all
                    at = np.flatnonzero(own > -np.inf)
                else:
                    tied = np.flatnonzero(own == value)
                    at = np.concatenate([np.flatnonzero(own > value), tied[np.argsort(ids[tied], kind="stable")[:k]]])
                out.append((np.full(len(at), query), ids[at], own[at].astype(np.int64)))
        q, v, s = (np.concatenate(c) for c in zip(*out)) if out else (np.empty(0, np.int64),) * 3
        return pd.DataFrame({"query_id": q, "vec_id": v, "score": s})

    found = left.cogroup(spread(state).groupBy("g", "b")).applyInPandas(keep, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
