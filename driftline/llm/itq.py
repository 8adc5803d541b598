"""Near-duplicate vectors by iterative quantisation: balanced binary codes, multi-index Hamming tables, exact reranking.

Codes: unit vectors are turned onto their principal axes, then a rotation is learned that brings them close to the corners of a
cube (alternating signs and the orthogonal Procrustes solution). Vectors are not centred first: the cosine is an angle at the
origin, and around another centre near vectors of a narrow bundle would lie apart. Where a length has fewer than 64 axes several
rotations are stacked, so a code has 64 bits always. The rotation is fitted on ``fit_rows`` vectors at most, those of the least
hashes; lengths the sample has fewer than two of take a random rotation by a fixed rule. Every vector is coded and indexed.

Retrieval: four tables of 16-bit parts. Each vector is posted under its part and the 16 parts one flip away, so two vectors meet
where a part differs in two bits or fewer; full codes of more than ``most`` differing bits are passed over inside the join. A
pair at cosine 0.9 differs in 9 bits of 64 on average and meets with probability 0.97, closer ones nearly always. What meets is
decided by the cosine of the vectors in double precision, so no link is false.

Groups of copies: equal vectors are one node. Nodes that share half of a code are compared with the least of them only, in
rounds; those within half the largest angle of such a pivot form its group, all of whose members are linked for certain. Groups
are posted once per key and compared pivot to pivot: the angle and the two radii mostly decide for all members at once; only
where they don't are members compared with the other pivot, and with its members last. So g close copies cost about g rows, and
counts of links are sums of sizes.

Vectors that are null, empty, zero or hold null or non-finite components link with nothing: no links, their own id as component.
Vectors of different lengths have no cosine. Repeated rows and ids count as rows of their own; null ids take part and rank last,
a component of null ids alone is null and its rows are kept. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored
from .simhash import components

BITS, PART, SEED = 64, 16, 42
#: Angles are compared with this margin; what lies inside it is decided by the cosine itself.
SLACK = 1e-7
Model = dict[int, np.ndarray]


def learn(unit: np.ndarray, d: int, steps: int = 50) -> np.ndarray:
    """A matrix: signs of x @ matrix are the 64 bits of unit vectors x of length ``d``."""
    rng = np.random.default_rng([SEED, d])
    known = len(unit) > 1
    axes = np.linalg.svd(unit, full_matrices=len(unit) < d)[2].T[:, :BITS] if known else np.linalg.qr(rng.standard_normal((d, min(d, BITS))))[0]
    flat, wide = unit @ axes, axes.shape[1]
    found = []
    for _ in range(math.ceil(BITS / wide)):
        turn = np.linalg.qr(rng.standard_normal((wide, wide)))[0]
        for _ in range(steps if known else 0):
            left, _, right = np.linalg.svd(np.where(flat @ turn >= 0, 1.0, -1.0).T @ flat)
            turn = (left @ right).T
        found.append(axes @ turn)
    return np.concatenate(found, axis=1)[:, :BITS]


def unit_rows(raw: np.ndarray) -> np.ndarray:
    raw = raw / np.abs(raw).max(axis=1, keepdims=True)
    return raw / np.linalg.norm(raw, axis=1, keepdims=True)


def fit(vectors: DataFrame, fit_rows: int) -> Model:
    """A model for each length that the sample of ``vectors`` (v) has."""
    sample = vectors.orderBy(F.xxhash64("v"), F.hash("v")).limit(fit_rows).select("v").toArrow().column("v").to_pylist()
    by: dict[int, list] = {}
    for v in sample:
        by.setdefault(len(v), []).append(v)
    return {d: learn(unit_rows(np.array(rows)), d) for d, rows in by.items()}


def code_of(unit: np.ndarray, model: Model) -> np.ndarray:
    d = unit.shape[1]
    matrix = model[d] if d in model else learn(np.empty((0, d)), d)
    return np.packbits(unit @ matrix >= 0, axis=1).view(">i8").ravel().astype(np.int64)


def _lists(column: pa.ListArray) -> np.ndarray:
    """Lists of equal length as the rows of a matrix."""
    return column.flatten().to_numpy().reshape(len(column), -1)


def _coded(nodes: DataFrame, model: Model) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d in set(batch.column("d").to_pylist()):
                part = batch.filter(pa.compute.equal(batch.column("d"), d))
                unit = unit_rows(_lists(part.column("v")))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(unit) + 1) * d, pa.int32()), pa.array(unit.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("node"), part.column("m"), pa.array(code_of(unit, model)), lists], names=["node", "m", "code", "u"])

    return nodes.select("node", "m", "v", F.size("v").alias("d")).mapInArrow(run, "node string, m long, code long, u array<double>")


def _cosines(pairs: DataFrame, schema: str) -> DataFrame:
    """The columns of ``schema`` but the last from ``pairs``, and ``cos`` of its columns ``ua`` and ``ub``; of unequal lengths: -2."""
    keep = [c.split()[0] for c in schema.split(", ")][:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(c) for c in ("ua", "ub"))
            la, lb = (pa.compute.list_value_length(x).to_numpy() for x in (a, b))
            cos = np.full(batch.num_rows, -2.0)
            for d in np.unique(la[la == lb]):
                at = np.flatnonzero((la == d) & (lb == d))
                cos[at] = np.einsum("ij,ij->i", _lists(a.take(pa.array(at))), _lists(b.take(pa.array(at))))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(cos)], names=[*keep, "cos"])

    return pairs.select(*keep, "ua", "ub").mapInArrow(run, schema)


def _differing(a: Column | str, b: Column | str) -> Column:
    return F.bit_count((F.col(a) if isinstance(a, str) else a).bitwiseXOR(F.col(b) if isinstance(b, str) else b))


def _beside(nodes: DataFrame, name: str, vector: str) -> DataFrame:
    return nodes.select(F.col("node").alias(name), F.col("u").alias(vector))


def attached(nodes: DataFrame, least_cos: float, rounds: int) -> DataFrame:
    """(node, pivot, cos): nodes within ``least_cos`` of a pivot, which is itself attached to none."""
    masks = [sum(0xFFFF << PART * p for p in pair) for pair in combinations(range(BITS // PART), 2)]
    halves = F.array(*[F.col("code").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m).cast("long")) for m in masks])
    free, found = nodes, None
    for _ in range(rounds):
        posted = stored(free.select("node", "code", F.posexplode(halves).alias("at", "key")))
        lead = posted.groupBy("at", "key").agg(F.min(F.struct("node", "code")).alias("lead"))
        near = posted.join(lead, ["at", "key"]).filter((F.col("lead.node") < F.col("node")) & (_differing("code", "lead.code") <= PART))
        pairs = near.select("node", F.col("lead.node").alias("pivot")).distinct()
        both = pairs.join(_beside(free, "node", "ua"), "node").join(_beside(free, "pivot", "ub"), "pivot")
        close = stored(_cosines(both, "node string, pivot string, cos double").filter(F.col("cos") >= least_cos))
        roots = close.join(close.select(F.col("node").alias("pivot")).distinct(), "pivot", "left_anti")
        new = stored(roots.groupBy("node").agg(F.max(F.struct("cos", "pivot")).alias("x")).select("node", "x.pivot", "x.cos"))
        if new.isEmpty():
            break
        found = new if found is None else found.union(new)
        gone = new.select("node").union(new.select("pivot")).distinct()
        free = stored(free.join(gone, "node", "left_anti"))
    return nodes.sparkSession.createDataFrame([], "node string, pivot string, cos double") if found is None else stored(found)


def groups_of(nodes: DataFrame, least: float, rounds: int) -> tuple[DataFrame, DataFrame]:
    """Members (node, m, code, u, pivot, angle) and groups (pivot, total, radius, spread, code, u): rows, angle and bits around the pivot."""
    angle = math.acos(least) / 2 - SLACK
    joined = attached(nodes, math.cos(angle), rounds)
    members = nodes.join(joined, "node", "left").select("node", "m", "code", "u", F.coalesce("pivot", "node").alias("pivot"), F.when(F.col("pivot").isNull(), 0.0).otherwise(F.acos(F.least("cos", F.lit(1.0)))).alias("angle"))
    members = stored(members)
    heads = members.filter(F.col("node") == F.col("pivot")).select("pivot", F.col("code").alias("head"), F.col("u").alias("head_u"))
    with_head = members.select("pivot", "m", "code", "angle").join(heads.select("pivot", "head"), "pivot")
    sums = with_head.groupBy("pivot").agg(F.sum("m").alias("total"), F.max("angle").alias("radius"), F.max(_differing("code", "head")).alias("spread"))
    return members, stored(sums.join(heads, "pivot").select("pivot", "total", "radius", "spread", F.col("head").alias("code"), F.col("head_u").alias("u")))


def meeting(members: DataFrame, groups: DataFrame, most: int) -> DataFrame:
    """(a, b): pivots of groups that hold members whose codes meet in a table and differ in ``most`` bits or fewer."""
    flips = [0, *(1 << k for k in range(PART))]
    keys = [(F.shiftrightunsigned("code", PART * t).bitwiseAND(F.lit((1 << PART) - 1)) + F.lit(t << PART)).bitwiseXOR(F.lit(x)).cast("int") for t in range(BITS // PART) for x in flips]
    posted = members.select("pivot", F.explode(F.array(*keys)).alias("key")).distinct()
    posted = stored(posted.join(groups.select("pivot", "code", "spread"), "pivot"))
    a, b = (posted.select("key", *[F.col(c).alias(f"{c}_{x}") for c in ("pivot", "code", "spread")]) for x in "ab")
    near = (F.col("pivot_a") < F.col("pivot_b")) & (_differing("code_a", "code_b") <= F.lit(most) + F.col("spread_a") + F.col("spread_b"))
    met = a.hint("shuffle_merge").join(b, (a.key == b.key) & near)
    return met.select(F.col("pivot_a").alias("a"), F.col("pivot_b").alias("b")).distinct()


def near_vectors(embeddings: DataFrame, least: float = 0.9, fit_rows: int = 8192, most: int = 16, rounds: int = 8) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``embeddings`` (vec_id, embedding)."""
    limit = math.acos(least)
    v = F.col("embedding").cast("array<double>")
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    usable = F.coalesce((F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False))
    name = F.concat(F.hex(F.xxhash64("v")), F.lit(":"), F.hex(F.xxhash64(F.lit(1), "v")))
    named = stored(rows.select("vec_id", "v", F.when(usable, name).alias("node")))
    good = named.filter(F.col("node").isNotNull())
    distinct = good.groupBy("node").agg(F.count("*").alias("m"), F.first("v").alias("v"))
    distinct = stored(distinct)
    nodes = stored(_coded(distinct, fit(distinct, fit_rows)))
    members, groups = groups_of(nodes, least, rounds)

    side = lambda x, u: groups.select(F.col("pivot").alias(x), F.col("u").alias(u), F.col("radius").alias(f"r{x}"), F.col("total").alias(f"t{x}"))
    both = meeting(members, groups, most).join(side("a", "ua"), "a").join(side("b", "ub"), "b")
    seen = _cosines(both, "a string, b string, ra double, rb double, ta long, tb long, cos double")
    turn, reach = F.acos(F.least(F.greatest("cos", F.lit(-1.0)), F.lit(1.0))), F.col("ra") + F.col("rb")
    every = F.when(reach == 0, F.col("cos") >= least).otherwise(turn + reach <= limit - SLACK)
    seen = seen.filter(F.col("cos") > -1.5).withColumn("every", every).filter(F.col("every") | ((reach > 0) & (turn - reach <= limit + SLACK)))
    seen = stored(seen)
    whole = seen.filter("every")
    part = seen.filter("not every")
    part = part.select("a", "b", "rb", "tb").union(part.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("ra").alias("rb"), F.col("ta").alias("tb")))
    own = members.select(F.col("pivot").alias("a"), F.col("node").alias("x"), F.col("u").alias("ua"))
    one = _cosines(part.join(own, "a").join(_beside(nodes, "b", "ub"), "b"), "a string, b string, x string, rb double, tb long, cos double")
    turn = F.acos(F.least(F.greatest("cos", F.lit(-1.0)), F.lit(1.0)))
    every = F.when(F.col("rb") == 0, F.col("cos") >= least).otherwise(turn + F.col("rb") <= limit - SLACK)
    one = stored(one.withColumn("every", every).filter(F.col("every") | ((F.col("rb") > 0) & (turn - F.col("rb") <= limit + SLACK))))
    other = members.select(F.col("pivot").alias("b"), "m", F.col("u").alias("ub"))
    rest = one.filter("not every").select("a", "b", "x").join(_beside(nodes, "x", "ua"), "x").join(other, "b")
    rest = stored(_cosines(rest, "a string, b string, x string, m long, cos double").filter(F.col("cos") >= least))

    by_group = whole.select("a", "tb").union(whole.select(F.col("b"), F.col("ta"))).groupBy(F.col("a").alias("pivot")).agg(F.sum("tb").alias("more"))
    by_node = one.filter("every").select("x", "tb").union(rest.select("x", "m")).groupBy(F.col("x").alias("node")).agg(F.sum("tb").alias("own"))
    edges = whole.select("a", "b").union(one.filter("every").select("a", "b")).union(rest.select("a", "b")).distinct()
    roots = components(edges).withColumnRenamed("node", "pivot")
    links = members.select("node", "pivot").join(groups.select("pivot", "total"), "pivot").join(by_group, "pivot", "left").join(by_node, "node", "left").join(roots, "pivot", "left")
    links = stored(links.select("node", F.coalesce("root", "pivot").alias("root"), (F.col("total") - 1 + F.coalesce("more", F.lit(0)) + F.coalesce("own", F.lit(0))).alias("n_links")))
    ids = good.groupBy("node").agg(F.min("vec_id").alias("low")).join(links, "node").groupBy("root").agg(F.min("low").alias("component_id"))
    links = stored(links.join(ids, "root").select("node", "n_links", "component_id"))
    out = good.join(links, "node").select("vec_id", "n_links", "component_id")
    out = out.union(named.filter(F.col("node").isNull()).select("vec_id", F.lit(0).cast("long"), F.col("vec_id")))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
