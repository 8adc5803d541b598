"""Near-duplicate vectors against all pairs."""

import math

import numpy as np
from pyspark.sql import functions as F

from driftline.llm import itq


def clusters(rng, d, sizes, noise):
    out = []
    for g in sizes:
        centre = rng.standard_normal(d)
        centre /= np.linalg.norm(centre)
        out += [centre + noise * rng.standard_normal(d) / math.sqrt(d) for _ in range(g)]
    return out


def brute(rows, least=0.9):
    """(vec_id, n_links, component_id) of each row, from all pairs."""
    good = [k for k, (_, v) in enumerate(rows) if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    unit = {k: np.array(rows[k][1]) / np.linalg.norm(rows[k][1]) for k in good}
    links = {k: {j for j in good if j != k and len(unit[j]) == len(unit[k]) and unit[j] @ unit[k] >= least} for k in good}
    out = []
    for k, (i, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            more = links.get(todo.pop(), set()) - seen
            seen |= more
            todo += more
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((i, len(links.get(k, ())), min(ids) if ids else None))
    return out


def key(r):
    return tuple(-(10**9) if x is None else x for x in r)


def run(spark, rows, **how):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("node", "v", "code", "pivot", "a", "m", "u", "key")})
    got = itq.near_vectors(df, **how).collect()
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    return sorted([(r.vec_id, r.n_links, r.component_id) for r in got], key=key)


def test_tight_groups_singles_and_odd_rows(spark):
    rng = np.random.default_rng(3)
    vectors = clusters(rng, 24, [1] * 60 + [2] * 10 + [40, 25, 7], 0.12)
    rows = [(k, [float(x) for x in v * rng.uniform(0.01, 50)]) for k, v in enumerate(vectors)]
    rows += [(3, rows[90][1]), (500, rows[90][1]), (500, rows[90][1]), (None, rows[80][1]), (None, rows[0][1])]  # repeated ids, rows and null ids
    rows += [(600, None), (601, []), (602, [0.0] * 24), (603, [1.0, None] + [0.0] * 22), (604, [math.nan] * 24), (605, [math.inf] + [0.0] * 23), (None, None)]
    rows += [(700, [1.0, 2.0]), (701, [2.0, 4.1]), (702, [3.0]), (703, [-1.0])]  # other lengths
    assert run(spark, rows) == sorted(brute(rows), key=key)
    assert run(spark, []) == []


def test_groups_whose_members_lie_across_the_threshold(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal(16)
    base /= np.linalg.norm(base)
    side = rng.standard_normal(16)
    side -= side @ base * base
    side /= np.linalg.norm(side)
    rows = []
    for step in range(9):  # tight groups along an arc of 7 degrees a step: near ones link wholly, further ones in part
        at = math.cos(math.radians(7 * step)) * base + math.sin(math.radians(7 * step)) * side
        rows += [(100 * step + k, [float(x) for x in at + 0.03 * rng.standard_normal(16)]) for k in range(12)]
    got, want = run(spark, rows), sorted(brute(rows), key=key)
    assert [r[0] for r in got] == [r[0] for r in want]
    found, all_links = sum(r[1] for r in got), sum(r[1] for r in want)
    assert 0.97 * all_links <= found <= all_links and all(a[1] <= b[1] for a, b in zip(got, want))
    assert {r[2] for r in got} == {r[2] for r in want}


def test_recall_at_the_threshold():
    rng = np.random.default_rng(5)
    x = rng.standard_normal((4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.standard_normal(x.shape)
    y -= (x * y).sum(axis=1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    model = {64: itq.learn(x, 64)}
    a, b = (itq.code_of(v, model).view(np.uint64) for v in (x, 0.9 * x + math.sqrt(0.19) * y))
    differ = a ^ b
    parts = np.stack([np.bitwise_count((differ >> np.uint64(16 * t)) & np.uint64(0xFFFF)) for t in range(4)])
    met = (parts.min(axis=0) <= 2) & (np.bitwise_count(differ) <= 16)
    assert met.mean() > 0.94  # pairs at exactly 0.9
    assert abs((np.unpackbits(a.view(np.uint8)).mean()) - 0.5) < 0.02  # balanced bits
