"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of ``least`` or more, besides close fingerprints.

Who may have a partner: MinHash, 160 minima in 32 bands of five. A pair of similarity s shares no band with probability
(1 - s^5)^32: 3e-6 at s = 0.8, 2e-12 at 0.9. That is the only loss. Texts that share no band with another go no further.

Which pairs: a prefix-filter join of the rest. All shingles have one global order, by their count and then their hash, so a text's
own words come first and common passages last. Two sets of similarity ``least`` share a shingle among the first
size - ceil(least * size) + 1 of each, so a text is posted under these alone, and texts that only share a common passage never
meet. Sizes and places bound the overlap of those that do.

Copies are joined to one text first: under each shingle all are compared with the one that has fewest shingles before it, the
one with least of its own, and classes are built from what holds together with the close fingerprints. Only where a shingle
still has several classes are their members compared across classes, in pairs of bounded blocks; an upper bound of the overlap
from 256 counts of shingles by hash, exact, passes over nearly all that aren't similar. What is left is decided on the shingles.

Words are those of the fingerprint. Texts of fewer than five words have one shingle, null and empty texts none; these are one
class by their fingerprint. Very long texts are one row with all their shingles. Equal texts are one from the start; repeated and
null ids, and rows equal in every column, are handled as in ``simhash.keep_one``. Columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import free_name, slices, stored

WIDTH, BANDS, ROWS = 5, 32, 5
#: Counts in a sketch, and members of a block that is compared with another one.
COUNTS, BLOCK = 256, 1024

_draw = np.random.default_rng(simhash.SEED)
_SPREAD, _TIMES, _PLUS, _MIX = (_draw.integers(0, 1 << 64, n, np.uint64) | np.uint64(1) for n in (WIDTH, BANDS * ROWS, BANDS * ROWS, ROWS))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(words: list[str]) -> np.ndarray:
    """Distinct 64-bit hashes of the runs of five words, ascending."""
    digest = xxhash.xxh64_intdigest
    own = {w: digest(w.encode(), simhash.SEED) for w in set(words)}
    hashes = np.fromiter((own[w] for w in words), np.uint64, len(words))
    n = max(1, len(words) - WIDTH + 1) if words else 0
    total = np.full(n, min(len(words), WIDTH), np.uint64)
    for j in range(min(WIDTH, len(words))):
        total += _mixed(hashes[j : j + n] * _SPREAD[j])
    return np.unique(_mixed(total))


def minima(shingles: np.ndarray) -> np.ndarray:
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 1024):
        least = np.minimum(least, _mixed(shingles[None, at : at + 1024] * _TIMES[:, None] + _PLUS[:, None]).min(axis=1))
    return least


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if both else 0.0


def prints(docs: DataFrame, row: str) -> DataFrame:
    """(doc_id, row, fp, node, size, keys): the fingerprint, a hash of the words, the shingles' number and the band values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column("text").to_pylist()
                lists = [simhash.words_of(t) for t in texts]
                sets = [shingle_set(w) for w in lists]
                least = np.array([minima(s) for s in sets], np.uint64).reshape(-1, BANDS, ROWS)
                keys = _mixed(_mixed((least * _MIX).sum(axis=2)) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)
                fp = np.array([simhash.fingerprint(t) for t in texts], np.uint64).view(np.int64)
                node = np.array([xxhash.xxh64_intdigest(" ".join(w).encode(), simhash.SEED) for w in lists], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("row"), pa.array(fp), pa.array(node), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys.tolist(), pa.list_(pa.int64()))], names=["doc_id", "row", "fp", "node", "size", "keys"])

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col(row).alias("row"))
    return given.mapInArrow(run, "doc_id long, row long, fp long, node long, size long, keys array<bigint>")


def grams(docs: DataFrame, wanted: DataFrame, row: str) -> DataFrame:
    """(node, fp, size, shingles, sketch) of the texts that ``wanted`` (node, fp, own_id, own_row) names; the sketch counts shingles by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = [shingle_set(simhash.words_of(t)) for t in part.column("text").to_pylist()]
                counts = [np.bincount((s >> np.uint64(40)).astype(np.int64) % COUNTS, minlength=COUNTS).astype(np.int32).tobytes() for s in sets]
                edges = np.cumsum([0, *(len(s) for s in sets)])
                flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
                lists = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([part.column("node"), part.column("fp"), pa.array(np.diff(edges)), lists, pa.array(counts, pa.binary())], names=["node", "fp", "size", "shingles", "sketch"])

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col(row).alias("row"))
    own = given.join(wanted, F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("row") == F.col("own_row"))).select("node", "fp", "text").dropDuplicates(["node"])
    return own.mapInArrow(run, "node long, fp long, size long, shingles array<bigint>, sketch binary")


def needed(a: Column | str, b: Column | str, least: float) -> Column:
    """The least overlap of two sets of these sizes that has the similarity."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.ceil((a + b) * F.lit(least / (1 + least)) - F.lit(1e-9))


def postings(texts: DataFrame, least: float) -> DataFrame:
    """(key, node, fp, size, place): each text under the shingles of its prefix that another text has too, with their place in the global order."""
    every = texts.select("node", F.explode("shingles").alias("key"))
    shared = stored(every.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"))
    known = every.join(shared, "key").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("n", "key"))).alias("own"))
    known = texts.select("node", "fp", "size").join(known, "node").withColumn("alone", F.col("size") - F.size("own"))
    prefix = F.col("size") - F.ceil(F.col("size") * F.lit(least) - F.lit(1e-9)) + 1 - F.col("alone")
    posted = known.filter(prefix > 0).select("node", "fp", "size", "alone", F.posexplode(F.slice("own", 1, prefix.cast("int"))).alias("at", "x"))
    return posted.select("x.key", "node", "fp", "size", (F.col("alone") + F.col("at")).alias("place"))


def possible(a: str, b: str, least: float) -> Column:
    """Whether sizes and places of two postings of a shingle, structs ``a`` and ``b``, leave room for the overlap."""
    left = lambda x: F.col(f"{x}.size") - F.col(f"{x}.place")
    return F.least(left(a), left(b)) >= needed(F.col(f"{a}.size"), F.col(f"{b}.size"), least)


def around(posted: DataFrame, least: float) -> DataFrame:
    """(a, b): under each shingle, pairs with the text that has fewest shingles before it."""
    one = F.struct("place", "size", "node")
    ends = posted.groupBy("key").agg(F.min(one).alias("low"))
    met = posted.join(ends, "key").select(one.alias("own"), "low").filter(F.col("own.node") != F.col("low.node"))
    return met.filter(possible("own", "low", least)).select(F.least("own.node", "low.node").alias("a"), F.greatest("own.node", "low.node").alias("b")).distinct()


def across(posted: DataFrame, of: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """(a, b): pairs under a shingle that lie in different classes of ``of`` (fp, root) and may be similar by sizes, places and sketches."""
    known = posted.join(of, "fp").select("key", "node", "root", "size", "place")
    groups = known.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count("*").alias("m")).filter("r0 <> r1")
    open_ = stored(known.join(groups.select("key", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks")), "key"))
    # Two blocks meet in one group of at most about 2 * BLOCK members, whatever the shingle's number of texts.
    own = F.pmod(F.hash("node"), F.col("blocks"))
    dealt = open_.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "node", "root", "size", "place")
    dealt = dealt.join(texts.select("node", "sketch"), "node")
    share = least / (1 + least)

    def run(group: pa.Table) -> pa.Table:
        own, lo, node, root, size, place = (group.column(c).to_numpy() for c in ("own", "lo", "node", "root", "size", "place"))
        sketch = np.frombuffer(b"".join(group.column("sketch").to_pylist()), np.int32).reshape(-1, COUNTS)
        within = (own == own[0]).all()
        left = size - place
        found = []
        for i in range(len(node)):
            ok = (root != root[i]) & (node > node[i] if within else (own != lo[i]) & (own[i] == lo[i]))
            ok &= np.minimum(left, left[i]) >= np.ceil((size + size[i]) * share - 1e-9)
            at = np.flatnonzero(ok)
            both = np.minimum(sketch[at], sketch[i]).sum(axis=1)
            at = at[both >= np.ceil((size[at] + size[i]) * share - 1e-9)]
            found.append(np.stack([np.minimum(node[i], node[at]), np.maximum(node[i], node[at])]))
        a, b = np.concatenate(found, axis=1)
        return pa.table({"a": a, "b": b})

    return dealt.groupBy("key", "lo", "hi").applyInArrow(run, "a long, b long").distinct()


def verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """(a, b) as fingerprints: the pairs (a, b) of nodes whose shingles have the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, second = (batch.column(c) for c in ("a_set", "b_set"))
            keep = [similarity(first[k].values.to_numpy(), second[k].values.to_numpy()) >= least - 1e-12 for k in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column("fp_a"), batch.column("fp_b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = lambda x: texts.select(F.col("node").alias(x), F.col("fp").alias(f"fp_{x}"), F.col("shingles").alias(f"{x}_set"))
    both = pairs.join(side("b"), "b").join(side("a"), "a").select("fp_a", "fp_b", "a_set", "b_set")
    return both.mapInArrow(run, "a long, b long").distinct()


def classes(docs: DataFrame, seen: DataFrame, row: str, distance: int = 2, least: float = 0.8) -> DataFrame:
    """(fp, root): the class of each fingerprint of ``seen``, by links of fingerprints and of similar texts."""
    fps = stored(seen.select("fp").distinct())
    edges = stored(simhash.links(fps, distance))
    nodes = seen.filter("size > 0").groupBy("node").agg(F.min(F.struct("doc_id", "row", "fp")).alias("x"), F.first("keys").alias("keys"))
    banded = stored(nodes.select("node", "x", F.explode("keys").alias("key")))
    mixed = banded.groupBy("key").agg(F.min("x.fp").alias("f0"), F.max("x.fp").alias("f1")).filter("f0 <> f1")
    wanted = banded.join(mixed, "key", "left_semi").select("node", F.col("x.fp").alias("fp"), F.col("x.doc_id").alias("own_id"), F.col("x.row").alias("own_row")).distinct()
    texts = stored(grams(docs, wanted, row))
    posted = stored(postings(texts, least))

    def roots(edges: DataFrame) -> DataFrame:
        return fps.join(simhash.components(edges).withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))

    edges = stored(edges.select("a", "b").union(verified(around(posted, least), texts, least)))
    of = stored(roots(edges))
    more = stored(verified(across(posted, of, texts, least), texts, least))
    return of if more.isEmpty() else stored(roots(edges.union(more)))


def keep_one(docs: DataFrame, distance: int = 2, least: float = 0.8) -> DataFrame:
    """``docs`` with one row of each class, that of the smallest doc_id; of equal ids one row, chosen by a hash of all columns."""
    name = free_name(docs, "row")
    marked = docs.withColumn(name, F.xxhash64(*docs.columns))
    seen = stored(prints(marked, name))
    return simhash.first_rows(marked, name, seen.select("doc_id", "row", "fp"), classes(marked, seen, name, distance, least))
