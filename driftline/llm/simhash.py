"""SimHash near-duplicates by a byte-position inverted index with count filtering.

Fingerprints have 8 bytes. Two that differ in at most ``d`` bits differ in at most ``d`` bytes, so they share at least
8 - d positional bytes. Postings of single bytes would hold n/256 fingerprints each and pairs that grow with n², so a
posting is keyed by a set of 8 - d positions at once (28 sets for d = 2): a pair that meets there has reached the
guaranteed minimum of shared positional bytes, and each pair that reaches it meets in at least one. Only distinct
fingerprints are posted. Inside a posting the remaining ``d`` bytes take at most 256^d values, so it is bounded; pairs are
verified there by flipping up to ``d`` bits and looking the result up, never by listing all pairs, and one link from each
member to the smallest member it is connected with inside the posting is kept. That loses no connection.

Components follow by spreading the smallest id along links with pointer jumping; every round is written to the shared
folder. Null texts count as empty; texts without words have fingerprint zero and are linked like any other. Repeated ids
are one node, null ids form one node that ranks last. An empty table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import TO_LOWER, free_name, slices, stored

_SPACES = str.maketrans(dict.fromkeys(map(chr, range(9, 14)), " "))
SEED = 42


def words_of(text: str | None) -> list[str]:
    return [w for w in (text or "").translate(TO_LOWER).translate(_SPACES).split(" ") if w]


def fingerprint(text: str | None, width: int = 3) -> int:
    """64 bits; a bit is set if it is set in over half of the shingle hashes."""
    words = words_of(text)
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return digest(" ".join(words).encode(), SEED)
    raw = " ".join(words).encode()
    ends = np.flatnonzero(np.frombuffer(raw, np.uint8) == 32).tolist() + [len(raw)]
    begins = [0, *(e + 1 for e in ends[:-1])]
    votes, count = np.zeros(64, np.int64), len(words) - width + 1
    for at in range(0, count, 1 << 16):
        stop = min(count, at + (1 << 16))
        hashes = np.array([digest(raw[a:b], SEED) for a, b in zip(begins[at:stop], ends[at + width - 1 : stop + width - 1])], ">u8")
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > count).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 3, row: Column | None = None) -> DataFrame:
    """(doc_id, row, fp): the fingerprint as a signed long; ``row`` is carried along."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                prints = np.array([fingerprint(t, width) for t in part.column("text").to_pylist()], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("row"), pa.array(prints)], names=["doc_id", "row", "fp"])

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (F.lit(0) if row is None else row).cast("long").alias("row"))
    return given.mapInArrow(run, "doc_id long, row long, fp long")


def _roots(low: np.ndarray, distance: int, bits: int) -> np.ndarray:
    """For distinct values of ``bits`` bits: the index of one connected value, equal for all that are connected by links of up to ``distance`` bits."""
    if len(low) <= 128:
        a, b = np.nonzero(np.bitwise_count(low[:, None] ^ low[None, :]) <= distance)
        pairs = [np.stack([a, b])]
    else:
        order = np.argsort(low)
        value, pairs = low[order], []
        for n in range(1, distance + 1):
            for bit in combinations(range(bits), n):
                other = value ^ sum(1 << b for b in bit)
                at = np.searchsorted(value, other)
                at[at == len(value)] = 0
                hit = np.flatnonzero(value[at] == other)
                pairs.append(order[np.stack([hit, at[hit]])])
    a, b = np.concatenate(pairs, axis=1)
    root = np.arange(len(low))
    while True:
        new = root.copy()
        np.minimum.at(new, a, root[b])
        new = new[new]
        if (new == root).all():
            return root
        root = new


def links(nodes: DataFrame, distance: int = 2) -> DataFrame:
    """(a, b): links between distinct fingerprints ``nodes`` (fp); they connect exactly what all close pairs connect."""
    sets = list(combinations(range(8), 8 - distance))
    masks = [sum(0xFF << (8 * p) for p in s) for s in sets]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    posted = nodes.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m).cast("long")) for m in signed])).alias("at", "key"))
    shared = posted.repartition("at", "key").sortWithinPartitions("at", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # the last posting, it may go on in the next batch
        for batch in batches:
            rows = np.stack([batch.column(c).to_numpy() for c in ("at", "key", "fp")])
            rows = np.concatenate([*held, rows], axis=1)
            if not rows.shape[1]:
                continue
            new = np.flatnonzero((np.diff(rows[0]) != 0) | (np.diff(rows[1]) != 0)) + 1
            last = new[-1] if len(new) else 0
            held = [rows[:, last:]]
            if last:
                yield close(rows[:, :last])
        if held:
            yield close(held[0])

    def close(rows: np.ndarray) -> pa.RecordBatch:
        at, key, fp = rows
        new = np.flatnonzero((np.diff(at) != 0) | (np.diff(key) != 0)) + 1
        begin, end = np.concatenate([[0], new]), np.concatenate([new, [at.size]])
        found = []
        two = np.flatnonzero(end - begin == 2)
        near = two[np.bitwise_count((fp[begin[two]] ^ fp[begin[two] + 1]).view(np.uint64)) <= distance]
        found.append(np.stack([fp[begin[near] + 1], fp[begin[near]]]))
        for k in np.flatnonzero(end - begin > 2):
            a, b = begin[k], end[k]
            free = [p for p in range(8) if p not in sets[at[a]]]
            raw = fp[a:b].view(np.uint64)
            low = sum(((raw >> np.uint64(8 * p)) & np.uint64(255)).astype(np.int64) << (8 * j) for j, p in enumerate(free))
            root = _roots(low, distance, 8 * len(free))
            to = fp[a:b][root]
            found.append(np.stack([fp[a:b][fp[a:b] != to], to[fp[a:b] != to]]))
        a, b = np.concatenate(found, axis=1)
        return pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], names=["a", "b"])

    return shared.mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable from each node that has a link."""
    edges = stored(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = stored(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
    while True:
        offered = edges.join(labels, edges.b == labels.node).groupBy("a").agg(F.min("root").alias("offer"))
        lower = stored(labels.join(offered, labels.node == offered.a).select("node", F.col("root").alias("old"), F.least("root", "offer").alias("root")))
        above = lower.select(F.col("node").alias("up"), F.col("root").alias("over"))
        labels = stored(lower.join(above, lower.root == above.up).select("node", "old", F.col("over").alias("root")))
        if labels.filter("root <> old").isEmpty():
            return labels.select("node", "root")
        labels = labels.select("node", "root")


def classes(prints: DataFrame, distance: int) -> DataFrame:
    """(fp, root, least): each distinct fingerprint with the name of its class and the smallest doc_id of its own rows."""
    nodes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(nodes, distance)).withColumnRenamed("node", "fp")
    return stored(nodes.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least"))


def near_duplicates(docs: DataFrame, distance: int = 2, width: int = 3) -> DataFrame:
    """(doc_id, fp, fingerprint, component_id) for each row of ``docs``. A class of null ids alone has a null component."""
    prints = stored(fingerprints(docs, width).drop("row"))
    of = classes(prints, distance)
    named = stored(of.groupBy("root").agg(F.min("least").alias("component_id")))
    of = stored(of.join(named, "root").select("fp", "component_id"))
    return prints.join(of, "fp").select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def first_rows(marked: DataFrame, name: str, prints: DataFrame, roots: DataFrame) -> DataFrame:
    """``marked`` without column ``name``, the hash of a row: the first row of each class; ``prints``: (doc_id, row, fp), ``roots``: (fp, root)."""
    own, of = free_name(marked, "kept_id"), free_name(marked, "kept_row")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
    kept = prints.join(roots, "fp").groupBy("root").agg(first).select(F.col("first.doc_id").alias(own), F.col("first.row").alias(of))
    out = marked.join(stored(kept), F.col("doc_id").cast("long").eqNullSafe(F.col(own)) & (F.col(name) == F.col(of)), "left_semi")
    twice = prints.groupBy("doc_id", "row").agg(F.count("*").alias("n")).filter("n > 1")
    if not twice.isEmpty():  # rows that are equal in every column
        out = out.dropDuplicates(["doc_id", name])
    return out.drop(name)


def keep_one(docs: DataFrame, distance: int = 2, width: int = 3) -> DataFrame:
    """``docs`` with one row of each class, that of the smallest doc_id; of equal ids one row, chosen by a hash of all columns."""
    name = free_name(docs, "row")
    marked = docs.withColumn(name, F.xxhash64(*docs.columns))
    prints = stored(fingerprints(marked, width, F.col(name)))
    return first_rows(marked, name, prints, classes(prints, distance).select("fp", "root"))
