"""Scoring texts with a context-tree-weighting model of bytes.

A byte is eight binary decisions. At each of them, contexts of 0 to ``DEPTH`` preceding bytes keep counts of zeros and ones;
each estimates the next bit by Krichevsky-Trofimov, and a context mixes its own estimate with those of its one byte longer
contexts in the proportion in which both have coded the training texts (a context-tree weighting with weight 1/2 at each
node). A context that training never met says nothing: its parent's estimate stands. Text begins after ``DEPTH`` end marks
and ends with one (the byte 255, which no UTF-8 text has), so probabilities of all texts sum to one.

How it runs: texts are dealt into batches of about ``batch_bytes`` by a hash of the id. A task counts the byte strings and
words of its batches; counts are summed over all training texts; subtrees of contexts are computed per group of contexts
with equal last two bytes. Only nodes of depth 0 and 1 (at most 65,536) meet in the driver. Each batch then gets the values
of just the byte strings and words it has, next to its texts, so nothing that grows with the corpus is broadcast.

Null texts count as empty and hold the end alone. A row without id belongs to the training texts; repeated rows are
learned as often as they occur and scored one by one. Without training texts each bit has probability 1/2. An empty table
gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, stored

DEPTH = 4
END = b"\xff"
_LEVELS = np.arange(8)


def byte_strings(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all coded bytes of the texts and each text's count of them.

    A key holds the context, latest byte first, and then the byte: five bytes, so a shift leaves a shorter context.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    raw = np.frombuffer(END * DEPTH + (END * (DEPTH + 1)).join(texts) + END, np.uint8).astype(np.int64)
    key = raw[DEPTH:].copy()
    for d in range(1, DEPTH + 1):
        key |= raw[DEPTH - d : len(raw) - d] << (8 * (DEPTH + 1 - d))
    coded = np.ones(len(key), bool)
    ends = np.cumsum(sizes + DEPTH + 1) - DEPTH - 1
    for d in range(1, DEPTH + 1):
        coded[ends[:-1] + d] = False
    return key[coded], sizes + 1


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of lower-case texts one after another, and how many each text has."""
    lists = pc.ascii_split_whitespace(texts)
    flat = lists.flatten()
    some = pc.greater(pc.binary_length(flat), 0)
    n = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    upto = np.concatenate([[0], np.cumsum(some.to_numpy(zero_copy_only=False).astype(np.int64))])
    edges = np.concatenate([[0], np.cumsum(n)])
    return flat.filter(some), np.diff(upto[edges])


def _lower(part: pa.RecordBatch) -> pa.Array:
    texts = pc.fill_null(part.column("text").cast(pa.large_string()), "")
    return pc.ascii_lower(texts.take(pa.array(np.arange(len(texts)))))


def _lgamma(x: np.ndarray) -> np.ndarray:
    """Log gamma for x >= 1/2: Stirling's series after eight steps up."""
    y = x + 8
    s = (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3)
    for k in range(8):
        s = s - np.log(x + k)
    return s


def kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a sequence with these counts."""
    return _lgamma(zeros + 0.5) + _lgamma(ones + 0.5) - _lgamma(zeros + ones + 1) - np.log(np.pi)


def _mixed(zeros: np.ndarray, ones: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log weighted probability of nodes with children, and the weight of their own estimate."""
    own = kt(zeros, ones)
    return np.logaddexp(own, below) - np.log(2), 1 / (1 + np.exp(np.clip(below - own, -700, 700)))


def subtrees(key: np.ndarray, n: np.ndarray) -> list[dict]:
    """Nodes of depth 2 to DEPTH for the contexts of distinct keys; from deep to shallow.

    A node's name is its context and the bits of the byte so far. ``up``: the place of its parent context's node in the next
    entry. The first entry also has, for each key and bit, the place of the node (``at``).
    """
    context, byte = key >> 8, key & 255
    bit = (byte[:, None] >> (7 - _LEVELS)) & 1
    name = (context[:, None] << 8) | (1 << _LEVELS) | (byte[:, None] >> (8 - _LEVELS))
    names, at = np.unique(name, return_inverse=True)
    at = at.reshape(name.shape)
    ones = np.bincount(at.ravel(), (n[:, None] * bit).ravel(), len(names))
    zeros = np.bincount(at.ravel(), (n[:, None] * (1 - bit)).ravel(), len(names))
    out = [{"name": names, "at": at, "bit": bit, "zeros": zeros, "ones": ones, "log": kt(zeros, ones), "weight": np.ones(len(names))}]
    for _ in range(DEPTH - 2):
        last = out[-1]
        names, up = np.unique((last["name"] >> 16 << 8) | (last["name"] & 255), return_inverse=True)
        last["up"] = up
        total = lambda c: np.bincount(up, last[c], len(names))
        zeros, ones = total("zeros"), total("ones")
        log, weight = _mixed(zeros, ones, total("log"))
        out.append({"name": names, "zeros": zeros, "ones": ones, "log": log, "weight": weight})
    return out


class Top:
    """Nodes of depth 0 and 1, as tables by (last byte, bits so far)."""

    def __init__(self, last: np.ndarray, bits: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray):
        grid = lambda v: np.bincount(last * 256 + bits, v, 65536).reshape(256, 256)
        z, o, b = grid(zeros), grid(ones), grid(below)
        log, self.weight1 = _mixed(z, o, b)
        self.one1, self.seen1 = (o + 0.5) / (z + o + 1), z + o > 0
        z0, o0 = z.sum(axis=0), o.sum(axis=0)
        _, self.weight0 = _mixed(z0, o0, np.where(self.seen1, log, 0).sum(axis=0))
        self.one0, self.seen0 = (o0 + 0.5) / (z0 + o0 + 1), z0 + o0 > 0

    def mix(self, last: np.ndarray, bits: np.ndarray, one: np.ndarray, seen: np.ndarray) -> np.ndarray:
        """Probability of a one from that of the depth 2 context, where seen."""
        w1, own1 = self.weight1[last, bits], self.one1[last, bits]
        one = np.where(seen, w1 * own1 + (1 - w1) * one, own1)
        w0, own0 = self.weight0[bits], self.one0[bits]
        one = np.where(self.seen1[last, bits], w0 * own0 + (1 - w0) * one, own0)
        return np.where(self.seen0[bits], one, 0.5)


def log10_of(key: np.ndarray, n: np.ndarray, top: Top) -> np.ndarray:
    """log10 probability of each distinct key's byte after its context."""
    levels = subtrees(key, n)
    one = seen = None
    for k, level in enumerate(levels):
        own = (level["ones"] + 0.5) / (level["zeros"] + level["ones"] + 1)
        level["own"], level["seen"] = own, level["zeros"] + level["ones"] > 0
    place = [levels[0]["at"]]
    for level in levels[:-1]:
        place.append(level["up"][place[-1]])
    one, seen = levels[0]["own"][place[0]], levels[0]["seen"][place[0]]
    for level, at in zip(levels[1:], place[1:]):
        w, own = level["weight"][at], level["own"][at]
        one, seen = np.where(seen, w * own + (1 - w) * one, own), level["seen"][at]
    bits = (1 << _LEVELS) | ((key & 255)[:, None] >> (8 - _LEVELS))
    one = top.mix(np.broadcast_to((key >> (8 * DEPTH))[:, None], bits.shape), bits, one, seen)
    return np.log10(np.where(levels[0]["bit"] == 1, one, 1 - one)).sum(axis=1)


def _seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Byte strings and words of each batch with their counts in training texts."""
    names = ["batch", "key", "word", "n"]
    now, keys, counts, found = None, [], [], []

    def closed() -> Iterator[pa.RecordBatch]:
        every, at = np.unique(np.concatenate(keys), return_inverse=True)
        n = np.bincount(at, np.concatenate(counts), len(every)).astype(np.int64)
        yield from rows(pa.array(every), pa.nulls(len(every), pa.string()), n)
        table = pa.concat_tables(found).group_by("word").aggregate([("n", "sum")])
        word, n = table.column("word").combine_chunks(), table.column("n_sum").to_numpy()
        if len(word):
            yield from rows(pa.nulls(len(word), pa.int64()), word.cast(pa.string()), n)

    def rows(key: pa.Array, word: pa.Array, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(n), 100_000):
            size = min(100_000, len(n) - a)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(size, now)), key.slice(a, size), word.slice(a, size), pa.array(n[a : a + size])], names=names)

    for whole in batches:
        for batch in slices(whole, "text"):
            of = batch.column("batch").to_numpy()
            for a, b in _runs(of):
                if now is not None and of[a] != now:
                    yield from closed()
                    keys, counts, found = [], [], []
                now, part = of[a], batch.slice(a, b - a)
                train = part.column("train").to_numpy(zero_copy_only=False)
                texts = _lower(part)
                key, sizes = byte_strings(texts.cast(pa.large_binary()).to_pylist())
                every, n = np.unique(key * 2 + np.repeat(train, sizes), return_counts=True)
                keys.append(every >> 1)
                counts.append(n * (every & 1))
                word, n_words = words(texts)
                table = pa.table({"word": word, "n": pa.array(np.repeat(train, n_words).astype(np.int64))})
                found.append(table.group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"]))
                if len(keys) >= 8:
                    every, at = np.unique(np.concatenate(keys), return_inverse=True)
                    keys, counts = [every], [np.bincount(at, np.concatenate(counts), len(every)).astype(np.int64)]
                    found = [pa.concat_tables(found).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])]
    if keys:
        yield from closed()


def _runs(values: np.ndarray) -> list[tuple[int, int]]:
    edges = [0, *(np.flatnonzero(np.diff(values)) + 1).tolist(), len(values)]
    return [(a, b) for a, b in zip(edges, edges[1:]) if b > a]


def _scorer(total: int, distinct: int, ends: int) -> Callable:
    """Scores of the texts of sorted (batch, kind) rows: values of byte strings, counts of words, texts."""
    base = total + 0.5 * (distinct + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, keys, values, known, counts = None, [], [], [], []
        lookup = None
        for whole in batches:
            for batch in slices(whole, "text"):
                of, kind = batch.column("batch").to_numpy(), batch.column("kind").to_numpy()
                for a, b in _runs(of * 3 + kind):
                    part = batch.slice(a, b - a)
                    if of[a] != now:
                        now, keys, values, known, counts, lookup = of[a], [], [], [], [], None
                    if kind[a] == 0:
                        keys.append(part.column("key").to_numpy())
                        values.append(part.column("value").to_numpy())
                    elif kind[a] == 1:
                        known.append(part.column("word"))
                        counts.append(part.column("value").to_numpy())
                    else:
                        if lookup is None:
                            word = pa.concat_arrays(known).cast(pa.large_string()) if known else pa.array([], pa.large_string())
                            lookup = pa.array(np.concatenate(keys)), np.concatenate(values), word, np.concatenate([*counts, [0.0]])
                            keys, values, known, counts = [], [], [], []
                        yield score(part, *lookup)

    def score(part: pa.RecordBatch, keys: pa.Array, values: np.ndarray, known: pa.Array, counts: np.ndarray) -> pa.RecordBatch:
        texts = _lower(part)
        key, sizes = byte_strings(texts.cast(pa.large_binary()).to_pylist())
        each = values[pc.index_in(pa.array(key), value_set=keys).to_numpy()]
        model = np.add.reduceat(each, np.cumsum(sizes) - sizes)
        word, n = words(texts)
        at = pc.fill_null(pc.index_in(word, value_set=known), len(known)).to_numpy()
        c = counts[at]
        upto = lambda v: np.concatenate([[0], np.cumsum(v)])
        edges = upto(n)
        logs = np.diff(upto(np.log10((c + 0.5) / base))[edges]) + np.log10((ends + 0.5) / base)
        seen = np.diff(upto(c > 0)[edges]) + (ends > 0)
        columns = [part.column("doc_id"), pa.array(~part.column("train").to_numpy(zero_copy_only=False)), pa.array(n + 1), pa.array(seen.astype(np.int64)), pa.array(np.full(len(n), total)), pa.array(logs), pa.array(model), pa.array(sizes)]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "coded_bytes"])

    return run


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, coded_bytes long"


def scores(docs: DataFrame, train, batch_bytes: int = 24 << 20, keys_per_group: int = 200_000) -> DataFrame:
    """Scores of all ``docs``; ``train``: a column that is true for those to learn from."""
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), train.alias("train"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = given.agg(F.sum(F.octet_length("text")).alias("b"), F.count_if("train").alias("n")).first()
    batches = max(1, -(-(size.b or 0) // batch_bytes))
    given = given.withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(batches)))
    seen = stored(given.repartition(batches, "batch").sortWithinPartitions("batch").mapInArrow(_seen, "batch long, key long, word string, n long"))

    grams = stored(seen.filter("key is not null").groupBy("key").agg(F.sum("n").alias("n")))
    groups = max(1, -(-grams.count() // keys_per_group))
    grouped = grams.withColumn("g", F.pmod(F.xxhash64(F.shiftright("key", 8 * (DEPTH - 1))), F.lit(groups))).groupBy("g")

    def upper(rows: pd.DataFrame) -> pd.DataFrame:
        node = subtrees(rows.key.to_numpy(), rows.n.to_numpy())[-1]
        met = node["zeros"] + node["ones"] > 0
        return pd.DataFrame({"last": node["name"] >> 16, "bits": node["name"] & 255, "zeros": node["zeros"], "ones": node["ones"], "below": node["log"]})[met]

    def value(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"key": rows.key, "value": log10_of(rows.key.to_numpy(), rows.n.to_numpy(), top)})

    nodes = grouped.applyInPandas(upper, "last long, bits long, zeros double, ones double, below double").groupBy("last", "bits").agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "below")])
    nodes = nodes.toPandas().sort_values(["last", "bits"])  # at most 256 * 255 rows
    top = Top(*(nodes[c].to_numpy() for c in ("last", "bits", "zeros", "ones", "below")))
    values = stored(grouped.applyInPandas(value, "key long, value double"))

    counted = seen.filter("word is not null").groupBy("word").agg(F.sum("n").alias("n"))
    whole = counted.agg(F.sum("n").alias("n"), F.count_if(F.col("n") > 0).alias("v")).first()
    ends = size.n
    total, distinct = (whole.n or 0) + ends, whole.v + (ends > 0)
    # a word is in a batch once, so what meets here is one row for each batch
    known = seen.filter("word is not null").select("batch", F.lit(1).alias("kind"), "word", F.sum("n").over(Window.partitionBy("word")).cast("double").alias("value"))
    model = seen.filter("key is not null").select("batch", "key").join(values, "key").select("batch", F.lit(0).alias("kind"), "key", "value")
    rows = given.withColumn("kind", F.lit(2)).unionByName(known, True).unionByName(model, True)
    rows = rows.repartition(batches, "batch").sortWithinPartitions("batch", "kind")
    return rows.mapInArrow(_scorer(total, distinct, ends), SCORES)
