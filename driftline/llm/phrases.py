"""Phrase collocations by best-first branch and bound: prefix counts bound the scores of all phrases that grow from them.

Texts are tokenised once into slabs: for each language of a slice of texts its distinct words and the places they stand at, with
breaks between pieces. Every later pass reads slabs only, counts phrases slab by slab and sums the counts over the corpus.

For a phrase that grows from a prefix of count f, whose first word has count l, each cut's score is at most 2f/(l + f): it is
growing in the phrase's own count, which f bounds, and the rest's count is no less than that. The best-first frontier of a
language is therefore all prefixes of bound ``theta`` or more. A wave at ``theta`` counts

- three words whose prefix has a bound of ``theta`` or more, or whose last two words score ``theta`` or more,
- four words whose prefix or last three words are so, and the three-word ends that their scores ask for.

Afterwards every phrase of score ``theta`` or more is counted with all phrases longer by one word on either side, so it is settled
whether it survives: a longer phrase that holds nearly all its occurrences also holds those of the phrase longer by one between
them. If ``top`` phrases or more survive, ties included, the language is done; else ``theta`` falls to where more phrases are and
the next wave starts, down to zero.

Which phrases a pass counts is marked in bitmaps of 2^``bits`` bits, hashed by language and words: that is all a task gets, 2 MB
each, whatever the vocabulary's size. A false hit counts a phrase more than needed and changes no result. Texts and slabs are sent
to Python in batches of 8 MB or one row, and slabs are written and read eight at a time, however large a task's share is.

Null texts count as empty; null languages are ``und``. Texts of any length are read whole, one makes at least one slab. Repeated
rows count again; doc_id and further columns are not read. Tables without a candidate, and empty ones, give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LARGE_ROWS, slices, small_batches, stored

#: A-Z to a-z, tab to space, and what ends a piece to a line break.
_BYTES = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz " + b"\n" * 9)
MOST, SCALE, SEED = 4, 2_000_000, 42
_ODD = np.uint64(0x9E3779B97F4A7C15)
COUNTS = "lang string, phrase string, c long"


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w.encode(), SEED) for w in words), np.uint64, len(words))


def _grown(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of the phrases of hash ``h`` with one more word."""
    return _mixed(h * _ODD + word)


def tokens(texts: list[str | None]) -> tuple[pa.StringArray, np.ndarray]:
    """Distinct words, and for each place the word's number from 1, with 0 where a piece ends."""
    raw = np.frombuffer("\n".join(t or "" for t in texts).encode().translate(_BYTES), np.uint8)
    inside = (raw != 32) & (raw != 10)
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(begin):
        return pa.array([], pa.string()), np.zeros(0, np.int32)
    offsets = np.concatenate([[0], np.cumsum(end - begin)]).astype(np.int32)
    words = pa.StringArray.from_buffers(len(begin), pa.py_buffer(offsets), pa.py_buffer(raw[inside].tobytes())).dictionary_encode()
    piece = np.cumsum(raw == 10)[begin]
    step = np.concatenate([[0], (np.diff(piece) > 0).astype(np.int64)])
    ids = np.zeros(len(begin) + int(step.sum()), np.int32)
    ids[np.arange(len(begin)) + np.cumsum(step)] = words.indices.to_numpy() + 1
    return words.dictionary, ids


def slabs(docs: DataFrame, size: int) -> DataFrame:
    """(lang, words, ids): one row for each language of about ``size`` bytes of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", size):
                for lang in pc.unique(part.column("lang")).to_pylist():
                    words, ids = tokens(part.filter(pc.equal(part.column("lang"), lang)).column("text").to_pylist())
                    if len(ids):
                        lists = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words)
                        yield pa.RecordBatch.from_arrays([pa.array([lang], pa.string()), lists, pa.array([ids.tobytes()])], names=["lang", "words", "ids"])

    given = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    return given.mapInArrow(run, "lang string, words array<string>, ids binary")


def marked(phrases: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of the hashes of ``phrases`` (lang, phrase)."""
    mask = np.uint64((1 << bits) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [p.split(" ") for p in batch.column("phrase").to_pylist()]
            h = _word_hashes(batch.column("lang").to_pylist())
            for j in range(MOST):
                at = np.array([k for k, p in enumerate(lists) if len(p) > j], np.int64)
                h[at] = _grown(h[at], _word_hashes([lists[k][j] for k in at]))
            h &= mask
            yield pa.RecordBatch.from_arrays([pa.array((h >> np.uint64(6)).view(np.int64)), pa.array((np.uint64(1) << (h & np.uint64(63))).view(np.int64))], names=["cell", "x"])

    cells = phrases.select("lang", "phrase").mapInArrow(run, "cell long, x long").groupBy("cell").agg(F.bit_or("x").alias("x")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[cells.column("cell").to_numpy()] = cells.column("x").to_numpy().view(np.uint64)
    return out


def _holds(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    h = h & np.uint64(len(bitmap) * 64 - 1)
    return (bitmap[(h >> np.uint64(6)).view(np.int64)] >> (h & np.uint64(63))) & np.uint64(1) == 1


def counted(read: DataFrame, length: int, least: int, rules: list[list[tuple[int, int, np.ndarray]]]) -> DataFrame:
    """(lang, phrase, c): phrases of ``length`` words that occur ``least`` times and pass a test of each rule; a test (at, words, bitmap) holds if the bitmap has the run of ``words`` words from word ``at`` on."""
    held = read.sparkSession.sparkContext.broadcast(rules)

    def of(lang: str, words: pa.Array, ids: np.ndarray) -> pa.RecordBatch:
        n = len(ids) - length + 1
        ok = np.ones(max(n, 0), bool)
        for j in range(length):
            ok &= ids[j : j + n] > 0
        places = np.flatnonzero(ok)
        if held.value:
            own = np.concatenate([[np.uint64(0)], _word_hashes(words.to_pylist())])[ids]
            start = _word_hashes([lang])
            for rule in held.value:
                good = np.zeros(len(places), bool)
                for at, run, bitmap in rule:
                    h = np.broadcast_to(start, len(places))
                    for j in range(at, at + run):
                        h = _grown(h, own[places + j])
                    good |= _holds(bitmap, h)
                places = places[good]
        key, firsts = np.zeros(len(places), np.int64), np.arange(len(places))
        for j in range(length):  # number the phrases word by word
            _, firsts, key = np.unique(key * (len(words) + 1) + ids[places + j], return_index=True, return_inverse=True)
        parts = [words.take(pa.array(ids[places[firsts] + j] - 1)) for j in range(length)]
        phrase = pc.binary_join_element_wise(*parts, " ") if length > 1 else parts[0]
        count = np.bincount(key, minlength=len(firsts)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(firsts), pa.string()), phrase.cast(pa.string()), pa.array(count)], names=["lang", "phrase", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                out = of(batch.column("lang")[k].as_py(), batch.column("words")[k].values, np.frombuffer(batch.column("ids")[k].as_buffer(), np.int32))
                if out.num_rows:
                    yield out

    return read.mapInArrow(run, COUNTS).groupBy("lang", "phrase").agg(F.sum("c").alias("c")).filter(F.col("c") >= least)


def score(a: str, total: Column) -> Column:
    """floor(2000000 a / total), exact beyond 64 bits."""
    return F.call_function("div", F.col(a).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(7,0)"), total.cast("decimal(21,0)")).cast("long")


def _cut(phrases: DataFrame, length: int) -> DataFrame:
    """``phrases`` with ``w``, their words."""
    return phrases.withColumn("w", F.split("phrase", " ")).withColumn("words", F.lit(length))


def _part(begin: int, size: int) -> Column:
    return F.array_join(F.slice("w", begin + 1, size), " ")


def scored(phrases: DataFrame, length: int, known: dict[int, DataFrame]) -> DataFrame:
    """(lang, phrase, words, a, f1, l, r, score): the lowest cut of phrases all of whose parts ``known`` has; ``f1``: count of the first word."""
    out = _cut(phrases.withColumnRenamed("c", "a"), length)
    for k in range(1, length):
        for side, begin, size in (("l", 0, k), ("r", k, length - k)):
            part = known[size].select("lang", F.col("phrase").alias("part"), F.col("c").alias(f"{side}{k}"))
            out = out.withColumn("part", _part(begin, size)).join(part, ["lang", "part"]).drop("part")
    cuts = [F.struct(score("a", F.col(f"l{k}") + F.col(f"r{k}")).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")) for k in range(1, length)]
    best = F.least(*cuts) if len(cuts) > 1 else cuts[0]
    return out.withColumn("best", best).select("lang", "phrase", "words", "a", F.col("l1").alias("f1"), "best.l", "best.r", "best.score")


def reach(found: DataFrame, theta: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of ``found``, scored phrases: those that may grow to ``theta`` (lang, theta), and those that have it."""
    known = found.join(theta, "lang").withColumn("bound", score("a", F.col("f1") + F.col("a")))
    return known.filter("bound >= theta"), known.filter("score >= theta")


def ranked_score(found: DataFrame, wanted: Column) -> DataFrame:
    """(lang, reached): the score of the ``wanted``-th best of ``found`` (lang, score, wanted), 0 where there are fewer. Scores are at most 1,000,000, so a window sees no more rows."""
    sums = found.groupBy("lang", "score").agg(F.count("*").alias("n"), F.max(wanted).alias("wanted"))
    order = Window.partitionBy("lang").orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return sums.withColumn("upto", F.sum("n").over(order)).groupBy("lang").agg(F.coalesce(F.max(F.when(F.col("upto") >= F.col("wanted"), F.col("score"))), F.lit(0)).alias("reached"))


def collocations(docs: DataFrame, top: int = 2000, least: int = 30, share: int = 80, bits: int = 24, size: int = 8 << 20) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of two to four words of each language of ``docs`` (lang, text)."""
    with small_batches(docs.sparkSession):  # all passes run here
        return _collocations(docs, top, least, share, bits, size)


def _collocations(docs: DataFrame, top: int, least: int, share: int, bits: int, size: int) -> DataFrame:
    read = stored(slabs(docs, size), options=LARGE_ROWS)
    every = counted(read, 1, 1, [])
    single = stored(every)
    total = single.groupBy("lang").agg(F.sum("c").alias("n"))
    single = stored(single.filter(F.col("c") >= least))
    has1 = marked(single, bits)
    known = {1: single, 2: stored(counted(read, 2, least, [[(0, 1, has1)], [(1, 1, has1)]]))}
    two = stored(scored(known[2], 2, known))
    has2 = marked(known[2], bits)
    theta = stored(ranked_score(two, F.lit(2 * top)).withColumn("rank", F.lit(2.0 * top)).withColumnRenamed("reached", "theta"))
    done: DataFrame | None = None
    while not theta.isEmpty():
        grow, settle = reach(two.join(theta.select("lang"), "lang", "left_semi"), theta)
        open2 = [(0, 2, marked(grow, bits)), (1, 2, marked(settle, bits))]
        known[3] = stored(counted(read, 3, least, [[(0, 2, has2)], [(1, 2, has2)], open2]))
        three = stored(scored(known[3], 3, known))
        grow, settle = reach(three, theta)
        open3 = [(0, 3, marked(grow, bits)), (1, 3, marked(settle, bits))]
        known[4] = stored(counted(read, 4, least, [[(k, 2, has2)] for k in range(3)] + [open3]))
        grow = grow.select("lang", F.col("phrase").alias("prefix"))
        grown = stored(_cut(known[4], 4).withColumn("prefix", _part(0, 3)).join(grow, ["lang", "prefix"]).select("lang", "phrase", "c", _part(1, 3).alias("end")))
        ends = grown.select("lang", F.col("end").alias("phrase")).distinct().join(known[3], ["lang", "phrase"], "left_anti")
        asked = counted(read, 3, least, [[(0, 3, marked(ends, bits))]]).join(ends, ["lang", "phrase"], "left_semi")
        known[5] = stored(known[3].union(asked))  # three words, with the ends asked for
        four = scored(grown.select("lang", "phrase", "c"), 4, {**known, 3: known[5]})
        found = stored(two.join(theta, "lang").drop("theta", "rank").union(three).union(four))
        longer = [_cut(known[k], k).select("lang", _part(b, k - 1).alias("phrase"), "c") for k in (3, 4) for b in (0, 1)]
        over = longer[0].union(longer[1]).union(longer[2]).union(longer[3]).groupBy("lang", "phrase").agg(F.max("c").alias("over"))
        # what is below theta isn't settled yet; no word is below 0
        alive = found.join(theta, "lang").filter("score >= theta").join(over, ["lang", "phrase"], "left").filter(F.col("over").isNull() | (F.col("over") * 100 < F.col("a") * share))
        alive = stored(alive.select("lang", "phrase", "a", "l", "r", "score"))
        counts = theta.join(alive.groupBy("lang").agg(F.count("*").alias("m")), "lang", "left").withColumn("m", F.coalesce("m", F.lit(0)))
        counts = stored(counts.withColumn("closed", (F.col("m") >= top) | (F.col("theta") <= 0)))
        ready = stored(alive.join(counts.filter("closed").select("lang"), "lang", "left_semi"))
        done = ready if done is None else done.union(ready)
        # aim at half as many again as the survivors so far say, at least half as many again as before
        rank = F.col("rank") * F.greatest(F.lit(1.5), F.lit(1.2) * top / F.greatest("m", F.lit(1)))
        following = counts.filter("not closed").select("lang", rank.alias("rank"))
        lower = ranked_score(found.join(following, "lang").withColumnRenamed("rank", "wanted"), F.col("wanted"))
        theta = stored(following.join(lower, "lang").select("lang", F.col("reached").alias("theta"), "rank"))
    if done is None:
        return two.join(total, "lang").select("lang", F.lit(0).alias("rank"), "phrase", "a", "l", "r", "n", "score").filter("false")
    last = ranked_score(done, F.lit(top))
    first = done.join(last, "lang").filter("score >= reached")
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    return first.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
