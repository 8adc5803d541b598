"""Toxicity by a weighted lexicon, matched with Aho-Corasick on folded text.

Folding lowers A-Z, maps look-alike letters to Latin ones, drops zero-width characters and reads digits and signs as the
letters they stand for, in runs of letters and signs that hold a letter: all that stand between letters, and digits before
them. Signs before the first and after the last letter can be punctuation too, so such a run is also matched and learned with
them read, all or but for closing exclamation marks. Numbers with a unit or ordinal, hexadecimal hashes and mail addresses
stay as they are. Lexicon entries are whole words or word beginnings (``stem*``), weighted by
their log odds in toxic against other texts. A hit inside an exception phrase does not count. The score is a logistic
function of the summed weight and of that sum per word, so length counts.

An entry must stand in at least ``least_count`` toxic texts of the sample that earlier entries don't explain, with log odds of
``least_weight`` or more and a log-likelihood ratio (G) against the other texts of twice the logarithm of the sample's size or
more; the share of the toxic texts that it explains plays no part. Among more than ``candidates`` such
terms those of the greatest ratio are taken.

Learning takes a sample of about ``fit_rows`` labelled rows of each class, chosen by a hash of the id; entries, exceptions
and calibration come from counts that Spark makes over that sample. ``fit_rows``, ``candidates`` and ``entries`` bound the
model and what the driver sees. Scoring covers every row.

Null and empty texts have no hits and get the score of a text without hits. Without labels of both classes the score is the
smoothed share of toxic labels. Rows are scored one by one, so repeats and null ids are kept. Labels that are null or
without text are ignored; of several labels of an id the greatest counts. Further columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, slices

# Letters of other scripts that look like Latin ones, in the order of the Latin letters below them.
LOOKS = "авсԁеғԍһіјкӏмпорԛгѕтцѵшхузαβεικνορτυχ"
LATIN = "abcdefghijklmnopqrstuvwxyzabeikvoptux"
# Digits and signs that stand for letters.
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
ZERO_WIDTH = "​‌‍⁠﻿­"

_FOLD = str.maketrans(UPPER, LOWER) | str.maketrans(LOOKS[:26], LATIN[:26]) | str.maketrans(LOOKS[26:], LATIN[26 : len(LOOKS)]) | {0xFF21 + k: LOWER[k] for k in range(26)} | {0xFF41 + k: LOWER[k] for k in range(26)} | dict.fromkeys(map(ord, ZERO_WIDTH))
_RUN = re.compile(r"(?<![^\W\d_])[^\W\d_]*+[013457@$!](?:[^\W\d_]|[013457@$!])*")
_ENDS = re.compile(r"[013457@$!]*")
_NUMBER = re.compile(r"[@$!]*\d+(?:st|nd|rd|th|am|pm|kg|km|cm|mm|gb|mb|kb|tb|px|ms|hz|[a-z])?[@$!]*|[@$!]*\d\d+[a-z]{1,2}[@$!]*")
_HASH = re.compile(r"(?<![^\W_])(?=[a-f]*\d)[0-9a-f]{8,}(?![^\W_])")
_MAIL = re.compile(r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+")
_READ = str.maketrans(SIGNS)
WORD = re.compile(r"[^\W\d_]+")
STEMS = (4, 5, 6, 7)


def forms(text: str | None) -> tuple[str, list[tuple[int, str]]]:
    """The folded text, and (place, run) of further readings of runs with signs at an end; all readings keep the length."""
    out = (text or "").translate(_FOLD)
    first = next(_RUN.finditer(out), None)
    if first is None:
        return out, []
    kept = [m.span() for m in _HASH.finditer(out)]
    if "@" in out:
        kept += [m.span() for m in _MAIL.finditer(out)]
    kept.sort()
    others: list[tuple[int, str]] = []
    parts, done, at = [], 0, 0
    for m in _RUN.finditer(out, first.start()):
        run, a, b = m[0], *m.span()
        while at < len(kept) and kept[at][1] <= a:
            at += 1
        if at < len(kept) and kept[at][0] < b or _NUMBER.fullmatch(run):
            continue
        lead = _ENDS.match(run).end()
        if lead == len(run):  # no letter
            continue
        body = len(run) - _ENDS.match(run[::-1]).end()
        if a and out[a - 1].isdigit():  # goes on from a number
            heads = [run[:lead]]
        elif run[:lead].isdigit():
            heads = [run[:lead].translate(_READ), run[:lead]]
        else:
            heads = [run[:lead], run[:lead].translate(_READ)]
        loud = body + len(run[body:].rstrip("!"))
        tails = [run[body:]] if b < len(out) and out[b].isdigit() else [run[body:], run[body:loud].translate(_READ) + run[loud:], run[body:].translate(_READ)]
        inner = run[lead:body].translate(_READ)
        every = list(dict.fromkeys(h + inner + t for h in heads for t in tails))
        parts += [out[done:a], every[0]]
        done = b
        others += [(a, x) for x in every[1:]]
    return "".join([*parts, out[done:]]), others


def fold(text: str | None) -> str:
    return forms(text)[0]


def terms(words: set[str]) -> set[str]:
    return words | {w[:k] + "*" for w in words for k in STEMS if len(w) > k}


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    exceptions: frozenset = frozenset()
    curve: tuple[float, float, float] = (0.0, 0.0, 0.0)

    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for key in sorted({t.rstrip("*") for t in self.weights} | set(self.exceptions)):
            found.add_word(key, key)
        found.make_automaton()
        return found

    def hits(self, folded: str, automaton, others: list[tuple[int, str]] = ()) -> list[tuple[int, int, float]]:
        """(from, to, weight), the longest entry where several begin at a place, in one reading of each run."""
        found = self._hits(folded, automaton)
        by: dict[int, list] = {}
        for at, run in others:
            own = [(at + a, at + b, w) for a, b, w in self._hits(run, automaton)[0]]
            if sum(w for *_, w in own) > sum(w for *_, w in by.get(at, ())):
                by[at] = own
        out, spared = found
        for at, own in by.items():
            end = at + next(len(x) for k, x in others if k == at)
            inside = [h for h in out if at <= h[0] < end]
            if sum(w for *_, w in own) > sum(w for *_, w in inside):
                out = [h for h in out if not at <= h[0] < end] + own
        return sorted((a, b, w) for a, b, w in out if not any(x <= a and b <= y for x, y in spared))

    def _hits(self, folded: str, automaton) -> tuple[list, list]:
        best: dict[int, tuple[int, float]] = {}
        spared = []
        for last, key in automaton.iter(folded):
            a, b = last - len(key) + 1, last + 1
            if a and folded[a - 1].isalpha():
                continue
            whole = b == len(folded) or not folded[b].isalpha()
            if key in self.exceptions and whole:
                spared.append((a, b))
            weight = self.weights.get(key) if whole else None
            stem = self.weights.get(key + "*")
            weight = max((w for w in (weight, stem) if w is not None), default=None)
            if weight is not None and b > best.get(a, (0, 0))[0]:
                best[a] = (b, weight)
        return [(a, b, w) for a, (b, w) in best.items()], spared


def measures(text: str | None, model: Model, automaton) -> tuple[float, float, int]:
    """Summed weight, its ratio to the words, and the number of hits."""
    if not model.weights or not text:
        return 0.0, 0.0, 0
    folded, others = forms(text)
    hits = model.hits(folded, automaton, others)
    total = sum(w for _, _, w in hits)
    return total, total / (1 + text.count(" ") + text.count("\n")), len(hits)


def features(total: float, ratio: float) -> tuple[float, float]:
    return float(np.log1p(total)), float(np.log1p(1000 * ratio))


def sampled(docs: DataFrame, labels: DataFrame, fit_rows: int) -> DataFrame | None:
    """(text, toxic) of about ``fit_rows`` rows of each class."""
    marks = labels.filter("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    sizes = {r.toxic: r.n for r in marks.groupBy("toxic").agg(F.count("*").alias("n")).collect()}  # a row for each class
    if not sizes.get(0) or not sizes.get(1):
        return None
    share = F.when(F.col("toxic") == 1, fit_rows / sizes[1]).otherwise(fit_rows / sizes[0])
    chosen = marks.filter(F.col("toxic").isin(0, 1) & (F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < share * 1_000_003))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").select("text", "toxic").dropDuplicates()


TEXTS = ""  # counted once for each text


def counted(rows: DataFrame, label: int, model: Model | None, only: frozenset | None) -> DataFrame:
    """(term, n): texts of a class that have a term, without those that ``model`` hits; ``only``: the terms of interest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = model.automaton() if model and model.weights else None
        for batch in batches:
            for part in slices(batch, "text"):
                found: Counter = Counter()
                for folded, others in map(forms, part.column("text").to_pylist()):
                    if automaton is None or not model.hits(folded, automaton, others):
                        own = terms({w for t in (folded, *(x for _, x in others)) for w in WORD.findall(t)}) | {TEXTS}
                        found.update(own if only is None else own & only)
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["term", "n"])

    return rows.filter(F.col("toxic") == label).select("text").mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def chosen(odds: dict[str, float], positive: dict[str, int], most: int) -> dict[str, float]:
    """Entries without those that another explains: a beginning whose extension is as frequent, an extension that adds nothing."""

    def begins(t: str) -> list[str]:
        word = t.rstrip("*")
        return [word[:k] + "*" for k in STEMS if k < len(word) or k == len(word) and t == word]

    kept = dict(odds)
    for t in sorted(odds, key=lambda t: (len(t.rstrip("*")), t[-1] != "*")):
        for p in begins(t):
            if p in kept and positive[t] >= 0.9 * positive[p]:
                del kept[p]
    alone = [t for t in kept if not any(p in kept and kept[p] >= kept[t] - 1.5 for p in begins(t))]
    return {t: kept[t] for t in sorted(alone, key=lambda t: (-positive[t] * kept[t], t))[:most]}


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = 20_000, candidates: int = 20_000, entries: int = 4_096, least_weight: float = 3.0, least_count: int = 3, rounds: int = 8, exceptions: tuple[str, ...] = ()) -> Model:
    """Lexicon, exception phrases and calibration from labelled rows; ``exceptions`` are added to the learned ones."""
    rows = sampled(docs, labels, fit_rows)
    if rows is None:
        share = labels.filter("toxic is not null").agg(F.sum(F.col("toxic").cast("int")).alias("a"), F.count("*").alias("n")).first()
        p = ((share.a or 0) + 0.5) / (share.n + 1)
        return Model(curve=(float(np.log(p / (1 - p))), 0.0, 0.0))
    rows = rows.persist()
    clean = counted(rows, 0, None, None).withColumnRenamed("n", "m").persist()
    try:
        sizes = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
        toxic, other = sizes.get(1, 0), sizes.get(0, 0)
        model = Model({}, frozenset(fold(e) for e in exceptions))
        left, had = toxic, 0
        for _ in range(rounds):  # each round learns from the toxic texts that the entries so far do not explain
            both = counted(rows, 1, model, None).filter((F.col("n") >= least_count) & (F.col("term") != TEXTS)).join(clean, "term", "left").fillna(0, ["m"])
            n, m = F.col("n").cast("double"), F.col("m").cast("double")
            part = lambda k, size: F.when(k > 0, k * F.log(k * (left + other) / ((n + m) * size))).otherwise(0.0)
            without = lambda k, size: F.when(k < size, (size - k) * F.log((size - k) * (left + other) / ((left + other - n - m) * size))).otherwise(0.0)
            ratio = 2 * (part(n, left) + part(m, other) + without(n, left) + without(m, other))
            odds_of = F.log((n + 0.5) / (left + 1)) - F.log((m + 0.5) / (other + 1))
            found = both.select("term", "n", odds_of.alias("odds"), ratio.alias("ratio")).filter((F.col("odds") >= least_weight) & (F.col("ratio") >= 2 * np.log(toxic + other)))
            found = found.orderBy(F.desc("ratio"), "term").limit(candidates).collect()
            positive, odds = {r.term: r.n for r in found}, {r.term: r.odds for r in found}
            model.weights |= chosen(odds, positive, entries - len(model.weights))
            if len(model.weights) in (had, entries):
                break
            had = len(model.weights)
            left = next((r.n for r in counted(rows, 1, model, frozenset([TEXTS])).collect()), 0)
            if left < max(5, 0.01 * toxic):
                break
        model.exceptions |= spared(rows, model)
        model.curve = calibrated(rows, model)
        return model
    finally:
        clean.unpersist()
        rows.unpersist()


def spared(rows: DataFrame, model: Model, least: int = 5) -> frozenset:
    """Word pairs around a hit that speak for a harmless text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = model.automaton()
        for batch in batches:
            found: Counter = Counter()
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                folded, others = forms(text)
                pairs = set()
                for a, _, _ in model.hits(folded, automaton, others):
                    before, after = folded[max(0, a - 40) : a].split(" "), folded[a : a + 80].split(" ")
                    if len(before) > 1 and before[-1] == "" and before[-2]:
                        pairs.add(f"{before[-2]} {after[0]}")
                    if len(after) > 2:
                        pairs.add(f"{after[0]} {after[1]}")
                found.update((p, toxic) for p in pairs)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.int32()), pa.array(list(found.values()), pa.int64())], names=["pair", "toxic", "n"])

    if not model.weights:
        return frozenset()
    pairs = rows.mapInArrow(run, "pair string, toxic int, n long").groupBy("pair").agg(F.sum(F.col("n") * F.col("toxic")).alias("a"), F.sum(F.col("n") * (1 - F.col("toxic"))).alias("b"))
    return frozenset(r.pair for r in pairs.filter((F.col("b") >= least) & (F.col("b") > 3 * F.col("a"))).orderBy(F.desc("b"), "pair").limit(1000).collect())


def calibrated(rows: DataFrame, model: Model) -> tuple[float, float, float]:
    """Logistic regression on counts of rounded features, a few thousand cells at most; slopes are not negative."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = model.automaton()
        for batch in batches:
            found: Counter = Counter()
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                x, y = features(*measures(text, model, automaton)[:2])
                found[round(x, 1), round(y, 1), toxic] += 1
            columns = list(zip(*(k + (n,) for k, n in found.items()))) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.float64(), pa.float64(), pa.int32(), pa.int64()))], names=["x", "y", "toxic", "n"])

    cells = rows.mapInArrow(run, "x double, y double, toxic int, n long").groupBy("x", "y", "toxic").agg(F.sum("n").alias("n")).collect()
    data = np.array(sorted((r.x, r.y, r.toxic, r.n) for r in cells), float)
    design, label, count = np.column_stack([np.ones(len(data)), data[:, 0], data[:, 1]]), data[:, 2], data[:, 3]
    ridge, beta = np.diag([1e-3, 0.5, 0.5]), np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        slope = design.T @ (count * (label - p)) - ridge @ beta
        beta = beta + np.linalg.solve((design.T * (count * np.maximum(p * (1 - p), 1e-6))) @ design + ridge, slope).clip(-2, 2)
    return float(beta[0]), float(max(0.0, beta[1])), float(max(0.0, beta[2]))


def scored(docs: DataFrame, model: Model, text: Column | str = "text") -> Column:
    """Column struct<score, weight, hits> for texts of ``docs``; the model is bounded by its ``entries``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("struct<score: double, weight: double, hits: bigint>")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = shared.value
        automaton = own.automaton()
        for batch in texts:
            out = np.array([measures(t, own, automaton) for t in batch], float).reshape(-1, 3)
            z = own.curve[0] + own.curve[1] * np.log1p(out[:, 0]) + own.curve[2] * np.log1p(1000 * out[:, 1])
            yield pd.DataFrame({"score": 1 / (1 + np.exp(-np.clip(z, -30, 30))), "weight": out[:, 0], "hits": out[:, 2].astype(np.int64)})

    return score(F.col(text).cast("string") if isinstance(text, str) else text.cast("string"))
