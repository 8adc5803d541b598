"""Benchmark decontamination: a BM25 inverted index of test items, queried by every training passage.

Items are indexed in shards of at most ``per_shard`` items, so that what a task receives is bounded whatever the size of the
benchmark; every text meets every shard. A text is cut into passages of 96 words, one every 32 words, so each run of up to
64 words lies in one passage. A passage is a query; an item is retrieved if its BM25 score is at least ``share`` of the least
score that a run of 64 words of the item gets (one every 32 words, and the last; of a shorter item, its whole text). A text
that holds any such run has it in one passage, so an item of any length is retrieved by each of them, and then verified as a
whole. Block-max WAND decides what is scored:

1. each block of 16 items has an upper bound for a passage: the greatest impact on an item of the block of each rare word
      that stands in it, added up over the passage's three parts of 32 words; the long postings of frequent words are not read
   here, each item's threshold is lowered by all that as many of them as a passage has words could add;
2. only blocks whose bound reaches the lowest such threshold of their items are scored, with all words.

So nothing that reaches its threshold is lost. A retrieved
item is verified on the whole text: its question, and its answer (the last sentence, or the last third where that is short),
must each have ``overlap`` of their five-word shingles in the text; parts of fewer than five words must stand there as they are.

Null texts and items count as empty; an item without words is never found. Equal items are all reported, a row of the
documents is judged by itself, null ids are kept. Empty tables give empty results. Further columns are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name

WORD = re.compile(r"[^\W_]+")
PASSAGE, STRIDE, BLOCK = 96, 32, 16
K1, B = 1.2, 0.75


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def shingles(words: list[str], width: int = 5) -> set[str]:
    return {" ".join(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else set()


def held(part: list[str], own: set[str], whole: str, width: int = 5) -> float:
    """Share of a part's shingles in a text; a part of fewer words is there or not."""
    if len(part) < width:
        return float(not part or f" {' '.join(part)} " in whole)
    need = shingles(part, width)
    return len(need & own) / len(need)


def question_and_answer(text: str | None) -> tuple[list[str], list[str]]:
    """The words of an item's question and of its answer."""
    sentences = [w for s in re.split(r"[.?!]\s+", (text or "").strip()) if (w := words_of(s))]
    words = [w for s in sentences for w in s]
    last = len(sentences[-1]) if sentences else 0
    cut = len(words) - (last if len(sentences) > 1 and last >= 5 else max(1, len(words) // 3))
    return words[:cut], words[cut:]


def runs(words: list[str]) -> list[list[str]]:
    """Runs of 64 words, one every 32 words and the last; each lies in one passage of a text that holds it."""
    most = PASSAGE - STRIDE
    last = max(0, len(words) - most)
    return [words[k : k + most] for k in sorted({*range(0, last, STRIDE), last})]


class Index:
    """BM25 impacts of a shard of items; a passage asks with its distinct words."""

    def __init__(self, items: list[tuple], share: float):
        self.ids = [i for i, _ in items]
        texts = [words_of(t) for _, t in items]
        self.parts = [question_and_answer(t) for _, t in items]
        mean = max(1.0, float(np.mean([len(t) for t in texts])))
        postings: dict[str, dict[int, int]] = defaultdict(dict)
        for k, t in enumerate(texts):
            for w in t:
                postings[w][k] = postings[w].get(k, 0) + 1
        self.terms = {w: t for t, w in enumerate(postings)}
        self.impacts = np.zeros((len(postings) + 1, len(items)), np.float32)  # the last row is that of unknown words
        for w, t in self.terms.items():
            idf = np.log(1 + (len(items) - len(postings[w]) + 0.5) / (len(postings[w]) + 0.5))
            for k, tf in postings[w].items():
                self.impacts[t, k] = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(texts[k]) / mean))
        own = np.array([min(self.impacts[list({self.terms[w] for w in run}), k].sum() for run in runs(t)) if t else np.inf for k, t in enumerate(texts)])
        self.threshold = (share * own).astype(np.float32)
        spread = (self.impacts > 0).sum(axis=1)
        self.rare = (spread > 0) & (spread <= max(4, 0.05 * len(items)))
        frequent = self.impacts[~self.rare]
        if len(frequent) > PASSAGE:  # a passage has no more words than that
            frequent = np.partition(frequent, len(frequent) - PASSAGE, axis=0)[-PASSAGE:]
        needed = self.threshold - frequent.sum(axis=0)
        order = np.argsort(needed, kind="stable")  # items of like thresholds share a block
        self.ids, self.parts = [self.ids[k] for k in order], [self.parts[k] for k in order]
        self.impacts, self.threshold, needed = self.impacts[:, order], self.threshold[order], needed[order]
        edges = np.arange(0, len(items), BLOCK)
        block_max = np.maximum.reduceat(self.impacts, edges, axis=1)
        # what rare words must add at least: the threshold less all that frequent words can add
        self.needed = np.minimum.reduceat(needed, edges)
        term, self.post_block = np.nonzero(block_max * self.rare[:, None])
        self.post_impact = block_max[term, self.post_block].astype(np.float64)
        self.post_edge = np.searchsorted(term, np.arange(len(block_max) + 1))

    def retrieve(self, texts: list[np.ndarray]) -> list[dict[int, float]]:
        """Of each text, given as term numbers: the items that one of its passages reaches, with the best score."""
        n = np.array([len(t) for t in texts], np.int64)
        words = np.concatenate(texts)
        cells = -(-n // STRIDE)
        first = np.cumsum(cells) - cells
        place = np.arange(len(words)) - np.repeat(np.cumsum(n) - n, n)
        cell = np.repeat(first, n) + place // STRIDE
        rare = self.rare[words]
        cell, term = np.divmod(np.unique(cell[rare] * len(self.rare) + words[rare]), len(self.rare))
        size = self.post_edge[term + 1] - self.post_edge[term]
        post = np.arange(size.sum()) + np.repeat(self.post_edge[term] - (np.cumsum(size) - size), size)
        blocks, total = len(self.needed), int(cells.sum())
        sums = np.bincount(np.repeat(cell, size) * blocks + self.post_block[post], self.post_impact[post], total * blocks).reshape(total, blocks)
        owner = np.repeat(np.arange(len(texts)), cells)
        bound = sums.copy()
        for k in range(1, PASSAGE // STRIDE):
            bound[:-k] += sums[k:] * (owner[k:] == owner[:-k])[:, None]
        found: list[dict[int, float]] = [{} for _ in texts]
        for c, block in zip(*(x.tolist() for x in np.nonzero(bound >= self.needed - 1e-3))):
            k = owner[c]
            begin, a = (c - first[k]) * STRIDE, block * BLOCK
            terms = np.unique(texts[k][begin : begin + PASSAGE])
            score = self.impacts[terms, a : a + BLOCK].sum(axis=0)
            for j in np.flatnonzero(score >= self.threshold[a : a + BLOCK] - 1e-3).tolist():
                found[k][a + j] = max(found[k].get(a + j, 0.0), float(score[j]))
        return found


def matches(docs: DataFrame, items: DataFrame, share: float = 0.5, overlap: float = 0.8, per_shard: int = 1024, name: str = "found") -> DataFrame:
    """``docs`` (text and what else they have) with column ``name``: the verified items (item_id, score, question, answer) of each row."""
    spark = docs.sparkSession
    given = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("length(text) > 0")
    shards = max(1, -(-given.count() // per_shard))
    kind = "array<struct<item_id: bigint, score: double, question: double, answer: double>>"
    given = given.withColumn("shard", F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)))

    def finder(shard: int):
        rows = sorted(((r.item_id, r.text) for r in given.filter(F.col("shard") == shard).collect() if words_of(r.text)), key=lambda r: (r[0] is None, r[0] or 0, r[1]))  # about per_shard items
        shared = spark.sparkContext.broadcast(rows)

        @F.pandas_udf(kind)
        def find(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            index = Index(shared.value, share) if shared.value else None
            for batch in texts:
                yield pd.Series([[] for _ in batch] if index is None else [x for part in parts(batch) for x in look(index, part)], dtype=object)

        return find

    def parts(batch: pd.Series) -> Iterator[list]:
        """Some megabytes of texts at a time."""
        held, size = [], 0
        for text in batch:
            held.append(text)
            size += len(text or "")
            if size >= 4 << 20:
                yield held
                held, size = [], 0
        if held:
            yield held

    def look(index: Index, texts: list) -> list[list[dict]]:
        get, none = index.terms.get, len(index.terms)
        lists = [words_of(t) for t in texts]
        found = index.retrieve([np.fromiter((get(w, none) for w in words), np.int64, len(words)) for words in lists])
        out = []
        for words, items in zip(lists, found):
            out.append([])
            own, whole = (shingles(words), f" {' '.join(words)} ") if items else (set(), "")
            for k, score in sorted(items.items()):
                q, a = (held(part, own, whole) for part in index.parts[k])
                if q >= overlap and a >= overlap:
                    out[-1].append({"item_id": index.ids[k], "score": score, "question": q, "answer": a})
        return out

    text = F.col("text").cast("string")
    columns = [finder(k)(text) for k in range(shards)]
    return docs.withColumn(name, reduce(F.concat, columns) if columns else F.array().cast(kind))


def report(docs: DataFrame, items: DataFrame, **settings) -> DataFrame:
    """(doc_id, n_items, items, best_score) of every document; ``items`` are the leaked items' ids, ascending."""
    found = matches(docs.select("doc_id", "text"), items, **settings)
    ids = F.array_sort(F.transform("found", lambda x: x["item_id"]))
    return found.select("doc_id", F.size("found").cast("long").alias("n_items"), F.array_join(ids.cast("array<string>"), ",").alias("items"), F.coalesce(F.array_max(F.transform("found", lambda x: x["score"])), F.lit(0.0)).alias("best_score"))


def clean(docs: DataFrame, items: DataFrame, **settings) -> DataFrame:
    """The documents without a leaked item, with their own columns."""
    name = free_name(docs, "found")
    return matches(docs, items, name=name, **settings).filter(F.size(name) == 0).drop(name)
