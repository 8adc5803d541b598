"""License notices: exact phrases, and an exact set-similarity join of text blocks with notice templates.

Notices are whole; those of more than 32 words are joined in pieces of about equal length, at most 32 words each, and every
piece gives the notice's label. Notices that have a paragraph in common (the warranty of mit-notice and unlicense) are both
reported where it stands alone. A text is cut into blocks of 64 words, one every 32 words, so each run of up to 32 words lies in one block. The join finds
every block whose set of words contains at least ``threshold`` of a template's set. Only words of the templates can
overlap, so blocks are reduced to those; words are ordered by their count over all documents, rarest first. A pair that
reaches the overlap ``o`` must share a word among the template's first ``|T| - o + 1`` and the block's first ``|B| - o + 1``
words (prefix filter), the block must have ``o`` words (length filter), and from the places of the shared word on enough
words must be left on both sides (positional filter). What is left is verified. The index holds the templates' prefixes:
its size is that of the template list, a parameter, not of the data.

Null texts count as empty: no words, null places, empty labels, score 0. Each row is scanned for itself, so repeated rows
and null or repeated ids keep their own result. An empty table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TO_LOWER, slices, stored

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
STEP = 32  # words; a block is two steps

# Phrases and their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

# Well-known notices; further words of a notice follow below under the same name.
NOTICES = (
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0-notice", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("mit-notice", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("bsd-notice", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc-notice", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("apache-2.0-notice", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("gpl-notice", "either version 3 of the license or at your option any later version"),
    ("gpl-notice", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"),
    ("gpl-notice", "you should have received a copy of the gnu general public license along with this program if not see http www gnu org licenses"),
    ("mit-notice", "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("mit-notice", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit-notice", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("bsd-notice", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-notice", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd-notice", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-notice", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"),
    ("isc-notice", "provided that the above copyright notice and this permission notice appear in all copies"),
    ("isc-notice", "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"),
    ("mpl-2.0", "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0"),
    ("cc-by-4.0", "to view a copy of this license visit http creativecommons org licenses by 4 0 or send a letter to creative commons po box 1866 mountain view ca 94042 usa"),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
    ("unlicense", "in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors we intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law"),
    ("unlicense", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
)


def pieces(notices: tuple) -> tuple:
    """(name, words) of at most 32 words each; a longer notice is cut into parts of about equal length."""
    out = []
    for name, text in notices:
        words = WORD.findall(text.translate(TO_LOWER))
        n = -(-len(words) // STEP)
        out += [(name, " ".join(words[k * len(words) // n : (k + 1) * len(words) // n])) for k in range(n)]
    return tuple(out)


TEMPLATES = pieces(NOTICES)

_SCANNED = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, blocks array<array<int>>, counts array<long>"


def scan(docs: DataFrame, templates: tuple = TEMPLATES, threshold: float = 0.8) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score); score is the best containment, 1 for a phrase."""
    sets = [(name, sorted(set(text.split(" ")))) for name, text in pieces(templates)]
    vocabulary = {w: k for k, w in enumerate(sorted({w for _, s in sets for w in s}))}
    need = [ceil(threshold * len(s) - 1e-9) for _, s in sets]
    least = min(need)
    holds = np.zeros((len(vocabulary), len(sets)), np.float32)
    for k, (_, s) in enumerate(sets):
        holds[[vocabulary[w] for w in s], k] = 1
    phrases = [(p.split(" "), label) for p, label in PHRASES]

    def base(words: list[str]) -> tuple:
        places, labels = [], set()
        for at, word in enumerate(words):
            for phrase, label in phrases:
                if word == phrase[0] and words[at : at + len(phrase)] == phrase:
                    places.append(at)
                    labels.add(label)
        return len(places), min(places, default=None), max(places, default=None), sorted(labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, size = vocabulary.get, len(vocabulary)
        lasts = {p[-1] for p, _ in phrases}
        for batch in batches:
            for part in slices(batch, "text"):
                lists = [WORD.findall((t or "").translate(TO_LOWER)) for t in part.column("text").to_pylist()]
                n = np.array([len(w) for w in lists], np.int64)
                known = np.fromiter((get(w, size) for w in chain.from_iterable(lists)), np.int64, int(n.sum()))
                steps = -(-n // STEP)
                first = np.cumsum(steps) - steps
                inside = np.arange(len(known)) - np.repeat(np.cumsum(n) - n, n)
                seen = np.zeros((int(steps.sum()) + 1, size + 1), bool)
                seen[np.repeat(first, n) + inside // STEP, known] = True
                tail = np.zeros(len(seen), bool)  # the last step of a text has no next one
                tail[(first + steps - 1)[steps > 0]] = True
                seen[:-1] |= seen[1:] & ~tail[:-1, None]
                full = np.flatnonzero(seen[:, :size].sum(axis=1) >= least)
                full = full[(seen[full, :size].astype(np.float32) @ holds >= np.array(need)).any(axis=1)]  # the overlap with some piece, before the join
                blocks: list[list] = [[] for _ in lists]
                owner = np.repeat(np.arange(len(lists)), steps)
                for k in full.tolist():
                    blocks[owner[k]].append(np.flatnonzero(seen[k, :size]).tolist())
                found = [base(w) if not lasts.isdisjoint(w) else (0, None, None, []) for w in lists]
                counts = np.bincount(known, minlength=size + 1)[:size].tolist()
                rows = [part.column("doc_id"), pa.array(n), *(pa.array([f[k] for f in found], pa.int64()) for k in range(3)), pa.array([f[3] for f in found], pa.list_(pa.string())), pa.array(blocks, pa.list_(pa.list_(pa.int32()))), pa.array([counts] + [None] * (len(lists) - 1), pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(rows, names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "blocks", "counts"])

    spark = docs.sparkSession
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scanned = stored(given.mapInArrow(run, _SCANNED).withColumn("row", F.monotonically_increasing_id()))
    total = dict.fromkeys(range(len(vocabulary)), 0)
    for r in scanned.filter("counts is not null").select(F.posexplode("counts").alias("k", "n")).groupBy("k").agg(F.sum("n").alias("n")).collect():  # a row for each template word
        total[r.k] = r.n
    rank = {k: i for i, k in enumerate(sorted(total, key=lambda k: (total[k], k)))}
    index = []
    for (name, words), most in zip(sets, need):
        own = sorted(rank[vocabulary[w]] for w in words)
        index += [(r, i, len(own), most, name, own) for i, r in enumerate(own[: len(own) - most + 1])]
    prefixes = spark.createDataFrame(index, "word int, i int, size int, need int, template string, own array<int>")
    ranks = F.array(*[F.lit(rank[k]) for k in range(len(vocabulary))])
    ordered = F.array_sort(F.transform("block", lambda x: F.element_at(ranks, x + 1)))
    block = scanned.select("row", F.explode("blocks").alias("block")).select("row", ordered.alias("block"))
    words = block.select("row", "block", F.size("block").alias("length"), F.posexplode(F.slice("block", F.lit(1), F.size("block") - least + 1)).alias("j", "word"))
    pairs = words.join(F.broadcast(prefixes), "word").filter("length >= need AND j <= length - need AND 1 + least(size - i - 1, length - j - 1) >= need")
    checked = pairs.withColumn("shared", F.size(F.array_intersect("block", "own"))).filter("shared >= need")
    matched = checked.groupBy("row").agg(F.collect_set("template").alias("found"), F.max(F.col("shared") / F.col("size")).alias("best"))
    empty = F.array().cast("array<string>")
    joined = scanned.drop("blocks", "counts").join(matched, "row", "left")
    every = F.array_sort(F.array_union("base_labels", F.coalesce("found", empty)))
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0)))
    return joined.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), F.array_join(every, ",").alias("labels"), score.alias("score"))
