"""Collocations against plain counting."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from driftline.llm import phrases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, top, least):
    counts = {}
    for lang, text in rows:
        c = counts.setdefault("und" if lang is None else lang, [Counter() for _ in range(5)])
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall("[^\x20\x09]+", piece)
            for k in range(1, 5):
                c[k].update(zip(*[words[j:] for j in range(k)]))
    out = []
    for lang, c in counts.items():
        candidates = {p: a for k in (2, 3, 4) for p, a in c[k].items() if a >= least}
        dropped = {p[s : s + k] for p, a in candidates.items() for k in range(2, len(p)) for s in range(len(p) - k + 1) if 100 * a >= 80 * c[k][p[s : s + k]]}
        ranked = []
        for p, a in candidates.items():
            if p not in dropped:
                score, k = min((2000000 * a // (c[k][p[:k]] + c[len(p) - k][p[k:]]), k) for k in range(1, len(p)))
                ranked.append((-score, -a, " ".join(p).encode(), c[k][p[:k]], c[len(p) - k][p[k:]]))
        ranked.sort()
        n = sum(c[1].values())
        out += [(lang, i + 1, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(ranked[:top])]
    return sorted(out)


def texts(seed, n):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(40)] + ["Über", "été", "x\xa0y", "\x00"]
    fixed = ["strong tea in england", "strong tea in", "fresh bread", "w1 w2 w3 w4", "w2 w3 w4 w5", "a a a", "kick the bucket"]
    for _ in range(n):
        parts = [rng.choice(fixed) if rng.random() < 0.3 else rng.choice(words) for _ in range(rng.randrange(60))]
        yield rng.choice(["en", "de", None, "x y"]), "".join(p + rng.choice([" "] * 12 + [".", ", ", "\t", "\n", "!?"]) for p in parts)


def run(spark, rows, **how):
    df = spark.createDataFrame(rows, "lang string, text string").withColumns({c: F.lit(1) for c in ("doc_id", "phrase", "c", "a", "w", "words", "theta", "rank", "n")})
    return sorted(tuple(r) for r in phrases.collocations(df, **how).collect())


def test_phrases_match_plain_counting(spark):
    rows = [*texts(1, 400), ("en", None), ("en", ""), ("fr", "only once"), (None, None), ("en", "w1 w2 " * 4000)]
    for top, least in ((2000, 5), (12, 4), (1, 30)):
        assert run(spark, rows, top=top, least=least, size=1 << 12) == brute(rows, top, least)
    # a bitmap of 64 bits holds nearly everything: more is counted, results stay
    assert run(spark, rows, top=12, least=4, bits=6) == brute(rows, 12, 4)


def test_ties_at_the_last_rank_and_waves(spark):
    rows = [("en", f"a{k} b{k}") for k in range(60) for _ in range(30)]  # all of one score and count
    rows += [("en", f"c{k} d{k} e{k}. c{k} x. e{k}") for k in range(40) for _ in range(31)]
    assert run(spark, rows, top=7, least=30) == brute(rows, 7, 30)
    assert run(spark, rows, top=100, least=30) == brute(rows, 100, 30)


def test_nothing_to_find(spark):
    assert run(spark, [], top=5) == [] and run(spark, [("en", "a b")], top=5) == [] and run(spark, [("en", None)], top=5) == []


def test_score_is_exact_beyond_64_bits(spark):
    a, total = 10**14 + 7, 3 * 10**14 + 1
    row = spark.createDataFrame([(a, total)], "a long, t long").select(phrases.score("a", F.col("t")).alias("s")).head()
    assert row.s == 2000000 * a // total


def test_slabs_are_read_in_parts(spark, monkeypatch):
    """A task's slabs don't reach Python in one batch, nor lie in one row group."""
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 50, 60_000)) for _ in range(80)]
    docs = spark.createDataFrame([("en", t) for t in texts], "lang string, text string").coalesce(1)
    seen, run = [], phrases.counted

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    def spy(read, *rest):
        if not seen:
            groups = sum(pq.ParquetFile(f.removeprefix("file:")).metadata.num_row_groups for f in read.inputFiles())
            seen.append((groups, [r.n for r in read.mapInArrow(sizes, "n long").collect()]))
        return run(read, *rest)

    monkeypatch.setattr(phrases, "counted", spy)
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    assert phrases.collocations(docs, top=5, least=1 << 20, size=1 << 17).count() == 0
    (groups, batches), = seen
    assert groups > 1 and sum(batches) > 16 << 20 and max(batches) < 9 << 20
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before
