"""Spelling variants against plain comparison of all words."""

import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from driftline.llm import spelling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(rows, one_in=199):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % one_in == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 6:
                n[run] += 1
    n = {w: c for w, c in n.items() if c >= 5}
    near = {w: [v for v in n if one_edit(v, w)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out, key=str)


def run(spark, rows, **how):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("word", "near", "n", "run", "bag", "role", "sig", "form")})
    return sorted([tuple(r) for r in spelling.variants(df, **how).collect()], key=str)


def typo(rng, w):
    k = rng.randrange(len(w))
    return rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("abcxyzéÿ") + w[k + 1 :], w[:k] + rng.choice("aeioué") + w[k:]])


def test_variants_match_all_pairs(spark):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdeiorstnlé") for _ in range(rng.randrange(6, 11))) for _ in range(60)]
    words += ["listen", "silent", "tinsel", "enlist", "aaaaaa", "aaaaaaa", "aaaaab", "Straße", "ÀÉÎÕÜß", "×÷×÷×÷"]  # anagrams, runs of one letter
    pool = []
    for w in words:
        pool += [w] * rng.choice([3, 5, 26, 200])
        for _ in range(3):
            first = typo(rng, w)
            pool += [first] * rng.choice([1, 5, 6, 30]) + [typo(rng, first)] * rng.choice([4, 5, 7])
    rng.shuffle(pool)
    rows = [(k, rng.choice([" ", ". ", "1", "-"]).join(pool[k * 40 : k * 40 + 40])) for k in range(len(pool) // 40)]
    rows += [(None, "listen silent " * 4), (7, None), (8, ""), (9, "x" * 100_000), (9, "x" * 100_000)] * 3 + [(3, "UPPER Upper UPPERS uppers " * 9)]
    for one_in, parts in ((199, 5), (3, 4), (7, 7)):
        assert run(spark, rows, one_in=one_in, parts=parts) == brute(rows, one_in)


def test_nothing_to_find(spark):
    assert run(spark, []) == [] and run(spark, [(1, None), (2, "short few")]) == []


def test_near_words_share_a_signature(spark):
    rng = random.Random(8)
    words = {"".join(rng.choice("abcdefgéÿ") for _ in range(rng.randrange(1, 9))) for _ in range(300)}
    words |= {typo(rng, w) for w in words if len(w) > 1}
    words = sorted(w for w in words if w)
    known = spark.createDataFrame([(w, 1) for w in words], "word string, n long")
    got = {(r.word, r.near) for r in spelling.near_pairs(known).collect()}
    assert got == {(a, b) for a in words for b in words if one_edit(a, b)}
