"""The near-duplicate stage against all pairs of five-word Jaccard similarity, with planted copies."""

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from driftline.llm import nearcopies, simhash


def jaccard(a, b):
    own = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := simhash.words_of(t)) else set() for t in (a, b)]
    return len(own[0] & own[1]) / max(1, len(own[0] | own[1]))


def planted():
    rng = np.random.default_rng(8)
    fresh = iter(f"w{k}" for k in range(100_000))
    edit = lambda words, places: [next(fresh) if k in places else w for k, w in enumerate(words)]
    texts = []
    for _ in range(12):
        base = [next(fresh) for _ in range(int(rng.integers(190, 260)))]
        texts.append(base)
        for edits in (1, 2, 3, 4, 6, 9):  # at 10 words each from the last: similarity 0.95 down to about 0.65
            texts.append(edit(base, {10 + 12 * k for k in range(edits)}))
    base = [next(fresh) for _ in range(200)]
    for k in range(6):  # a chain: neighbours are similar, ends are not
        texts.append(base)
        base = edit(base, {7 + 30 * k, 20 + 30 * k})
    texts += [base[:150], base[:4], base[:4], base[:3], []]
    return [" ".join(t) for t in texts]


def test_planted_near_copies_go_and_others_stay(spark):
    texts = planted()
    label = list(range(len(texts)))
    prints = [simhash.fingerprint(t) for t in texts]
    for a in range(len(texts)):
        for b in range(a):
            if jaccard(texts[a], texts[b]) >= 0.8 or bin(prints[a] ^ prints[b]).count("1") <= 2:
                old, new = label[a], label[b]
                label = [min(old, new) if x in (old, new) else x for x in label]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({c: F.lit(1) for c in ("row", "node", "fp", "size", "key", "own_id", "root")})
    stage = dict(corpus_pipeline.STAGES)["near_duplicates"]
    out = stage(spark, docs, "")
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect()) == sorted(set(label))
    assert len(set(label)) < simhash.keep_one(docs).count()  # two bits alone keep more


def test_near_copies_of_odd_rows(odd, none):
    assert sorted(str(r.doc_id) for r in nearcopies.keep_one(odd).collect()) == sorted(str(r.doc_id) for r in simhash.keep_one(odd).collect())
    assert nearcopies.keep_one(none).count() == 0


def test_share_of_pairs_that_meet_in_a_band():
    rng = np.random.default_rng(1)
    met = 0
    for _ in range(2000):
        pool = rng.integers(0, 1 << 64, 180, np.uint64)
        a, b = np.unique(pool[:162]), np.unique(np.concatenate([pool[:144], pool[162:]]))  # 144 of 180: 0.8
        met += bool(((nearcopies.minima(a) == nearcopies.minima(b)).reshape(nearcopies.BANDS, -1)).all(axis=1).any())
    assert met == 2000


def test_many_copies_around_the_threshold(spark, monkeypatch):
    """A hot group whose copies are similar to each other or just not, beside texts that only share a long passage."""
    monkeypatch.setattr(nearcopies, "BLOCK", 8)
    rng = np.random.default_rng(11)
    fresh = iter(f"v{k}" for k in range(100_000))
    base = [next(fresh) for _ in range(150)]
    texts = []
    for _ in range(70):
        places = set(rng.integers(0, 150, int(rng.integers(0, 9))).tolist())
        texts.append([next(fresh) if k in places else w for k, w in enumerate(base)])
    for _ in range(12):  # copies of a copy that is no longer similar to the base
        places = set(rng.integers(0, 150, 2).tolist())
        texts.append([next(fresh) if k in places else w for k, w in enumerate(texts[-1] if rng.random() < 0.3 else [*base[:90], *(f"u{j}" for j in range(60))])])
    passage = [next(fresh) for _ in range(120)]
    texts += [[*passage, *(next(fresh) for _ in range(60))] for _ in range(40)]
    texts = [" ".join(t) for t in texts]
    label, prints = list(range(len(texts))), [simhash.fingerprint(t) for t in texts]
    for a in range(len(texts)):
        for b in range(a):
            if jaccard(texts[a], texts[b]) >= 0.8 or bin(prints[a] ^ prints[b]).count("1") <= 2:
                old, new = label[a], label[b]
                label = [min(old, new) if x in (old, new) else x for x in label]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in nearcopies.keep_one(docs).collect()) == sorted(set(label))
    assert 45 < len(set(label)) < len(texts)
