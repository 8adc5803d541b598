"""Toxicity, licenses, personal data, decontamination and the pipeline: rules, learning and odd rows."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from driftline.llm import decontaminate, licenses, pii, toxicity
from driftline.llm.queries import QUERIES, tokenizer_file
from driftline.llm.tagger import LENGTH, Tagger


def test_folding():
    assert toxicity.fold("ID1OT 1diot idi0t ｉｄｉｏｔ іdiоt id​iot") == "idiot idiot idiot idiot idiot idiot"
    assert toxicity.fold("idiot$$$ 10 apples") == "idiot$$$ 10 apples" and toxicity.fold(None) == ""


def test_lexicon_hits_and_exceptions():
    model = toxicity.Model({"trash": 3.0, "lowei*": 4.0}, frozenset({"trash can"}), (-5.0, 2.0, 0.0))
    a = model.automaton()
    assert [w for *_, w in model.hits("trash, loweischaft retrash trashy trash can", a)] == [3.0, 4.0]
    assert toxicity.measures(None, model, a) == toxicity.measures("", model, a) == (0.0, 0.0, 0)


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(3)
    rows, words = [], [f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(200)]
    for k in range(600):
        text = list(rng.choice(words, 60))
        toxic = k % 5 == 0
        if toxic:
            for _ in range(3):
                text.insert(int(rng.integers(60)), str(rng.choice(["scumbag", "nastyish", "nastyful"])))
        elif k % 7 == 0:
            text[10:11] = ["scumbag", "fish"]
        rows.append((k, " ".join(text), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int").cache()


def test_toxicity_learns_words_stems_and_exceptions(labelled, odd, none):
    docs, labels = labelled.select("doc_id", "text"), labelled.select("doc_id", "toxic")
    model = toxicity.fit(docs, labels)
    assert "nasty*" in model.weights or {"nastyi*", "nastyf*"} <= set(model.weights) or {"nastyish", "nastyful"} <= set(model.weights)
    rows = labelled.select("toxic", toxicity.scored(labelled, model).alias("s")).collect()
    right = np.mean([(r.s.score >= 0.3) == bool(r.toxic) for r in rows])
    assert right > 0.97
    scored = odd.select("doc_id", toxicity.scored(odd, model).alias("s")).collect()
    assert len(scored) == odd.count() and all(0 <= r.s.score <= 1 for r in scored)
    assert toxicity.fit(docs, labels.filter("toxic = 0")).weights == {}
    empty = toxicity.fit(none, labels.filter("false"))
    assert none.select(toxicity.scored(none, empty)).count() == 0


def brute_containment(text, threshold=0.8):
    words = licenses.WORD.findall((text or "").lower())
    out = {}
    for name, template in licenses.TEMPLATES:
        need = set(licenses.WORD.findall(template))
        for at in range(0, max(1, len(words)), licenses.STEP):
            share = len(need & set(words[at : at + 2 * licenses.STEP])) / len(need)
            if share >= threshold - 1e-9:
                out[name] = max(out.get(name, 0), share)
    return out


def test_license_join_equals_brute_force(spark, odd, none):
    rng = np.random.default_rng(4)
    every = sorted({w for _, t in licenses.TEMPLATES for w in t.split()})
    texts = ["GNU General Public License gnu general public license", "cc by", "MIT License mit license x", None, ""]
    for _, t in licenses.TEMPLATES:
        words = t.split()
        for drop in (0, 2, 5):
            some = [w for w in words if rng.random() > drop / len(words)]
            texts.append(" ".join([*rng.choice(every, 40), *some, *rng.choice(every, int(rng.integers(0, 90)))]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in licenses.scan(df).collect():
        found = brute_containment(texts[r.doc_id])
        assert set(r.labels.split(",")) - {""} == set(found) | (set(r.base_labels.split(",")) - {""})
        assert abs(r.score - (1.0 if r.n_base else max(found.values(), default=0.0))) < 1e-9
    first = {r.doc_id: r for r in licenses.scan(df).collect()}
    assert (first[0].n_words, first[0].n_base, first[0].first_word, first[0].last_word, first[0].base_labels) == (8, 2, 0, 4, "gpl")
    assert (first[3].n_words, first[3].n_base, first[3].first_word, first[3].labels, first[3].score) == (0, 0, None, "", 0.0)
    assert licenses.scan(odd).count() == odd.count() and licenses.scan(none).count() == 0


def leftmost(pattern, text):
    return [(m.start(), m.end()) for m in re.finditer(pattern, text)]


@pytest.mark.parametrize("text", ["a@b.c", "x.y@a-b.co.uk@z.q", "@@a@b", "..@a.b.", "a@b", "q a@b.c, d@e.f", "é@a.b ab@c.d@e.f.g", "a" * 300 + "@b.c"])
def test_emails_equal_the_pattern(text):
    want = leftmost(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)
    assert [(a, b) for k, a, b in pii.rules(text) if k == 0] == want


def test_rules_drop_failing_matches():
    assert pii.joined(pii.rules("1.2.3.4.5 300.1.1.1, 4046195599780836, 4046195599780837, 1 4046195599780836 +1 (229) 555-4838 +1 2")) == "ip:0:7,card:21:37,phone:76:93"
    assert pii.rules(None) == [] and pii.masked("a b@c.de f", pii.rules("a b@c.de f")) == "a <EMAIL> f"


def test_tagger_gradients_and_learning():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 5, (300, LENGTH)).astype(np.int8)
    y = np.where(x == 1, 1, np.where((np.roll(x, 1, axis=1) == 1) & (np.arange(LENGTH) > 0), 2, 0)).astype(np.int8)
    small = Tagger(3, hidden=3)
    small.p = {k: v.astype(np.float64) for k, v in small.p.items()}
    _, g = small.gradients(x[:2], y[:2])
    for k, v in small.p.items():
        at = np.unravel_index(np.abs(g[k]).argmax(), v.shape)
        v[at] += 1e-4
        up = small.gradients(x[:2], y[:2])[0]
        v[at] -= 2e-4
        down = small.gradients(x[:2], y[:2])[0]
        v[at] += 1e-4
        assert abs((up - down) / 2e-4 - g[k][at]) < 1e-3 * max(1, abs(g[k][at]))
    tagger = Tagger(3, hidden=8)
    tagger.fit(x[:250], y[:250], steps=300)
    assert (tagger.decode(x[250:]) == y[250:]).mean() > 0.97


def test_tagger_adds_looser_forms_and_keeps_rules(spark, sf, odd, none):
    docs = spark.read.parquet(f"{sf}/documents.parquet").union(spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet"))
    tagger = pii.fit(docs)
    texts = ["please call (229) 555-4838 now", "write to foo.bar @ mail3.example.com today", "card 4046.1955.9978.0836 ok", "on 2024-05-17 at v2.10.3 paid 12,345.67"]
    found = pii.added(texts, [pii.rules(t) for t in texts], tagger)
    assert sum(bool(f) for f in found[:3]) >= 2 and not found[3]
    rows = {(r.doc_id, r.spans): r for r in pii.report(odd, tagger).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert rows[2, ""].base_sha256 == empty and rows[2, ""].n_email == 0
    nine = next(r for (d, _), r in rows.items() if d == 9)
    assert (nine.n_phone, nine.n_card, nine.n_ip) == (1, 1, 1) and nine.base_sha256 == hashlib.sha256(pii.joined(pii.rules("call +1 (229) 555-4838, card 4046195599780836, host 57.96.160.157")).encode()).hexdigest()
    masked = pii.redact(odd, tagger)
    assert masked.columns == odd.columns and {r.text for r in masked.filter("doc_id = 9").collect()} == {"call <PHONE>, card <CARD>, host <IP>"}
    assert pii.fit(none) is None and pii.report(none, None).count() == 0


def test_windows_cover_and_reconcile():
    text = "x" * 100 + "7" * 150 + "y" * 100 + "@"
    begins = pii.windows(text)
    seen = {p for b in begins.tolist() for p in range(b, b + LENGTH)}
    assert {m.start() for m in re.finditer("[0-9@]", text)} <= seen
    tags = np.zeros((len(begins), LENGTH), np.int8)
    for k, b in enumerate(begins.tolist()):
        for p in range(b, min(b + LENGTH, len(text))):
            if text[p] == "7":
                tags[k, p - b] = 3 if p == 100 else 4
    assert pii.reconciled(text, begins, tags) == [(1, 100, 250)]


def test_decontamination_finds_verified_items_only(spark, odd, none):
    rng = np.random.default_rng(8)
    words = [f"{a}{b}" for a in "bcdfghjklm" for b in ("ana", "ore", "uti", "elo", "ish", "urn")]
    items = [(k, " ".join(rng.choice(words, 40)) + ". " + " ".join(rng.choice(words, 12)) + ".") for k in range(50)] + [(50, None), (51, ""), (52, "one two three"), (None, "x y z x y z x")]
    noise = lambda n: " ".join(rng.choice(words, n))
    docs = [(0, f"{noise(300)} {items[7][1].upper()} {noise(500)}"), (1, noise(900)), (2, f"{noise(50)} {items[9][1].split('. ')[0]} {noise(50)}"), (3, None), (4, ""), (5, items[11][1] + " " + items[12][1]), (6, "well one two three four")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("found", F.lit("mine"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    for per_shard in (1024, 7):
        got = {r.doc_id: r["items"] for r in decontaminate.report(frame, bench, per_shard=per_shard).collect()}
        assert got == {0: "7", 1: "", 2: "", 3: "", 4: "", 5: "11,12", 6: "52"}
    kept = decontaminate.clean(frame, bench)
    assert kept.columns == frame.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 4]
    assert decontaminate.clean(odd, bench).columns == odd.columns
    assert decontaminate.report(odd, bench.filter("false")).filter("n_items > 0").count() == 0 and decontaminate.report(none, bench).count() == 0


def test_pipeline_stages_take_effect(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = docs.unionByName(docs.limit(5)).withColumns({"toxic": F.lit(1), "row": F.lit(2), "spotted": F.lit(3)})
    kept = extra
    sizes = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, sf).cache()
        assert kept.columns == extra.columns, name
        sizes.append(kept.count())
    assert sizes[0] < extra.count() and sizes[1] < sizes[0] and sizes[2] <= sizes[1] and sizes[3] == sizes[2]
    found = QUERIES["op2_toxicity"](spark, sf).filter("predicted = 1").select("doc_id")
    assert kept.join(found, "doc_id").count() == 0 and kept.select("doc_id").distinct().count() == kept.count()
    assert kept.filter(F.col("text").rlike(r"\+[0-9] \([0-9]{3}\) [0-9]{3}-[0-9]{4}")).count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, sf)
    assert packed.select("doc_id").distinct().count() == kept.count()
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 4096").count() == 0
