"""Signs read as letters, and a lexicon of many rare words."""

import numpy as np
import pytest

from driftline.llm import toxicity


@pytest.mark.parametrize("text, word", [("l00ser", "looser"), ("lo55er", "losser"), ("hat3", "hate"), ("idi07", "idiot"), ("@pple", "apple"), ("$tupid", "stupid"), ("!diot", "idiot"), ("$h17!", "shit"), ("a$$", "ass"), ("@$$hole!!", "asshole"), ("1d10t", "idiot"), ("@idiot", "idiot"), ("idiot!", "idiot"), ("5ex", "sex"), ("idi0t2", "idiot")])
def test_signs_at_any_place_are_read(text, word):
    model = toxicity.Model({word: 3.0})
    assert toxicity.measures(f"so {text} here", model, model.automaton())[2] == 1
    assert toxicity.measures(text, model, model.automaton())[2] == 1


def test_numbers_hashes_and_mail_stay():
    for text in ("1st 3rd 4th 10 am 100k $50 7am 5kg 1990s 21st", "deadbeef01345", "mail b0b@ma1l.example.com now", "idiot$$$ 10 apples"):
        assert toxicity.forms(text)[0] == text
    assert toxicity.forms("1st 4th 7am deadbeef01345 b0b@ma1l.example.com 10 $")[1] == []


def test_a_long_tail_of_toxic_words_is_learned(spark):
    rng = np.random.default_rng(9)
    name = lambda k, n=5: "".join(chr(97 + (k * 7919 + 31 * j * (k + 3)) % 26) for j in range(n)) + chr(97 + k % 26) + chr(97 + k // 26)
    plain, bad = [name(k) for k in range(300)], [name(k, 6) for k in range(300, 400)]
    assert not {b[:4] for b in bad} & {p[:4] for p in plain} or len(set(bad) - set(plain)) == 100
    rows = []
    for k in range(5000):
        text = list(rng.choice(plain, 40))
        if k % 2:
            text[int(rng.integers(40))] = bad[k // 2 % 100]  # each in 1 % of the toxic texts
        rows.append((k, " ".join(text), k % 2))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int").cache()
    model = toxicity.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    found = df.select("toxic", toxicity.scored(df, model).alias("s")).collect()
    assert np.mean([(r.s.score >= 0.3) == bool(r.toxic) for r in found]) > 0.98
