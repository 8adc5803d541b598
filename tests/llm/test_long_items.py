"""Test items longer than a passage."""

import numpy as np

from driftline.llm import decontaminate


def test_long_items_are_found_at_every_alignment(spark):
    rng = np.random.default_rng(6)
    word = lambda k: "".join(chr(97 + int(c)) for c in str(k))
    items, n = [], 0
    for size in (100, 200, 1000):
        items.append((size, " ".join(word(k) for k in range(n, n + size))))
        n += size
    items += [(9000 + k, " ".join(word(x) for x in rng.integers(5000, 5400, 40))) for k in range(60)]
    docs = []
    for size, text in items[:3]:
        for at in range(32):
            docs.append((size * 100 + at, " ".join([*(word(x) for x in rng.integers(20_000, 30_000, at + 40)), text, *(word(x) for x in rng.integers(20_000, 30_000, 70))])))
    docs.append((1, " ".join(items[2][1].split()[:300])))  # a part is not the item
    got = {r.doc_id: r["items"] for r in decontaminate.report(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got.pop(1) == ""
    assert len(got) == 96 and all(v == str(d // 100) for d, v in got.items())
