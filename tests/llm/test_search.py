"""Top-k search, near-duplicates, archives and byte models against brute force."""

import hashlib
import math
import zlib

import numpy as np
import xxhash
from pyspark.sql import functions as F

from driftline.llm import ctw, simhash, topk, warc


def test_topk_with_ties_nulls_and_few_candidates(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 4) / 256]) for i in range(300)]
    rows += [(300, None), (301, []), (302, [1.0, None, 0.0, 0.0]), (303, [float("nan")] * 4), (304, [float("inf")] * 4), (None, [1.0] * 4), (50, [0.0, 0.0, 0.0, 3 / 256]), (400, [1.0, 2.0]), (401, [2.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"g": F.lit(1), "b": F.lit(2), "v": F.lit(3)})
    got = sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 50 == 0, k=4, group=64, block=3).collect())
    good = [(i, tuple(math.floor(256 * x) for x in v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    queries = {}
    for i, v in good:
        if i % 50 == 0:
            queries[i] = min(v, queries.get(i, v))
    want = []
    for q, v in queries.items():
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in good if i != q and len(w) == len(v))
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scored[:4])]
    assert got == sorted(want)
    assert topk.top_k(df.filter("false"), F.col("vec_id") % 50 == 0).count() == 0


def brute_components(prints):
    label = {d: d for d in range(len(prints))}
    changed = True
    while changed:
        changed = False
        for a in label:
            for b in label:
                if bin(prints[a] ^ prints[b]).count("1") <= 2 and label[b] < label[a]:
                    label[a], changed = label[b], True
    return label


def test_fingerprint_is_the_majority_of_hashes():
    words = "One two THREE  four\tfive six".lower().split()
    hashes = [xxhash.xxh64_intdigest(" ".join(words[k : k + 3]), 42) for k in range(4)]
    want = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > 4)
    assert simhash.fingerprint("One two THREE  four\tfive six") == want
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0
    assert simhash.fingerprint("Two words") == xxhash.xxh64_intdigest("two words", 42)


def test_links_connect_what_brute_force_connects(spark):
    rng = np.random.default_rng(2)
    prints = {0}
    for seed in rng.integers(0, 1 << 63, 12).tolist():
        now = seed
        for _ in range(25):  # chains and clusters
            now ^= 1 << int(rng.integers(64))
            prints.add(now)
    low = int(rng.integers(1 << 62)) & ~0xFFFF
    prints |= {low | int(x) for x in rng.integers(0, 1 << 16, 250)}  # a posting of more than 128
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    nodes = spark.createDataFrame([(p,) for p in signed], "fp long")
    found = {r.node: r.root for r in simhash.components(simhash.links(nodes, 2)).collect()}
    want = brute_components(prints)
    groups = {}
    for k, p in enumerate(signed):
        groups.setdefault(found.get(p, p), set()).add(want[k])
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(want.values()))


def test_near_duplicates_of_odd_rows(spark, odd, none):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    by = {}
    for r in rows:
        by.setdefault(r.fingerprint, set()).add(r.component_id)
    assert all(len(v) == 1 for v in by.values())
    assert by["0" * 16] == {2} and {r.component_id for r in rows if r.doc_id == 6} == {1}
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(by) and ids.count(2) == 1 and 3 not in ids and 4 not in ids and 6 not in ids and ids.count(7) == 2
    assert simhash.near_duplicates(none).count() == 0 and simhash.keep_one(none).count() == 0


def pages_frame(spark):
    big = "x" * 1200 + "é"
    inner = "a" * 990 + "\r\n\r\nWARC/1.0\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" + "tail WARC/1.0\r\n"
    rows = [(1, "http://a", big), (2, "http://b", big), (3, None, None), (4, "u\r\nContent-Length: 7", ""), (5, "http://c" * 900, inner), (6, "http://d", inner), (7, "http://e", "WARC/1.0\r\n"), (8, "", "short"), (9, "", "short"), (None, "http://n", big), (10, "", "WARC/1.0\r\nContent-Length: 5\r\n\r\n"), (11, "", "\r\n\r\n")]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"payload": F.lit(1), "salt": F.lit(2), "keeper": F.lit(3)}), rows


def test_archives_keep_payloads_and_reject_inner_records(spark, tmp_path):
    df, rows = pages_frame(spark)
    for parts in (1, 3):
        folder = str(tmp_path / f"w{parts}")
        warc.write(df.repartition(parts), folder)
        got = {r.page_id: r for r in warc.read(spark, folder).collect()}
        assert len(got) == len(rows)
        light = {r.page_id: r for r in warc.read(spark, folder, payload=False).collect()}
        assert all(light[p].payload_digest == got[p].payload_digest and light[p].refers_to == got[p].refers_to for p in got)
        for page, _, html in rows:
            raw = (html or "").encode()
            r = got[page]
            assert (r.payload_bytes, r.payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
            if r.record_type == "response":
                assert r.payload == (html or "")
        assert (got[1].refers_to, got[2].record_type, got[5].refers_to, got[None].refers_to) == (2, "response", 6, 2)
        assert got[8].record_type == got[9].record_type == "response"


def test_chains_over_many_splits(spark, tmp_path):
    df, rows = pages_frame(spark)
    many = df.crossJoin(spark.range(40).withColumnRenamed("id", "copy")).withColumn("page_id", F.col("page_id") * 100 + F.col("copy"))
    folder = str(tmp_path / "w")
    warc.write(many.coalesce(1), folder, least=10**9)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7001")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        assert warc.candidates(spark, folder, False).select("split").distinct().count() > 8
        got = warc.read(spark, folder).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    want = sorted((-1 if r.page_id is None else r.page_id, r.html or "") for r in many.select("page_id", "html").collect())
    assert sorted((-1 if r.page_id is None else r.page_id, r.payload) for r in got) == want
    assert warc.round_trip(df.filter("false")).count() == 0


def brute_ctw(train, text):
    """Bit probabilities from a tree of plain dictionaries."""
    counts = {}

    def bits(data):
        raw = ctw.END * ctw.DEPTH + data + ctw.END
        for i in range(ctw.DEPTH, len(raw)):
            for level in range(8):
                yield raw[i - ctw.DEPTH : i][::-1], (1 << level) | (raw[i] >> (8 - level)), raw[i] >> (7 - level) & 1

    for data in train:
        for context, node, bit in bits(data):
            for d in range(ctw.DEPTH + 1):
                counts.setdefault((context[:d], node), [0, 0])[bit] += 1
    children = {}
    for context, node in counts:
        if context:
            children.setdefault((context[:-1], node), []).append((context, node))
    lg = math.lgamma
    own = {k: lg(a + 0.5) + lg(b + 0.5) - lg(a + b + 1) - math.log(math.pi) for k, (a, b) in counts.items()}
    weighted = {}
    for k in sorted(counts, key=lambda k: -len(k[0])):
        weighted[k] = own[k] if len(k[0]) == ctw.DEPTH else np.logaddexp(own[k], sum(weighted[c] for c in children[k])) - math.log(2)
    total = 0.0
    for context, node, bit in bits(text):
        p = None
        for d in range(ctw.DEPTH, -1, -1):
            k = (context[:d], node)
            if k in counts:
                a, b = counts[k]
                q = ((a, b)[bit] + 0.5) / (a + b + 1)
                if p is None:
                    p = q
                else:
                    w = 1 / (1 + math.exp(min(700, sum(weighted[c] for c in children[k]) - own[k])))
                    p = w * q + (1 - w) * p
        total += math.log10(0.5 if p is None else p)
    return total


def test_context_tree_weighting(spark, odd, none):
    texts = [(i, t) for i, t in enumerate(["the cat sat on the mat", "The dog sat on the log", "a cat and a dog", None, "", "zzz ééé the cat", "the cat sat on the mat"])]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("key", F.lit(1))
    held = lambda d: zlib.crc32(str(d).encode()) % 5 == 1
    train = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 1
    got = {r.doc_id: r for r in ctw.scores(df, train, batch_bytes=40, keys_per_group=50).collect()}
    low = {i: (t or "").lower().encode() for i, t in texts}
    known = [low[i] for i, _ in texts if not held(i)]
    for i, _ in texts:
        assert got[i].held_out == held(i)
        assert abs(got[i].score - brute_ctw(known, low[i])) < 1e-6
    rows = ctw.scores(odd, F.lit(True)).collect()
    assert len(rows) == odd.count() and all(r.score < 0 and r.base_score < 0 and r.n_known == r.n_tokens for r in rows)
    alone = ctw.scores(df, F.lit(False)).collect()
    assert all(abs(r.score + 8 * math.log10(2) * (len(low[r.doc_id]) + 1)) < 1e-6 and r.train_tokens == 0 for r in alone)
    assert ctw.scores(none, F.lit(True)).count() == 0
