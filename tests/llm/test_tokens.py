"""Packing and Huffman files against whole-text tokenization."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from driftline.llm import huffman, packing
from driftline.llm.queries import tokenizer_file
from driftline.llm.tokens import Encoder

FILES = {True: "word_bpe_49k.json", False: "byte_bpe_50k.json"}


def plain(drops_space):
    t = Tokenizer.from_file(tokenizer_file(FILES[drops_space]))
    t.encode_special_tokens = True
    return t


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("drops_space", [True, False])
@settings(max_examples=60, deadline=None)
@given(texts=st.lists(st.text(alphabet="abZ'., \n\t\x01é́İ<|1$ ", max_size=40), max_size=6))
def test_chunks_give_the_ids_of_the_whole_text(drops_space, texts):
    import pyarrow as pa

    enc = test_chunks_give_the_ids_of_the_whole_text.__dict__.setdefault(drops_space, Encoder(tokenizer_file(FILES[drops_space]), drops_space, "<|endoftext|>"))
    ids, starts = enc.encode(pa.array(texts, pa.string()))
    for k, text in enumerate(texts):
        assert ids[starts[k] : starts[k + 1]].tolist() == enc.plain.encode(text, add_special_tokens=False).ids


def test_packing_places_every_id_once(spark, odd):
    size = 64
    rows = packing.pack(odd, tokenizer_file(FILES[True]), size=size, per_shard=4).collect()
    t = plain(True)
    want = sorted((r.doc_id if r.doc_id is not None else -99, tuple(t.encode(r.text or "", add_special_tokens=False).ids + [2])) for r in odd.select("doc_id", "text").collect())
    assert sorted({(r.doc_id if r.doc_id is not None else -99, r.doc_tokens) for r in rows}) == sorted({(d, len(i)) for d, i in want})
    assert sum(r.length for r in rows) == sum(len(i) for _, i in want)
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= size
    for doc, ids in want:
        if [d for d, _ in want].count(doc) == 1:
            own = sorted((r.start, r.length, r.ids_crc32) for r in rows if r.doc_id == doc)
            assert own[0][0] == 0 and sum(n for _, n, _ in own) == len(ids)
            assert all(crc(ids[a : a + n]) == c for a, n, c in own)


def test_assignment_is_full_and_goes_to_the_cheapest(spark):
    rng = np.random.default_rng(1)
    lengths = np.sort(rng.integers(1, 100, 300))[::-1]
    placed = packing.assign(lengths, 100, 1.0, 0.01)
    assert len({s for *_, s in placed}) == -(-lengths.sum() // 100)
    used = np.bincount([s for *_, s in placed], [n for _, _, n, _ in placed])
    assert used.max() <= 100 and used.sum() == lengths.sum()
    assert packing.assign(np.array([6, 5, 4, 3]), 10, 1.0, 0.0)[:2] == [(0, 0, 6, 0), (1, 0, 5, 1)]


def test_empty_tables(spark, none, tmp_path):
    assert packing.pack(none, tokenizer_file(FILES[True])).count() == 0
    assert huffman.round_trip(none, tokenizer_file(FILES[False])).count() == 0


def test_huffman_round_trip(spark, odd, tmp_path):
    huffman.write(odd, tokenizer_file(FILES[False]), str(tmp_path / "x"), ids_per_bucket=4000, ids_per_block=300)
    rows = huffman.read(spark, str(tmp_path / "x")).collect()
    t = plain(False)
    want = [(r.doc_id, t.encode(r.text or "", add_special_tokens=False).ids + [2]) for r in odd.select("doc_id", "text").collect()]
    want.sort(key=lambda r: (r[0] is not None, r[0] or 0, len(r[1]), crc(r[1])))
    at = 0
    for (doc, ids), row in zip(want, sorted(rows, key=lambda r: r.start)):
        if doc is not None and doc != 7:
            assert row.doc_id == doc
        assert row.start == at and row.n_tokens == len(np.frombuffer(row.ids, "<u4"))
        at += row.n_tokens
    assert sorted((-99 if d is None else d, crc(i)) for d, i in want) == sorted((-99 if r.doc_id is None else r.doc_id, r.ids_crc32) for r in rows)
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in rows)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 10**9), min_size=1, max_size=300))
def test_codes_are_prefix_free_short_and_near_the_entropy(counts):
    counts = np.array(counts + [1])
    lengths = huffman.code_lengths(counts)
    assert lengths.max() <= huffman.LIMIT and ((lengths > 0) == (counts > 0)).all()
    if (counts > 0).sum() > 1:
        assert sum(2.0 ** -int(x) for x in lengths[lengths > 0]) == 1
        share = counts[counts > 0] / counts.sum()
        entropy = -(share * np.log2(share)).sum()
        assert (share * lengths[counts > 0]).sum() <= entropy + 1.1
    rng = np.random.default_rng(0)
    ids = rng.choice(np.flatnonzero(counts), 1000).astype(np.uint16)
    bits, marks = huffman.encode(ids, huffman.canonical(lengths), lengths)
    assert (huffman.decode(bits, marks, huffman._lanes(np.array([1000])), huffman.decode_table(lengths)) == ids).all()


def test_length_limit_binds():
    fib = [1, 1]
    while len(fib) < 40:
        fib.append(fib[-1] + fib[-2])
    lengths = huffman.code_lengths(np.array(fib))
    assert lengths.max() == huffman.LIMIT and sum(2.0 ** -int(x) for x in lengths) == 1


def test_pieces_are_those_of_the_pattern():
    import random
    import re

    import pyarrow as pa

    from driftline.llm.tokens import _pieces

    rng = random.Random(3)
    texts = ["".join(rng.choice(["a", "Z", "é", ".", ",", " ", "\n", "  ", "1", "x.", "y, "]) for _ in range(rng.randrange(14))) for _ in range(3000)] + ["", "", "a.", ".", " "]
    for array in (pa.array(texts, pa.large_string()), pa.array(texts, pa.large_string()).slice(5, 900), pa.array([], pa.large_string())):
        words, counts = _pieces(array)
        want = []
        for t in array.to_pylist():
            t = re.sub(r"([A-Za-z])([.,])(?=[ \n]|\Z)", "\\1\x01\\2", t)
            want.append(re.sub(r"(?<=[^ \n\x01])([ \n])", "\x01\\1", t).split("\x01"))
        assert words.to_pylist() == [w for x in want for w in x] and counts.tolist() == [len(x) for x in want]
