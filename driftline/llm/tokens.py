"""Token ids of whole texts with a fixed public tokenizer, a batch at a time.

Both tokenizers cut a text into pre-tokens before they merge bytes, and no pre-token reaches from a visible character
into the white space after it. So a text may be cut in such places, each distinct chunk encoded once, and the ids be
joined; they equal the ids of the whole text. Texts with other white space than blank and line feed are encoded whole.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Chunks remembered by one Python worker; beyond it the memory is emptied, so the size is bounded.
MEMORY = 800_000
#: Longer chunks are not remembered.
LONG = 64
_encoders: dict = {}


def _pieces(texts: pa.LargeStringArray) -> tuple[pa.LargeStringArray, np.ndarray]:
    """Texts cut before a blank or line feed that follows something else, and before a full stop or comma between a letter and white
    space or the text's end; all pieces, and their number in each text. The pieces share the texts' bytes.
    """
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
    raw = raw[: ends[-1]]
    white = (raw == 32) | (raw == 10)
    low = raw | 32
    letter, stop = (low >= 97) & (low <= 122), (raw == 46) | (raw == 44)
    last = np.zeros(len(raw), bool)  # the last byte of a text
    last[ends[1:][ends[1:] > ends[:-1]] - 1] = True
    cut = np.zeros(len(raw), bool)
    cut[1:] = white[1:] & ~white[:-1]
    after = last.copy()
    after[:-1] |= white[1:]
    cut[1:] |= stop[1:] & letter[:-1] & after[1:]
    cut[ends[:-1][ends[:-1] < len(raw)]] = False  # a text's beginning is none of its cuts
    cut[: ends[0]] = False
    at = np.flatnonzero(cut)
    counts = np.searchsorted(at, ends[1:], side="left") - np.searchsorted(at, ends[:-1], side="left") + 1
    offsets = np.insert(at, np.searchsorted(at, ends[:-1], side="left"), ends[:-1])
    offsets = np.append(offsets, ends[-1])
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(raw)), counts


class Encoder:
    """``drops_space``: the tokenizer ignores white space and case of A-Z; otherwise a chunk keeps the space before it."""

    def __init__(self, path: str, drops_space: bool, separator: str):
        from tokenizers import Tokenizer

        self.plain, self.split = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.plain.encode_special_tokens = True
        self.drops_space, self.separator = drops_space, separator
        self.mark = self.split.token_to_id(separator)
        self.known: dict[str, bytes] = {}

    def _learn(self, chunks: list[str]) -> list[bytes]:
        """Ids of each chunk. Chunks go to the tokenizer in one string with the special token between them."""
        odd = [k for k, c in enumerate(chunks) if "<|" in c]
        if odd:
            out = dict.fromkeys(range(len(chunks)))
            out |= {k: np.array(self.plain.encode(chunks[k], add_special_tokens=False).ids, np.uint16).tobytes() for k in odd}
            rest = [k for k in out if out[k] is None]
            return list((out | dict(zip(rest, self._learn([chunks[k] for k in rest])))).values())
        joined = [self.separator.join(chunks[at : at + 256]) for at in range(0, len(chunks), 256)]
        out = []
        for found in self.split.encode_batch_fast(joined, add_special_tokens=False):
            ids = np.array(found.ids, np.uint16)
            raw, cuts = ids.tobytes(), (np.flatnonzero(ids == self.mark) * 2).tolist()
            out += [raw[a:b] for a, b in zip([0, *(c + 2 for c in cuts)], [*cuts, len(raw)])]
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and where each text's ids begin (one more entry than texts). Null counts as empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        texts = texts.take(pa.array(np.arange(len(texts))))  # a copy whose offsets start at 0: ascii_lower misreads others
        odd = pc.match_substring_regex(texts, r"[\x01\t\x0b-\x0d\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")
        whole = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        cut = pc.if_else(odd, "", texts) if len(whole) else texts
        if self.drops_space:
            cut = pc.replace_substring_regex(pc.ascii_lower(cut), r"([a-z])([.,])([ \n]|$)", r"\1 \2\3")
            cut = pc.replace_substring(cut, "\n", " ")
            lists = pc.split_pattern(cut, " ")
            counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            words = lists.flatten().dictionary_encode()
        else:
            words, counts = _pieces(cut)
            words = words.dictionary_encode()
        chunks, index = words.dictionary.to_pylist(), words.indices.to_numpy()
        known = self.known
        found = [known.get(c) for c in chunks]
        new = [k for k, v in enumerate(found) if v is None]
        for k, ids in zip(new, self._learn([chunks[k] for k in new])):
            found[k] = ids
        if len(known) + len(new) > MEMORY:
            known.clear()
        known.update((chunks[k], found[k]) for k in new[:MEMORY] if len(chunks[k]) <= LONG)
        size = np.fromiter(map(len, found), np.int64, len(found)) // 2
        flat = np.frombuffer(b"".join(found), np.uint16)
        begin = np.cumsum(size) - size
        each = size[index]
        ends = np.cumsum(each)
        ids = flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin[index] - (ends - each), each)] if len(flat) else np.empty(0, np.uint16)
        starts = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        if len(whole):
            own = {int(k): np.array(e.ids, np.uint16) for k, e in zip(whole, self.plain.encode_batch(texts.take(pa.array(whole)).to_pylist(), add_special_tokens=False))}
            parts = [own.get(k, ids[starts[k] : starts[k + 1]]) for k in range(len(texts))]
            starts = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
            ids = np.concatenate(parts)
        return ids, starts


def encoder(path: str, drops_space: bool, separator: str = "<|endoftext|>") -> Encoder:
    """One per worker process and file."""
    if (path, drops_space) not in _encoders:
        _encoders[path, drops_space] = Encoder(path, drops_space, separator)
    return _encoders[path, drops_space]
