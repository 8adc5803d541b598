"""Cost-balanced packing of token sequences.

A document's ids are cut into full pieces of ``size`` ids, which are sequences by themselves, and a tail. Tails are dealt
into shards of about ``per_shard`` documents by a hash of the id and of the ids' checksum. In a shard the least number of
sequences that can hold all tails is opened; tails are taken in descending length and each goes to the sequence of lowest
estimated cost (``linear`` per token plus ``quadratic`` per squared token of a piece, as attention costs) that still has
room for it. Tails that fit nowhere are cut and fill the remaining room, again cheapest sequence first. So a shard leaves
less than one sequence of padding, and a task holds at most the tails of one shard, each shorter than ``size``.

Null texts count as empty (a document of the end id alone). A row is a document: repeated ids or rows are packed one by
one, null ids too. Ties go to the smaller id. An empty table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .tokens import encoder

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, cost double"
_TAILS = "doc_id long, shard long, doc_tokens long, full binary, tail binary"


def crc_of(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def assign(lengths: np.ndarray, size: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int]]:
    """(item, from, length, sequence) for items in descending order of length."""
    total = int(lengths.sum())
    count = -(-total // size)
    cost, room = np.zeros(count), np.full(count, size, np.int64)
    out, late = [], []

    def put(item: int, start: int, n: int, at: int) -> None:
        out.append((item, start, n, at))
        cost[at] += linear * n + quadratic * n * n
        room[at] -= n

    for item, n in enumerate(lengths.tolist()):
        fits = np.where(room >= n, cost, np.inf)
        at = int(fits.argmin())
        if fits[at] == np.inf:
            late.append((item, n))
        else:
            put(item, 0, n, at)
    for item, n in late:
        done = 0
        while done < n:
            at = int(np.where(room > 0, cost, np.inf).argmin())
            part = min(n - done, int(room[at]))
            put(item, done, part, at)
            done += part
    return out


def pack(docs: DataFrame, tokenizer: str, size: int = 4096, end_id: int = 2, per_shard: int = 2048, linear: float = 1.0, quadratic: float = 1 / 4096) -> DataFrame:
    """One row per piece with its sequence and place there. ``tokenizer``: a file for the tokenizers library that ignores white space."""
    shards = max(1, -(-docs.count() // per_shard))

    def tails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, True)
        for batch in batches:
            for part in slices(batch, "text"):
                ids, starts = enc.encode(part.column("text"))
                rows: list[list] = [[], [], [], [], []]
                for doc, a, b in zip(part.column("doc_id").to_pylist(), starts.tolist(), starts[1:].tolist()):
                    own = np.append(ids[a:b], end_id).astype(np.uint16)
                    cut = len(own) // size * size
                    full = np.array([crc_of(own[k : k + size]) for k in range(0, cut, size)], "<u4")
                    tail = own[cut:].tobytes()
                    mix = zlib.crc32(tail, zlib.crc32(str(doc).encode()))
                    for column, value in zip(rows, (doc, mix % shards, len(own), full.tobytes(), tail)):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.int64()), pa.array(rows[3], pa.binary()), pa.array(rows[4], pa.binary())], names=["doc_id", "shard", "doc_tokens", "full", "tail"])

    def place(key: tuple, rows: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        ids, tokens = rows.column("doc_id").to_pylist(), rows.column("doc_tokens").to_pylist()
        full = [np.frombuffer(x, "<u4") for x in rows.column("full").to_pylist()]
        tail = [np.frombuffer(x, np.uint16) for x in rows.column("tail").to_pylist()]
        order = sorted((k for k in range(len(ids)) if len(tail[k])), key=lambda k: (-len(tail[k]), ids[k] is None, ids[k] or 0, tail[k].tobytes()))
        pieces = [(order[i], tokens[order[i]] - len(tail[order[i]]) + s, n, crc_of(tail[order[i]][s : s + n]), at) for i, s, n, at in assign(np.array([len(tail[k]) for k in order], np.int64), size, linear, quadratic)]
        filled: dict[int, int] = {}
        out = []
        for k, start, n, crc, at in pieces:
            out.append((ids[k], start, n, crc, tokens[k], at, filled.get(at, 0), linear * n + quadratic * n * n))
            filled[at] = filled.get(at, 0) + n
        at = len(filled)
        for k, crcs in enumerate(full):
            for j, crc in enumerate(crcs.tolist()):
                out.append((ids[k], j * size, size, crc, tokens[k], at, 0, linear * size + quadratic * size * size))
                at += 1
        columns = list(zip(*out)) or [()] * 8
        kinds = [pa.int64()] * 7 + [pa.float64()]
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "cost"]
        columns[5] = [(shard << 32) + s for s in columns[5]]
        return pa.table({n: pa.array(c, t) for n, c, t in zip(names, columns, kinds)})

    cut = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tails, _TAILS)
    return cut.groupBy("shard").applyInArrow(place, PIECES)
