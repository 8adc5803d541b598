"""Files of token ids in a canonical, length-limited Huffman code of global counts.

``write`` tokenises each text, counts all ids, builds one code of at most ``LIMIT`` bits (package-merge over at most 65,536
counts, the only thing that meets in the driver), and writes blocks in ascending order of the document id. ``read`` gives
the documents back. A folder holds

- ``code``: one row with the code length of every id; canonical codes follow from it,
- ``blocks``: rows (bucket, block, n_docs, n_ids, payload) in file and row order of the ids. A payload stands alone: a
  header, the documents' ids and lengths, one bit offset for every ``EVERY`` ids of a document, and the code bits. Each
  document begins on a byte.

Decoding is table driven: the next ``LIMIT`` bits index a table of (id, length), and all checkpoints of a block advance in
step. A task holds a few batches of texts or one block; a block is at least one document.

Null texts count as empty and get the end id alone. Null ids sort first; equal ids are ordered by their content and each row
stays a document of its own. An empty table gives an empty folder and an empty result. Further columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import scratch, slices, stored
from .tokens import encoder

LIMIT = 16
EVERY = 128
SYMBOLS = 1 << 16
MAGIC = b"HUF1"
_SLICE = 1 << 16  # ids coded at once, a multiple of EVERY


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits by package-merge; 0 where a count is 0."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} symbols do not fit in codes of {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    levels, row = [], leaves
    flags = np.ones(len(leaves), bool)
    for _ in range(limit):
        levels.append(flags)
        pairs = row[: len(row) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaves, pairs])
        rank = np.argsort(both, kind="stable")
        row, flags = both[rank], rank < len(leaves)
    take, length = 2 * len(leaves) - 2, np.zeros(len(leaves), np.int64)
    for flags in reversed(levels):
        own = int(flags[:take].sum())
        length[:own] += 1
        take = 2 * (take - own)
    out[order] = length
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, id)."""
    codes = np.zeros(len(lengths), np.uint32)
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    sizes = lengths[order].astype(np.int64)
    top = np.cumsum(1 << (LIMIT - sizes)) - (1 << (LIMIT - sizes))
    codes[order] = top >> (LIMIT - sizes)
    return codes


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each possible next ``LIMIT`` bits: the id and its length."""
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    spans = 1 << (LIMIT - lengths[order].astype(np.int64))
    ids, size = np.zeros(1 << LIMIT, np.uint16), np.ones(1 << LIMIT, np.uint8)
    n = int(spans.sum())
    ids[:n], size[:n] = np.repeat(order, spans), np.repeat(lengths[order], spans)
    return ids, size


def encode(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Code bits and the bit offset of every ``EVERY``-th id."""
    parts, marks, base = [], [], 0
    for at in range(0, len(ids), _SLICE):
        own = ids[at : at + _SLICE]
        size = lengths[own].astype(np.int64)
        ends = np.cumsum(size)
        begin = ends - size
        word = begin >> 5
        value = codes[own].astype(np.uint64) << (64 - (begin & 31) - size).astype(np.uint64)
        n = int(ends[-1] + 31) // 32
        high = np.bincount(word, (value >> np.uint64(32)).astype(np.float64), n + 1)
        low = np.bincount(word + 1, (value & np.uint64(0xFFFFFFFF)).astype(np.float64), n + 1)
        raw = (high[: n + 1] + low[: n + 1]).astype(">u4").tobytes()[: int(ends[-1] + 7) // 8]
        marks.append(begin[::EVERY] + base)
        parts.append(raw)
        base += 8 * len(raw)
    return b"".join(parts), np.concatenate(marks).astype("<u8")


def decode(bits: bytes, marks: np.ndarray, counts: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """All ids of lanes that begin at bit ``marks`` and have ``counts`` (up to EVERY) ids."""
    raw = np.frombuffer(bits + bytes(4), np.uint8).astype(np.uint32)
    window = raw[:-3] << np.uint32(24) | raw[1:-2] << np.uint32(16) | raw[2:-1] << np.uint32(8) | raw[3:]
    out = np.zeros((len(marks), EVERY), np.uint16)
    order = np.argsort(-counts, kind="stable")
    at, left = marks[order].astype(np.int64), counts[order]
    lanes = np.searchsorted(-left, -np.arange(EVERY), side="left")  # how many lanes have more than k ids
    for k in range(int(left[0]) if len(left) else 0):
        n = lanes[k]
        here = at[:n]
        code = (window[here >> 3] >> (16 - (here & 7)).astype(np.uint32)) & np.uint32(0xFFFF)
        out[:n, k] = table[0][code]
        here += table[1][code]
    back = np.empty_like(out)
    back[order] = out
    return back[np.arange(EVERY) < counts[:, None]]


def _lanes(lengths: np.ndarray) -> np.ndarray:
    """Ids of each checkpoint of documents with ``lengths`` ids."""
    n = -(-lengths // EVERY)
    counts = np.full(int(n.sum()), EVERY, np.int64)
    counts[np.cumsum(n) - 1] = lengths - (n - 1) * EVERY
    return counts


def _payload(rows: list[tuple]) -> bytes:
    ids = np.array([0 if r[0] is None else r[0] for r in rows], "<i8")
    known = np.array([r[0] is not None for r in rows], np.uint8)
    lengths = np.array([r[1] for r in rows], "<u8")
    begin = np.cumsum([0, *(len(r[2]) for r in rows[:-1])]) * 8
    marks = np.concatenate([np.frombuffer(r[3], "<u8") + np.uint64(b) for r, b in zip(rows, begin)])
    return b"".join([MAGIC, np.array([len(rows), EVERY, len(marks)], "<u4").tobytes(), ids.tobytes(), known.tobytes(), lengths.tobytes(), marks.tobytes(), *(r[2] for r in rows)])


def unpack(payload: bytes, table: tuple[np.ndarray, np.ndarray]) -> tuple[list, np.ndarray, np.ndarray]:
    """(document ids, lengths, all token ids) of a block."""
    if payload[:4] != MAGIC:
        raise ValueError("not a block of Huffman coded ids")
    n, every, n_marks = np.frombuffer(payload, "<u4", 3, 4).tolist()
    if every != EVERY:
        raise ValueError(f"checkpoints at {every} ids")
    ids = np.frombuffer(payload, "<i8", n, 16)
    known = np.frombuffer(payload, np.uint8, n, 16 + 8 * n)
    lengths = np.frombuffer(payload, "<u8", n, 16 + 9 * n).astype(np.int64)
    marks = np.frombuffer(payload, "<u8", n_marks, 16 + 17 * n)
    return [i if k else None for i, k in zip(ids.tolist(), known.tolist())], lengths, decode(payload[16 + 17 * n + 8 * n_marks :], marks, _lanes(lengths), table)


def write(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 2, ids_per_bucket: int = 8 << 20, ids_per_block: int = 1 << 17) -> None:
    """Token files of ``docs`` (doc_id, text). The tokenizer keeps white space (byte-level)."""

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, False)
        for batch in batches:
            for part in slices(batch, "text", 12 << 20):
                ids, starts = enc.encode(part.column("text"))
                ends = np.cumsum(np.diff(starts) + 1)  # with the end id of each document
                flat = np.empty(int(ends[-1]), "<u2")
                last = np.zeros(len(flat), bool)
                last[ends - 1] = True
                flat[last], flat[~last] = end_id, ids
                offsets = np.concatenate([[0], ends * 2]).astype(np.int32)
                own = pa.BinaryArray.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), own], names=["doc_id", "ids"])

    spark = docs.sparkSession
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    coded = stored(given.mapInArrow(tokenise, "doc_id long, ids binary"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS, np.int64)
        for batch in batches:
            for part in slices(batch, "ids", 1 << 24):
                column = part.column("ids")
                edges = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
                raw = np.frombuffer(column.buffers()[2], "<u2") if column.buffers()[2] else np.empty(0, "<u2")
                total += np.bincount(raw[edges[0] // 2 : edges[-1] // 2], minlength=SYMBOLS)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int64)), pa.array(total[found])], names=["id", "n"])

    counts = np.zeros(SYMBOLS, np.int64)
    for row in coded.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():  # a row for each id in use
        counts[row.id] = row.n
    lengths = code_lengths(counts)
    codes = canonical(lengths)
    buckets = max(1, -(-int(counts.sum()) // ids_per_bucket))
    cuts = coded.select(F.percentile_approx("doc_id", [k / buckets for k in range(1, buckets)], 10_000).alias("q")).first().q if buckets > 1 else []
    bounds = np.unique(np.array(cuts or [], np.int64))

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "ids"):
                rows = []
                for doc, raw in zip(part.column("doc_id").to_pylist(), part.column("ids").to_pylist()):
                    ids = np.frombuffer(raw, "<u2")
                    bits, marks = encode(ids, codes, lengths)
                    rows.append((-1 if doc is None else int(np.searchsorted(bounds, doc, side="right")), doc, len(ids), zlib.crc32(raw), bits, marks.tobytes()))
                yield pa.RecordBatch.from_pylist([dict(zip(("bucket", "doc_id", "n", "crc", "bits", "marks"), r)) for r in rows], pa.schema([("bucket", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int64()), ("crc", pa.int64()), ("bits", pa.binary()), ("marks", pa.binary())]))

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("payload", pa.binary())])
        rows: list[tuple] = []
        bucket, block, held = None, 0, 0

        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"bucket": bucket, "block": block, "n_docs": len(rows), "n_ids": held, "payload": _payload(rows)}], kind)

        for batch in batches:
            for b, doc, n, _, bits, marks in zip(*(c.to_pylist() for c in batch.columns)):
                if rows and (b != bucket or held >= ids_per_block):
                    yield closed()
                    rows, held, block = [], 0, block + 1 if b == bucket else 0
                bucket = b
                rows.append((doc, n, bits, marks))
                held += n
        if rows:
            yield closed()

    blocks = coded.mapInArrow(compress, "bucket int, doc_id long, n long, crc long, bits binary, marks binary").repartition(buckets, "bucket").sortWithinPartitions("bucket", F.col("doc_id").asc_nulls_first(), "n", "crc", "bits")
    blocks.mapInArrow(assemble, "bucket int, block long, n_docs long, n_ids long, payload binary").write.option("compression", "none").parquet(f"{folder}/blocks")
    spark.createDataFrame([(bytearray(lengths.tobytes()),)], "lengths binary").write.parquet(f"{folder}/code")


def read(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids): documents of the folder; ``ids`` are little-endian 32-bit, ``start`` counts all ids before.

    Without ``with_ids`` the ids are still decoded and summed up, but not handed on.
    """
    lengths = np.frombuffer(bytes(spark.read.parquet(f"{folder}/code").first().lengths), np.uint8)

    def restore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = decode_table(lengths)
        for batch in batches:
            for bucket, block, payload in zip(*(batch.column(c).to_pylist() for c in ("bucket", "block", "payload"))):
                docs, sizes, ids = unpack(payload, table)
                ends = np.cumsum(sizes)
                raw = [ids[a:b].astype("<u4").tobytes() for a, b in zip((ends - sizes).tolist(), ends.tolist())]
                n = len(docs)
                yield pa.RecordBatch.from_arrays([pa.array([bucket] * n, pa.int32()), pa.array([block] * n, pa.int64()), pa.array(docs, pa.int64()), pa.array(ends - sizes), pa.array(sizes), pa.array([zlib.crc32(x) for x in raw], pa.int64()), pa.array(raw if with_ids else [None] * n, pa.binary())], names=["bucket", "block", "doc_id", "before", "n_tokens", "ids_crc32", "ids"])

    blocks = spark.read.parquet(f"{folder}/blocks")
    sizes = blocks.select("bucket", "block", "n_ids")
    before = sizes.groupBy("bucket").agg(F.sum("n_ids").alias("n")).select(F.col("bucket").alias("of"), (F.sum("n").over(Window.orderBy("bucket")) - F.col("n")).alias("base"))  # one row per bucket
    inside = F.sum("n_ids").over(Window.partitionBy("bucket").orderBy("block")) - F.col("n_ids")
    places = sizes.withColumn("inside", inside).join(before, F.col("bucket") == F.col("of")).select("bucket", "block", (F.col("base") + F.col("inside")).alias("base"))
    rows = blocks.select("bucket", "block", "payload").mapInArrow(restore, "bucket int, block long, doc_id long, before long, n_tokens long, ids_crc32 long, ids binary")
    return rows.join(places, ["bucket", "block"]).select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", "ids")


def round_trip(docs: DataFrame, tokenizer: str, folder: str | None = None, with_ids: bool = True) -> DataFrame:
    """Write ``docs`` to a folder (one in the shared folder by default) and read it back."""
    folder = folder or f"{scratch(docs.sparkSession)}/{uuid.uuid4().hex}"
    write(docs, tokenizer, folder)
    return read(docs.sparkSession, folder, with_ids)
