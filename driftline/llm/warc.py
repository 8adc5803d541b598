"""Web archives: writing records with revisits, and reading them back by a verified chain of record boundaries.

``write`` makes plain WARC 1.0 text files through Spark's own text writer, so any store that Spark writes to will do and a
lost task leaves nothing behind. Of pages with equal payloads (SHA-1 and length) of ``least`` bytes or more the one with the
largest id is a response and the others are revisits that name it; shorter payloads are always responses.

``read`` lets Spark split the files at every occurrence of the record magic, inside payloads too, so files of any size are
read by many tasks. Each piece after a magic is a candidate record; its header, if it has one, names the offset of its
successor. Tasks follow the chains inside their own split, so only (entry, exit) of a split remain, and pointer jumping
joins these over the file: from the file's start only reachable records are kept, a magic inside a payload is never one.
Payloads that were cut at a magic inside are put together again.

Null html counts as an empty payload, null urls as empty; a null page id is written as an empty one and comes back as null;
it does not refer or get referred to by id unless no id is known in its group. Repeated rows are records of their own. An empty
table gives empty archives and an empty result. Further columns are ignored.
"""

from __future__ import annotations

import uuid
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import scratch, stored

MAGIC = "WARC/1.0\r\n"
END = "\r\n\r\n"
SALTS = 16


def _may_repeat(groups: DataFrame, bits: int):
    """A test on a hash of (digest, bytes): false for payloads that ``groups`` (mark) lacks, from a bitmap of 2^``bits`` bits."""
    size = F.lit((1 << bits) - 1).cast("long")
    at = F.col("mark").bitwiseAND(size)
    cells = groups.select(F.shiftright(at, 6).alias("cell"), F.expr("shiftleft(1L, cast(mark & 63 as int))").alias("bit")).groupBy("cell").agg(F.bit_or("bit").alias("x")).toArrow()
    bitmap = np.zeros(1 << (bits - 6), np.uint64)
    bitmap[cells.column("cell").to_numpy()] = cells.column("x").to_numpy().view(np.uint64)
    held = groups.sparkSession.sparkContext.broadcast(bitmap)

    @F.pandas_udf("boolean")
    def test(mark: pd.Series) -> pd.Series:
        h = mark.to_numpy().view(np.uint64) & np.uint64((1 << bits) - 1)
        return pd.Series((held.value[(h >> np.uint64(6)).view(np.int64)] >> (h & np.uint64(63))) & np.uint64(1) == 1)

    return test


def records(pages: DataFrame, least: int = 1000, bits: int = 24) -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to).

    Most payloads occur once. A bitmap of fixed size tells which may not; all others pass straight through, so only payloads
    that repeat (and a few that share a bit with one) are moved to find their groups.
    """
    given = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"))
    key = ["payload_digest", "payload_bytes"]
    summed = given.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha1(F.col("payload").cast("binary"))}).withColumn("mark", F.xxhash64(*key))
    # a row for each payload that occurs more than once; copied over the salts, since one payload may have a third of the pages
    groups = stored(summed.filter(F.col("payload_bytes") >= least).groupBy(*key, "mark").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).filter("n > 1"))
    salted = groups.select(*key, "keeper", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    tested = summed.withColumn("again", _may_repeat(groups, bits)("mark"))
    many = tested.filter("again").withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")).join(salted, [*key, "salt"], "left")
    names = ["page_id", "url", "payload", *key[::-1]]
    revisit = F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    many = many.select(*names, F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("keeper")).alias("refers_to"))
    once = tested.filter("not again").select(*names, F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    return once.unionByName(many)


def write(pages: DataFrame, folder: str, least: int = 1000) -> None:
    """WARC files of all pages. A revisit has no body; its header has the digest and length of the payload it stands for."""
    found = records(pages, least)
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise("")
    clean = F.regexp_replace("url", r"[\x00-\x20\x7f]", "")
    named = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    number = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    header = F.concat(
        F.lit(MAGIC), named("WARC-Type", F.col("record_type")), named("WARC-Record-ID", F.concat(F.lit("<urn:page:"), number("page_id"), F.lit(">"))), named("WARC-Target-URI", clean),
        named("WARC-Date", F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")), named("Content-Type", F.lit("text/html; charset=utf-8")),
        F.when(F.col("record_type") == "revisit", named("WARC-Profile", F.lit("http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"))).otherwise(""),
        named("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))), named("X-Payload-Length", number("payload_bytes")),
        F.when(F.col("record_type") == "revisit", named("WARC-Refers-To", F.concat(F.lit("<urn:page:"), number("refers_to"), F.lit(">")))).otherwise(""),
        named("Content-Length", F.octet_length(body).cast("string")), F.lit("\r\n"),
    )
    found.select(F.concat(header, body).alias("value")).write.option("lineSep", END).text(folder)


def _fields(piece: Column, header: Column, length: Column) -> Column:
    """What a whole record says: struct<page_id, url, record_type, refers_to, named, said, digest, bytes>."""
    head = F.substring_index(piece, END, 1)
    value = lambda name: F.regexp_extract(head, rf"(?:^|\r\n){name}: ([^\r\n]*)", 1)
    number = lambda text: F.regexp_extract(text, r"(-?[0-9]+)", 1).try_cast("long")
    body = _body(piece, header, length)
    parts = {"page_id": number(value("WARC-Record-ID")), "url": value("WARC-Target-URI"), "record_type": value("WARC-Type"), "refers_to": number(value("WARC-Refers-To"))}
    parts |= {"named": F.regexp_extract(value("WARC-Payload-Digest"), "sha1:(.*)", 1), "said": number(value("X-Payload-Length")), "digest": F.sha1(body), "bytes": F.octet_length(body).cast("long")}
    return F.struct(*[c.alias(name) for name, c in parts.items()])


def _body(piece: Column, header: Column, length: Column) -> Column:
    return F.substring(piece.cast("binary"), header + 1, length.cast("int"))


def candidates(spark: SparkSession, paths: str | list[str], with_text: bool) -> DataFrame:
    """A row per piece between magics: (file, split, size, offset, next, header, length, fields), and ``piece`` if asked for.

    ``offset`` is that of the magic before the piece; ``next`` is where the record that begins there says that its successor
    begins, null if the piece is no record. ``fields`` hold for records that lie in one piece.
    """
    text = spark.read.option("lineSep", MAGIC).text(paths)
    pieces = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("seq"), F.col("value").alias("piece"))
    head, piece = F.substring_index("piece", END, 1), F.col("piece")
    length = F.when(F.locate(END, piece) > 0, F.regexp_extract(head, r"(?:^|\r\n)Content-Length: ([0-9]{1,15})(?:\r\n|$)", 1)).otherwise("")
    pieces = pieces.withColumns({"size": F.octet_length("piece").cast("long") + len(MAGIC), "header": F.octet_length(head) + len(END), "length": F.when(length != "", length.cast("long"))})
    pieces = pieces.withColumn("fields", F.when(F.col("length").isNotNull(), _fields(piece, F.col("header"), F.col("length"))))
    pieces = stored(pieces if with_text else pieces.drop("piece"))
    totals = pieces.groupBy("file", "split").agg(F.sum("size").alias("n"))  # a row for each split
    base = totals.select(F.col("file").alias("f"), F.col("split").alias("s"), (F.sum("n").over(Window.partitionBy("file").orderBy("split")) - F.col("n")).alias("base"))
    inside = F.sum("size").over(Window.partitionBy("file", "split").orderBy("seq")) - F.col("size")
    placed = pieces.withColumn("inside", inside).join(base, (F.col("file") == F.col("f")) & (F.col("split") == F.col("s")))
    placed = placed.withColumn("offset", F.col("base") + F.col("inside") - len(MAGIC)).drop("f", "s", "base", "inside", "seq")
    return stored(placed.withColumn("next", F.col("offset") + len(MAGIC) + F.col("header") + F.col("length") + len(END)))


def _follow(offsets: np.ndarray, nexts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each candidate of a split: index of its successor in the split (-1: none), and where its chain leaves the split."""
    at = np.searchsorted(offsets, nexts)
    inside = (at < len(offsets)) & (offsets[np.minimum(at, len(offsets) - 1)] == nexts)
    to = np.where(inside, at, -1)
    leaves = nexts.copy()
    for k in range(len(offsets) - 1, -1, -1):
        if to[k] >= 0:
            leaves[k] = leaves[to[k]]
    return to, leaves


def reachable(light: DataFrame) -> DataFrame:
    """(file, offset) of the records on the chain from each file's start."""

    def chains(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("offset")
        _, leaves = _follow(rows.offset.to_numpy(), rows.next.to_numpy())
        return pd.DataFrame({"file": rows.file, "offset": rows.offset, "jump": leaves})

    found = light.filter("next is not null")
    # entry -> exit of its split; squared until no chain grows: the number of rounds is the logarithm of a file's splits
    jumps = stored(found.select("file", "split", "offset", "next").groupBy("file", "split").applyInPandas(chains, "file string, offset long, jump long"))
    entries = stored(jumps.filter("offset = 0").select("file", "offset"))
    several = not light.groupBy("file").agg(F.count_distinct("split").alias("n")).filter("n > 1").isEmpty()
    while several:
        far = jumps.select(F.col("file").alias("f"), F.col("offset").alias("o"), F.col("jump").alias("far"))
        step = entries.hint("merge").join(jumps, ["file", "offset"]).select("file", F.col("jump").alias("offset"))
        more = stored(step.hint("merge").join(jumps.select("file", "offset"), ["file", "offset"], "left_semi").union(entries).distinct())
        squared = stored(jumps.hint("merge").join(far, (F.col("file") == F.col("f")) & (F.col("jump") == F.col("o")), "left").select("file", "offset", F.coalesce("far", "jump").alias("jump")))
        if more.count() == entries.count():
            break
        entries, jumps = more, squared

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("offset")
        to, _ = _follow(rows.offset.to_numpy(), rows.next.to_numpy())
        on = rows.entry.to_numpy().copy()
        for k in range(len(on)):
            if on[k] and to[k] >= 0:
                on[to[k]] = True
        return pd.DataFrame({"file": rows.file[on], "offset": rows.offset[on]})

    marked = found.select("file", "split", "offset", "next").hint("merge").join(entries.withColumn("entry", F.lit(True)), ["file", "offset"], "left").select("file", "split", "offset", "next", F.coalesce("entry", F.lit(False)).alias("entry"))
    return marked.groupBy("file", "split").applyInPandas(walk, "file string, offset long")


def read(spark: SparkSession, folder: str, payload: bool = True) -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to) of all records; a revisit has a null payload.

    Without ``payload`` that column is left out, and only files in which a magic cuts a record are read again. Sizes and
    digests of responses are those of the bytes read; a record whose digest header differs raises an error.
    """
    rows = candidates(spark, folder, payload)
    kept = stored(reachable(rows).hint("merge").join(rows, ["file", "offset"]))  # offsets grow with the pages: never broadcast
    cut = F.col("next") > F.col("offset") + F.col("size")
    text = [F.when(F.col("fields.record_type") == "response", _body(F.col("piece"), F.col("header"), F.col("length")).cast("string")).alias("payload")] if payload else []
    found = kept.filter(~cut).select("fields", *text)
    broken = kept.filter(cut).select("file", F.col("offset").alias("start"), F.col("next").alias("stop"), F.col("header").alias("h"), F.col("length").alias("l"))
    files = [r.file for r in broken.select("file").distinct().collect()]  # a row for each archive with such a record
    if files:
        parts = rows if payload else candidates(spark, files, True)
        parts = broken.join(parts.select("file", "offset", "piece"), "file").filter("offset >= start AND offset < stop")
        whole = parts.groupBy("file", "start", "h", "l").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("offset", "piece"))), lambda x: x["piece"]), MAGIC).alias("piece"))
        whole = whole.select("piece", F.col("h").alias("header"), F.col("l").alias("length")).withColumn("fields", _fields(F.col("piece"), F.col("header"), F.col("length")))
        found = found.unionByName(whole.select("fields", *text))
    response = F.col("record_type") == "response"
    differs = F.raise_error(F.concat(F.lit("payload differs from its digest: "), F.col("url"))).cast("string")
    digest = F.when(~response, F.col("named")).when(F.col("digest") == F.col("named"), F.col("digest")).otherwise(differs)
    names = ["page_id", "url", *(["payload"] if payload else [])]
    return found.select("fields.*", *(["payload"] if payload else [])).select(*names, F.when(response, F.col("bytes")).otherwise(F.col("said")).alias("payload_bytes"), digest.alias("payload_digest"), "record_type", "refers_to")


def round_trip(pages: DataFrame, folder: str | None = None, least: int = 1000, payload: bool = True) -> DataFrame:
    folder = folder or f"{scratch(pages.sparkSession)}/{uuid.uuid4().hex}"
    write(pages, folder, least)
    return read(pages.sparkSession, folder, payload)
