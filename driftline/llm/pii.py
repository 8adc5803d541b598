"""Personal data: rules, and a character-level bidirectional LSTM with CRF transitions that adds what rules miss.

The rules find emails, addresses, cards and phones of exact form. The tagger learns from their spans in a bounded sample of
texts (``fit_texts``, ``fit_windows``): spans as they are, spans rewritten in looser forms (spaces, other separators, no
plus), and numbers that are none of them. It then reads overlapping windows of 64 characters around every digit and every
@ of every text; outside of these no span of the four kinds can lie. Each character takes its tag from the window in whose
middle it lies best, so spans are reconciled over the whole text. A decoded span is added if it touches no rule's span and
its digits fit the kind (Luhn for cards, parts up to 255 for addresses, 8 to 15 digits for phones). Rule spans stay.

Null and empty texts have no spans. Rows are read one by one, so repeats and null ids are kept. Where the sample has no
spans at all the tagger adds nothing. An empty table gives an empty result. Further columns are kept or ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name
from .tagger import LENGTH, Tagger, classes

KINDS = ("email", "ip", "card", "phone")
_HOST = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SIGN = re.compile(r"[0-9@]")
MARGIN, STRIDE = 24, 32
Span = tuple[int, int, int]  # kind, from, to


def digits(text: str) -> str:
    return re.sub(r"[^0-9]", "", text)


def luhn(number: str) -> bool:
    total = sum(int(c) if k % 2 == 0 else (2 * int(c) - 9 if c > "4" else 2 * int(c)) for k, c in enumerate(reversed(number)))
    return total % 10 == 0


def _emails(text: str) -> list[Span]:
    """Leftmost matches, found from the @ signs, so long runs without one cost nothing."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and (text[begin - 1].isascii() and text[begin - 1].isalnum() or text[begin - 1] in "._%+-"):
            begin -= 1
        host = _HOST.match(text, at + 1)
        if begin < at and host:
            out.append((0, begin, host.end()))
            done = host.end()
        at = text.find("@", max(at + 1, done))
    return out


def rules(text: str | None) -> list[Span]:
    """Spans of the exact forms, by kind and place."""
    text = text or ""
    out = _emails(text)
    if _SIGN.search(text):
        out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        out += [(2, m.start(), m.end()) for m in _CARD.finditer(text) if m.end() - m.start() <= 40 and 16 <= len(n := digits(m[0])) <= 19 and luhn(n)]
        out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(digits(m[0])) <= 15]
    return out


def fits(kind: int, text: str) -> bool:
    """Whether a decoded span can be of its kind."""
    n = digits(text)
    if kind == 0:
        return "@" in text and "." in text.split("@")[-1] and len(text) >= 6 and len(text) <= 100
    if kind == 1:
        parts = re.findall(r"[0-9]+", text)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    return 16 <= len(n) <= 19 and luhn(n) if kind == 2 else 8 <= len(n) <= 15 and not re.search(r"[A-Za-z]", text)


def tags_of(size: int, spans: list[Span]) -> np.ndarray:
    """0 outside, 1 + 2k at the begin of kind k, 2 + 2k inside."""
    out = np.zeros(size, np.int8)
    for kind, a, b in spans:
        out[a:b] = 2 + 2 * kind
        out[a] = 1 + 2 * kind
    return out


def _loosened(kind: int, text: str, pick) -> str:
    """A looser form of a span."""
    if kind == 0:
        return text.replace("@", pick((" @ ", "@ ", " @", "@"))).replace(".", pick((".", ".", " . ")))
    if kind == 1:
        return text.replace(".", pick((" . ", "-", ". ", "_")))
    if kind == 2:
        n, sign = digits(text), pick((".", "/", "_", " - "))
        return sign.join(n[k : k + 4] for k in range(0, len(n), 4))
    n = digits(text)[-10:]
    return pick((f"({n[:3]}) {n[3:6]}-{n[6:]}", f"{n[:3]}-{n[3:6]}-{n[6:]}", f"{n[:3]}/{n[3:]}", f"00{n}"))


def _harmless(pick, number) -> str:
    """Numbers that are no personal data."""
    return pick((f"20{number(10, 30)}-0{number(1, 9)}-{number(10, 28)}", f"v{number(0, 20)}.{number(0, 40)}.{number(0, 40)}", f"{number(10, 23)}:{number(10, 59)}:{number(10, 59)}", f"{number(1, 999)},{number(100, 999)}.{number(10, 99)}", f"{number(10**17, 10**18):x}", f"#{number(1, 99999)}", f"id={number(10**4, 10**7)}", f"{number(1, 400)} x {number(1, 400)}"))


def examples(text: str) -> list[tuple[bytes, bytes]]:
    """Windows (classes, tags) of a text: its spans in their own, looser and harmless forms, and its other numbers."""
    spans = rules(text)
    tags = tags_of(len(text), spans)
    rng = np.random.default_rng(zlib.crc32(text.encode("utf-8", "replace")))
    pick, number = (lambda x: x[int(rng.integers(len(x)))]), (lambda a, b: int(rng.integers(a, b)))
    out = []

    def add(left: str, middle: str, right: str, tag: np.ndarray) -> None:
        x, y = np.zeros(LENGTH, np.int8), np.zeros(LENGTH, np.int8)
        own = classes(left + middle + right)[:LENGTH]
        x[: len(own)], y[: len(own)] = own, tag[: len(own)]
        out.append((x.tobytes(), y.tobytes()))

    for kind, a, b in spans:
        before = number(0, 30)
        left, right = text[max(0, a - before) : a], text[b : b + LENGTH]
        for form in (text[a:b], _loosened(kind, text[a:b], pick), None):
            middle = _harmless(pick, number) if form is None else form
            inner = tags_of(len(middle), [] if form is None else [(kind, 0, len(middle))])
            add(left, middle, right, np.concatenate([tags[max(0, a - before) : a], inner, tags[b : b + LENGTH]]))
    other = [m.start() for m in _SIGN.finditer(text) if tags[m.start()] == 0]
    for at in other[:: max(1, len(other) // 4)]:
        a = max(0, at - number(0, 40))
        add("", text[a : a + LENGTH], "", tags[a : a + LENGTH])
    return out


def fit(docs: DataFrame, fit_texts: int = 3_000, fit_windows: int = 2_500, **settings) -> Tagger | None:
    """The tagger, trained on the driver from at most ``fit_windows`` windows of about ``fit_texts`` texts."""
    text = F.col("text").cast("string")
    numbers = docs.filter(text.rlike("[0-9@]")).select(text.alias("text"))
    many = numbers.count()
    if not many:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column("text").to_pylist():
                found = examples(text)
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.binary()), pa.array([y for _, y in found], pa.binary())], names=["x", "y"])

    some = numbers.filter(F.pmod(F.xxhash64("text"), F.lit(1_000_003)) < fit_texts / many * 1_000_003)
    rows = some.mapInArrow(run, "x binary, y binary").dropDuplicates(["x"]).orderBy(F.xxhash64("x"), "x").limit(fit_windows).collect()
    if not rows:
        return None
    x = np.frombuffer(b"".join(bytes(r.x) for r in rows), np.int8).reshape(-1, LENGTH)
    y = np.frombuffer(b"".join(bytes(r.y) for r in rows), np.int8).reshape(-1, LENGTH)
    if not y.any():
        return None
    tagger = Tagger(1 + 2 * len(KINDS))
    tagger.fit(x, y, **settings)
    return tagger


def windows(text: str) -> np.ndarray:
    """Begins of the windows that cover every digit and @ with a margin."""
    places = np.array([m.start() for m in _SIGN.finditer(text)], np.int64)
    if not len(places):
        return places
    breaks = np.flatnonzero(np.diff(places) > 2 * MARGIN)
    first, last = places[np.concatenate([[0], breaks + 1])] - MARGIN, places[np.concatenate([breaks, [len(places) - 1]])] + MARGIN
    return np.concatenate([np.arange(max(0, a), max(a + 1, b - LENGTH + STRIDE), STRIDE) for a, b in zip(first.tolist(), last.tolist())])


def reconciled(text: str, begins: np.ndarray, tags: np.ndarray) -> list[Span]:
    """Spans from the tags of overlapping windows: a character's tag is that of the window where it lies nearest the middle."""
    at = begins[:, None] + np.arange(LENGTH)
    depth = np.broadcast_to(np.minimum(np.arange(LENGTH), LENGTH - 1 - np.arange(LENGTH)), at.shape)
    inside = (at < len(text)).ravel()
    place, tag = at.ravel()[inside], tags.ravel()[inside]
    order = np.lexsort((depth.ravel()[inside], place))
    place, tag = place[order], tag[order]
    best = np.append(place[1:] != place[:-1], True)
    place, tag = place[best], tag[best]
    out, open_at = [], None
    for p, t in zip(place.tolist() + [-9], tag.tolist() + [0]):
        if open_at is not None and (t == 0 or t % 2 == 1 or p != last + 1 or (t - 1) // 2 != kind):
            out.append((kind, open_at, last + 1))
            open_at = None
        if t and open_at is None:
            kind, open_at = (t - 1) // 2, p
        last = p
    trimmed = []
    for kind, a, b in out:
        raw = text[a:b]
        a, b = a + len(raw) - len(raw.lstrip(" \n\t,;:")), b - (len(raw) - len(raw.rstrip(" \n\t,;:.")))
        if a < b:
            trimmed.append((kind, a, b))
    return trimmed


def added(texts: list[str], found: list[list[Span]], tagger: Tagger | None) -> list[list[Span]]:
    """Spans that the tagger adds to those of the rules, for several texts at once."""
    if tagger is None:
        return [[] for _ in texts]
    begins = [windows(t) for t in texts]
    out: list[list[Span]] = []
    for at in range(0, len(texts), 64):
        part = range(at, min(at + 64, len(texts)))
        x = np.zeros((sum(len(begins[k]) for k in part), LENGTH), np.int8)
        row = 0
        for k in part:
            for a in begins[k].tolist():
                own = classes(texts[k][a : a + LENGTH])
                x[row, : len(own)] = own
                row += 1
        tags, row = tagger.decode(x), 0
        for k in part:
            n, own = len(begins[k]), []
            if n:
                for kind, a, b in reconciled(texts[k], begins[k], tags[row : row + n]):
                    if fits(kind, texts[k][a:b]) and all(b <= s or a >= e for _, s, e in found[k]):
                        own.append((kind, a, b))
            out.append(own)
            row += n
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def masked(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind; spans that overlap become one."""
    out, done = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= done:
            out += [text[done:a], f"<{KINDS[kind].upper()}>"]
        done = max(done, b)
    return "".join(out) + text[done:]


def spotted(docs: DataFrame, tagger: Tagger | None, text: str = "text", mask: bool = False) -> Column:
    """Column struct<base, spans, counts, n_added, masked>; null for texts without a digit or @, which have no spans."""
    shared = docs.sparkSession.sparkContext.broadcast(tagger)

    @F.pandas_udf("struct<n: array<bigint>, base: string, spans: string, n_added: bigint, masked: string>")
    def spot(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for batch in batches:
            texts = ["" if t is None else t for t in batch]
            found = [rules(t) for t in texts]
            more = added(texts, found, model)
            yield pd.DataFrame({
                "n": [[sum(k == kind for k, _, _ in f) for kind in range(len(KINDS))] for f in found], "base": [joined(f) for f in found],
                "spans": [joined(f + m) for f, m in zip(found, more)], "n_added": [len(m) for m in more],
                "masked": [masked(t, f + m) if mask and (f or m) else None for t, f, m in zip(texts, found, more)],
            })

    column = F.col(text).cast("string")
    return spot(F.when(column.rlike("[0-9@]"), column))


def report(docs: DataFrame, tagger: Tagger | None) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added); counts and digest are those of the rules."""
    found = docs.select("doc_id", spotted(docs, tagger).alias("s"))
    return found.select("doc_id", *[F.col("s.n")[k].alias(f"n_{kind}") for k, kind in enumerate(KINDS)], F.sha2(F.col("s.base").cast("binary"), 256).alias("base_sha256"), F.col("s.spans").alias("spans"), F.col("s.n_added").alias("n_added"))


def redact(docs: DataFrame, tagger: Tagger | None) -> DataFrame:
    """``docs`` with every span of its text replaced by the kind; ``n_chars``, if there, follows."""
    name = free_name(docs, "spotted")
    new = F.col(name)["masked"]
    out = docs.withColumn(name, spotted(docs, tagger, mask=True))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(new.isNotNull(), F.length(new).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.withColumn("text", F.coalesce(new, F.col("text"))).drop(name)
