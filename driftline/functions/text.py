"""Keys, hashes, dates and JSON checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def key_text(*cols: Column) -> Column:
    return F.concat_ws("/", *[c.cast("string") for c in cols])


def phases(items: Column) -> Column:
    return F.array_join(F.array_sort(items), "|")


def ids_to_text(ids: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(ids), lambda i: i.cast("string")), ";")


def text_to_ids(text: Column) -> Column:
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<int>")).otherwise(
        F.transform(F.split(text, ";"), lambda s: s.cast("int"))
    )


def is_sha256(c: Column) -> Column:
    return F.coalesce(c.rlike("^[0-9a-f]{64}$"), F.lit(False))


def sha256(c: Column) -> Column:
    return F.sha2(c, 256)


def tau_label(tau: Column) -> Column:
    return F.format_string("tau_%05d", F.round(tau * 100000).cast("long"))


def migrate_terms(text: Column, replacements: Mapping[str, str]) -> Column:
    """Ordered literal replacements in (nested JSON) text."""
    for old, new in replacements.items():
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def parse_utc(text: Column) -> Column:
    """ISO-8601 time with an explicit offset; anything else raises."""
    explicit = text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$")
    return F.when(explicit, F.to_timestamp(text)).otherwise(
        F.raise_error(F.concat(F.lit("timestamp without a UTC offset: "), F.coalesce(text, F.lit("null")))).cast("timestamp")
    )


def strictly_before(first: Column, second: Column) -> Column:
    return F.coalesce(first < second, F.lit(False))


def missing_keys(json_text: Column, required: Sequence[str]) -> Column:
    """Required top-level keys that a JSON object lacks."""
    have = F.coalesce(F.json_object_keys(json_text), F.array().cast("array<string>"))
    return F.array_except(F.array(*[F.lit(k) for k in required]), have)


def same_map_keys(left: Column, right: Column) -> Column:
    return F.array_sort(F.map_keys(left)) == F.array_sort(F.map_keys(right))


def draw32(*parts) -> Column:
    """Unsigned 32-bit draw from the md5 of pipe-joined parts; the same number in any SQL engine."""
    cols = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    text = F.concat_ws("|", *[c.cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def draw60(*parts) -> Column:
    """60-bit draw, wide enough to order a very large table."""
    cols = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    text = F.concat_ws("|", *[c.cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def hash_selected(seed: int, keys: Sequence[Column], modulus: int, threshold: int) -> Column:
    """SHA-256 sampling: the first eight bytes of the pipe-joined key, modulo ``modulus``, below ``threshold``."""
    text = F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys])
    digest = F.sha2(text, 256)
    high = F.conv(F.substring(digest, 1, 8), 16, 10).cast("decimal(20,0)")
    low = F.conv(F.substring(digest, 9, 8), 16, 10).cast("decimal(20,0)")
    step = F.lit(2**32 % modulus).cast("decimal(20,0)")
    remainder = ((high % modulus) * step + low % modulus) % F.lit(modulus)
    return remainder < threshold
