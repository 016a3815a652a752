"""Column functions on strings, numbers, hashes and JSON."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

#: RFC 4122 namespace for URLs.
NAMESPACE_URL = "6ba7b8119dad11d180b400c04fd430c8"


def rounded(x: Column | str, digits: int) -> Column:
    """A double rounded half up in magnitude, as Spark's `round` does; what becomes zero keeps its sign, as in IEEE arithmetic and SQL engines that follow it."""
    x = F.col(x) if isinstance(x, str) else x
    return F.when(F.abs(x) < float(f"5e-{digits + 1}"), x * 0.0).otherwise(F.round(x, digits))


def sha_seed(*parts: Column) -> Column:
    """An unsigned 64-bit seed, the first 8 bytes of SHA-256 of the parts joined by a colon."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", *(p.cast("string") for p in parts)), 256), 1, 16), 16, 10).cast("decimal(20,0)")


def ranked_seed(base: Column, rank: Column, workers: int) -> Column:
    """base + rank * workers, modulo 2**64."""
    return F.pmod(base.cast("decimal(38,0)") + rank.cast("decimal(20,0)") * workers, F.lit(str(2**64)).cast("decimal(38,0)")).cast("decimal(20,0)")


def unit_draw(*parts: Column) -> Column:
    """A number in [0, 1) that only the parts decide: 52 bits of SHA-256."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", *(p.cast("string") for p in parts)), 256), 1, 13), 16, 10).cast("double") / float(2**52)


def uuid5(name: Column, namespace: str = NAMESPACE_URL) -> Column:
    """Name-based UUID, version 5, of a binary or string column."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), name.cast("binary")))
    variant = F.lower(F.conv((F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3) + 8).cast("string"), 10, 16))
    return F.concat_ws(
        "-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)),
        F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12),
    )


def framed(value: Column) -> Column:
    """A value behind its length in 8 big-endian bytes, so that no two lists of values join alike."""
    data = value.cast("string").cast("binary")
    return F.concat(F.unhex(F.lpad(F.hex(F.octet_length(data)), 16, "0")), data)


def framed_digest(*values: Column) -> Column:
    return F.sha2(F.concat(*(framed(v) for v in values)), 256)


def request_digest(request: dict) -> str:
    """SHA-256 of canonical JSON, for the names of cached subsets."""
    import hashlib

    return hashlib.sha256(json.dumps(request, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def normal_label(x: Column) -> Column:
    """Lower case, letters and numbers only."""
    return F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}]", "")


def number_group(name: Column) -> Column:
    """Digits with the separators around them as one #."""
    return F.regexp_replace(name, r"[\s_.-]*\d+[\s_.-]*", "#")


def common_prefix(a: Column, b: Column) -> Column:
    n = F.least(F.length(a), F.length(b))
    at = F.aggregate(
        F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0),
        lambda k, i: F.when((k == i - 1) & (i <= n) & (F.substr(a, i, F.lit(1)) == F.substr(b, i, F.lit(1))), i).otherwise(k),
    )
    return F.substr(a, F.lit(1), at)


def decibels(power: Column, floor: float = 1e-8) -> Column:
    return 10 * F.log10(F.greatest(power, F.lit(floor)))


def midi_pitch(hz: Column, low: float = 8.0) -> Column:
    return 69 + 12 * F.log2(F.greatest(hz, F.lit(low)) / 440.0)


def frame_count(samples: Column, hop: int) -> Column:
    return F.lit(1) + F.floor(samples / hop).cast("long")


def scaled(x: Column, low: Column | float, high: Column | float) -> Column:
    """To [0, 1] from [low, high]; 0 for an empty range."""
    low, high = (F.lit(v) if isinstance(v, (int, float)) else v for v in (low, high))
    return F.coalesce(F.try_divide(x - low, high - low), F.lit(0.0))


def unscaled(u: Column, low: Column | float, high: Column | float) -> Column:
    low, high = (F.lit(v) if isinstance(v, (int, float)) else v for v in (low, high))
    return low + F.least(F.greatest(u, F.lit(0.0)), F.lit(1.0)) * (high - low)


def one_hot(x: Column, low: int, high: int) -> Column:
    return F.transform(F.sequence(F.lit(low), F.lit(high)), lambda i: (i == x).cast("double"))


def arg_max(v: Column) -> Column:
    """Position of the largest component, the first of equals, from 0."""
    return F.array_position(v, F.array_max(v)) - 1


def nearest(x: Column, values: Column) -> Column:
    """Position from 0 of the value nearest to x, the lowest of equals."""
    return F.array_min(F.transform(values, lambda v, i: F.struct(F.abs(v - x).alias("d"), i.alias("i"))))["i"]


def utc_run_id(config: Column, ts: Column) -> Column:
    return F.concat_ws("-", config, F.date_format(ts, "yyyyMMdd'T'HHmmssSSS'Z'"))


def utc_only(text: Column) -> Column:
    """A timestamp of ISO text that ends in Z or +00:00; null for other offsets, none, or no timestamp."""
    return F.when(text.rlike(r"(Z|\+00:00)$"), F.try_to_timestamp(F.regexp_replace(text, r"(Z|\+00:00)$", ""), F.lit("yyyy-MM-dd'T'HH:mm:ss")))


def last_number(text: Column, key: str) -> Column:
    """The last number that follows `key` and a colon or equals sign."""
    found = F.regexp_extract_all(text, F.lit(rf"{key}\s*[:=]\s*(-?[0-9]+(?:\.[0-9]+)?)"), F.lit(1))
    return F.try_element_at(found, F.lit(-1)).try_cast("double")
