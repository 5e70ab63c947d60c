"""Hashes, bits, durations, buckets and ordinals as JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LEVELS = ("low", "medium", "high")


def stable_hash(*columns: Column) -> Column:
    """SHA-256 of the columns in the given order; nulls differ from empty strings."""
    return F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-")) for c in columns)), 256)


def short_key(*columns: Column) -> Column:
    return F.left(stable_hash(*columns), F.lit(24))


def group_key(ids: Column) -> Column:
    """One key for a set of ids, whatever their order."""
    return F.sha2(F.array_join(F.sort_array(ids), "|"), 256)


def sign_bits(vector: Column) -> Column:
    """Signs of the first 64 components as the bits of a long: first component highest."""
    bits = F.transform(F.slice(vector, 1, 64), lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), F.lit(63) - i)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))


def hex_bits(c: Column) -> Column:
    """Sixteen hexadecimal digits as a long; null if they are not."""
    ok = F.lower(c).rlike("^[0-9a-f]{16}$")
    half = lambda a: F.conv(F.substr(c, F.lit(a), F.lit(8)), 16, 10).cast("long")
    return F.when(ok, F.call_function("shiftleft", half(1), F.lit(32)).bitwiseOR(half(9)))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two longs; 999 where either is missing."""
    return F.coalesce(F.bit_count(a.bitwiseXOR(b)).cast("int"), F.lit(999))


def duration_seconds(start: Column, end: Column, stated: Column | None = None) -> Column:
    between = (F.unix_micros(end) - F.unix_micros(start)) / 1e6
    return between if stated is None else F.coalesce(stated.cast("double"), between)


def duration_text(seconds: Column) -> Column:
    s = F.round(seconds).cast("long")
    h, m, r = F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60), F.pmod(s, F.lit(60))
    return (
        F.when(seconds.isNull(), F.lit("-"))
        .when(h > 0, F.concat(h.cast("string"), F.lit("h "), m.cast("string"), F.lit("m "), r.cast("string"), F.lit("s")))
        .when(m > 0, F.concat(m.cast("string"), F.lit("m "), r.cast("string"), F.lit("s")))
        .otherwise(F.concat(r.cast("string"), F.lit("s")))
    )


def parsed_time(c: Column, zone: str = "Asia/Shanghai") -> Column:
    """ISO-8601 text as an instant; text without a zone is read in ``zone``; null if it is no time."""
    zoned = c.rlike(r"(Z|[+-]\d\d:?\d\d)$")
    plain = F.to_utc_timestamp(F.try_to_timestamp(F.concat(F.regexp_replace(c, "Z$", ""), F.lit("Z"))), zone)
    return F.when(zoned, F.try_to_timestamp(c)).otherwise(plain)


def confidence_bucket(c: Column) -> Column:
    return F.when(c >= 0.85, ">=0.85").when(c >= 0.65, "0.65-0.85").when(c > 0, "0-0.65").otherwise("missing")


def duration_bucket(c: Column) -> Column:
    """Upper bounds belong to their bucket."""
    return F.when(c <= 90, "<=90s").when(c <= 180, "90-180s").when(c <= 300, "180-300s").when(c.isNotNull(), ">300s")


def level_rank(c: Column) -> Column:
    """low, medium, high as 0, 1, 2; anything else as medium."""
    return F.when(c == "low", 0).when(c == "high", 2).otherwise(1)


def higher_level(a: Column, b: Column) -> Column:
    """The higher level; the left one if they rank alike."""
    return F.when(level_rank(b) > level_rank(a), b).otherwise(a)


def first_set(*columns: Column) -> Column:
    """First column that is neither null nor zero."""
    return F.coalesce(*(F.nullif(c, F.lit(0)) for c in columns), F.lit(0))


def percent_text(part: Column, whole: Column) -> Column:
    return F.format_string("%.2f%%", F.when(whole > 0, part * 100.0 / whole).otherwise(F.lit(0.0)))


def average_hash(pixels: Column) -> Column:
    """Sixteen hexadecimal digits for the 64 grey values of an 8 x 8 picture: a bit is 1 where the value is at least the mean; empty if there are not 64.

    Null values have no share in the mean, and their bits are 0.
    """
    known = F.array_compact(pixels)
    mean = F.try_divide(F.aggregate(known, F.lit(0.0), lambda a, x: a + x), F.size(known))
    half = lambda first: F.aggregate(F.slice(pixels, first, 32), F.lit(0).cast("long"), lambda a, x: a * 2 + F.coalesce(x >= mean, F.lit(False)).cast("long"))
    return F.when(F.size(pixels) == 64, F.lower(F.concat(*(F.lpad(F.hex(half(f)), 8, "0") for f in (1, 33))))).otherwise("")


def image_ids(content: Column) -> Column:
    """(sha256, canonical_image_id) of the bytes of a picture."""
    digest = F.sha2(content, 256)
    return F.struct(digest.alias("sha256"), F.concat(F.lit("sha256:"), digest).alias("canonical_image_id"))
