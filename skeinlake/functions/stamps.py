"""Capture and page time stamps and digests as column expressions. Session time zone: UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RFC3339 = r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}[Tt ][0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]{1,9})?([Zz]|[+-]([01][0-9]|2[0-3]):[0-5][0-9])\z"
COMPATIBLE = r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}([Tt ][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]{1,9})?)?)?\z"


def _instant(text: Column) -> tuple[Column, Column]:
    """(no leap second, text with at most six digits of fraction)."""
    return ~text.rlike(r":60([.Zz+-]|\z)"), F.regexp_replace(F.upper(text), r"(\.[0-9]{6})[0-9]+", "$1")


def parse_rfc3339(text: Column) -> Column:
    """Timestamp of strict RFC 3339 text, else null."""
    ok, cut = _instant(text)
    return F.when(text.rlike(RFC3339) & ok, F.try_to_timestamp(cut))


def parse_compatible(text: Column) -> Column:
    """As parse_rfc3339, and text without a zone, seconds or a time of day, all read as UTC."""
    ok, cut = _instant(text)
    return F.coalesce(parse_rfc3339(text), F.when(text.rlike(COMPATIBLE) & ok, F.try_to_timestamp(cut)))


def cdx_timestamp(ts: Column) -> Column:
    """17 digits, cut to milliseconds."""
    return F.date_format(F.date_trunc("MILLISECOND", ts), "yyyyMMddHHmmssSSS")


def parse_cdx(ts_raw: Column) -> Column:
    """Timestamp of 14 or 17 digits, else null."""
    spaced = F.regexp_replace(ts_raw, r"^(\d{4})(\d{2})(\d{2})(\d{2})(\d{2})(\d{2})(\d{3})?$", "$1-$2-$3 $4:$5:$6.$7")
    return F.when(ts_raw.rlike(r"\A[0-9]{14}([0-9]{3})?\z"), F.try_to_timestamp(F.regexp_replace(spaced, r"\.$", "")))


def render_rfc3339(ts: Column) -> Column:
    """UTC with ``Z`` and without trailing zeros of the fraction."""
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.regexp_replace(F.date_format(ts, ".SSSSSS"), r"\.?0+$", ""), F.lit("Z"))


def same_precision(ts_raw: Column, record_ts: Column) -> Column:
    """Does a capture's time equal a record's at the capture's own precision?"""
    unit = F.when(F.length(ts_raw) == 17, F.date_trunc("MILLISECOND", record_ts)).otherwise(F.date_trunc("SECOND", record_ts))
    return parse_cdx(ts_raw) == unit


def sha256_label(content: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(content, 256))


def canonical_sha256(text: Column) -> Column:
    """Lower-case ``sha256:`` digest; null for other labels, encodings or lengths."""
    return F.when(text.rlike(r"\Asha256:[0-9A-Fa-f]{64}\z"), F.concat(F.lit("sha256:"), F.lower(F.substr(text, F.lit(8)))))


def digest_parts(text: Column) -> Column:
    """Struct(algorithm, hex) of a labelled digest in hexadecimal, base32 or base64, so that equal values are equal; bare
    text of 32 base32 characters is SHA-1, as capture indexes have it. ``hex`` is null where the value has not the
    length of its algorithm, or the algorithm is none of MD5, SHA-1, SHA-256 and SHA-512."""
    label = F.lower(F.regexp_replace(F.when(text.contains(":"), F.substring_index(text, ":", 1)).otherwise("sha1"), "-", ""))
    value = F.when(text.contains(":"), F.regexp_replace(text, r"^[^:]*:", "")).otherwise(text)
    size = F.create_map(F.lit("md5"), F.lit(16), F.lit("sha1"), F.lit(20), F.lit("sha256"), F.lit(32), F.lit("sha512"), F.lit(64))[label]
    bare = F.length(F.regexp_replace(value, "=+$", ""))
    as_hex = F.when(value.rlike(r"\A[0-9A-Fa-f]+\z") & (F.length(value) == 2 * size), F.lower(value))
    bits = F.array_join(F.transform(F.split(F.regexp_replace(F.upper(value), "=+$", ""), ""), lambda c: F.lpad(F.bin(F.instr(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), c) - 1), 5, "0")), "")
    # four bits a digit, without what fills the last character
    nibbles = F.transform(F.sequence(F.lit(1), 2 * size), lambda i: F.lower(F.conv(F.substr(bits, (i - 1) * 4 + 1, F.lit(4)), 2, 16)))
    from32 = F.when(value.rlike(r"\A[A-Za-z2-7]+=*\z") & (bare == F.ceil(size * 8 / 5)), F.array_join(nibbles, ""))
    plain = F.regexp_replace(F.translate(value, "-_", "+/"), "=+$", "")
    from64 = F.when(value.rlike(r"\A[A-Za-z0-9+/_-]+={0,2}\z") & (bare == F.ceil(size * 4 / 3)), F.lower(F.hex(F.unbase64(F.rpad(plain, (F.ceil(size / 3) * 4).cast("int"), "=")))))
    return F.struct(label.alias("algorithm"), F.coalesce(as_hex, from32, from64).alias("hex"))


def synthetic_id(ts_text: Column, url: Column, length: int = 24) -> Column:
    """The first ``length`` hexadecimal digits of the SHA-256 of time text and URL."""
    return F.left(F.sha2(F.concat(ts_text, url), 256), F.lit(min(length, 64)))
