"""Digest, encoding and time-text expressions. All run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GENESIS = "0" * 64


def sha256(c: Column) -> Column:
    return F.sha2(c.cast("string"), 256)


def is_digest(c: Column) -> Column:
    return F.coalesce(c.rlike("^[0-9a-f]{64}$"), F.lit(False))


def digest_set(c: Column) -> Column:
    """Aggregate: digest of the sorted distinct digests, one to a line."""
    return F.sha2(F.array_join(F.array_sort(F.collect_set(c)), "\n"), 256)


def ordered_digest(order: Column, text: Column) -> Column:
    """Aggregate: digest of a JSON array of already canonical texts, in the given order."""
    items = F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), text.alias("t")))), lambda x: x["t"])
    return F.sha2(F.concat(F.lit("["), F.array_join(items, ","), F.lit("]")), 256)


def storage_key(digest: Column) -> Column:
    """Null for what is no digest."""
    key = F.concat(F.lit("sha256/"), F.substring(digest, 1, 2), F.lit("/"), F.substring(digest, 3, 2), F.lit("/"), digest)
    return F.when(is_digest(digest), key)


def micros_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def millis_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def uuid_time(c: Column) -> Column:
    """Creation time in a version 7 UUID: its first 48 bits, in milliseconds."""
    return F.timestamp_millis(F.conv(F.substring(F.replace(c, F.lit("-"), F.lit("")), 1, 12), 16, 10).cast("long"))


def is_uuid(c: Column) -> Column:
    return F.coalesce(c.rlike("^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"), F.lit(False))


def base64url(c: Column) -> Column:
    return F.rtrim(F.translate(F.base64(c), "+/", "-_"), F.lit("="))


def cursor_text(*fields: Column) -> Column:
    """A cursor in the form of paging.encode: fields joined by U+001F, null as U+0000."""
    return base64url(F.encode(F.array_join(F.array(*(F.coalesce(f.cast("string"), F.lit("\0")) for f in fields)), "\x1f"), "utf-8"))


def backoff_seconds(attempts: Column, base: int = 5, most: int = 3600) -> Column:
    return F.least(F.lit(most), (F.lit(base) * F.pow(F.lit(2), F.least(attempts, F.lit(40)) - 1)).cast("long"))
