"""Upload parts, read-back checks, and what bytes look like."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MIB = 1 << 20
PREFERRED, MOST_PARTS, LEAST_PART, MOST_PART = 64 * MIB, 10_000, 5 * MIB, 5 << 30
INSPECTED, SNIFFED_LINES = 16 * MIB, 64
#: The delimiters looked for, in order.
DELIMITERS = (",", "\t", ";", "|")
_SNIFFED = {"kind": "string", "width": "long", "height": "long", "bit_depth": "long", "colour_type": "long", "byte_order": "string", "line_count": "long", "delimiter": "string", "column_count": "long"}


def part_size(size: Column, preferred: int = PREFERRED, parts: int = MOST_PARTS) -> Column:
    return F.greatest(F.lit(preferred).cast("long"), F.ceil(size / parts).cast("long"))


def part_count(size: Column, each: Column) -> Column:
    return F.greatest(F.lit(1).cast("long"), F.ceil(size / each).cast("long"))


def plan_problem(size: Column, preferred: int = PREFERRED) -> Column:
    """Why an object can't be uploaded in parts: a preferred part below the least size, no size, or parts beyond the largest; else null."""
    return F.when(F.lit(preferred < LEAST_PART), "preferred_too_small").when(size.isNull() | (size < 0), "size").when(part_size(size, preferred) > MOST_PART, "object_too_large")


def begun(entries: DataFrame, artifacts: DataFrame, sessions: DataFrame) -> DataFrame:
    """entries (id, digest, size and others) with action: present (an artifact of that digest and size exists), size_mismatch (of another size), resume (an open session) or open; and the artifact."""
    known = artifacts.select("digest", F.col("size").alias("_size"), "artifact")
    opened = sessions.where("state = 'OPEN'").select("id").distinct().withColumn("_session", F.lit(True))
    out = entries.join(known, "digest", "left").join(opened, "id", "left")
    action = F.when(F.col("_size") == F.col("size"), "present").when(F.col("_size").isNotNull(), "size_mismatch").when(F.col("_session"), "resume").otherwise("open")
    return out.withColumn("action", action).select(*entries.columns, "action", "artifact")


def resolved_parts(recorded: DataFrame, provided: DataFrame) -> DataFrame:
    """id, part_number, etag: recorded parts, overlaid by those that the caller provides; etags without quotes."""
    a = recorded.select("id", "part_number", F.col("etag").alias("_a"))
    b = provided.select("id", "part_number", F.col("etag").alias("_b"))
    return a.join(b, ["id", "part_number"], "full").select("id", "part_number", unquoted(F.coalesce("_b", "_a")).alias("etag"))


def recorded_parts(events: DataFrame, sessions: DataFrame) -> DataFrame:
    """id, recorded, total_parts: how many distinct parts of each session its part events (id, part_number, etag, at) hold."""
    n = events.groupBy("id", "part_number").agg(F.max_by("etag", "at").alias("etag")).groupBy("id").agg(F.count(F.lit(1)).alias("recorded"))
    return sessions.select("id", "total_parts").join(n, "id", "left").withColumn("recorded", F.coalesce("recorded", F.lit(0).cast("long")))


def to_presign(missing: DataFrame, most: int = 512) -> DataFrame:
    """The first parts of each session that are presigned at once."""
    order = Window.partitionBy("id").orderBy("part_number")
    return missing.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_n")


def bound(verified: DataFrame, artifacts: DataFrame) -> DataFrame:
    """verified entries (id, run, digest, size) with the artifact of their digest: the existing one, or the smallest id of the entries that bring it, and whether this entry creates it."""
    first = verified.groupBy("digest").agg(F.min("id").alias("_first"))
    out = verified.join(first, "digest").join(artifacts.select("digest", "artifact"), "digest", "left")
    return out.withColumns({"created": F.col("artifact").isNull() & (F.col("id") == F.col("_first")), "artifact": F.coalesce("artifact", "_first")}).drop("_first")


def unquoted(etag: Column) -> Column:
    return F.trim(F.regexp_replace(etag, '^"|"$', ""))


def suffix_split(path: Column) -> tuple[Column, Column]:
    """A path's logical name and the operation behind its last slash; null without one."""
    return F.nullif(F.regexp_extract(path, r"(?s)^(.+)/([^/]+)\z", 1), F.lit("")), F.nullif(F.regexp_extract(path, r"(?s)^(.+)/([^/]+)\z", 2), F.lit(""))


def download_name(first_binding: Column, digest: Column) -> Column:
    """The last segment of an artifact's first name, else its digest."""
    return F.coalesce(F.nullif(F.element_at(F.split(first_binding, "/"), -1), F.lit("")), F.concat(digest, F.lit(".bin")))


def outstanding(sessions: DataFrame, recorded: DataFrame) -> DataFrame:
    """id, part_number that sessions (id, total_parts) still lack."""
    return sessions.select("id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("total_parts"))).alias("part_number")).join(recorded, ["id", "part_number"], "left_anti")


def verdict(declared_size: Column, size: Column, declared_digest: Column, digest: Column) -> Column:
    return F.when(size.isNull(), "missing").when(declared_size != size, "size_mismatch").when(declared_digest != digest, "digest_mismatch").otherwise("verified")


def line_count(text: Column) -> Column:
    lines = F.size(F.split(text, "\n"))
    return F.when(text == "", 0).otherwise(lines - F.when(text.endswith("\n"), 1).otherwise(0))


def delimiter(text: Column) -> Column:
    """The first of comma, tab, semicolon and bar that cuts all non-empty ones of the first lines into as many columns, two at least. A carriage return is part of its line."""
    lines = F.filter(F.slice(F.split(text, "\n"), 1, SNIFFED_LINES), lambda x: x != "")

    def fits(mark: str) -> Column:
        columns = lambda x: F.size(F.split(x, "[|]" if mark == "|" else mark))
        first = columns(F.get(lines, F.lit(0)))
        return F.when((first >= 2) & F.forall(lines, lambda x: columns(x) == first), mark)

    return F.coalesce(*(fits(m) for m in DELIMITERS))


def is_plain(text: Column) -> Column:
    """No control characters but tab and line ends."""
    return ~text.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F]")


def _tiff(content: bytes) -> dict | None:
    """Byte order and sides in the first directory; None if it isn't a TIFF that names both."""
    order = {b"II": "<", b"MM": ">"}.get(content[:2])
    if len(content) < 8 or order is None or struct.unpack_from(order + "H", content, 2)[0] != 42:
        return None
    at = struct.unpack_from(order + "I", content, 4)[0]
    if at + 2 > len(content):
        return None
    entries = min(struct.unpack_from(order + "H", content, at)[0], (len(content) - at - 2) // 12)
    sides: dict[int, int] = {}
    for i in range(entries):
        tag, kind = struct.unpack_from(order + "HH", content, at + 2 + 12 * i)
        if tag in (0x100, 0x101) and kind in (3, 4):
            sides[tag] = struct.unpack_from(order + ("H" if kind == 3 else "I"), content, at + 10 + 12 * i)[0]
    return {"kind": "tiff", "width": sides[0x100], "height": sides[0x101], "byte_order": "little" if order == "<" else "big"} if len(sides) == 2 else None


def _png(content: bytes) -> dict | None:
    if len(content) < 26 or content[:8] != b"\x89PNG\r\n\x1a\n" or content[12:16] != b"IHDR":
        return None
    return dict(zip(("width", "height", "bit_depth", "colour_type"), struct.unpack_from(">IIBB", content, 16), strict=True), kind="png")


def _text(content: bytes) -> dict | None:
    """Lines and delimiter of UTF-8 without control characters but tab and line ends; None for nothing."""
    try:
        text = content.decode("utf-8-sig")
    except UnicodeDecodeError:
        return None
    if not content or any(ord(c) < 32 and c not in "\t\n\r" for c in set(text)):
        return None
    sample = [x for x in text.split("\n", SNIFFED_LINES)[:SNIFFED_LINES] if x]
    counts = ((m, {x.count(m) + 1 for x in sample}) for m in DELIMITERS)
    mark, columns = next(((m, min(n)) for m, n in counts if len(n) == 1 and min(n) > 1), (None, None))
    return {"kind": "text", "line_count": text.count("\n") + (text != "" and not text.endswith("\n")), "delimiter": mark, "column_count": columns}


def sniff_bytes(content: bytes | None) -> dict:
    """What bytes look like: kind (tiff, png, text or unknown) and what is known of that kind. A malformed header is unknown."""
    if content is None or len(content) > INSPECTED:
        return {"kind": "unknown"}
    try:
        return _tiff(content) or _png(content) or _text(content) or {"kind": "unknown"}
    except struct.error:
        return {"kind": "unknown"}


def sniff(content: Column) -> Column:
    """sniff_bytes of each object's bytes, as one struct; what doesn't apply to a kind is null."""

    def read(contents: pd.Series) -> pd.DataFrame:
        found = pd.DataFrame([sniff_bytes(c) for c in contents], columns=list(_SNIFFED))
        return found.astype({c: "Int64" if t == "long" else object for c, t in _SNIFFED.items()})

    read.__annotations__ = {"contents": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(read, ", ".join(f"{c} {t}" for c, t in _SNIFFED.items()))(content)
