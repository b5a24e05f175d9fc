"""Keyset pages: predicates as columns, cursors as opaque text."""

from __future__ import annotations

import base64
import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

DEFAULT, MOST, LONGEST_CURSOR = 50, 200, 512
_SEP, _NULL = "\x1f", "\0"


class BadCursor(ValueError):
    pass


def encode(*fields: object) -> str:
    """Fields in one opaque text; times keep their microseconds."""
    text = [_NULL if f is None else f.strftime("%Y-%m-%dT%H:%M:%S.%fZ") if isinstance(f, dt.datetime) else str(f) for f in fields]
    return base64.urlsafe_b64encode(_SEP.join(text).encode()).decode().rstrip("=")


def decode(cursor: str, arity: int) -> list[str | None]:
    if not cursor or len(cursor) > LONGEST_CURSOR:
        raise BadCursor("length")
    try:
        raw = base64.b64decode(cursor + "=" * (-len(cursor) % 4), altchars=b"-_", validate=True).decode()
    except ValueError as e:
        raise BadCursor("form") from e
    fields = [None if f == _NULL else f for f in raw.split(_SEP)]
    if len(fields) != arity or encode(*fields) != cursor:
        raise BadCursor("content")
    return fields


def after_nullable_desc(key: Column, ident: Column, at: object, last: object) -> Column:
    """Rows behind (at, last) in the order key desc nulls first, ident desc."""
    if at is None:
        return key.isNotNull() | (key.isNull() & (ident < F.lit(last)))
    at_ = F.lit(at)
    return key.isNotNull() & ((key < at_) | ((key == at_) & (ident < F.lit(last))))


@dataclass
class Page:
    items: list[Row]
    next_cursor: str | None


def page(df: DataFrame, limit: int, *fields: str) -> Page:
    """The first limit rows of an ordered frame, and the cursor of the last one if more follow."""
    rows = df.limit(limit + 1).collect()  # limit is a page's size, MOST at most
    more = len(rows) > limit
    return Page(rows[:limit], encode(*(rows[limit - 1][f] for f in fields)) if more else None)
