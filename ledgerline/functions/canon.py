"""Canonical JSON (RFC 8785): keys by UTF-16 order, ECMAScript numbers, shortest escapes."""

from __future__ import annotations

import hashlib
import json
import math
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class NotJson(ValueError):
    """A value that JSON can't hold; says where."""


def number(x: float, path: str = "$") -> str:
    """Number::toString of ECMAScript."""
    if not math.isfinite(x):
        raise NotJson(f"{path}: not finite")
    if x == 0:
        return "0"
    sign, digits, e = Decimal(repr(float(x))).as_tuple()
    text = "".join(map(str, digits)).rstrip("0")
    point = len(digits) + e  # the decimal point stands behind so many digits
    k = len(text)
    if k <= point <= 21:
        out = text + "0" * (point - k)
    elif 0 < point <= 21:
        out = f"{text[:point]}.{text[point:]}"
    elif -6 < point <= 0:
        out = "0." + "0" * -point + text
    else:
        out = text[0] + ("." + text[1:] if k > 1 else "") + f"e{'+' if point > 0 else '-'}{abs(point - 1)}"
    return "-" * sign + out


def canonicalize(value: object, path: str = "$") -> str:
    if value is None or isinstance(value, bool):
        return {None: "null", True: "true", False: "false"}[value]
    if isinstance(value, str):
        return json.dumps(value, ensure_ascii=False)
    if isinstance(value, (int, float)):
        try:
            return number(float(value), path)
        except OverflowError as e:
            raise NotJson(f"{path}: beyond a double") from e
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(canonicalize(v, f"{path}[{i}]") for i, v in enumerate(value)) + "]"
    if isinstance(value, dict):
        if not all(isinstance(k, str) for k in value):
            raise NotJson(f"{path}: a key is no string")
        keys = sorted(value, key=lambda k: k.encode("utf-16-be", "surrogatepass"))
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{canonicalize(value[k], f'{path}.{k}')}" for k in keys) + "}"
    raise NotJson(f"{path}: {type(value).__name__}")


def digest(value: object) -> str:
    return hashlib.sha256(canonicalize(value).encode("utf-8")).hexdigest()


def canonical(text: Column) -> Column:
    """Struct of canonical (the canonical form of a JSON text) and problem (why there is none); both null for null."""

    def form(text: str | None) -> tuple[str | None, str | None]:
        if text is None:
            return None, None
        try:
            return canonicalize(json.loads(text)), None
        except (ValueError, RecursionError) as e:
            return None, "not JSON" if isinstance(e, json.JSONDecodeError) else str(e) or type(e).__name__

    def read(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([form(t) for t in texts], columns=["canonical", "problem"])

    read.__annotations__ = {"texts": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(read, "canonical string, problem string")(text)


def digest_of(canonical: Column) -> Column:
    """Digest of a canonical text."""
    return F.sha2(canonical, 256)
