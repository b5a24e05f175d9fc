"""Decisions that depend on the order of a key's events: exactly-once keys and rate limits.

Each is a function of a key's state and its next event; batches fold a key's
events in order, streams (ledgerline.streaming) keep the state between batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

RETENTION_S, WINDOW_S = 24 * 3600, 60


def idempotency_step(state: tuple | None, at: float, fingerprint: str, retention: float = RETENTION_S) -> tuple[tuple, str]:
    """State (expiry, fingerprint) and outcome: owned, replay, or reused (the same key with another body)."""
    if state is None or at >= state[0]:
        return (at + retention, fingerprint), "owned"
    return state, "replay" if state[1] == fingerprint else "reused"


def request_step(state: tuple | None, at: float, kind: str, fingerprint: str, retention: float = RETENTION_S) -> tuple[tuple | None, str]:
    """State (expiry, fingerprint, done) and outcome of a begin (owned, replay, reused or in_flight), a complete (completed or unknown) or a fail, which frees the key (released or unknown)."""
    if state is not None and at >= state[0]:
        state = None
    if kind == "begin":
        if state is None:
            return (at + retention, fingerprint, False), "owned"
        return state, "reused" if state[1] != fingerprint else "replay" if state[2] else "in_flight"
    if state is None or state[2]:
        return state, "unknown"
    return ((state[0], state[1], True), "completed") if kind == "complete" else (None, "released")


def rate_step(state: tuple | None, at: float, limit: int, window: float = WINDOW_S) -> tuple[tuple, tuple[bool, int]]:
    """State (window's start, count) and (allowed, seconds to wait). A window starts at its first event."""
    if state is None or at >= state[0] + window:
        return (at, 1), (True, 0)
    start, n = state
    if n < limit:
        return (start, n + 1), (True, 0)
    return state, (False, max(1, -int(-(start + window - at) // 1)))


def folded(rows: DataFrame, keys: list[str], order: list[str], schema: str, step: Callable[[tuple | None, pd.Series], tuple]) -> DataFrame:
    """rows by keys in order, each through step(state, row) -> (state, output row). A key's rows come in batches, so memory doesn't grow with them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = object(), None
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                own = tuple(getattr(row, k) for k in keys)
                if own != key:
                    key, state = own, None
                state, result = step(state, row)
                out.append(result)
            yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def idempotency_outcomes(requests: DataFrame, retention: float = RETENTION_S) -> DataFrame:
    """key, id, outcome of requests (key, id, at_s, fingerprint) in order of time and id."""

    def step(state, row):
        state, outcome = idempotency_step(state, row.at_s, row.fingerprint, retention)
        return state, (row.key, row.id, outcome)

    return folded(requests, ["key"], ["at_s", "id"], "key string, id long, outcome string", step)


def request_outcomes(requests: DataFrame, retention: float = RETENTION_S) -> DataFrame:
    """key, id, outcome of requests (key, id, at_s, kind, fingerprint) in order of time and id."""

    def step(state, row):
        state, outcome = request_step(state, row.at_s, row.kind, row.fingerprint, retention)
        return state, (row.key, row.id, outcome)

    return folded(requests, ["key"], ["at_s", "id"], "key string, id long, outcome string", step)


def rate_decisions(requests: DataFrame, limit: int, window: float = WINDOW_S) -> DataFrame:
    """key, id, allowed, retry_after of requests (key, id, at_s)."""

    def step(state, row):
        state, (allowed, wait) = rate_step(state, row.at_s, limit, window)
        return state, (row.key, row.id, allowed, wait)

    return folded(requests, ["key"], ["at_s", "id"], "key string, id long, allowed boolean, retry_after long", step)
