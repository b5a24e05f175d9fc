"""Run search: optional conditions, what an actor may see, keyset pages.

The page is cut before names are joined to it, so a search over any number of
runs joins no more rows than a page has.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import Scope
from . import paging


class NotFound(LookupError):
    pass


@dataclass(frozen=True)
class Wanted:
    """Conditions on runs; those that are None don't count. cursor: (acquired_at, run_id) of the row before the page."""

    study: object = None
    instrument: object = None
    operator: object = None
    states: tuple[str, ...] | None = None
    acquired_from: object = None
    acquired_to: object = None
    cursor: tuple | None = None


def visible_studies(scope: Scope, studies: DataFrame, memberships: DataFrame, grants: DataFrame) -> DataFrame:
    """study: all for the system, a user's by live membership, an instrument's by grant, none for others."""
    if scope.actor_type == "system":
        return studies.select("study").distinct()
    if scope.actor_type == "user":
        return memberships.where((F.col("user") == F.lit(scope.actor_id)) & F.col("revoked_at").isNull()).select("study").distinct()
    if scope.actor_type == "instrument":
        return grants.where(F.col("instrument") == F.lit(scope.actor_id)).select("study").distinct()
    return studies.select("study").where(F.lit(False))


def matching(runs: DataFrame, wanted: Wanted, visible: DataFrame | None = None) -> DataFrame:
    """Runs (run_id, study, instrument, operator, state, acquired_at) that meet the conditions; a null time meets no range."""
    for column in ("study", "instrument", "operator"):
        if getattr(wanted, column) is not None:
            runs = runs.where(F.col(column) == F.lit(getattr(wanted, column)))
    if wanted.states is not None:
        runs = runs.where(F.col("state").isin(*wanted.states))
    if wanted.acquired_from is not None:
        runs = runs.where(F.col("acquired_at") >= F.lit(wanted.acquired_from))
    if wanted.acquired_to is not None:
        runs = runs.where(F.col("acquired_at") <= F.lit(wanted.acquired_to))
    if wanted.cursor is not None:
        runs = runs.where(paging.after_nullable_desc(F.col("acquired_at"), F.col("run_id"), *wanted.cursor))
    return runs if visible is None else runs.join(visible, "study", "left_semi")


def search(runs: DataFrame, wanted: Wanted, visible: DataFrame | None = None, limit: int = paging.DEFAULT) -> DataFrame:
    """The page of matching runs, latest first, runs without a time before all others."""
    if not 1 <= limit <= paging.MOST:
        raise ValueError(f"a page has 1 to {paging.MOST} rows")
    return matching(runs, wanted, visible).orderBy(F.desc_nulls_first("acquired_at"), F.desc("run_id")).limit(limit)


def one(runs: DataFrame, key: str, value: object) -> DataFrame:
    """The row with that key; raises NotFound where there is none."""
    found = runs.where(F.col(key) == F.lit(value))
    if found.isEmpty():
        raise NotFound(f"{key} {value}")
    return found
