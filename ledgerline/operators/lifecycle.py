"""Run states, sealing, superseding, and what may change in between."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import lineage

#: Allowed moves between run states.
TRANSITIONS = (
    ("OPEN", "SEALED"), ("OPEN", "ABANDONED"), ("OPEN", "QUARANTINED"), ("SEALED", "PROCESSING"), ("PROCESSING", "PROCESSED"), ("PROCESSING", "PROCESSING_FAILED"), ("PROCESSING_FAILED", "PROCESSING"),
)
SUPERSEDE_DEPTH = 64


def illegal_moves(moves: DataFrame, allowed: tuple[tuple[str, str], ...] = TRANSITIONS) -> DataFrame:
    """Rows of moves (before, after) that the table doesn't allow."""
    table = moves.sparkSession.createDataFrame(list(allowed), "before string, after string")
    return moves.join(F.broadcast(table), ["before", "after"], "left_anti")  # a state machine's fixed table


def frozen_changes(before: DataFrame, after: DataFrame, key: str, frozen: list[str], may: Column) -> DataFrame:
    """key and names of frozen columns that differ between two versions of rows for which may (over the old row) doesn't hold; deleted rows count as all of them."""
    a, b = before.where(~may).alias("a"), after.alias("b")
    both = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "left")
    names = F.array_compact(F.array(*(F.when(F.col(f"b.{key}").isNull() | ~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), F.lit(c)) for c in frozen)))
    return both.select(F.col(f"a.{key}").alias(key), F.array_join(names, ",").alias("changed")).where("changed <> ''")


def seal_blockers(entries: DataFrame, verified: Column) -> DataFrame:
    """run, blockers: how many entries of each run keep it from being sealed."""
    return entries.groupBy("run").agg(F.count_if(~F.coalesce(verified, F.lit(False))).alias("blockers")).where("blockers > 0")


def supersede_chain(runs: DataFrame, starts: DataFrame, most: int = SUPERSEDE_DEPTH) -> DataFrame:
    """start, run, depth, direction over runs (run, supersedes), nearest first, both ways."""
    link = runs.where("supersedes is not null").select(F.col("run").alias("source"), F.col("supersedes").alias("target"), F.col("run").alias("derivation"), F.lit("supersedes").alias("role"))
    first = starts.select(F.col("run").alias("artifact")).distinct()
    ways = (lineage.walk(link, first, most, down=down, most=most).where("depth > 0").select("start", F.col("artifact").alias("run"), "depth", F.lit(name).alias("direction")) for name, down in (("ancestor", False), ("descendant", True)))
    return reduce(DataFrame.unionByName, ways)


def violations(checks: dict[str, tuple[DataFrame, Column]]) -> DataFrame:
    """rule, rows: how many rows break each named rule. A rule that is null holds."""
    return reduce(DataFrame.union, (df.agg(F.count_if(F.coalesce(~rule, F.lit(False))).alias("rows")).select(F.lit(name).alias("rule"), "rows") for name, (df, rule) in checks.items()))


def repeated_keys(df: DataFrame, *keys: str) -> DataFrame:
    return df.where(reduce(Column.__and__, (F.col(k).isNotNull() for k in keys))).groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def orphans(df: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Rows whose reference names no parent; null references are none."""
    return df.where(F.col(column).isNotNull()).join(parent.select(F.col(key).alias(column)), column, "left_anti")


def insert_once(rows: DataFrame, existing: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows to append so that keys stay unique: of new rows with one key the first by order, and none that exists."""
    first = rows.groupBy(*keys).agg(F.min(F.struct(*order, F.struct(*rows.columns).alias("row"))).alias("m")).select("m.row.*")
    return first.join(existing.select(*keys), keys, "left_anti")


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last version of each key."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), order).alias("m")).select("m.*")
