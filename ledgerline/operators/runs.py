"""The run's life: registration, states, sealing, quarantine, and rules that rows keep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.digests import is_digest, ordered_digest
from .lifecycle import TRANSITIONS

#: Fixed value: what a manifest's names look like.
LOGICAL_NAME, LONGEST_NAME = r"^[A-Za-z0-9][A-Za-z0-9._/-]*$", 512
SEALED = ("SEALED", "PROCESSING", "PROCESSED", "PROCESSING_FAILED")


def reference_problems(requests: DataFrame, studies: DataFrame, instruments: DataFrame, grants: DataFrame, operators: DataFrame) -> DataFrame:
    """requests (run, study, instrument, operator, actor_type, actor_id) with problem, the first that holds, else null:
    study_not_found, study_closed, not_own_instrument, instrument_unavailable, not_granted, operator_unavailable.
    studies (study, closed_at), instruments (instrument, disabled_at), operators (operator, disabled_at), grants (study, instrument).
    """
    found = lambda df, key, at: df.select(key, F.struct(F.col(at).alias("at")).alias(f"_{key}"))
    out = requests.join(found(studies, "study", "closed_at"), "study", "left").join(found(instruments, "instrument", "disabled_at"), "instrument", "left").join(found(operators, "operator", "disabled_at"), "operator", "left")
    out = out.join(grants.select("study", "instrument", F.lit(True).alias("_granted")).distinct(), ["study", "instrument"], "left")
    gone = lambda c: F.col(c).isNull() | F.col(f"{c}.at").isNotNull()
    own = (F.col("actor_type") == "instrument") & ~F.col("actor_id").eqNullSafe(F.col("instrument"))
    problem = F.when(F.col("_study").isNull(), "study_not_found").when(F.col("_study.at").isNotNull(), "study_closed").when(own, "not_own_instrument")
    problem = problem.when(gone("_instrument"), "instrument_unavailable").when(F.col("_granted").isNull(), "not_granted").when(gone("_operator"), "operator_unavailable")
    return out.withColumn("problem", problem).select(*requests.columns, "problem")


def registered(requests: DataFrame, entries: DataFrame, problems: DataFrame, bad: DataFrame, at: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New runs, their manifest entries and audit events, of requests without problems and with a well-formed manifest."""
    runs = requests.join(problems.where("problem is not null").select("run"), "run", "left_anti").join(bad.select("run"), "run", "left_anti")
    runs = runs.withColumns({"state": F.lit("OPEN"), "registered_at": at})
    own = entries.join(runs.select("run"), "run", "left_semi").withColumn("verification", F.lit("PENDING"))
    return runs, own, runs.select(F.lit("run.registered").alias("action"), F.col("run").alias("target"), at.alias("occurred_at"))


def superseding(requests: DataFrame, runs: DataFrame) -> DataFrame:
    """requests (run, supersedes, reason) with problem: self, no_reason, not_found, or open (an OPEN or ABANDONED run can't be superseded)."""
    before = runs.select(F.col("run").alias("supersedes"), F.col("state").alias("_state"))
    out = requests.join(before, "supersedes", "left")
    problem = F.when(F.col("run").eqNullSafe(F.col("supersedes")), "self").when(F.col("reason").isNull(), "no_reason").when(F.col("_state").isNull(), "not_found").when(F.col("_state").isin("OPEN", "ABANDONED"), "open")
    return out.withColumn("problem", problem).select(*requests.columns, "problem")


def moved(current: DataFrame, requests: DataFrame, at: Column, allowed: tuple[tuple[str, str], ...] = TRANSITIONS) -> DataFrame:
    """run, before, state, accepted, at: requests (run, to) against current (run, state). An accepted move is a state event; a request to be where the run is is accepted, without an event time, so that a repeated request changes nothing."""
    table = current.sparkSession.createDataFrame(list(allowed), "before string, to string").withColumn("_legal", F.lit(True))
    out = requests.join(current.select("run", F.col("state").alias("before")), "run").join(F.broadcast(table), ["before", "to"], "left")  # a fixed table
    same = F.col("before") == F.col("to")
    legal = F.col("_legal").isNotNull()
    return out.select("run", "before", F.when(legal, F.col("to")).otherwise(F.col("before")).alias("state"), (legal | same).alias("accepted"), F.when(legal & ~same, at).alias("at"))


def sealing(runs: DataFrame, entries: DataFrame) -> DataFrame:
    """run, verdict of sealing runs (run, state, manifest_digest): not_open, empty, unverified, manifest_mismatch or sealed.
    entries: run, name, entry (its canonical text), verified."""
    own = entries.groupBy("run").agg(F.count_if(~F.coalesce("verified", F.lit(False))).alias("_open"), ordered_digest(F.col("name"), F.col("entry")).alias("_digest"))
    out = runs.join(own, "run", "left")
    verdict = F.when(F.col("state") != "OPEN", "not_open").when(F.col("_open").isNull(), "empty").when(F.col("_open") > 0, "unverified").when(~F.col("_digest").eqNullSafe(F.col("manifest_digest")), "manifest_mismatch")
    return out.select("run", verdict.otherwise("sealed").alias("verdict"))


def quarantined(entries: DataFrame, mismatched: DataFrame, reason: str) -> tuple[DataFrame, DataFrame]:
    """Entries (run, name, verification) with the mismatched ones (run, name) rejected first, then run, state and quarantine_reason of their runs."""
    bad = mismatched.select("run", "name", F.lit(True).alias("_bad")).distinct()
    out = entries.join(bad, ["run", "name"], "left").withColumn("verification", F.when(F.col("_bad"), "REJECTED").otherwise(F.col("verification"))).drop("_bad")
    return out, bad.select("run").distinct().withColumns({"state": F.lit("QUARANTINED"), "quarantine_reason": F.lit(reason)})


def run_rules() -> dict[str, Column]:
    """Rules over a run's row. A rule that is null holds, as in SQL."""
    has = lambda c: F.col(c).isNotNull()
    return {
        "supersede_reason_present": has("supersedes") == has("supersede_reason"),
        "no_self_supersede": ~F.col("supersedes").eqNullSafe(F.col("run")),
        "sealed_at_consistent": F.col("state").isin(*SEALED) == has("sealed_at"),
        "quarantine_reason_present": (F.col("state") == "QUARANTINED") == has("quarantine_reason"),
    }


def manifest_problems(entries: DataFrame) -> DataFrame:
    """run, problem: the first of repeated_name, name, digest, size that an entry (run, name, digest, size as text) of it shows."""
    named = entries.groupBy("run", "name").agg(F.count(F.lit(1)).alias("n"), F.max(~is_digest(F.col("digest"))).alias("digest"), F.max(~F.coalesce(F.col("size").rlike(r"^(0|[1-9][0-9]*)\z"), F.lit(False))).alias("size"))
    ill = F.coalesce(~F.col("name").rlike(LOGICAL_NAME) | (F.length("name") > LONGEST_NAME), F.lit(True))
    rank = F.when(F.col("n") > 1, 1).when(ill, 2).when(F.col("digest"), 3).when(F.col("size"), 4)
    worst = named.groupBy("run").agg(F.min(rank).alias("k")).where("k is not null")
    return worst.select("run", F.element_at(F.array(*map(F.lit, ("repeated_name", "name", "digest", "size"))), F.col("k")).alias("problem"))


def frozen_entries(before: DataFrame, after: DataFrame, runs: DataFrame, columns: list[str]) -> DataFrame:
    """run, name, change (added, deleted, changed) of manifest entries whose run isn't OPEN."""
    a, b = (df.select("run", "name", F.struct(*columns).alias(c)) for df, c in ((before, "_a"), (after, "_b")))
    both = a.join(b, ["run", "name"], "full").where(~F.col("_a").eqNullSafe(F.col("_b")))
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "deleted").otherwise("changed")
    return both.join(runs.where("state <> 'OPEN'").select("run"), "run", "left_semi").select("run", "name", change.alias("change"))


def reaped(tables: dict[str, DataFrame], tenants: DataFrame, as_of: Column) -> tuple[dict[str, DataFrame], DataFrame]:
    """What is left of tenants' tables (with a column tenant) when expired sandbox tenants (tenant, sandbox, expires_at) go, and table, rows that went. Other tenants are never touched."""
    gone = tenants.where(F.col("sandbox") & (F.col("expires_at") <= as_of)).select("tenant")
    left = {name: df.join(gone, "tenant", "left_anti") for name, df in tables.items()}
    counts = None
    for name, df in tables.items():
        n = df.join(gone, "tenant", "left_semi").agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows")
        counts = n if counts is None else counts.union(n)
    return left, counts


def quota_reason(expired: Column, runs: Column, most_runs: int, stored: Column, most_bytes: int, entry: Column | None = None, most_entry: int | None = None) -> Column:
    """Why a sandbox write is refused: expired, runs, bytes or entry, in this order; else null."""
    out = F.when(expired, "expired").when(runs >= most_runs, "runs").when(stored >= most_bytes, "bytes")
    return out if entry is None else out.when(entry > most_entry, "entry")
