"""Uploads from the request to complete them to what it changes: entries, runs, sessions, artifacts and audit events."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.digests import storage_key
from . import uploads


@dataclass(frozen=True)
class Completion:
    """outcomes: id, run, outcome, reason, artifact of each request. entries, runs and sessions: all rows, as they are afterwards. artifacts: the new ones. events: run, id, place (0, 1 of a request's events), action, target, payload (canonical JSON)."""

    outcomes: DataFrame
    entries: DataFrame
    runs: DataFrame
    sessions: DataFrame
    artifacts: DataFrame
    events: DataFrame


def decided(requests: DataFrame, entries: DataFrame, runs: DataFrame, sessions: DataFrame, parts: DataFrame, stored: DataFrame, artifacts: DataFrame) -> DataFrame:
    """outcomes of requests (id of an entry), in the order of ids within a run; ids that are no entry are left out, repeated ones are one.

    entries (id, run, name, digest, size, verification, artifact), runs (run, state),
    sessions (id, state, total_parts), parts (id, part_number, etag) after
    uploads.resolved_parts, stored (id, head_size, read_size, read_digest),
    artifacts (digest, artifact). Outcomes, the first that holds: done (verified
    before), run_not_open, no_session, missing_parts, object_missing,
    size_mismatch, digest_mismatch, verified. The first mismatch in a run closes
    it, so that later requests of the batch find it not open.
    """
    open_ = sessions.where("state = 'OPEN'").groupBy("id").agg(F.max("total_parts").alias("total_parts"))
    have = parts.join(open_, "id").where((F.col("part_number") >= 1) & (F.col("part_number") <= F.col("total_parts")) & (F.col("etag") != ""))
    have = have.groupBy("id").agg(F.count_distinct("part_number").alias("have"))
    rows = requests.select("id").distinct().join(entries.select("id", "run", "name", "digest", "size", "verification", F.col("artifact").alias("bound")), "id")
    rows = rows.join(runs.select("run", F.col("state").alias("run_state")), "run").join(open_, "id", "left").join(have, "id", "left").join(stored, "id", "left")
    outcome = F.when((F.col("verification") == "VERIFIED") & F.col("bound").isNotNull(), "done").when(F.col("run_state") != "OPEN", "run_not_open").when(F.col("total_parts").isNull(), "no_session")
    outcome = outcome.when(F.coalesce("have", F.lit(0)) < F.col("total_parts"), "missing_parts").when(F.col("head_size").isNull(), "object_missing")
    sizes = (F.col("head_size") != F.col("size")) | ~F.col("read_size").eqNullSafe(F.col("size"))
    outcome = outcome.when(sizes, "size_mismatch").when(~F.col("read_digest").eqNullSafe(F.col("digest")), "digest_mismatch").otherwise("verified")
    rows = rows.withColumn("outcome", outcome)
    wrong = F.col("outcome").isin("size_mismatch", "digest_mismatch")
    rows = rows.join(rows.where(wrong).groupBy("run").agg(F.min("id").alias("closed_by")), "run", "left")
    late = (F.col("id") > F.col("closed_by")) & (F.col("outcome") != "done")
    rows = rows.withColumn("outcome", F.when(late, "run_not_open").otherwise(F.col("outcome")))
    said = lambda *xs: F.concat(*(F.coalesce(x.cast("string"), F.lit("nothing")) if isinstance(x, Column) else F.lit(x) for x in xs))
    reason = F.when((F.col("outcome") == "size_mismatch") & (F.col("head_size") != F.col("size")), said("stored size ", F.col("head_size"), " does not match the declared size ", F.col("size")))
    reason = reason.when(F.col("outcome") == "size_mismatch", said("read back ", F.col("read_size"), " bytes for a declared size of ", F.col("size")))
    reason = reason.when(F.col("outcome") == "digest_mismatch", said("stored bytes hash to ", F.col("read_digest"), ", declared ", F.col("digest")))
    rows = rows.withColumn("reason", reason)
    bound = uploads.bound(rows.where("outcome = 'verified'").select("id", "digest"), artifacts.select("digest", "artifact")).select("id", F.col("artifact").alias("_artifact"), "created")
    rows = rows.join(bound, "id", "left")
    return rows.withColumn("artifact", F.when(F.col("outcome") == "done", F.col("bound")).otherwise(F.col("_artifact"))).drop("_artifact", "bound", "have", "total_parts", "run_state", "closed_by", "verification")


def _json(**fields: Column) -> Column:
    """Canonical JSON of texts: keys in order, null written out."""
    return F.to_json(F.struct(*(c.cast("string").alias(k) for k, c in sorted(fields.items()))), {"ignoreNullFields": "false"})


def events_of(outcomes: DataFrame) -> DataFrame:
    """What outcomes of decided() are written to the audit log as: artifact.verified, or run.quarantined and then artifact.rejected."""
    c = F.col
    told = {"logicalName": c("name"), "runId": c("run")}
    verified = _json(**told, artifactId=c("artifact"), digest=c("digest"), sizeBytes=c("read_size"), storageKey=storage_key(c("digest")), verifiedBy=F.lit("read-back-sha256"))
    fault = {**told, "declaredDigest": c("digest"), "declaredSize": c("size"), "reason": c("reason")}
    head = c("head_size") != c("size")
    rejected = F.when(c("outcome") == "digest_mismatch", _json(**fault, computedDigest=c("read_digest"))).otherwise(_json(**fault, storedSize=F.when(head, c("head_size")).otherwise(c("read_size"))))

    def event(place: int, action: str, target: Column, payload: Column) -> Column:
        return F.struct(F.lit(place).alias("place"), F.lit(action).alias("action"), target.cast("string").alias("target"), payload.alias("payload"))

    made = F.when(c("outcome") == "verified", F.array(event(0, "artifact.verified", c("id"), verified)))
    made = made.when(c("reason").isNotNull(), F.array(event(0, "run.quarantined", c("run"), _json(**told, reason=c("reason"))), event(1, "artifact.rejected", c("id"), rejected)))
    return outcomes.select("run", "id", F.explode(made).alias("e")).select("run", "id", "e.*")


def completed(requests: DataFrame, entries: DataFrame, runs: DataFrame, sessions: DataFrame, parts: DataFrame, stored: DataFrame, artifacts: DataFrame) -> Completion:
    """Applies decided(). Its outcomes are read by each of the six frames: write them first where that is dear. Other columns of entries, runs and sessions come back as they are; rejection_reason and quarantine_reason are set."""
    all_ = decided(requests, entries, runs, sessions, parts, stored, artifacts)
    wrong = F.col("_reason").isNotNull()
    mine = all_.where("outcome = 'verified' or reason is not null").select("id", F.col("artifact").alias("_artifact"), F.col("reason").alias("_reason"), F.lit(True).alias("_new"))
    old = lambda df, c: F.col(c) if c in df.columns else F.lit(None).cast("string")
    after = entries.join(mine, "id", "left").withColumns({
        "artifact": F.when(F.col("_new"), F.col("_artifact")).otherwise(F.col("artifact")),
        "verification": F.when(wrong, "REJECTED").when(F.col("_new"), "VERIFIED").otherwise(F.col("verification")),
        "rejection_reason": F.when(F.col("_new"), F.col("_reason")).otherwise(old(entries, "rejection_reason")),
    })
    closed = all_.where("reason is not null").select("run", F.col("reason").alias("_reason"))  # one a run at most
    runs_after = runs.join(closed, "run", "left").withColumns({"state": F.when(wrong, "QUARANTINED").otherwise(F.col("state")), "quarantine_reason": F.coalesce("_reason", old(runs, "quarantine_reason"))})
    sessions_after = sessions.join(mine, "id", "left").withColumn("state", F.when(F.col("_new") & (F.col("state") == "OPEN"), F.when(wrong, "ABORTED").otherwise("COMPLETED")).otherwise(F.col("state")))
    new = all_.where("created").select("artifact", "digest", F.col("read_size").alias("size"), storage_key(F.col("digest")).alias("storage_key"), F.col("run").alias("first_seen_run"))
    hidden = ("_artifact", "_reason", "_new")
    return Completion(all_.select("id", "run", "outcome", "reason", "artifact"), after.drop(*hidden), runs_after.drop(*hidden), sessions_after.drop(*hidden), new, events_of(all_))
