"""A durable queue as functions of frames; the clock is an argument."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.digests import backoff_seconds


def claimable(as_of: Column) -> Column:
    """Pending and due, or active with a lease that has run out."""
    return ((F.col("state") == "PENDING") & (F.col("run_after") <= as_of)) | ((F.col("state") == "ACTIVE") & (F.col("lease_expires_at") < as_of))


def claim(jobs: DataFrame, as_of: Column, limit: int, worker: str, lease_s: int = 300) -> DataFrame:
    """The first limit claimable jobs of each queue by priority (high first), run_after and id, as they are once claimed."""
    order = Window.partitionBy("queue").orderBy(F.desc("priority"), "run_after", "id")
    rows = jobs.where(claimable(as_of)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    return rows.withColumns(
        {"state": F.lit("ACTIVE"), "attempts": F.col("attempts") + 1, "claimed_by": F.lit(worker), "lease_expires_at": as_of + F.make_interval(secs=F.lit(lease_s)), "started_at": F.coalesce("started_at", as_of)}
    )


def release(failed: DataFrame, as_of: Column) -> DataFrame:
    """Failed jobs: dead once out of attempts, else pending after a growing wait."""
    dead = F.col("attempts") >= F.col("max_attempts")
    wait = backoff_seconds(F.col("attempts"))
    return failed.withColumns({"state": F.when(dead, "DEAD").otherwise("PENDING"), "wait_s": F.when(~dead, wait), "run_after": F.when(~dead, F.timestamp_add("SECOND", wait, as_of)).otherwise(F.col("run_after"))})


def owned(jobs: DataFrame, worker: str) -> DataFrame:
    """Jobs that a worker may still complete, renew or fail."""
    return jobs.where((F.col("state") == "ACTIVE") & (F.col("claimed_by") == worker))


def enqueued(wanted: DataFrame, existing: DataFrame) -> DataFrame:
    """Jobs (id, tenant, queue, key and others) to append: one for each (tenant, queue, key), and none that exists; a null key never counts as a repeat."""
    keys = ["tenant", "queue", "key"]
    first = wanted.where("key is not null").groupBy(*keys).agg(F.min_by(F.struct(*wanted.columns), "id").alias("j")).select("j.*")
    return first.join(existing.where("key is not null").select(*keys), keys, "left_anti").unionByName(wanted.where("key is null"))


def fenced(jobs: DataFrame, reports: DataFrame, as_of: Column, lease_s: int = 300) -> DataFrame:
    """reports (id, worker, outcome: complete, renew or fail) and what they make of active jobs that the worker holds: accepted, state, lease_expires_at, wait_s. Reports of others change nothing."""
    out = reports.join(jobs.select("id", F.col("state").alias("_state"), "claimed_by", "attempts", "max_attempts", F.col("lease_expires_at").alias("_lease")), "id")
    mine = F.coalesce((F.col("_state") == "ACTIVE") & (F.col("claimed_by") == F.col("worker")), F.lit(False))
    dead, failed = F.col("attempts") >= F.col("max_attempts"), mine & (F.col("outcome") == "fail")
    state = F.when(mine & (F.col("outcome") == "complete"), "COMPLETED").when(failed, F.when(dead, "DEAD").otherwise("PENDING")).otherwise(F.col("_state"))
    lease = F.when(mine & (F.col("outcome") == "renew"), as_of + F.make_interval(secs=F.lit(lease_s))).when(mine, None).otherwise(F.col("_lease"))
    return out.select("id", "worker", "outcome", mine.alias("accepted"), state.alias("state"), lease.alias("lease_expires_at"), F.when(failed & ~dead, backoff_seconds(F.col("attempts"))).alias("wait_s"))


def poll_wait_ms(failures: Column, poll_ms: int, most_ms: int = 30_000, cap: int = 10) -> Column:
    """How long a worker waits after so many failed polls in a row."""
    return F.least(F.lit(most_ms), poll_ms * F.pow(F.lit(2), F.least(failures, F.lit(cap)))).cast("long")


def depths(jobs: DataFrame, as_of: Column) -> DataFrame:
    """queue, pending, dead, oldest_wait_s: how deep queues are and how long their oldest due job has waited."""
    due = (F.col("state") == "PENDING") & (F.col("run_after") <= as_of)
    waited = F.max(F.when(due, F.timestamp_diff("SECOND", F.col("run_after"), as_of)))
    return jobs.groupBy("queue").agg(F.count_if(F.col("state") == "PENDING").alias("pending"), F.count_if(F.col("state") == "DEAD").alias("dead"), waited.alias("oldest_wait_s"))
