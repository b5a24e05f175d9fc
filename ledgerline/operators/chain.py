"""Hash-chained audit logs.

append() folds each tenant's new events in order, as every hash needs the one
before; verify() needs no fold: a row is checked by itself and its stored
predecessor, which it meets by an equi-join, and the first failure is a
minimum. So a tenant's log is verified by all tasks. The two share no code.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.canon import canonical
from ..functions.digests import GENESIS, micros_text

ACTION = r"^[a-z]+(_[a-z]+)*\.[a-z]+(_[a-z]+)*$"


def append(events: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """events (tenant, id, occurred_at, payload) with seq, payload_digest, prev_hash, hash; heads: tenant, last_seq, last_hash before them.

    Rows without a tenant are left out. A tenant's new events go through one task
    in order of time, id and payload, as their hashes depend on each other, in
    batches of rows: time grows with their number, memory doesn't.
    """
    rows = events.where("tenant is not null").select("tenant", "id", "occurred_at", "payload", F.sha2(F.coalesce("payload", F.lit("")), 256).alias("payload_digest"))
    rows = rows.withColumns({"last_seq": F.lit(None).cast("long"), "last_hash": F.lit(None).cast("string")})
    if heads is not None:
        rows = rows.unionByName(heads.select("tenant", F.col("last_seq").cast("long").alias("last_seq"), "last_hash"), allowMissingColumns=True)
    rows = rows.withColumns({"owner": F.col("tenant").cast("string"), "at": micros_text(F.col("occurred_at"))})
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    out = ["tenant", "id", "occurred_at", "payload", "payload_digest"]
    schema = ", ".join(f"{c} {types[c]}" for c in out) + ", seq long, prev_hash string, hash string"

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seq, last = None, 0, GENESIS
        for batch in batches:
            seqs, before, made = [], [], []
            for owner, at, digest, last_seq, last_hash in zip(*(batch.column(c).to_pylist() for c in ("owner", "at", "payload_digest", "last_seq", "last_hash")), strict=True):
                if owner != own:
                    own, seq, last = owner, 0, GENESIS
                if last_seq is not None:
                    seq, last = last_seq, last_hash
                    continue
                seq += 1
                before.append(last)
                last = hashlib.sha256("|".join(x for x in (owner, str(seq), last, digest, at) if x is not None).encode()).hexdigest()
                seqs.append(seq)
                made.append(last)
            kept = batch.filter(pc.is_null(batch.column("last_seq")))
            yield pa.RecordBatch.from_arrays([*(kept.column(c) for c in out), pa.array(seqs, pa.int64()), pa.array(before, pa.string()), pa.array(made, pa.string())], [*out, "seq", "prev_hash", "hash"])

    # a head comes before its tenant's events
    ordered = rows.repartition("tenant").sortWithinPartitions("tenant", F.col("last_seq").desc_nulls_last(), "occurred_at", "id", "payload")
    return ordered.mapInArrow(link, schema).select("tenant", "seq", "id", "occurred_at", "payload", "payload_digest", "prev_hash", "hash")


def prepared(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """events (tenant, id, action, payload and others) with their payloads in canonical form, ready for append(); and those refused, with problem, the first that holds: tenant (none), action (not of the form noun.verb) or payload (not JSON, or none)."""
    rows = events.withColumn("_c", canonical(F.col("payload")))
    problem = F.when(F.col("tenant").isNull(), "tenant").when(~F.coalesce(F.col("action").rlike(ACTION), F.lit(False)), "action").when(F.col("_c.canonical").isNull(), "payload")
    rows = rows.withColumns({"problem": problem, "payload": F.coalesce("_c.canonical", "payload")}).drop("_c")
    return rows.where("problem is null").drop("problem"), rows.where("problem is not null")


def verify(log: DataFrame, from_seq: int | DataFrame = 1, anchors: DataFrame | None = None) -> DataFrame:
    """tenant, ok, events_verified, head_hash, broken_at, reason, expected, actual for each tenant in log.

    Reasons, the first that holds: sequence_gap, payload_digest, prev_hash_mismatch,
    hash. A number that occurs twice is a gap before its second row, which should
    have the next one. anchors (tenant, seq, hash) are checkpoints that the row
    before from_seq must match. A deleted tail and a consistent rewrite without
    anchor go unseen. from_seq may be a frame (tenant, from_seq) with a row per
    tenant at most; tenants without one begin at 1.
    """
    if isinstance(from_seq, DataFrame):
        log = log.join(from_seq.select("tenant", F.col("from_seq").cast("long").alias("since")), "tenant", "left").withColumn("since", F.coalesce("since", F.lit(1).cast("long")))
    else:
        log = log.withColumn("since", F.lit(from_seq).cast("long"))
    log = log.where(F.col("seq") >= F.col("since") - 1)
    start = F.greatest(F.lit(1).cast("long"), F.col("since") - 1)
    said = lambda reason, want, got: F.struct(F.lit(reason).alias("reason"), want.cast("string").alias("expected"), got.cast("string").alias("actual"))
    digest = F.sha2(F.coalesce("payload", F.lit("")), 256)
    stamp = F.date_format("occurred_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    made = F.sha2(F.array_join(F.array(F.col("tenant").cast("string"), F.col("seq").cast("string"), F.col("prev_hash"), F.col("payload_digest"), stamp), "|"), 256)
    # what a row shows by itself is found before the join, which so moves no payloads
    rows = log.select(
        "tenant", "seq", "prev_hash", "hash", "since",
        F.when(digest != F.col("payload_digest"), said("payload_digest", digest, F.col("payload_digest"))).alias("content"),
        F.when(made != F.col("hash"), said("hash", made, F.col("hash"))).alias("link"),
    )
    if anchors is not None:
        known = anchors.select("tenant", "seq", F.col("hash").alias("anchored"))
        rows = rows.join(known, ["tenant", "seq"], "left")
        rows = rows.withColumn("anchor", F.when((F.col("seq") == F.col("since") - 1) & (F.col("anchored") != F.col("hash")), said("hash", F.col("anchored"), F.col("hash")))).drop("anchored")
    else:
        rows = rows.withColumn("anchor", F.lit(None).cast("struct<reason string, expected string, actual string>"))
    prior = log.groupBy(F.col("tenant").alias("owner"), F.col("seq").alias("last")).agg(F.min("hash").alias("before"), F.count(F.lit(1)).alias("copies"))
    rows = rows.withColumn("here", F.lit(True)).join(prior, F.col("tenant").eqNullSafe(F.col("owner")) & (F.col("seq") == F.col("last") + 1), "full")
    here, inside = F.col("here").isNotNull(), F.col("seq") >= F.col("since")
    prev = F.when(F.col("seq") == 1, F.lit(GENESIS)).otherwise(F.col("before"))
    unlike = F.when(prev != F.col("prev_hash"), said("prev_hash_mismatch", prev, F.col("prev_hash")))
    fault = F.coalesce(F.when(inside, F.coalesce("content", unlike, "link")), "anchor")
    rows = rows.select(
        F.when(here, F.col("tenant")).otherwise(F.col("owner")).alias("tenant"), "seq", "hash", "since", inside.alias("inside"),
        F.when(fault.isNotNull(), F.struct("seq", fault.alias("fault"))).alias("own"),
        F.when(here & F.col("last").isNull() & (F.col("seq") != start), F.col("seq")).alias("orphan"),
        F.when(~here, F.col("last")).alias("end"),
        F.when(F.col("copies") > 1, F.col("last")).alias("twice"),
    )
    out = rows.groupBy("tenant").agg(
        F.min("own").alias("own"), F.min("seq").alias("first"), F.min("orphan").alias("orphan"), F.min("end").alias("end"), F.min("twice").alias("twice"),
        F.count_if("inside").alias("n"), F.max_by("hash", "seq").alias("head"), F.max("since").alias("since"),
    )
    # the first row behind a gap, and the number that it should have; all before it are in sequence
    gap = F.when(F.col("first") != start, F.struct(F.col("first").alias("seq"), F.lit(0).alias("k"), start.alias("want")))
    gap = gap.when(F.col("orphan").isNotNull(), F.struct(F.col("orphan").alias("seq"), F.lit(0).alias("k"), (F.col("end") + 1).alias("want")))
    again = F.when(F.col("twice").isNotNull(), F.struct(F.col("twice").alias("seq"), F.lit(2).alias("k"), (F.col("twice") + 1).alias("want")))
    out = out.withColumn("gap", F.least(gap, again))  # of one number, a gap before its first row goes before it
    out = out.withColumn("f", F.when(F.col("own").isNotNull() & (F.col("gap").isNull() | (F.struct("own.seq", F.lit(1).alias("k")) < F.struct("gap.seq", "gap.k"))), F.struct(F.col("own.seq").alias("at"), F.col("own.fault").alias("fault"))).when(F.col("gap").isNotNull(), F.struct(F.col("gap.want").alias("at"), said("sequence_gap", F.col("gap.want"), F.col("gap.seq")).alias("fault"))))
    ok = F.col("f").isNull()
    return out.select("tenant", ok.alias("ok"), F.when(ok, F.col("n")).alias("events_verified"), F.when(ok, F.col("head")).alias("head_hash"), F.col("f.at").alias("broken_at"), F.col("f.fault.reason").alias("reason"), F.col("f.fault.expected").alias("expected"), F.col("f.fault.actual").alias("actual"))


def heads(log: DataFrame) -> DataFrame:
    """tenant, last_seq, last_hash, events."""
    return log.groupBy("tenant").agg(F.max("seq").alias("last_seq"), F.max_by("hash", "seq").alias("last_hash"), F.count(F.lit(1)).alias("events"))


def due_checkpoints(log: DataFrame, checkpoints: DataFrame, least: int = 50, force: bool = False) -> DataFrame:
    """tenant, through_seq, chain_hash, event_count: heads of tenants without a checkpoint, or with at least so many events since their last one (tenant, through_seq); all of them if forced."""
    last = checkpoints.groupBy("tenant").agg(F.max("through_seq").alias("_through"))
    now = heads(log).join(last, "tenant", "left")
    due = F.col("_through").isNull() | (F.col("last_seq") - F.col("_through") >= least)
    return now.where(F.lit(force) | due).select("tenant", F.col("last_seq").alias("through_seq"), F.col("last_hash").alias("chain_hash"), F.col("events").alias("event_count"))


def checkpointed(log: DataFrame, checkpoints: DataFrame, least: int = 50, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """New checkpoints (tenant, through_seq, chain_hash, event_count, action and payload of their audit events), and tenants whose log is broken behind their last checkpoint (tenant, broken_at, reason), who get none.

    checkpoints: tenant, through_seq, chain_hash. A log is verified from the row
    behind its last checkpoint, which that row's predecessor must match.
    """
    last = checkpoints.groupBy("tenant").agg(F.max(F.struct("through_seq", "chain_hash")).alias("c")).select("tenant", F.col("c.through_seq").alias("seq"), F.col("c.chain_hash").alias("hash"))
    due = due_checkpoints(log, checkpoints, least, force)
    said = verify(log.join(due.select("tenant"), "tenant", "left_semi"), last.select("tenant", (F.col("seq") + 1).alias("from_seq")), last)
    text = F.to_json(F.struct(F.col("chain_hash").alias("chainHash"), F.col("event_count").cast("string").alias("eventCount"), F.lit(None).cast("string").alias("externalRef"), F.col("through_seq").cast("string").alias("throughSeq")), {"ignoreNullFields": "false"})
    made = due.join(said.where("ok").select("tenant"), "tenant", "left_semi").withColumns({"action": F.lit("audit.checkpointed"), "payload": text})
    return made, said.where("not ok").select("tenant", "broken_at", "reason")
