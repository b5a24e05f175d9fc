"""The chain and the per-key decisions as streams: each micro-batch goes on from the state that the one before it left.

A batch writes its own folder, named by its number, with its rows and the state
after it, and overwrites it if Spark runs the batch again; what it builds on is
the state of the batch before, never the log. So a batch that is repeated after
a failure gives the same rows once, and a batch costs its own rows and the live
state, however long the stream has run. States two batches old are deleted.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import chain, folds

_LOG = "tenant long, seq long, id long, occurred_at timestamp, payload string, payload_digest string, prev_hash string, hash string, batch long"
_HEADS = "tenant long, last_seq long, last_hash string, events long"


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _started(source: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, every: str | None) -> StreamingQuery:
    """Ends when all that is there has been read, or, with an interval, goes on until it is stopped."""
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return source.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def log(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(_LOG).parquet(f"{out}/log")


def append_chain(events: DataFrame, out: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """events (tenant, id, occurred_at, payload), streamed to the chain in out/log; the tenants' heads after batch n are in out/heads/n."""

    def append(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        heads = spark.read.schema(_HEADS).parquet(f"{out}/heads/{number - 1}") if number else None
        chain.append(batch, heads).write.mode("overwrite").parquet(f"{out}/log/batch={number}")
        now = chain.heads(spark.read.schema(_LOG).parquet(f"{out}/log/batch={number}"))
        if heads is not None:
            now = heads.union(now).groupBy("tenant").agg(F.max("last_seq").alias("last_seq"), F.max_by("last_hash", "last_seq").alias("last_hash"), F.sum("events").alias("events"))
        now.write.mode("overwrite").parquet(f"{out}/heads/{number}")
        _delete(spark, f"{out}/heads/{number - 2}")

    return _started(events, append, checkpoint, every)


def decisions(spark: SparkSession, out: str, schema: str) -> DataFrame:
    """What decide() has written to out: the columns of schema and batch."""
    return spark.read.schema(f"{schema}, batch long").parquet(f"{out}/decided")


def decide(requests: DataFrame, order: list[str], schema: str, step: Callable[[tuple | None, object], tuple], expiry: Callable[[tuple], float], out: str, checkpoint: str, lateness: float = 3600.0, every: str | None = None) -> StreamingQuery:
    """requests (key string, at_s and others), streamed through step(state, row) -> (state, output row) to out/decided, in the order given within a batch.

    A key's state is left to the next batch until lateness seconds after
    expiry(state), by the newest at_s of its batch; then the key is new again, as step would find it. Requests
    more than lateness behind the newest may meet a state that is gone. A key's
    requests of a batch come in batches of rows, so memory doesn't grow with them.
    """
    names = [c.split()[0] for c in schema.split(", ")]
    whole = f"{schema}, state string, until double, of string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state, seen = None, None, False

        def left() -> list[tuple]:
            return [(*(None,) * len(names), json.dumps(state, default=float), float(expiry(state)), key)] if seen and state is not None else []

        for rows in batches:
            done = []
            for row in rows.itertuples(index=False):
                if not seen or row.key != key:
                    done += left()
                    key, state, seen = row.key, None, True
                if row.kept_state is not None:
                    state = tuple(json.loads(row.kept_state))
                    continue
                state, result = step(state, row)
                done.append((*result, None, None, None))
            yield _framed(done)
        yield _framed(left())

    def _framed(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[*names, "state", "until", "of"], dtype=object)

    def fold(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.where("key is not null").withColumn("kept_state", F.lit(None).cast("string"))
        newest = batch.agg(F.max("at_s")).first()[0]
        if number:
            kept = spark.read.schema("state string, until double, of string").parquet(f"{out}/states/{number - 1}")
            rows = rows.unionByName(kept.select(F.col("of").alias("key"), F.col("state").alias("kept_state")), allowMissingColumns=True)
        ordered = rows.repartition("key").sortWithinPartitions("key", F.col("kept_state").isNull(), *order)
        # one pass makes both; it is written once, then parted
        made = f"{out}/made/{number}"
        ordered.mapInPandas(run, whole).write.mode("overwrite").parquet(made)
        both = spark.read.schema(whole).parquet(made)
        both.where("state is null").select(*names).write.mode("overwrite").parquet(f"{out}/decided/batch={number}")
        live = both.where("state is not null").select("state", "until", "of")
        if newest is not None:  # what this batch's own requests met is decided; later ones are no older than this
            live = live.where(F.col("until") + lateness > float(newest))
        live.write.mode("overwrite").parquet(f"{out}/states/{number}")
        _delete(spark, made)
        _delete(spark, f"{out}/states/{number - 2}")

    return _started(requests, fold, checkpoint, every)


IDEMPOTENCY, RATE = "key string, id long, outcome string", "key string, id long, allowed boolean, retry_after long"


def idempotency_outcomes(requests: DataFrame, out: str, checkpoint: str, retention: float = folds.RETENTION_S, **more) -> StreamingQuery:
    """folds.idempotency_outcomes of a stream of requests (key, id, at_s, fingerprint)."""

    def step(state, row):
        state, outcome = folds.idempotency_step(state, row.at_s, row.fingerprint, retention)
        return state, (row.key, row.id, outcome)

    return decide(requests, ["at_s", "id"], IDEMPOTENCY, step, lambda state: state[0], out, checkpoint, **more)


def request_outcomes(requests: DataFrame, out: str, checkpoint: str, retention: float = folds.RETENTION_S, **more) -> StreamingQuery:
    """folds.request_outcomes of a stream of requests (key, id, at_s, kind, fingerprint)."""

    def step(state, row):
        state, outcome = folds.request_step(state, row.at_s, row.kind, row.fingerprint, retention)
        return state, (row.key, row.id, outcome)

    return decide(requests, ["at_s", "id"], IDEMPOTENCY, step, lambda state: state[0], out, checkpoint, **more)


def rate_decisions(requests: DataFrame, limit: int, out: str, checkpoint: str, window: float = folds.WINDOW_S, **more) -> StreamingQuery:
    """folds.rate_decisions of a stream of requests (key, id, at_s)."""

    def step(state, row):
        state, (allowed, wait) = folds.rate_step(state, row.at_s, limit, window)
        return state, (row.key, row.id, allowed, wait)

    return decide(requests, ["at_s", "id"], RATE, step, lambda state: state[0] + window, out, checkpoint, **more)
