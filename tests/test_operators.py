"""Guarantees on tiny fixtures."""

import datetime as dt
import hashlib
import json
import struct

import pytest
from pyspark.sql import functions as F

from ledgerline.functions import canon
from ledgerline.operators import chain, completion, folds, lineage, paging, processors, runs, search, uploads
from ledgerline.sources.tables import Scope, ScopedCatalog
from ledgerline.streaming import streams


def events(spark, n, first=0):
    at = dt.datetime(2024, 1, 1)
    rows = [(1 + i % 2, i, at + dt.timedelta(seconds=i), f'{{"k":{i}}}') for i in range(first, first + n)]
    return spark.createDataFrame(rows, "tenant long, id long, occurred_at timestamp, payload string")


def test_canonical_json():
    assert [canon.number(x) for x in (1e8, 40.0, -0.0, 1e21, 1e-7, 0.000001, 123.456, 5e-324, 1e16, -1.5)] == ["100000000", "40", "0", "1e+21", "1e-7", "0.000001", "123.456", "5e-324", "10000000000000000", "-1.5"]
    assert canon.canonicalize({"דּ": 1, "\U0001f600": 2, "a": [None, True, "€\n"]}) == '{"a":[null,true,"€\\n"],"\U0001f600":2,"דּ":1}'
    with pytest.raises(canon.NotJson):
        canon.canonicalize({"a": float("nan")})
    assert canon.digest({"b": 1, "a": 2}) == canon.digest({"a": 2, "b": 1}) != canon.digest({"a": 2, "b": "1"})


def test_cursors():
    c = paging.encode(dt.datetime(2024, 1, 2, 3, 4, 5, 678901), None, "", "é")
    assert paging.decode(c, 4) == ["2024-01-02T03:04:05.678901Z", None, "", "é"]
    for bad in ("", c[:-1], c + "=", "***", "a" * 600):
        with pytest.raises(paging.BadCursor):
            paging.decode(bad, 4)


def test_pages(spark):
    df = spark.range(3).orderBy(F.desc("id"))
    p = paging.page(df, 2, "id")
    assert [r.id for r in p.items] == [2, 1] and paging.decode(p.next_cursor, 1) == ["1"] and paging.page(df, 3, "id").next_cursor is None


@pytest.mark.parametrize("edit, at, reason", [
    ({"payload": "x"}, 3, "payload_digest"), ({"hash": "0" * 64}, 3, "hash"), ({"prev_hash": "1" * 64}, 3, "prev_hash_mismatch"), (None, 3, "sequence_gap"),
])
def test_chain_breaks(spark, edit, at, reason):
    log = chain.append(events(spark, 12))
    broken = log.where("seq <> 3") if edit is None else log.withColumns({k: F.when(F.col("seq") == 3, F.lit(v)).otherwise(F.col(k)) for k, v in edit.items()})
    assert {(r.broken_at, r.reason) for r in chain.verify(broken).collect()} == {(at, reason)}
    assert {(r.ok, r.events_verified) for r in chain.verify(log).collect()} == {(True, 6)}
    assert {(r.ok, r.events_verified) for r in chain.verify(log, 4).collect()} == {(True, 3)}


def test_chain_breaks_that_come_together(spark):
    log = chain.append(events(spark, 12)).where("tenant = 1")
    said = lambda df, *more: tuple(chain.verify(df, *more).first())[1:]
    edited = log.withColumn("payload", F.when(F.col("seq").isin(2, 5), F.lit("x")).otherwise(F.col("payload")))
    assert said(edited.where("seq <> 4"))[3:5] == (2, "payload_digest") and said(edited.where("seq not in (1, 4)"))[3:] == (1, "sequence_gap", "1", "2")
    assert said(log.where("seq not in (3, 4)"))[3:] == (3, "sequence_gap", "3", "5")
    assert said(log.union(log.where("seq = 4")))[3:] == (5, "sequence_gap", "5", "4") and said(log.union(log.where("seq = 6")))[3:] == (7, "sequence_gap", "7", "6")
    assert said(log.where("seq <> 3"), 4)[3:] == (3, "sequence_gap", "3", "4") and said(log.where("seq <> 2"), 4)[:2] == (True, 3)
    assert chain.verify(log.limit(0)).isEmpty() and chain.append(events(spark, 3).limit(0)).isEmpty()


def test_anchor_and_continued_append(spark):
    log = chain.append(events(spark, 8))
    more = chain.append(events(spark, 6, 8), chain.heads(log))
    both = log.unionByName(more)
    assert {(r.ok, r.events_verified) for r in chain.verify(both).collect()} == {(True, 7)}
    anchors = log.where("seq = 2").select("tenant", "seq", F.lit("f" * 64).alias("hash"))
    assert {(r.broken_at, r.reason) for r in chain.verify(both, 3, anchors).collect()} == {(2, "hash")}


def test_checkpoints_follow_verified_logs(spark):
    log = chain.append(events(spark, 24))
    none = log.limit(0).select("tenant", F.col("seq").alias("through_seq"), F.col("hash").alias("chain_hash"))
    made, broken = chain.checkpointed(log, none)
    assert sorted(tuple(r)[:2] for r in made.collect()) == [(1, 12), (2, 12)] and broken.isEmpty()
    seventh = log.where("seq = 7").select("tenant", F.col("seq").alias("through_seq"), F.col("hash").alias("chain_hash"))
    assert chain.checkpointed(log, seventh, 6)[0].isEmpty() and chain.checkpointed(log, seventh, 5)[0].count() == chain.checkpointed(log, seventh, 6, force=True)[0].count() == 2
    before = log.withColumn("payload", F.when((F.col("seq") == 3) & (F.col("tenant") == 1), F.lit("x")).otherwise(F.col("payload")))
    assert chain.checkpointed(before, seventh, 5)[0].count() == 2  # behind the last checkpoint only
    made, broken = chain.checkpointed(before.where("tenant = 1 or seq <> 9"), none)
    assert made.isEmpty() and sorted(map(tuple, broken.collect())) == [(1, 3, "payload_digest"), (2, 9, "sequence_gap")]
    false_ = seventh.withColumn("chain_hash", F.when(F.col("tenant") == 2, F.lit("f" * 64)).otherwise(F.col("chain_hash")))
    made, broken = chain.checkpointed(log, false_, 5)
    assert [r.tenant for r in made.collect()] == [1] and [tuple(r) for r in broken.collect()] == [(2, 7, "hash")]
    assert json.loads(made.first().payload) == {"chainHash": made.first().chain_hash, "eventCount": "12", "externalRef": None, "throughSeq": "12"}


def test_completed_uploads_reach_the_log(spark):
    one = lambda rows, schema: spark.createDataFrame(rows, schema)
    d = [c * 64 for c in "abc"]
    entries = one([(1, 7, "x", d[0], 3, "PENDING", None), (2, 7, "y", d[1], 3, "PENDING", None), (3, 7, "z", d[2], 3, "PENDING", None), (4, 8, "x", d[0], 3, "PENDING", None)], "id long, run long, name string, digest string, size long, verification string, artifact long")
    runs_, asked = one([(7, "OPEN"), (8, "OPEN"), (9, "SEALED")], "run long, state string"), spark.range(1, 5)
    sessions = one([(i, "OPEN", 1) for i in range(1, 5)], "id long, state string, total_parts long")
    parts = one([(i, 1, "e") for i in range(1, 5)], "id long, part_number long, etag string")
    stored = one([(1, 3, 3, d[0]), (2, 3, 3, d[2]), (3, 3, 3, d[2]), (4, 3, 3, d[0])], "id long, head_size long, read_size long, read_digest string")
    artifacts = one([], "digest string, artifact long")
    done = completion.completed(asked, entries, runs_, sessions, parts, stored, artifacts)
    assert {r.id: (r.outcome, r.artifact) for r in done.outcomes.collect()} == {1: ("verified", 1), 2: ("digest_mismatch", None), 3: ("run_not_open", None), 4: ("verified", 1)}
    assert {r.run: r.state for r in done.runs.collect()} == {7: "QUARANTINED", 8: "OPEN", 9: "SEALED"} and {r.id: r.state for r in done.sessions.collect()} == {1: "COMPLETED", 2: "ABORTED", 3: "OPEN", 4: "COMPLETED"}
    assert [(r.artifact, r.first_seen_run) for r in done.artifacts.collect()] == [(1, 7)] and {r.id: r.verification for r in done.entries.collect()} == {1: "VERIFIED", 2: "REJECTED", 3: "PENDING", 4: "VERIFIED"}
    ready, refused = chain.prepared(done.events.withColumns({"tenant": F.lit(1).cast("long"), "id": F.col("id") * 2 + F.col("place"), "occurred_at": F.lit("2024-01-01").cast("timestamp")}))
    log = chain.append(ready)
    assert refused.isEmpty() and log.count() == 4 and chain.verify(log).first().ok
    again = completion.completed(asked, done.entries, done.runs, done.sessions, parts, stored, done.artifacts.select("digest", "artifact"))
    assert {r.id: r.outcome for r in again.outcomes.collect()} == {1: "done", 2: "run_not_open", 3: "run_not_open", 4: "done"} and again.events.isEmpty()


def test_stream_appends_a_chain(spark, tmp_path):
    for k in range(3):
        events(spark, 10, 10 * k).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    source = spark.readStream.schema("tenant long, id long, occurred_at timestamp, payload string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    streams.append_chain(source, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    log = streams.log(spark, str(tmp_path / "out"))
    assert log.count() == 30 and {(r.ok, r.events_verified) for r in chain.verify(log.drop("batch")).collect()} == {(True, 15)}


@pytest.mark.parametrize("kind", ["idempotency", "request", "rate"])
def test_streamed_decisions_are_those_of_one_batch(spark, tmp_path, kind):
    kinds = ("begin", "begin", "complete", "fail")
    rows = [(f"k{i * 7 % 5}", i, 20.0 * i, kinds[i * i % 4], "ab"[i % 11 == 0]) for i in range(90)]
    schema = "key string, id long, at_s double, kind string, fingerprint string"
    requests = spark.createDataFrame(rows, schema)
    for k in range(3):
        requests.where(f"id >= {30 * k} and id < {30 * k + 30}").coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    out, cp = str(tmp_path / "out"), str(tmp_path / "cp")
    ours, whole, said = {
        "idempotency": (lambda: streams.idempotency_outcomes(source, out, cp, 300, lateness=0), folds.idempotency_outcomes(requests, 300), streams.IDEMPOTENCY),
        "request": (lambda: streams.request_outcomes(source, out, cp, 300, lateness=0), folds.request_outcomes(requests, 300), streams.IDEMPOTENCY),
        "rate": (lambda: streams.rate_decisions(source, 2, out, cp, 400, lateness=0), folds.rate_decisions(requests, 2, 400), streams.RATE),
    }[kind]
    query = ours()
    assert query.awaitTermination(120) and query.exception() is None
    got = streams.decisions(spark, out, said)
    assert sorted(map(tuple, got.drop("batch").collect())) == sorted(map(tuple, whole.collect())) and got.select("batch").distinct().count() == 3
    assert sorted(p.name for p in (tmp_path / "out/states").iterdir()) == ["1", "2"]
    assert len({r[2:] for r in got.drop("batch").collect()}) > 1


def test_folds():
    state, said = folds.idempotency_step(None, 0, "a")
    assert said == "owned" and folds.idempotency_step(state, 5, "a")[1] == "replay" and folds.idempotency_step(state, 5, "b")[1] == "reused" and folds.idempotency_step(state, 86400, "b")[1] == "owned"
    state, said = folds.rate_step(None, 100, 1)
    assert said == (True, 0) and folds.rate_step(state, 130.5, 1)[1] == (False, 30) and folds.rate_step(state, 160, 1)[1] == (True, 0)


def test_scope(spark, tmp_path):
    events(spark, 4).write.parquet(str(tmp_path / "e.parquet"))
    c = ScopedCatalog(spark, str(tmp_path), {"e": "tenant"})
    assert [c.read("e", Scope(t)).count() for t in (1, 9, None)] == [2, 0, 0] and c.check_write(events(spark, 4), "e", Scope(1)).count() == 2


def test_sniffing(spark):
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", 7, 9) + b"\x08\x02"
    tiff = b"II" + struct.pack("<HIH", 42, 8, 2) + struct.pack("<HHIHH", 0x100, 3, 1, 5, 0) + struct.pack("<HHII", 0x101, 4, 1, 6)
    contents = [png, tiff, b"a,b\n1,2\n", b"a\tb\n\nc\td\r", b"one, two\nthree", b"\xef\xbb\xbf", b"", b"\0", b"\xff\xfe", tiff[:30], b"II*\0", png[:25], None]
    df = spark.createDataFrame([(i, "r", f"n{i:02d}", "0", "x/y", len(c or b""), c) for i, c in enumerate(contents)], "i int, run string, name string, digest string, media_type string, size long, content binary")
    got = [{k: v for k, v in r.s.asDict().items() if v is not None} for r in df.orderBy("i").select(uploads.sniff("content").alias("s")).collect()]
    text = lambda n, mark=None, columns=None: {"kind": "text", "line_count": n} | ({"delimiter": mark, "column_count": columns} if mark else {})
    assert got[:6] == [{"kind": "png", "width": 7, "height": 9, "bit_depth": 8, "colour_type": 2}, {"kind": "tiff", "width": 5, "height": 6, "byte_order": "little"}, text(2, ",", 2), text(3, "\t", 2), text(2), text(0)]
    assert got[6:] == [{"kind": "unknown"}] * 7
    made = json.loads(processors.REGISTRY["metadata-extract"].run(df.withColumn("size", F.when(F.col("i") == 2, 1 << 25).otherwise(F.col("size")))).first().content)
    assert [a["metadata"] for a in made["artifacts"]][:5] == [
        {"bitDepth": 8, "colorType": 2, "height": 9, "type": "png", "width": 7}, {"byteOrder": "little", "height": 6, "type": "tiff", "width": 5}, {"inspected": False, "type": "unknown"},
        {"columnCount": 2, "delimiter": "\t", "lineCount": 3, "type": "text"}, {"columnCount": None, "delimiter": None, "lineCount": 2, "type": "text"},
    ]
    assert made["recognisedCount"] == 5 and canon.canonicalize(made) == processors.REGISTRY["metadata-extract"].run(df.withColumn("size", F.when(F.col("i") == 2, 1 << 25).otherwise(F.col("size")))).first().content
    marks = spark.createDataFrame([("a,b\n1,2\n",), ("a\tb",), ("a;b\nc",), ("x|y\n\nz|w",)], "t string")
    assert [r[0] for r in marks.select(uploads.delimiter(F.col("t"))).collect()] == [",", "\t", None, "|"]
    assert hashlib.sha256(b"abc").hexdigest() == spark.range(1).select(F.sha2(F.lit("abc"), 256)).first()[0]


def test_lineage_refuses_depths(spark):
    edges = spark.createDataFrame([(2, 1, "a", "r")], "source long, target long, derivation string, role string")
    for depth in (0, 33):
        with pytest.raises(ValueError):
            lineage.walk(edges, spark.createDataFrame([(2,)], "artifact long"), depth)


def test_search_pages_and_reads(spark):
    rows = [(i, i % 3, None if i % 4 == 0 else dt.datetime(2024, 1, 1 + i % 5)) for i in range(40)]
    runs_ = spark.createDataFrame(rows, "run_id long, study long, acquired_at timestamp")
    seen, cursor = [], None
    while page := search.search(runs_, search.Wanted(cursor=cursor), limit=7).collect():
        seen += [r.run_id for r in page]
        cursor = (page[-1].acquired_at, page[-1].run_id)
    assert len(seen) == len(set(seen)) == 40 and [rows[i][2] is None for i in seen] == [True] * 10 + [False] * 30
    with pytest.raises(ValueError):
        search.search(runs_, search.Wanted(), limit=201)
    with pytest.raises(search.NotFound):
        search.one(runs_, "run_id", 99)
    assert search.one(runs_, "run_id", 5).count() == 1
    nobody = search.visible_studies(Scope(1, None, None), runs_, runs_, runs_)
    assert search.matching(runs_, search.Wanted(), nobody).isEmpty()


def test_registration_seal_and_quarantine(spark):
    asked = spark.createDataFrame([(1, 1, None), (2, 1, "x"), (3, 1, None)], "run long, study long, reason string")
    problems = spark.createDataFrame([(1, None), (2, "study_closed"), (3, None)], "run long, problem string")
    entries = spark.createDataFrame([(1, "a", "0" * 64, "1"), (2, "a", "0" * 64, "1"), (3, "a b", "0" * 64, "1")], "run long, name string, digest string, size string")
    bad = runs.manifest_problems(entries)
    assert [tuple(r) for r in bad.collect()] == [(3, "name")]
    made, own, events_ = runs.registered(asked, entries, problems, bad, F.lit("2024-01-01").cast("timestamp"))
    assert [(r.run, r.state) for r in made.collect()] == [(1, "OPEN")] and own.count() == events_.count() == 1
    rejected, states = runs.quarantined(own, own.select("run", "name"), "digest")
    assert [r.verification for r in rejected.collect()] == ["REJECTED"] and [r.state for r in states.collect()] == ["QUARANTINED"]
    again = runs.moved(spark.createDataFrame([(1, "QUARANTINED")], "run long, state string"), spark.createDataFrame([(1, "QUARANTINED")], "run long, to string"), F.lit("2024-01-01").cast("timestamp")).first()
    assert again.accepted and again.at is None
    later = runs.superseding(spark.createDataFrame([(9, 1, "r"), (8, 2, "r"), (7, 7, "r"), (6, 1, None), (5, 4, "r")], "run long, supersedes long, reason string"), spark.createDataFrame([(1, "SEALED"), (2, "ABANDONED")], "run long, state string"))
    assert {r.run: r.problem for r in later.collect()} == {9: None, 8: "open", 7: "self", 6: "no_reason", 5: "not_found"}


def test_canonical_survives_bad_rows(spark):
    rows = spark.createDataFrame([('{"b":1,"a":[1e3]}',), ("{",), (None,), ("1" + "0" * 400,), ("[NaN]",)], "t string")
    out = [(r.c.canonical, r.c.problem is None) for r in rows.select(canon.canonical(F.col("t")).alias("c")).collect()]
    assert out == [('{"a":[1000],"b":1}', True), (None, False), (None, True), (None, False), (None, False)]


def test_request_states():
    step = folds.request_step
    state, said = step(None, 0, "begin", "a")
    assert said == "owned" and step(state, 1, "begin", "a")[1] == "in_flight" and step(state, 1, "begin", "b")[1] == "reused"
    done, said = step(state, 2, "complete", "a")
    assert said == "completed" and step(done, 3, "begin", "a")[1] == "replay" and step(done, 3, "fail", "a") == (done, "unknown")
    assert step(state, 2, "fail", "a") == (None, "released") and step(done, 86400, "begin", "b")[1] == "owned" and step(None, 0, "fail", "a") == (None, "unknown")
