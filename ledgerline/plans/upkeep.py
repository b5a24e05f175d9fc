"""Queries over uploads, the job queue, idempotent requests, processors and scalar forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import canon, digests
from ..operators import chain, completion, folds, jobs, processors, uploads
from ..sources.tables import table
from .catalog import _ORDERED, _seconds, query


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), digests.sha256(F.col("text")).alias("digest"), F.octet_length("text").cast("long").alias("size"))


@query("""with t as (select doc_id as id, sha256(text) as digest, octet_length(encode(text)) as size from documents), a as (select digest, min(id) as artifact, any_value(size) as size from t where id % 3 = 0 group by digest)
select t.id, case when a.digest is not null and (t.id % 10 <> 1) then 'present' when a.digest is not null then 'size_mismatch' when t.id % 4 = 1 then 'resume' else 'open' end as action, a.artifact from t left join a on a.digest = t.digest""")
def upload_begin(spark, d):
    t = _texts(spark, d)
    stored = t.where("id % 3 = 0").groupBy("digest").agg(F.min("id").alias("artifact"), F.first("size").alias("size"))
    entries = t.withColumn("size", F.when(F.col("id") % 10 == 1, F.col("size") + 1).otherwise(F.col("size")))
    sessions = t.select("id", F.when(F.col("id") % 4 == 1, "OPEN").otherwise("COMPLETED").alias("state"))
    return uploads.begun(entries, stored, sessions).select("id", "action", "artifact")


@query("""with r as (select event_id % 50 as id, event_id % 7 + 1 as part_number, arg_max('r' || event_id, event_id) as etag from events group by 1, 2), p as (select user_id % 50 as id, event_id % 9 + 1 as part_number, max(event_id) as e from events group by 1, 2)
select coalesce(r.id, p.id) as id, coalesce(r.part_number, p.part_number) as part_number, coalesce('p' || p.e, r.etag) as etag from r full join p on r.id = p.id and r.part_number = p.part_number""")
def upload_parts_resolved(spark, d):
    e, key = table(spark, d, "events"), F.col("event_id")
    quoted = lambda tag, c: F.concat(F.lit(f'"{tag}'), c.cast("string"), F.lit('"'))
    recorded = e.groupBy((key % 50).alias("id"), (key % 7 + 1).alias("part_number")).agg(F.max_by(quoted("r", key), key).alias("etag"))
    provided = e.groupBy((F.col("user_id") % 50).alias("id"), (key % 9 + 1).alias("part_number")).agg(quoted("p", F.max(key)).alias("etag"))
    return uploads.resolved_parts(recorded, provided)


@query("select x.id, cast(x.id % 9 + 1 as bigint) as total_parts, count(distinct e.event_id % 7) as recorded from range(60) x(id) left join events e on e.event_id % 50 = x.id group by x.id")
def upload_parts_recorded(spark, d):
    parts = table(spark, d, "events").select((F.col("event_id") % 50).alias("id"), (F.col("event_id") % 7).alias("part_number"), F.col("props").alias("etag"), F.col("ts").alias("at"))
    return uploads.recorded_parts(parts, spark.range(60).select("id", (F.col("id") % 9 + 1).alias("total_parts")))


@query("with t as (select doc_id as id, sha256(text) as digest from documents), a as (select digest, min(id) + 1000000 as artifact from t where id % 3 = 0 group by digest), f as (select digest, min(id) as first from t where id % 2 = 1 group by digest) select t.id, coalesce(a.artifact, f.first) as artifact, a.artifact is null and t.id = f.first as created from t join f on f.digest = t.digest left join a on a.digest = t.digest where t.id % 2 = 1")
def upload_bind(spark, d):
    t = _texts(spark, d)
    stored = t.where("id % 3 = 0").groupBy("digest").agg((F.min("id") + 1000000).alias("artifact"))
    return uploads.bound(t.where("id % 2 = 1"), stored).select("id", "artifact", "created")


@query("select doc_id as id, part_number from documents, range(1, doc_id % 9 * 100 + 2) t(part_number) where doc_id < 50 and part_number % 2 = 0 and part_number <= 1024")
def upload_presigned(spark, d):
    parts = table(spark, d, "documents").where("doc_id < 50").select(F.col("doc_id").alias("id"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("doc_id") % 9 * 100 + 1)).alias("part_number"))
    return uploads.to_presign(parts.where("part_number % 2 = 0"))


@query("select doc_id, case when doc_id % 5 = 0 then 'size' when doc_id % 3 = 0 then 'object_too_large' end as problem from documents")
def part_plan_problems(spark, d):
    size = F.when(F.col("doc_id") % 5 == 0, -1).when(F.col("doc_id") % 3 == 0, (5 << 30) * 10_000 + 1).otherwise(F.col("doc_id"))
    return table(spark, d, "documents").select("doc_id", uploads.plan_problem(size.cast("long")).alias("problem"))


@query("""select p_partkey, p_brand as logical_name, case when p_size % 2 = 0 then 'parts' else 'complete' end as operation, p_name as download, sha256(p_name) || '.bin' as fallback, p_brand as etag from part""")
def name_forms(spark, d):
    path = F.concat("p_brand", F.when(F.col("p_size") % 2 == 0, "/parts").otherwise("/complete"))
    name, operation = uploads.suffix_split(path)
    none = F.lit(None).cast("string")
    digest = digests.sha256(F.col("p_name"))
    return table(spark, d, "part").select(
        "p_partkey", name.alias("logical_name"), operation.alias("operation"), uploads.download_name(F.concat(F.lit("a/b/"), "p_name"), digest).alias("download"), uploads.download_name(none, digest).alias("fallback"),
        uploads.unquoted(F.concat(F.lit('"'), "p_brand", F.lit('"'))).alias("etag"),
    )


_DONE = """with t as (select doc_id as id, doc_id // 4 as run, sha256(text) as digest, octet_length(encode(text)) as size, doc_id % 9 + 1 as parts from documents),
s as (select *, id % 3 = 0 as missing, case when id % 17 = 0 then size + 1 else size end as head, case when id % 19 = 0 then size + 2 else size end as read, case when id % 13 = 0 then sha256(digest) else digest end as got from t),
o as (select *, case when id % 23 = 0 then 'done' when run % 11 = 0 then 'run_not_open' when id % 7 = 0 then 'no_session' when id % 29 = 0 and parts > 1 then 'missing_parts' when id % 31 = 0 then 'object_missing'
  when head <> size or read <> size then 'size_mismatch' when got <> digest then 'digest_mismatch' else 'verified' end as o from s),
c as (select run, min(id) as c from o where o in ('size_mismatch', 'digest_mismatch') group by run),
f as (select o.*, case when o <> 'done' and id > c then 'run_not_open' else o end as outcome from o left join c using (run)),
r as (select *, case when outcome = 'size_mismatch' and head <> size then 'stored size ' || head || ' does not match the declared size ' || size when outcome = 'size_mismatch' then 'read back ' || read || ' bytes for a declared size of ' || size
  when outcome = 'digest_mismatch' then 'stored bytes hash to ' || got || ', declared ' || digest end as reason, case when outcome = 'done' then id + 5000000 when outcome = 'verified' then min(case when outcome = 'verified' then id end) over (partition by digest) end as artifact from f)"""


def _completion(spark: SparkSession, d: str) -> completion.Completion:
    key, t = F.col("id"), _texts(spark, d)
    entries = t.withColumns({"run": F.floor(key / 4), "name": F.concat(F.lit("n"), key), "verification": F.when(key % 23 == 0, "VERIFIED").otherwise("PENDING"), "artifact": F.when(key % 23 == 0, key + 5000000)})
    runs = entries.groupBy("run").agg(F.max(F.when(F.col("run") % 11 == 0, "SEALED").otherwise("OPEN")).alias("state"))
    sessions = t.select("id", F.when(key % 7 == 0, "ABORTED").otherwise("OPEN").alias("state"), (key % 9 + 1).alias("total_parts"))
    part = F.col("part_number")
    parts = sessions.select("id", F.explode(F.sequence(F.lit(1).cast("long"), "total_parts")).alias("part_number")).where((key % 29 != 0) | (part != 2)).withColumn("etag", F.lit("e"))
    size, digest = F.col("size"), F.col("digest")
    stored = t.where(key % 31 != 0).select("id", F.when(key % 17 == 0, size + 1).otherwise(size).alias("head_size"), F.when(key % 19 == 0, size + 2).otherwise(size).alias("read_size"), F.when(key % 13 == 0, digests.sha256(digest)).otherwise(digest).alias("read_digest"))
    none = spark.createDataFrame([], "digest string, artifact long")
    return completion.completed(t, entries, runs, sessions, parts, stored, none)


@query(f"{_DONE} select id, run, outcome, reason, artifact from r")
def upload_completions(spark, d):
    return _completion(spark, d).outcomes


@query(f"""{_DONE}, k as (select *, substr(digest, 1, 2) || '/' || substr(digest, 3, 2) as dirs, '"logicalName":"n' || id || '"' as n, '"runId":"' || run || '"' as u, '"reason":"' || reason || '"' as w from r)
select run, id, 0 as place, 'artifact.verified' as action, cast(id as varchar) as target, '{{"artifactId":"' || artifact || '","digest":"' || digest || '",' || n || ',' || u || ',"sizeBytes":"' || read || '","storageKey":"sha256/' || dirs || '/' || digest || '","verifiedBy":"read-back-sha256"}}' as payload from k where outcome = 'verified'
union all select run, id, 0, 'run.quarantined', cast(run as varchar), '{{' || n || ',' || w || ',' || u || '}}' from k where reason is not null
union all select run, id, 1, 'artifact.rejected', cast(id as varchar), '{{' || case when outcome = 'digest_mismatch' then '"computedDigest":"' || got || '",' else '' end || '"declaredDigest":"' || digest || '","declaredSize":"' || size || '",' || n || ',' || w || ',' || u || case when outcome = 'size_mismatch' then ',"storedSize":"' || case when head <> size then head else read end || '"' else '' end || '}}' from k where reason is not null""")
def upload_events(spark, d):
    return _completion(spark, d).events


@query(f"{_DONE} select id, case when id % 23 = 0 or outcome = 'verified' then 'VERIFIED' when reason is not null then 'REJECTED' else 'PENDING' end as verification, artifact, reason as rejection_reason from r")
def upload_entries_after(spark, d):
    return _completion(spark, d).entries.select("id", "verification", "artifact", "rejection_reason")


# --- queue -----------------------------------------------------------------------

@query("""with w as (select event_id as id, user_id as tenant, event_type as queue, case when event_id % 6 <> 0 then event_id % 3 end as key from events) select min(id) as id, tenant, queue, key from w where key is not null and (tenant, queue, key) not in (select tenant, queue, key from w where key is not null and id % 10 = 0) group by tenant, queue, key
union all select id, tenant, queue, key from w where key is null""")
def job_enqueue(spark, d):
    e, key = table(spark, d, "events"), F.col("event_id")
    wanted = e.select(key.alias("id"), F.col("user_id").alias("tenant"), F.col("event_type").alias("queue"), F.when(key % 6 != 0, key % 3).alias("key"))
    return jobs.enqueued(wanted, wanted.where("id % 10 = 0"))


@query("""with j as (select o_orderkey as id, o_orderkey % 4 = 0 as mine, case o_orderkey % 3 when 0 then 'complete' when 1 then 'renew' else 'fail' end as outcome, o_orderkey % 5 + 1 as attempts from orders)
select id, mine as accepted, case when not mine then 'ACTIVE' when outcome = 'complete' then 'COMPLETED' when outcome = 'renew' then 'ACTIVE' when attempts >= 5 then 'DEAD' else 'PENDING' end as state, case when mine and outcome = 'fail' and attempts < 5 then cast(5 * power(2, attempts - 1) as bigint) end as wait_s from j""")
def job_reports(spark, d):
    key = F.col("o_orderkey")
    queue = table(spark, d, "orders").select(key.alias("id"), F.lit("ACTIVE").alias("state"), F.when(key % 4 == 0, "w1").otherwise("w2").alias("claimed_by"), (key % 5 + 1).alias("attempts"), F.lit(5).alias("max_attempts"), F.lit("2024-01-01").cast("timestamp").alias("lease_expires_at"))
    reports = table(spark, d, "orders").select(key.alias("id"), F.lit("w1").alias("worker"), F.when(key % 3 == 0, "complete").when(key % 3 == 1, "renew").otherwise("fail").alias("outcome"))
    return jobs.fenced(queue, reports, F.lit("2024-01-01").cast("timestamp")).select("id", "accepted", "state", "wait_s")


@query("""select o_orderpriority as queue, count(*) filter (o_orderstatus = 'P') as pending, count(*) filter (o_orderstatus = 'F') as dead, max(case when o_orderstatus = 'P' and o_orderdate <= timestamp '1997-01-01' then date_diff('second', o_orderdate, timestamp '1997-01-01') end) as oldest_wait_s from orders group by o_orderpriority""")
def job_depths(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("queue"), F.when(F.col("o_orderstatus") == "P", "PENDING").when(F.col("o_orderstatus") == "F", "DEAD").otherwise("ACTIVE").alias("state"), F.col("o_orderdate").cast("timestamp").alias("run_after"))
    return jobs.depths(o, F.lit("1997-01-01").cast("timestamp"))


@query("select o_orderkey as id, least(30000, 1000 * cast(power(2, least(o_orderkey % 14, 10)) as bigint)) as wait_ms from orders")
def poll_waits(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), jobs.poll_wait_ms(F.col("o_orderkey") % 14, 1000).alias("wait_ms"))


# --- idempotent requests -----------------------------------------------------------

_KIND = "case event_type when 'purchase' then 'complete' when 'error' then 'fail' else 'begin' end"


@query(f"""with recursive {_ORDERED.format(key='user_id')}, k as (select *, {_KIND} as kind, event_id % 2 as body from o),
r(user_id, n, id, expiry, body, done, outcome) as (
  select user_id, n, event_id, case when kind = 'begin' then tm + 86400 end, case when kind = 'begin' then body end, false, case when kind = 'begin' then 'owned' else 'unknown' end from k where n = 1
  union all select k.user_id, k.n, k.event_id,
    case when not live and k.kind = 'begin' then k.tm + 86400 when live and k.kind = 'fail' and not r.done then null when live then r.expiry end,
    case when not live and k.kind = 'begin' then k.body when live then r.body end,
    case when live and k.kind = 'complete' then true when live and not (k.kind = 'fail' and not r.done) then r.done else false end,
    case when k.kind = 'begin' then case when not live then 'owned' when r.body <> k.body then 'reused' when r.done then 'replay' else 'in_flight' end
      when not live or r.done then 'unknown' when k.kind = 'complete' then 'completed' else 'released' end
  from (select *, n + 1 as next from r) r join k on k.user_id = r.user_id and k.n = r.next, lateral (select r.expiry is not null and k.tm < r.expiry as live))
select cast(user_id as varchar) as key, id, outcome from r""")
def idempotency_requests(spark, d):
    e = table(spark, d, "events")
    return folds.request_outcomes(e.select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("id"), _seconds("ts").alias("at_s"), F.expr(_KIND).alias("kind"), (F.col("event_id") % 2).cast("string").alias("fingerprint")))


# --- processors ----------------------------------------------------------------------

_ENTRY = """'{"digest":"' || sha256(cast(l_partkey as varchar)) || '","logicalName":"' || name || '","mediaType":"text/plain","sizeBytes":"' || cast(l_quantity as bigint) || '"}'"""
_CHECKSUMS = f"""select l_orderkey as run, '{{"artifactCount":' || count(*) || ',"artifacts":[' || string_agg({_ENTRY}, ',' order by name) || '],"manifestVersion":1,"totalSizeBytes":"' || cast(sum(cast(l_quantity as bigint)) as bigint) || '"}}' as content, sha256(string_agg(distinct sha256(cast(l_partkey as varchar)), chr(10) order by sha256(cast(l_partkey as varchar)))) as inputs_digest
  from (select *, l_linenumber || '/' || l_partkey || '/' || l_suppkey || '/' || cast(l_quantity as bigint) as name from lineitem) group by l_orderkey"""


def _artifacts(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("l_quantity").cast("bigint")
    name = F.concat_ws("/", "l_linenumber", "l_partkey", "l_suppkey", size.cast("string"))
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("run"), name.alias("name"), digests.sha256(F.col("l_partkey")).alias("digest"), size.alias("size"), F.lit("text/plain").alias("media_type"))


@query(f"select run, 'manifest.json' as name, content, sha256(content) as digest from ({_CHECKSUMS})")
def checksum_manifest(spark, d):
    return processors.derived(_artifacts(spark, d), processors.REGISTRY["checksum-manifest"])[0].select("run", "name", "content", "digest")


@query(f"select run, sha256(inputs_digest || '|checksum-manifest|1.0.0|' || sha256('{{}}')) as derivation, run % 3 <> 0 and row_number() over (partition by inputs_digest order by run) = 1 and not exists (select 1 from ({_CHECKSUMS}) x where x.inputs_digest = c.inputs_digest and x.run % 3 = 0) as created from ({_CHECKSUMS}) c")
def derivations_recorded(spark, d):
    made = processors.derived(_artifacts(spark, d), processors.REGISTRY["checksum-manifest"])[1]
    return processors.recorded(made, made.where("run % 3 = 0")).select("run", "derivation", "created")


@query("""with l as (select *, not regexp_matches(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]') and text <> '' as plain, list_filter(string_split(text, chr(10))[1:64], lambda x: x <> '') as ls from documents),
m as (select *, list_filter([',', chr(9), ';', '|'], lambda c: len(ls) > 0 and len(string_split(ls[1], c)) > 1 and len(list_filter(ls, lambda x: len(string_split(x, c)) <> len(string_split(ls[1], c)))) = 0)[1] as mark from l)
select lang as run, '{"artifactCount":' || count(*) || ',"artifacts":[' || string_agg('{"digest":"' || sha256(text) || '","logicalName":"' || doc_id || '","mediaType":"text/plain","metadata":{' || case when plain
  then '"columnCount":' || case when mark is null then 'null' else cast(len(string_split(ls[1], mark)) as varchar) end || ',"delimiter":' || coalesce(case when mark = chr(9) then '"\\t"' else '"' || mark || '"' end, 'null') || ',"lineCount":' || (len(string_split(text, chr(10))) - case when ends_with(text, chr(10)) then 1 else 0 end) || ',"type":"text"'
  else '"inspected":true,"type":"unknown"' end || '},"sizeBytes":"' || octet_length(encode(text)) || '"}', ',' order by cast(doc_id as varchar)) || '],"recognisedCount":' || count(*) filter (plain) || ',"summaryVersion":1}' as content from m group by lang""")
def metadata_extract(spark, d):
    docs = table(spark, d, "documents")
    rows = docs.select(F.col("lang").alias("run"), F.col("doc_id").cast("string").alias("name"), digests.sha256(F.col("text")).alias("digest"), F.octet_length("text").cast("long").alias("size"), F.lit("text/plain").alias("media_type"), F.col("text").cast("binary").alias("content"))
    return processors.derived(rows, processors.REGISTRY["metadata-extract"])[0].select("run", "content")


# --- forms ---------------------------------------------------------------------------

@query("""with t as (select event_id, '{"k":' || cast(cast(json_extract(props, '$.k') as bigint) as varchar) || ',"n":[true,null,' || (event_id % 100) || '],"type":"' || event_type || '"}' as c from events)
select event_id, case when event_id % 50 <> 0 then c end as canonical, case when event_id % 50 <> 0 then sha256(c) end as digest, case when event_id % 50 = 0 then 'not JSON' end as problem from t""")
def canonical_json(spark, d):
    messy = F.concat(F.lit('{ "type": "'), "event_type", F.lit('", "n": [true , null, '), (F.col("event_id") % 100).cast("string"), F.lit(".0], "), F.expr("substr(props, 2)"))
    rows = table(spark, d, "events").select("event_id", canon.canonical(F.when(F.col("event_id") % 50 == 0, "{nothing").otherwise(messy)).alias("c"))
    return rows.select("event_id", "c.canonical", canon.digest_of(F.col("c.canonical")).alias("digest"), "c.problem")


@query("""select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.') || substr(strftime(ts, '%f'), 1, 3) || 'Z' as millis, event_id % 3 <> 0 as uuid, case when event_id % 3 <> 0 then epoch_ms(date_trunc('millisecond', ts)) end as minted_ms, event_type || '.done' as action, event_type <> 'view' as is_action from events""")
def text_forms(spark, d):
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    hexed = F.lower(F.lpad(F.hex(ms), 12, "0"))
    uuid = F.concat(F.substr(hexed, F.lit(1), F.lit(8)), F.lit("-"), F.substr(hexed, F.lit(9), F.lit(4)), F.when(F.col("event_id") % 3 != 0, "-7000-8000-000000000000").otherwise("-7000-8000"))
    action = F.concat("event_type", F.lit(".done"))
    ok = digests.is_uuid(uuid)
    checked = F.when(F.col("event_type") == "view", F.concat(F.lit("View"), action)).otherwise(action)
    return table(spark, d, "events").select("event_id", digests.millis_text(F.col("ts")).alias("millis"), ok.alias("uuid"), F.when(ok, F.unix_millis(digests.uuid_time(uuid))).alias("minted_ms"), action.alias("action"), checked.rlike(chain.ACTION).alias("is_action"))
