"""The queries over the driver's tables, with their SQL.

A run is an order (its study the customer, its site the nation), an audit event
an event of a user, an artifact a document, a manifest entry a line item.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import digests
from ..operators import chain, folds, jobs, lifecycle, lineage, paging, search, uploads
from ..sources.tables import Scope, ScopedCatalog, table

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# --- search -----------------------------------------------------------------

_RUNS = """with runs as (select o_orderkey as run_id, c_name as study, n_name as site, o_orderstatus as state,
  case when o_orderkey % 7 <> 0 then o_orderdate end as acquired_at, c_custkey, c_nationkey
  from orders join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey)
select run_id, study, site, state, strftime(acquired_at, '%Y-%m-%dT%H:%M:%S.%fZ') as acquired_at from runs """
_AT = "1997-06-01"


def _runs(spark: SparkSession, d: str) -> DataFrame:
    runs = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey")).join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    acquired = F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderdate"))
    return runs.select(F.col("o_orderkey").alias("run_id"), F.col("c_name").alias("study"), F.col("n_name").alias("site"), F.col("o_orderstatus").alias("state"), acquired.alias("acquired_at"), "c_nationkey")


def _listed(runs: DataFrame, limit: int | None = paging.DEFAULT) -> DataFrame:
    if limit:
        runs = runs.orderBy(F.desc_nulls_first("acquired_at"), F.desc("run_id")).limit(limit)
    return runs.select("run_id", "study", "site", "state", digests.micros_text(F.col("acquired_at")).alias("acquired_at"))


def _page(spark: SparkSession, d: str, wanted: search.Wanted) -> DataFrame:
    """A page is cut from orders alone; names are joined to its rows."""
    acquired = F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderdate"))
    runs = table(spark, d, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("study"), F.col("o_orderstatus").alias("state"), acquired.alias("acquired_at"))
    named = search.search(runs, wanted).withColumnRenamed("study", "key").join(table(spark, d, "customer"), F.col("c_custkey") == F.col("key")).join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    return named.select("run_id", F.col("c_name").alias("study"), F.col("n_name").alias("site"), "state", digests.micros_text(F.col("acquired_at")).alias("acquired_at"))


@query(_RUNS + "order by runs.acquired_at desc nulls first, run_id desc limit 50")
def run_search_page1(spark, d):
    return _page(spark, d, search.Wanted())


@query(_RUNS + f"where runs.acquired_at is not null and (runs.acquired_at < timestamp '{_AT}' or (runs.acquired_at = timestamp '{_AT}' and run_id < 1000)) order by runs.acquired_at desc nulls first, run_id desc limit 50")
def run_search_page2(spark, d):
    return _page(spark, d, search.Wanted(cursor=(datetime.datetime.fromisoformat(_AT), 1000)))


@query(_RUNS + "where runs.acquired_at is not null or run_id < 100 order by runs.acquired_at desc nulls first, run_id desc limit 50")
def run_search_null_cursor(spark, d):
    return _page(spark, d, search.Wanted(cursor=(None, 100)))


@query(_RUNS + "where state in ('F') and c_custkey = 5 and runs.acquired_at <= timestamp '1998-01-01' order by runs.acquired_at desc nulls first, run_id desc limit 50")
def run_search_conditions(spark, d):
    return _page(spark, d, search.Wanted(study=5, states=("F",), acquired_to=datetime.datetime(1998, 1, 1)))


@query(_RUNS + "where state in ('F', 'P') and runs.acquired_at between timestamp '1995-01-01' and timestamp '1995-12-31'")
def run_search_filtered(spark, d):
    span = F.col("acquired_at").between(F.lit("1995-01-01").cast("timestamp_ntz"), F.lit("1995-12-31").cast("timestamp_ntz"))
    return _listed(_runs(spark, d).where(F.col("state").isin("F", "P") & span), None)


@query("select o_orderkey as run_id from orders where o_custkey in (select c_custkey from customer join nation on n_nationkey = c_nationkey where n_regionkey = 1)")
def visible_runs_semi(spark, d):
    granted = table(spark, d, "customer").join(table(spark, d, "nation").where("n_regionkey = 1"), F.col("n_nationkey") == F.col("c_nationkey"))
    return table(spark, d, "orders").join(granted, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select(F.col("o_orderkey").alias("run_id"))


@query("select cast(event_id as varchar) as seq, user_id, event_type from events where event_type = 'click' and event_id < 900 order by event_id desc limit 50")
def audit_list_page(spark, d):
    rows = table(spark, d, "events").where("event_type = 'click' and event_id < 900").orderBy(F.desc("event_id")).limit(paging.DEFAULT)
    return rows.select(F.col("event_id").cast("string").alias("seq"), "user_id", "event_type")


@query("select user_id, count(*) as events, min(event_id) as first_id, max(event_id) as last_id from events where starts_with(event_type, 'p') group by user_id")
def audit_action_family(spark, d):
    rows = table(spark, d, "events").where(F.col("event_type").startswith("p"))
    return rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("events"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


@query("""select o_orderkey as run_id, rtrim(replace(replace(base64(encode(coalesce(case when o_orderkey % 7 <> 0 then strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%fZ') end, '@') || chr(31) || o_orderkey)), '+', '-'), '/', '_'), '=') as cursor from orders where o_orderkey % 7 <> 0
union all select o_orderkey, rtrim(replace(replace(base64(unhex('00') || encode(chr(31) || o_orderkey)), '+', '-'), '/', '_'), '=') from orders where o_orderkey % 7 = 0""")
def run_cursors(spark, d):
    at = F.when(F.col("o_orderkey") % 7 != 0, digests.micros_text(F.col("o_orderdate")))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("run_id"), digests.cursor_text(at, F.col("o_orderkey")).alias("cursor"))


# --- audit chain -------------------------------------------------------------

_ITEMS = """select user_id, event_id, ts, props, row_number() over (partition by user_id order by ts, event_id) as seq, sha256(props) as digest from events"""


def _log(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return chain.append(e.select(F.col("user_id").alias("tenant"), F.col("event_id").alias("id"), F.col("ts").alias("occurred_at"), F.col("props").alias("payload")))


@query(f"""select user_id as tenant, count(*) as last_seq, count(*) as events,
  list_reduce(list_prepend(repeat('0', 64), list(seq || '|' || '@' || '|' || digest || '|' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') order by seq)), lambda p, x: sha256(user_id || '|' || replace(x, '@', p))) as last_hash
  from ({_ITEMS}) group by user_id""")
def chain_append(spark, d):
    return chain.heads(_log(spark, d))


@query("select user_id as tenant, true as ok, count(*) as events_verified, cast(null as bigint) as broken_at, cast(null as varchar) as reason from events group by user_id")
def chain_verify_clean(spark, d):
    return chain.verify(_log(spark, d)).select("tenant", "ok", "events_verified", "broken_at", "reason")


@query("""select user_id as tenant, count(*) < 4 or user_id % 3 = 0 as ok, case when count(*) < 4 or user_id % 3 = 0 then count(*) end as events_verified,
  case when count(*) >= 4 and user_id % 3 <> 0 then 4 end as broken_at, case when count(*) < 4 or user_id % 3 = 0 then null when user_id % 3 = 1 then 'payload_digest' else 'hash' end as reason from events group by user_id""")
def chain_verify_tampered(spark, d):
    fourth, third = F.col("seq") == 4, F.col("tenant") % 3
    edited = {"payload": F.when(fourth & (third == 1), F.lit("{}!")).otherwise(F.col("payload")), "hash": F.when(fourth & (third == 2), F.repeat(F.lit("f"), F.lit(64))).otherwise(F.col("hash"))}
    return chain.verify(_log(spark, d).withColumns(edited)).select("tenant", "ok", "events_verified", "broken_at", "reason")


@query("""select user_id as tenant, count(*) < 4 as ok, case when count(*) < 4 then least(count(*), 2) end as events_verified, case when count(*) >= 4 then 3 end as broken_at,
  case when count(*) >= 4 then 'sequence_gap' end as reason, case when count(*) >= 4 then '3' end as expected, case when count(*) >= 4 then '4' end as actual from events group by user_id""")
def chain_verify_gap(spark, d):
    return chain.verify(_log(spark, d).where("seq <> 3")).select("tenant", "ok", "events_verified", "broken_at", "reason", "expected", "actual")


_CHECKPOINTS = """select user_id as tenant, count(*) as through_seq, count(*) as event_count from events group by user_id having user_id % 2 = 1 or count(*) - 5 >= 60"""


def _checkpoints(log: DataFrame) -> DataFrame:
    """Every second tenant's, at its fifth event or the last before."""
    first = log.where("tenant % 2 = 0 and seq <= 5").groupBy("tenant").agg(F.max(F.struct("seq", "hash")).alias("x"))
    return first.select("tenant", F.lit(5).cast("long").alias("through_seq"), F.col("x.hash").alias("chain_hash"))


@query(_CHECKPOINTS)
def checkpoint_head(spark, d):
    log = _log(spark, d)
    return chain.due_checkpoints(log, _checkpoints(log), 60).select("tenant", "through_seq", "event_count")


@query(f"select tenant, through_seq, event_count, 'audit.checkpointed' as action from ({_CHECKPOINTS}) where through_seq < 70 or tenant % 3 <> 0")
def checkpoints_created(spark, d):
    log = _log(spark, d)
    edited = log.withColumn("payload", F.when((F.col("seq") == 70) & (F.col("tenant") % 3 == 0), F.lit("{}")).otherwise(F.col("payload")))
    return chain.checkpointed(edited, _checkpoints(log), 60)[0].select("tenant", "through_seq", "event_count", "action")


@query("select event_id as id, case when event_id % 10 = 0 then 'tenant' when event_type = 'view' then 'action' when event_id % 7 = 0 then 'payload' end as problem from events where event_id % 10 = 0 or event_type = 'view' or event_id % 7 = 0")
def audit_refused(spark, d):
    key = F.col("event_id")
    e = table(spark, d, "events").select(F.when(key % 10 != 0, F.col("user_id")).alias("tenant"), key.alias("id"), F.concat("event_type", F.when(F.col("event_type") == "view", "").otherwise(".done")).alias("action"), F.when(key % 7 != 0, F.col("props")).alias("payload"))
    return chain.prepared(e)[1].select("id", "problem")


# --- content addressing ------------------------------------------------------

@query("select sha256(text) as digest, count(*) as copies, min(doc_id) as first_id, cast(sum(octet_length(encode(text))) as varchar) as bytes from documents group by text")
def artifact_dedup(spark, d):
    rows = table(spark, d, "documents").where("text is not null").select(digests.sha256(F.col("text")).alias("digest"), "doc_id", F.octet_length("text").alias("n"))
    return rows.groupBy("digest").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_id"), F.sum(F.col("n").cast("decimal(38,0)")).cast("string").alias("bytes"))


@query("select doc_id, 'sha256/' || h[1:2] || '/' || h[3:4] || '/' || h as storage_key from (select doc_id, sha256(text) as h from documents)")
def storage_keys(spark, d):
    return table(spark, d, "documents").select("doc_id", digests.storage_key(digests.sha256(F.col("text"))).alias("storage_key"))


@query("""select l_orderkey as run_id, count(*) as entries, sha256('[' || string_agg('{"digest":"' || sha256(cast(l_partkey as varchar)) || '","name":"' || name || '","size":' || cast(l_quantity as bigint) || '}', ',' order by name) || ']') as manifest_digest
  from (select *, l_linenumber || '/' || l_partkey || '/' || l_suppkey || '/' || cast(l_quantity as bigint) as name from lineitem) group by l_orderkey""")
def manifest_digest(spark, d):
    size = F.col("l_quantity").cast("bigint").cast("string")
    name = F.concat_ws("/", "l_linenumber", "l_partkey", "l_suppkey", size)
    entry = F.concat(F.lit('{"digest":"'), digests.sha256(F.col("l_partkey")), F.lit('","name":"'), name, F.lit('","size":'), size, F.lit("}"))
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("run_id")).agg(F.count(F.lit(1)).alias("entries"), digests.ordered_digest(name, entry).alias("manifest_digest"))


@query("select l_orderkey as run_id, sha256(string_agg(h, chr(10) order by h)) as inputs_digest from (select distinct l_orderkey, sha256(cast(l_partkey as varchar)) as h from lineitem) group by l_orderkey")
def inputs_digest_set(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("run_id")).agg(digests.digest_set(digests.sha256(F.col("l_partkey"))).alias("inputs_digest"))


_OWNED = "(select distinct sha256(text) as digest, source from documents where text is not null)"


def _owned(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select(digests.sha256(F.col("text")).alias("digest"), "source").distinct()


@query(f"select a.digest from {_OWNED} a where a.source = 'src0' and exists (select 1 from {_OWNED} b where b.digest = a.digest and b.source <> 'src0')")
def shared_digests(spark, d):
    own = _owned(spark, d)
    return own.where("source = 'src0'").join(own.where("source <> 'src0'"), "digest", "left_semi").select("digest")


@query(f"select a.digest from {_OWNED} a where a.source = 'src0' and not exists (select 1 from {_OWNED} b where b.digest = a.digest and b.source <> 'src0')")
def orphan_objects(spark, d):
    own = _owned(spark, d)
    return own.where("source = 'src0'").join(own.where("source <> 'src0'"), "digest", "left_anti").select("digest")


# --- lineage -----------------------------------------------------------------

_EDGES = "(select doc_id as source, doc_id // 2 as target, 'h' || doc_id as derivation, 'half' as role from documents where doc_id > 0 union all select doc_id, doc_id // 3, 't' || doc_id, 'third' from documents where doc_id > 0)"


def _edges(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("doc_id > 0")
    part = lambda k, tag, role: docs.select(F.col("doc_id").alias("source"), F.expr(f"doc_id div {k}").alias("target"), F.concat(F.lit(tag), F.col("doc_id").cast("string")).alias("derivation"), F.lit(role).alias("role"))
    return part(2, "h", "half").unionByName(part(3, "t", "third"))


def _walk_sql(here: str, there: str, depth: int) -> str:
    return f"""with recursive e as {_EDGES}, w(start, artifact, depth, derivation, role) as (select x, x, 0, cast(null as varchar), cast(null as varchar) from (values (cast(150 as bigint)), (7)) t(x)
  union all select w.start, e.{there}, w.depth + 1, e.derivation, e.role from w join e on e.{here} = w.artifact where w.depth < {depth}),
  walked as (select start, artifact, derivation, min(depth) as depth, arg_min(role, depth) as role from w group by start, artifact, derivation) """


def _starts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(150,), (7,)], "artifact long")


@query(_walk_sql("source", "target", 16) + "select * from walked")
def lineage_ancestors(spark, d):
    return lineage.walk(_edges(spark, d), _starts(spark))


@query(_walk_sql("target", "source", 3) + "select * from walked")
def lineage_descendants(spark, d):
    return lineage.walk(_edges(spark, d), _starts(spark), 3, down=True)


@query(_walk_sql("source", "target", 16) + """, own as (select e.* from e where derivation in (select derivation from walked))
  select derivation as subject, 'used' as relation, cast(target as varchar) as object from own union select cast(source as varchar), 'wasGeneratedBy', derivation from own union select cast(source as varchar), 'wasDerivedFrom', cast(target as varchar) from own""")
def lineage_edges(spark, d):
    edges = _edges(spark, d)
    return lineage.graph_edges(lineage.walk(edges, _starts(spark)), edges)


@query(_walk_sql("source", "target", 16) + "select distinct artifact from walked where artifact not in (select source from e)")
def lineage_roots(spark, d):
    edges = _edges(spark, d)
    return lineage.roots(lineage.walk(edges, _starts(spark)), edges)


@query(_walk_sql("source", "target", 16) + """select kind, id, arg_min(layer, abs(layer)) as layer from (select 'artifact' as kind, cast(artifact as varchar) as id, -2 * depth as layer from walked
  union all select 'derivation', derivation, -(2 * depth - 1) from walked where derivation is not null) group by kind, id""")
def lineage_layers(spark, d):
    return lineage.layers(lineage.walk(_edges(spark, d), _starts(spark)))


@query(_walk_sql("source", "target", 3) + """select distinct s.start from (select start, artifact, min(depth) as depth from walked group by start, artifact) s join e on e.source = s.artifact
  where s.depth >= 3 and not exists (select 1 from walked w where w.start = s.start and w.derivation = e.derivation)""")
def lineage_truncated(spark, d):
    edges = _edges(spark, d)
    return lineage.truncated(lineage.walk(edges, _starts(spark), 3), edges, 3)


_ORIGINS = "(select o_orderkey - 1 as artifact, o_orderkey as run, o_orderkey % 7 as instrument, case when o_orderkey % 3 <> 0 then o_custkey end as usr, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%fZ') as at_ from orders)"


def _origins(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("o_orderkey")
    return table(spark, d, "orders").select((key - 1).alias("artifact"), key.alias("run"), (key % 7).alias("instrument"), F.when(key % 3 != 0, F.col("o_custkey")).alias("user"), digests.micros_text(F.col("o_orderdate")).alias("at"))


_PROV = _walk_sql("source", "target", 16) + f""", own as (select e.* from e where derivation in (select derivation from walked)),
  first as (select o.* from {_ORIGINS} o where o.artifact in (select artifact from walked) and o.artifact not in (select source from e)),
  things as (select distinct 'entity' as section, 'run:artifact/' || artifact as id, '{{"prov:type":"Artifact","prov:label":"artifact ' || artifact || '"}}' as body from walked
    union all select distinct 'activity', 'run:derivation/' || derivation, '{{"prov:type":"Computation","prov:label":"derivation ' || derivation || '"}}' from walked where derivation is not null
    union all select distinct 'activity', 'run:run/' || run, '{{"prov:type":"Acquisition","prov:startTime":{{"$":"' || at_ || '","type":"xsd:dateTime"}}}}' from first
    union all select distinct 'agent', 'run:instrument/' || instrument, '{{"prov:type":"prov:SoftwareAgent"}}' from first
    union all select distinct 'agent', 'run:user/' || usr, '{{"prov:type":"prov:Person"}}' from first where usr is not null),
  ties as (select distinct 'used' as section, '{{"prov:activity":"run:derivation/' || derivation || '","prov:entity":"run:artifact/' || target || '","prov:role":{{"$":"' || role || '","type":"xsd:string"}}}}' as body from own
    union all select distinct 'wasGeneratedBy', '{{"prov:entity":"run:artifact/' || source || '","prov:activity":"run:derivation/' || derivation || '"}}' from own
    union all select distinct 'wasGeneratedBy', '{{"prov:entity":"run:artifact/' || artifact || '","prov:activity":"run:run/' || run || '"}}' from first
    union all select distinct 'wasDerivedFrom', '{{"prov:generatedEntity":"run:artifact/' || source || '","prov:usedEntity":"run:artifact/' || target || '"}}' from own
    union all select distinct 'wasAssociatedWith', '{{"prov:activity":"run:run/' || run || '","prov:agent":"run:instrument/' || instrument || '"}}' from first
    union all select distinct 'wasAssociatedWith', '{{"prov:activity":"run:run/' || run || '","prov:agent":"run:user/' || usr || '"}}' from first where usr is not null),
  entries as (select * from things union all select section, '_:' || section || row_number() over (partition by section order by body), body from ties) """


@query(_PROV + "select * from entries")
def prov_entries(spark, d):
    edges = _edges(spark, d)
    return lineage.prov_entries(lineage.walk(edges, _starts(spark)), edges, _origins(spark, d))


@query(_PROV + """select '{' || string_agg('"' || section || '":{' || inner_ || '}', ',' order by section) || '}' as document from (select section, string_agg('"' || id || '":' || body, ',' order by id) as inner_ from entries group by section)""")
def prov_export(spark, d):
    edges = _edges(spark, d)
    return lineage.prov_json(lineage.prov_entries(lineage.walk(edges, _starts(spark)), edges, _origins(spark, d)))


@query("select 'run:run/' || o_orderkey as id, 'acquisition' as kind from orders union all select 'run:derivation/' || event_id, event_type from events")
def prov_activity(spark, d):
    runs = table(spark, d, "orders").select(F.concat(F.lit("run:run/"), F.col("o_orderkey").cast("string")).alias("id"), F.lit("acquisition").alias("kind"))
    return runs.unionByName(table(spark, d, "events").select(F.concat(F.lit("run:derivation/"), F.col("event_id").cast("string")).alias("id"), F.col("event_type").alias("kind")))


@query("select 'run:user/' || c_custkey as id, c_name as label from customer union all select 'run:instrument/' || s_suppkey, s_name from supplier")
def prov_agent(spark, d):
    users = table(spark, d, "customer").select(F.concat(F.lit("run:user/"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_name").alias("label"))
    return users.unionByName(table(spark, d, "supplier").select(F.concat(F.lit("run:instrument/"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_name").alias("label")))


@query("""with t as (select conv_id * 1000 + turn as run, conv_id, turn from conversations), s as (select * from t where turn = 1)
select distinct s.run as start, t.run, abs(t.turn - s.turn) as depth, case when t.turn < s.turn then 'ancestor' else 'descendant' end as direction from s join t on t.conv_id = s.conv_id and t.turn <> s.turn""")
def supersede_chain(spark, d):
    c = table(spark, d, "conversations")
    run = F.col("conv_id") * 1000 + F.col("turn")
    runs = c.select(run.alias("run"), F.when(F.col("turn") > 0, run - 1).alias("supersedes")).distinct()
    out = lifecycle.supersede_chain(runs, c.where("turn = 1").select(run.alias("run")))
    return out.select("start", "run", F.col("depth").cast("long").alias("depth"), "direction").distinct()


# --- states and constraints --------------------------------------------------

_MOVES = "select user_id, event_id, event_type as after, lag(event_type) over (partition by user_id order by ts, event_id) as before from events"


@query(f"select user_id, event_id, before, after from ({_MOVES}) where before is not null and (before, after) not in (('click', 'view'), ('view', 'click'), ('view', 'purchase'), ('login', 'view'))")
def run_transitions_illegal(spark, d):
    from pyspark.sql import Window

    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    moves = table(spark, d, "events").select("user_id", "event_id", F.col("event_type").alias("after"), F.lag("event_type").over(order).alias("before")).where("before is not null")
    return lifecycle.illegal_moves(moves, (("click", "view"), ("view", "click"), ("view", "purchase"), ("login", "view"))).select("user_id", "event_id", "before", "after")


@query("""select o_orderkey, case when o_orderkey % 35 = 0 then 'o_custkey,o_orderpriority' when o_orderkey % 5 = 0 then 'o_custkey' else 'o_orderpriority' end as changed
  from orders where o_orderstatus <> 'O' and (o_orderkey % 5 = 0 or o_orderkey % 7 = 0)""")
def immutability_violations(spark, d):
    before = table(spark, d, "orders")
    after = before.withColumns({"o_custkey": F.when(F.col("o_orderkey") % 5 == 0, F.col("o_custkey") + 1).otherwise(F.col("o_custkey")), "o_orderpriority": F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderpriority"))})
    return lifecycle.frozen_changes(before, after, "o_orderkey", ["o_custkey", "o_orderpriority", "o_totalprice"], F.col("o_orderstatus") == "O")


@query("""select 'quantity_positive' as rule, count(*) filter (not l_quantity > 0) as rows from lineitem
union all select 'discount_range', count(*) filter (not l_discount <= 0.05) from lineitem
union all select 'entry_unique', (select count(*) from (select 1 from lineitem group by l_orderkey, l_linenumber having count(*) > 1))
union all select 'entry_has_run', (select count(*) from lineitem where l_orderkey not in (select o_orderkey from orders))
union all select 'run_has_entry', (select count(*) from orders where o_orderkey not in (select l_orderkey from lineitem))""")
def constraint_violations(spark, d):
    items, orders = table(spark, d, "lineitem"), table(spark, d, "orders")
    out = lifecycle.violations({"quantity_positive": (items, F.col("l_quantity") > 0), "discount_range": (items, F.col("l_discount") <= 0.05)})
    counted = {"entry_unique": lifecycle.repeated_keys(items, "l_orderkey", "l_linenumber"), "entry_has_run": lifecycle.orphans(items, "l_orderkey", orders, "o_orderkey"), "run_has_entry": lifecycle.orphans(orders, "o_orderkey", items, "l_orderkey")}
    for name, df in counted.items():
        out = out.union(df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name), "rows"))
    return out


@query("select l_orderkey as run, count(*) as blockers from lineitem where l_linestatus <> 'F' group by l_orderkey")
def seal_blockers(spark, d):
    return lifecycle.seal_blockers(table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "run"), F.col("l_linestatus") == "F")


@query("select user_id, event_type, min(event_id) as event_id from events where user_id % 2 = 1 group by user_id, event_type")
def insert_once(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", "event_id")
    return lifecycle.insert_once(e, e.where("user_id % 2 = 0"), ["user_id", "event_type"], ["event_id"]).select("user_id", "event_type", "event_id")


@query("select user_id, arg_max(event_type, event_id) as event_type, max(event_id) as event_id from events group by user_id")
def latest_state(spark, d):
    return lifecycle.latest(table(spark, d, "events").select("user_id", "event_type", "event_id"), ["user_id"], "event_id")


# --- folds, jobs, quotas -----------------------------------------------------

_ORDERED = "o as (select *, epoch_us(ts) / 1e6 as tm, row_number() over (partition by {key} order by epoch_us(ts) / 1e6, event_id) as n from events)"


@query(f"""with recursive {_ORDERED.format(key='user_id, event_type')}, r(user_id, event_type, n, id, expiry, body, outcome) as (
  select user_id, event_type, n, event_id, tm + 86400, props, 'owned' from o where n = 1
  union all select o.user_id, o.event_type, o.n, o.event_id, case when o.tm >= r.expiry then o.tm + 86400 else r.expiry end, case when o.tm >= r.expiry then o.props else r.body end,
    case when o.tm >= r.expiry then 'owned' when o.props = r.body then 'replay' else 'reused' end from r join o on o.user_id = r.user_id and o.event_type = r.event_type and o.n = r.n + 1)
select user_id || ':' || event_type as key, id, outcome from r""")
def idempotency_outcomes(spark, d):
    e = table(spark, d, "events")
    return folds.idempotency_outcomes(e.select(F.concat_ws(":", "user_id", "event_type").alias("key"), F.col("event_id").alias("id"), _seconds("ts").alias("at_s"), F.col("props").alias("fingerprint")))


def _seconds(column: str):
    return F.unix_micros(F.col(column).cast("timestamp")) / F.lit(1e6)


@query(f"""with recursive {_ORDERED.format(key='user_id')}, r(user_id, n, id, start, used, allowed, wait) as (
  select user_id, n, event_id, tm, 1, true, 0 from o where n = 1
  union all select o.user_id, o.n, o.event_id, case when o.tm >= r.start + 21600 then o.tm else r.start end, case when o.tm >= r.start + 21600 then 1 when r.used < 2 then r.used + 1 else r.used end,
    o.tm >= r.start + 21600 or r.used < 2, case when o.tm >= r.start + 21600 or r.used < 2 then 0 else greatest(1, cast(ceil(r.start + 21600 - o.tm) as bigint)) end from r join o on o.user_id = r.user_id and o.n = r.n + 1)
select cast(user_id as varchar) as key, id, allowed, cast(wait as bigint) as retry_after from r""")
def rate_limit_decisions(spark, d):
    e = table(spark, d, "events")
    return folds.rate_decisions(e.select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("id"), _seconds("ts").alias("at_s")), 2, 21600)


@query("""select queue, id, rank, attempts from (select o_orderpriority as queue, o_orderkey as id, o_orderkey % 4 + 1 as attempts,
  row_number() over (partition by o_orderpriority order by o_orderkey % 3 desc, o_orderdate, o_orderkey) as rank from orders
  where (o_orderstatus = 'P' and o_orderdate <= timestamp '1997-01-01') or (o_orderstatus = 'F' and o_orderdate + interval 300 second < timestamp '1997-01-01')) where rank <= 10""")
def job_claim_topk(spark, d):
    o = table(spark, d, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp"))
    state = F.when(F.col("o_orderstatus") == "P", "PENDING").when(F.col("o_orderstatus") == "F", "ACTIVE").otherwise("COMPLETED")
    queue = o.select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("queue"), state.alias("state"), (F.col("o_orderkey") % 3).alias("priority"), (F.col("o_orderkey") % 4).alias("attempts"),
        F.col("o_orderdate").alias("run_after"), (F.col("o_orderdate") + F.make_interval(secs=F.lit(300))).alias("lease_expires_at"), F.lit(None).cast("timestamp").alias("started_at"),
    )
    return jobs.claim(queue, F.lit("1997-01-01").cast("timestamp"), 10, "w1").select("queue", "id", F.col("rank").cast("long").alias("rank"), "attempts")


@query("select o_orderkey as id, case when o_orderkey % 12 >= 10 then 'DEAD' else 'PENDING' end as state, case when o_orderkey % 12 < 10 then cast(least(3600, 5 * power(2, o_orderkey % 12 - 1)) as bigint) end as wait_s from orders where o_orderkey % 12 > 0")
def job_backoff(spark, d):
    o = table(spark, d, "orders").where("o_orderkey % 12 > 0")
    failed = o.select(F.col("o_orderkey").alias("id"), F.lit("ACTIVE").alias("state"), (F.col("o_orderkey") % 12).alias("attempts"), F.lit(10).alias("max_attempts"), F.col("o_orderdate").cast("timestamp").alias("run_after"))
    return jobs.release(failed, F.lit("1997-01-01").cast("timestamp")).select("id", "state", "wait_s")


_USAGE = "select c_nationkey as tenant, count(*) as runs, cast(sum(cast(round(o_totalprice) as bigint)) as bigint) as bytes from orders join customer on c_custkey = o_custkey group by c_nationkey"


def _usage(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    return o.groupBy(F.col("c_nationkey").alias("tenant")).agg(F.count(F.lit(1)).alias("runs"), F.sum(F.round("o_totalprice").cast("bigint")).alias("bytes"))


@query(f"select n_nationkey as tenant, coalesce(runs, 0) as runs, coalesce(bytes, 0) as bytes from nation left join ({_USAGE}) on tenant = n_nationkey")
def tenant_usage(spark, d):
    out = table(spark, d, "nation").join(_usage(spark, d), F.col("tenant") == F.col("n_nationkey"), "left")
    return out.select(F.col("n_nationkey").alias("tenant"), F.coalesce("runs", F.lit(0)).alias("runs"), F.coalesce("bytes", F.lit(0)).alias("bytes"))


@query(f"select tenant, case when tenant % 5 = 0 then 'expired' when runs >= 600 then 'runs' else 'bytes' end as reason from ({_USAGE}) where tenant % 5 = 0 or runs >= 600 or bytes >= 90000000")
def quota_breaches(spark, d):
    reason = F.when(F.col("tenant") % 5 == 0, "expired").when(F.col("runs") >= 600, "runs").when(F.col("bytes") >= 90_000_000, "bytes")
    return _usage(spark, d).select("tenant", reason.alias("reason")).where("reason is not null")


@query("select c_nationkey as tenant, min(c_custkey) as last_admin from customer where c_mktsegment = 'BUILDING' and c_acctbal > 9000 group by c_nationkey having count(*) = 1")
def last_admin(spark, d):
    admins = table(spark, d, "customer").where("c_mktsegment = 'BUILDING' and c_acctbal > 9000")
    return admins.groupBy(F.col("c_nationkey").alias("tenant")).agg(F.count(F.lit(1)).alias("n"), F.min("c_custkey").alias("last_admin")).where("n = 1").drop("n")


@query("select c_nationkey as tenant, count(*) as rows from customer where c_nationkey in (1, 7) group by c_nationkey")
def scoped_counts(spark, d):
    catalog = ScopedCatalog(spark, d, {"customer": "c_nationkey"})
    seen = [catalog.read("customer", Scope(t)) for t in (1, 7, None)]  # without a tenant: no row
    return seen[0].union(seen[1]).union(seen[2]).groupBy(F.col("c_nationkey").alias("tenant")).agg(F.count(F.lit(1)).alias("rows"))


# --- uploads -----------------------------------------------------------------

_PLAN = "(select doc_id, size, each, greatest(1, (size + each - 1) // each) as parts from (select doc_id, size, greatest(67108864, (size + 9999) // 10000) as each from (select doc_id, octet_length(encode(text)) * 100003 as size from documents)))"


def _plan(spark: SparkSession, d: str) -> DataFrame:
    size = F.octet_length("text").cast("long") * 100003
    plan = table(spark, d, "documents").select("doc_id", size.alias("size")).withColumn("each", uploads.part_size(F.col("size")))
    return plan.withColumn("parts", uploads.part_count(F.col("size"), F.col("each")))


@query(f"select doc_id, cast(each as bigint) as part_size, cast(parts as bigint) as parts, cast((parts - 1) * each as bigint) as last_offset, cast(size - (parts - 1) * each as bigint) as last_size from {_PLAN}")
def part_plan(spark, d):
    last = (F.col("parts") - 1) * F.col("each")
    return _plan(spark, d).select("doc_id", F.col("each").alias("part_size"), "parts", last.alias("last_offset"), (F.col("size") - last).alias("last_size"))


@query(f"select doc_id as id, part_number from {_PLAN}, range(1, parts + 1) t(part_number) where (doc_id + part_number) % 3 = 0")
def outstanding_parts(spark, d):
    sessions = _plan(spark, d).select(F.col("doc_id").alias("id"), F.col("parts").alias("total_parts"))
    every = sessions.select("id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("total_parts"))).alias("part_number"))
    return uploads.outstanding(sessions, every.where("(id + part_number) % 3 <> 0"))


@query("select doc_id, case when doc_id % 11 = 0 then 'missing' when doc_id % 5 = 0 then 'size_mismatch' when doc_id % 7 = 0 then 'digest_mismatch' else 'verified' end as verdict from documents")
def upload_verification(spark, d):
    docs = table(spark, d, "documents")
    size, digest = F.octet_length("text"), digests.sha256(F.col("text"))
    declared = docs.select("doc_id", F.when(F.col("doc_id") % 5 == 0, size + 1).otherwise(size).alias("declared_size"), digest.alias("declared_digest"))
    stored = docs.where("doc_id % 11 <> 0").select("doc_id", size.alias("size"), F.when(F.col("doc_id") % 7 == 0, digests.sha256(F.concat("text", F.lit("x")))).otherwise(digest).alias("digest"))
    out = declared.join(stored, "doc_id", "left")
    return out.select("doc_id", uploads.verdict(*(F.col(c) for c in ("declared_size", "size", "declared_digest", "digest"))).alias("verdict"))


@query("""select doc_id, case when text = '' then 0 else len(string_split(text, chr(10))) - (case when ends_with(text, chr(10)) then 1 else 0 end) end as lines, not regexp_matches(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]') as plain from documents""")
def text_sniff(spark, d):
    text = F.col("text")
    return table(spark, d, "documents").select("doc_id", uploads.line_count(text).alias("lines"), uploads.is_plain(text).alias("plain"))


@query("select l_orderkey as run, count(*) as entries, string_agg(l_partkey || ':' || l_suppkey, ',' order by l_linenumber, l_partkey, l_suppkey) as inputs from lineitem group by l_orderkey")
def derivations_for_run(spark, d):
    part = F.struct("l_linenumber", "l_partkey", "l_suppkey")
    out = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("run")).agg(F.count(F.lit(1)).alias("entries"), F.sort_array(F.collect_list(part)).alias("x"))
    return out.select("run", "entries", F.array_join(F.transform("x", lambda p: F.concat_ws(":", p["l_partkey"], p["l_suppkey"])), ",").alias("inputs"))


@query("select l_partkey as artifact, 'manifest' as kind, l_orderkey as run from lineitem where l_returnflag = 'R' union all select p_partkey, 'derived', o_orderkey from part join orders on o_orderkey = p_partkey where p_size > 25")
def artifact_bindings(spark, d):
    own = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("artifact"), F.lit("manifest").alias("kind"), F.col("l_orderkey").alias("run"))
    derived = table(spark, d, "part").where("p_size > 25").join(table(spark, d, "orders"), F.col("o_orderkey") == F.col("p_partkey"))
    return own.unionByName(derived.select(F.col("p_partkey").alias("artifact"), F.lit("derived").alias("kind"), F.col("o_orderkey").alias("run")))


from . import access, upkeep  # noqa: E402, F401  more queries of the same registry
