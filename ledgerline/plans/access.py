"""Queries over roles, registration and states of runs, and lineage in both directions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import digests
from ..operators import access, lifecycle, lineage, runs, search
from ..sources.tables import Scope, table
from .catalog import _EDGES, _ORIGINS, _edges, _origins, _starts, _walk_sql, query

_ROLE = "case c_mktsegment when 'BUILDING' then 'admin' when 'MACHINERY' then 'operator' when 'AUTOMOBILE' then 'steward' else 'scientist' end"
_MEMBERS = f"(select c_custkey as study, c_nationkey as usr, {_ROLE} as role, case when c_acctbal < 0 then c_acctbal end as revoked_at from customer)"
_GRANTS = "(select distinct o_custkey as study, o_orderkey % 10 as instrument from orders where o_orderstatus = 'F')"


def _members(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").alias("study"), F.col("c_nationkey").alias("user"), F.expr(_ROLE).alias("role"), F.when(F.col("c_acctbal") < 0, F.col("c_acctbal")).alias("revoked_at"))


def _grants(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("study"), (F.col("o_orderkey") % 10).alias("instrument")).distinct()


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("run"), F.col("o_custkey").alias("study"), "o_orderstatus")


@query(f"""select 'user' as actor, o_orderkey as run from orders where o_custkey in (select study from {_MEMBERS} where usr = 7 and revoked_at is null)
union all select 'instrument', o_orderkey from orders where o_custkey in (select study from {_GRANTS} where instrument = 3) union all select 'system', o_orderkey from orders""")
def runs_visible_to_actors(spark, d):
    members, grants, orders = _members(spark, d), _grants(spark, d), _orders(spark, d)
    out = None
    for scope in (Scope(1, "user", 7), Scope(1, "instrument", 3), Scope(1, "system"), Scope(1, "guest", 7)):
        seen = search.matching(orders, search.Wanted(), search.visible_studies(scope, members, members, grants)).select(F.lit(scope.actor_type).alias("actor"), "run")
        out = seen if out is None else out.unionByName(seen)
    return out


_ASKED = "(select o_orderkey as run, o_custkey as study, case o_orderkey % 4 when 0 then 'system' when 1 then 'instrument' else 'user' end as actor_type, case when o_orderkey % 4 = 1 then o_orderkey % 10 else c_nationkey - (case when o_orderkey % 8 = 2 then 1 else 0 end) end as actor_id from orders join customer on c_custkey = o_custkey)"


@query(f"""select run, case when actor_type = 'system' then 'no_role' when actor_type = 'instrument' then case when g.instrument is null then 'not_granted' end
  else case when m.study is null then 'not_member' when m.role not in ('admin', 'operator', 'steward') then 'wrong_role' end end as reason
from {_ASKED} a left join {_GRANTS} g on a.actor_type = 'instrument' and g.study = a.study and g.instrument = a.actor_id
left join {_MEMBERS} m on a.actor_type = 'user' and m.study = a.study and m.usr = a.actor_id and m.revoked_at is null""")
def study_role_decisions(spark, d):
    both = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    key = F.col("o_orderkey")
    kind = F.when(key % 4 == 0, "system").when(key % 4 == 1, "instrument").otherwise("user")
    asked = both.select(key.alias("run"), F.col("o_custkey").alias("study"), kind.alias("actor_type"), F.when(key % 4 == 1, key % 10).otherwise(F.col("c_nationkey") - F.when(key % 8 == 2, 1).otherwise(0)).alias("actor_id"))
    return access.study_decisions(asked, _members(spark, d), _grants(spark, d), ("operator", "steward")).select("run", "reason")


@query(f"select distinct usr as user from {_MEMBERS} where revoked_at is null and role in ('steward')")
def tenant_role_holders(spark, d):
    m = _members(spark, d)
    return access.tenant_role(m.select("user").distinct(), m, ("steward",))


@query("select distinct l_partkey as artifact, o_custkey as study from lineitem join orders on o_orderkey = l_orderkey")
def artifact_studies(spark, d):
    return access.studies_of(table(spark, d, "lineitem").select(F.col("l_partkey").alias("artifact"), F.col("l_orderkey").alias("run")), _orders(spark, d))


@query(f"select distinct l_partkey as artifact from lineitem join orders on o_orderkey = l_orderkey where o_custkey in (select study from {_MEMBERS} where usr = 7 and revoked_at is null)")
def artifacts_readable(spark, d):
    return access.readable(table(spark, d, "lineitem").select(F.col("l_partkey").alias("artifact"), F.col("l_orderkey").alias("run")), _orders(spark, d), _members(spark, d), 7)


@query(f"""select c_custkey as study, case when m.revoked_at is not null then 'reinstated' when m.role = 'operator' then 'unchanged' when m.role = 'admin' then 'last_admin' else 'changed' end as outcome from customer join {_MEMBERS} m on m.study = c_custkey
union all select c_custkey + 1000000, 'granted' from customer where c_custkey % 5 = 0""")
def member_grants(spark, d):
    m = _members(spark, d)
    wanted = m.select("study", "user", F.lit("operator").alias("role"))
    return access.granted_role(m, wanted.union(wanted.where("study % 5 = 0").withColumn("study", F.col("study") + 1000000))).select("study", "outcome")


@query("select c_custkey as user, c_name as name from customer where lower(c_name) = lower('CUSTOMER#000000007') or lower(c_name) = 'customer#7'")
def user_by_email(spark, d):
    users = table(spark, d, "customer").select(F.col("c_custkey").alias("user"), F.col("c_name").alias("name"), F.col("c_name").alias("email"))
    return access.by_email(users, F.lit("CUSTOMER#000000007")).union(access.by_email(users, F.lit("customer#7"))).select("user", "name")


# --- registration and states ---------------------------------------------------

_REQ = "(select o_orderkey as run, case when o_orderkey % 17 = 0 then -1 else o_custkey end as study, o_orderkey % 12 as instrument, o_orderkey % 40 as operator, case when o_orderkey % 5 = 0 then 'instrument' else 'user' end as actor_type, o_orderkey % 9 as actor_id from orders)"


@query(f"""select run, case when c.c_custkey is null then 'study_not_found' when c_acctbal < 0 then 'study_closed' when actor_type = 'instrument' and actor_id <> q.instrument then 'not_own_instrument'
  when s_suppkey is null or s_acctbal < 0 then 'instrument_unavailable' when g.study is null then 'not_granted' when p_partkey is null or p_size < 5 then 'operator_unavailable' end as problem
from {_REQ} q left join customer c on c_custkey = q.study left join supplier on s_suppkey = q.instrument left join part on p_partkey = q.operator left join {_GRANTS} g on g.study = q.study and g.instrument = q.instrument""")
def run_reference_problems(spark, d):
    key = F.col("o_orderkey")
    asked = table(spark, d, "orders").select(
        key.alias("run"), F.when(key % 17 == 0, -1).otherwise(F.col("o_custkey")).alias("study"), (key % 12).alias("instrument"), (key % 40).alias("operator"), F.when(key % 5 == 0, "instrument").otherwise("user").alias("actor_type"), (key % 9).alias("actor_id")
    )
    gone = lambda t, k, name, at, bad: table(spark, d, t).select(F.col(k).alias(name), F.when(F.expr(bad), F.lit(1)).alias(at))
    out = runs.reference_problems(asked, gone("customer", "c_custkey", "study", "closed_at", "c_acctbal < 0"), gone("supplier", "s_suppkey", "instrument", "disabled_at", "s_acctbal < 0"), _grants(spark, d), gone("part", "p_partkey", "operator", "disabled_at", "p_size < 5"))
    return out.select("run", "problem")


_STATE = "case o_orderstatus when 'O' then 'OPEN' when 'F' then 'PROCESSING' else 'PROCESSED' end"
_TO = "case o_orderkey % 4 when 0 then 'SEALED' when 1 then 'PROCESSING_FAILED' when 2 then 'QUARANTINED' else 'PROCESSED' end"


@query(f"""select run, before, case when ok then to_ else before end as state, ok or before = to_ as accepted from (select *, (before, to_) in (('OPEN', 'SEALED'), ('OPEN', 'QUARANTINED'), ('PROCESSING', 'PROCESSED'), ('PROCESSING', 'PROCESSING_FAILED')) as ok
  from (select o_orderkey as run, {_STATE} as before, {_TO} as to_ from orders))""")
def run_moves(spark, d):
    o = table(spark, d, "orders")
    current, asked = o.select(F.col("o_orderkey").alias("run"), F.expr(_STATE).alias("state")), o.select(F.col("o_orderkey").alias("run"), F.expr(_TO).alias("to"))
    return runs.moved(current, asked, F.lit("2024-01-01").cast("timestamp")).select("run", "before", "state", "accepted")


@query(f"select o_orderkey as run, {_STATE} as before, {_TO} as after from orders where ({_STATE}, {_TO}) not in (('OPEN', 'SEALED'), ('OPEN', 'QUARANTINED'), ('PROCESSING', 'PROCESSED'), ('PROCESSING', 'PROCESSING_FAILED'))")
def run_moves_illegal(spark, d):
    return lifecycle.illegal_moves(table(spark, d, "orders").select(F.col("o_orderkey").alias("run"), F.expr(_STATE).alias("before"), F.expr(_TO).alias("after"))).select("run", "before", "after")


_NAME = "l_linenumber || '/' || l_partkey || '/' || l_suppkey || '/' || cast(l_quantity as bigint)"


@query(f"""with e as (select l_orderkey as run, count(*) filter (l_linestatus <> 'F') as bad, sha256('[' || string_agg('"' || name || '"', ',' order by name) || ']') as digest from (select *, {_NAME} as name from lineitem where l_orderkey % 6 <> 0) group by l_orderkey)
select o_orderkey as run, case when o_orderstatus = 'P' then 'not_open' when e.run is null then 'empty' when bad > 0 then 'unverified' when o_orderkey % 5 = 0 then 'manifest_mismatch' else 'sealed' end as verdict from orders left join e on e.run = o_orderkey""")
def run_sealing(spark, d):
    name = F.concat_ws("/", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("bigint").cast("string"))
    entries = table(spark, d, "lineitem").where("l_orderkey % 6 <> 0").select(F.col("l_orderkey").alias("run"), name.alias("name"), F.concat(F.lit('"'), name, F.lit('"')).alias("entry"), (F.col("l_linestatus") == "F").alias("verified"))
    declared = entries.groupBy("run").agg(digests.ordered_digest(F.col("name"), F.col("entry")).alias("manifest_digest"))
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("run"), F.when(F.col("o_orderstatus") == "P", "SEALED").otherwise("OPEN").alias("state"))
    o = o.join(declared, "run", "left").withColumn("manifest_digest", F.when(F.col("run") % 5 != 0, F.col("manifest_digest")))
    return runs.sealing(o, entries)


@query("""select 'supersede_reason_present' as rule, count(*) filter (o_orderkey % 6 = 0 and o_orderkey % 4 <> 0 or o_orderkey % 6 <> 0 and o_orderkey % 4 = 0) as rows from orders
union all select 'no_self_supersede', count(*) filter (o_orderkey % 12 = 0) from orders union all select 'sealed_at_consistent', count(*) filter (o_orderstatus = 'F' and o_orderkey % 7 = 0 or o_orderstatus <> 'F' and o_orderkey % 7 <> 0) from orders
union all select 'quarantine_reason_present', count(*) filter (o_orderstatus = 'P' and o_orderkey % 3 <> 0 or o_orderstatus <> 'P' and o_orderkey % 3 = 0) from orders""")
def run_rules(spark, d):
    key = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(
        key.alias("run"), F.when(F.col("o_orderstatus") == "F", "SEALED").when(F.col("o_orderstatus") == "P", "QUARANTINED").otherwise("OPEN").alias("state"), F.when(key % 6 == 0, F.when(key % 12 == 0, key).otherwise(key - 1)).alias("supersedes"),
        F.when(key % 4 == 0, "r").alias("supersede_reason"), F.when(key % 7 != 0, 1).alias("sealed_at"), F.when(key % 3 == 0, "q").alias("quarantine_reason"),
    )
    return lifecycle.violations({name: (rows, rule) for name, rule in runs.run_rules().items()})


@query("""with e as (select l_orderkey as run, case when l_orderkey % 11 = 0 then 'same' when l_orderkey % 13 = 0 then '-' || l_linenumber else 'a/' || l_linenumber end as name, l_orderkey % 17 = 0 as bad_digest, l_orderkey % 19 = 0 as bad_size from lineitem),
g as (select run, name, count(*) as n, bool_or(bad_digest) as d, bool_or(bad_size) as s from e group by run, name)
select run, case min(case when n > 1 then 1 when name like '-%' then 2 when d then 3 when s then 4 end) when 1 then 'repeated_name' when 2 then 'name' when 3 then 'digest' else 'size' end as problem from g where n > 1 or name like '-%' or d or s group by run""")
def manifest_problems(spark, d):
    key, line = F.col("l_orderkey"), F.col("l_linenumber").cast("string")
    # a run's lines can share a number, as its names then do
    name = F.when(key % 11 == 0, "same").when(key % 13 == 0, F.concat(F.lit("-"), line)).otherwise(F.concat(F.lit("a/"), line))
    digest = digests.sha256(F.col("l_partkey"))
    return runs.manifest_problems(table(spark, d, "lineitem").select(key.alias("run"), name.alias("name"), F.when(key % 17 == 0, F.upper(F.concat(F.lit("x"), digest))).otherwise(digest).alias("digest"), F.when(key % 19 == 0, "01").otherwise("10").alias("size")))


@query("""with e as (select distinct l_orderkey as run, cast(l_linenumber as varchar) as name from lineitem) select run, name, case when run % 4 = 1 then 'deleted' when run % 4 = 2 then 'changed' else 'added' end as change
from (select * from e where run % 4 in (1, 2) union all select run, name || 'x' from e where run % 4 = 3) join orders on o_orderkey = run where o_orderstatus <> 'O'""")
def manifest_frozen(spark, d):
    e = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("run"), F.col("l_linenumber").cast("string").alias("name")).distinct().withColumn("size", F.lit(1))
    after = e.where("run % 4 <> 1").withColumn("size", F.when(F.col("run") % 4 == 2, 2).otherwise(1)).union(e.where("run % 4 = 3").withColumn("name", F.concat("name", F.lit("x"))))
    states = table(spark, d, "orders").select(F.col("o_orderkey").alias("run"), F.when(F.col("o_orderstatus") == "O", "OPEN").otherwise("SEALED").alias("state"))
    return runs.frozen_entries(e, after, states, ["size"])


@query("""select 'orders' as "table", count(*) as rows from orders join customer on c_custkey = o_custkey where c_nationkey % 5 = 0 and c_nationkey <> 10 union all select 'customer', count(*) from customer where c_nationkey % 5 = 0 and c_nationkey <> 10""")
def sandbox_reaped(spark, d):
    tenants = table(spark, d, "nation").select(F.col("n_nationkey").alias("tenant"), (F.col("n_nationkey") != 10).alias("sandbox"), F.when(F.col("n_nationkey") % 5 == 0, F.lit("2023-01-01")).otherwise("2025-01-01").cast("timestamp").alias("expires_at"))
    customers = table(spark, d, "customer").withColumnRenamed("c_nationkey", "tenant")
    orders = table(spark, d, "orders").join(customers, F.col("c_custkey") == F.col("o_custkey"))
    return runs.reaped({"orders": orders, "customer": customers}, tenants, F.lit("2024-01-01").cast("timestamp"))[1]


# --- lineage both ways -----------------------------------------------------------

_BOTH = f"""with recursive e as {_EDGES}, u(artifact, depth, derivation) as (select x, 0, cast(null as varchar) from (values (cast(150 as bigint)), (7)) t(x) union all select e.target, u.depth + 1, e.derivation from u join e on e.source = u.artifact where u.depth < 4),
  w(artifact, depth, derivation) as (select x, 0, cast(null as varchar) from (values (cast(150 as bigint)), (7)) t(x) union all select e.source, w.depth + 1, e.derivation from w join e on e.target = w.artifact where w.depth < 4),
  l as (select 'artifact' as kind, cast(artifact as varchar) as id, -2 * depth as layer, 0 as turn from u union all select 'derivation', derivation, 1 - 2 * depth, 0 from u where derivation is not null
    union all select 'artifact', cast(artifact as varchar), 2 * depth, 1 from w union all select 'derivation', derivation, 2 * depth - 1, 1 from w where derivation is not null),
  placed as (select kind, id, arg_min(layer, abs(layer) * 2 + turn) as layer from l group by kind, id) """


@query(_BOTH + "select * from placed")
def lineage_layers_both(spark, d):
    return lineage.both_layers(*lineage.traced(_edges(spark, d), _starts(spark), 4))


@query(_BOTH + f""", own as (select o.*, layer from {_ORIGINS} o join placed on kind = 'artifact' and id = cast(artifact as varchar) where artifact % 4 = 0), r as (select run, instrument, usr, min(layer) - 1 as layer from own group by run, instrument, usr)
select * from placed union all select 'run', cast(run as varchar), min(layer) from r group by run union all select 'instrument', cast(instrument as varchar), min(layer) - 1 from r group by instrument union all select 'user', cast(usr as varchar), min(layer) - 1 from r where usr is not null group by usr""")
def lineage_nodes(spark, d):
    return lineage.nodes(*lineage.traced(_edges(spark, d), _starts(spark), 4), _origins(spark, d).where("artifact % 4 = 0"))


@query(_walk_sql("source", "target", 16) + """, own as (select e.* from e where derivation in (select derivation from walked)), roots as (select distinct artifact from walked where artifact not in (select source from e)),
  f(root, artifact, derivation, depth) as (select artifact, artifact, cast(null as varchar), 0 from roots union select f.root, own.source, own.derivation, f.depth + 1 from f join own on own.target = f.artifact where f.depth < 32 and own.source <> own.target)
  select distinct root, derivation from f where derivation is not null""")
def lineage_processors(spark, d):
    edges = _edges(spark, d)
    return lineage.processors(lineage.walk(edges, _starts(spark)), edges)


@query(_walk_sql("source", "target", 16) + """, b as (select l_partkey % 200 as artifact, l_orderkey as run, l_orderkey % 3 = 0 as first, l_orderkey || '/' || l_linenumber as name from lineitem)
  select a.artifact, coalesce(case when a.artifact % 2 = 1 then 'made ' || a.artifact end, n.name) as name from (select distinct artifact from walked) a left join (select artifact, arg_min(name, (case when first then 0 else 1 end, run, name)) as name from b group by artifact) n on n.artifact = a.artifact""")
def lineage_names(spark, d):
    edges = _edges(spark, d)
    walked = lineage.walk(edges, _starts(spark))
    outputs = walked.where("artifact % 2 = 1").select("artifact", F.concat(F.lit("made "), F.col("artifact").cast("string")).alias("name")).distinct()
    key = F.col("l_orderkey")
    name = F.concat_ws("/", key, "l_linenumber")
    bound = table(spark, d, "lineitem").select((F.col("l_partkey") % 200).alias("artifact"), key.alias("run"), F.when(key % 3 == 0, key).alias("first_run"), name.alias("name"), F.struct(key, name).alias("at"))
    return lineage.names(walked, edges, outputs, bound)
