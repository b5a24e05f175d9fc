"""Who may do what: study roles, tenant roles, and access to artifacts by any study."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The roles, and the one that an instrument acts in.
ROLES, INSTRUMENT_ROLE = ("scientist", "operator", "steward", "admin"), "operator"


def live(memberships: DataFrame) -> DataFrame:
    return memberships.where("revoked_at is null")


def study_decisions(requests: DataFrame, memberships: DataFrame, grants: DataFrame, allowed: tuple[str, ...]) -> DataFrame:
    """requests (actor_type, actor_id, study and others) with reason: null where allowed, else instrument_role, not_granted, no_role, not_member or wrong_role.

    An admin passes always; an instrument acts as operator only, on studies
    granted to it; any other actor than a user holds no role. Of several live
    memberships in a study the one that passes counts.
    """
    held = live(memberships).groupBy(F.col("study").alias("_study"), F.col("user").alias("_user")).agg(F.max(F.col("role").isin("admin", *allowed)).alias("_passes"))
    granted = grants.select(F.col("study").alias("_gstudy"), F.col("instrument").alias("_instrument"), F.lit(True).alias("_granted")).distinct()
    kind = F.col("actor_type")
    out = requests.join(held, (kind == "user") & (F.col("study") == F.col("_study")) & (F.col("actor_id") == F.col("_user")), "left")
    out = out.join(granted, (kind == "instrument") & (F.col("study") == F.col("_gstudy")) & (F.col("actor_id") == F.col("_instrument")), "left")
    as_instrument = F.when(F.lit(INSTRUMENT_ROLE not in allowed), "instrument_role").when(F.col("_granted").isNull(), "not_granted")
    as_user = F.when(F.col("_passes").isNull(), "not_member").when(~F.col("_passes"), "wrong_role")
    reason = F.when(kind == "instrument", as_instrument).when(kind == "user", as_user).otherwise("no_role")
    return out.withColumn("reason", reason).select(*requests.columns, "reason")


def tenant_role(users: DataFrame, memberships: DataFrame, allowed: tuple[str, ...]) -> DataFrame:
    """users (user) with any live membership in one of the roles."""
    return users.join(live(memberships).where(F.col("role").isin(*allowed)).select("user"), "user", "left_semi")


def studies_of(bindings: DataFrame, runs: DataFrame) -> DataFrame:
    """artifact, study: the distinct studies of the runs that artifacts are bound to, first seen or by a derivation."""
    return bindings.select("artifact", "run").join(runs.select("run", "study"), "run").select("artifact", "study").distinct()


def readable(bindings: DataFrame, runs: DataFrame, memberships: DataFrame, user: object, allowed: tuple[str, ...] = ROLES) -> DataFrame:
    """artifact: those that any study which grants the user a role makes readable."""
    own = live(memberships).where((F.col("user") == F.lit(user)) & F.col("role").isin("admin", *allowed)).select("study")
    return studies_of(bindings, runs).join(own, "study", "left_semi").select("artifact").distinct()


def members(memberships: DataFrame, users: DataFrame) -> DataFrame:
    """Live memberships with their users (user, name, email)."""
    return live(memberships).join(users, "user")


def by_email(users: DataFrame, email: Column) -> DataFrame:
    """Users with that address, in any case."""
    return users.where(F.lower("email") == F.lower(email))


def by_key_prefix(keys: DataFrame, prefix: object) -> DataFrame:
    """The tenant of a key's prefix, which is unique over all tenants."""
    return keys.where(F.col("key_prefix") == F.lit(prefix))


def granted_role(memberships: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (study, user, role) with outcome: unchanged (the same live role), last_admin (would leave a study without one), reinstated, changed or granted."""
    now = memberships.select("study", "user", F.col("role").alias("_role"), "revoked_at")
    admins = live(memberships).where("role = 'admin'").groupBy("study").agg(F.count(F.lit(1)).alias("_admins"))
    out = wanted.join(now, ["study", "user"], "left").join(admins, "study", "left")
    alive = F.col("_role").isNotNull() & F.col("revoked_at").isNull()
    last = alive & (F.col("_role") == "admin") & (F.col("role") != "admin") & (F.col("_admins") == 1)
    outcome = F.when(alive & (F.col("_role") == F.col("role")), "unchanged").when(last, "last_admin").when(F.col("_role").isNull(), "granted").when(~alive, "reinstated").otherwise("changed")
    return out.withColumn("outcome", outcome).select(*wanted.columns, "outcome")
