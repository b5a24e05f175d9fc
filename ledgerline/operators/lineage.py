"""Bounded walks over provenance edges.

edges: source (what was made), target (what it was made of), derivation, role.
A walk keeps a visited set, so each artifact is expanded once, at its smallest
depth, however many paths lead to it; edges into a visited artifact still give
their row. Frontiers are written to the checkpoint folder between steps.
"""

from __future__ import annotations

import tempfile
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_DEPTH, MOST_DEPTH = 16, 32


def _cut(df: DataFrame) -> DataFrame:
    sc = df.sparkSession.sparkContext
    if not df.sparkSession.conf.get("spark.checkpoint.dir", None) and not sc.getCheckpointDir():
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="ledgerline-"))
    return df.checkpoint()


def walk(edges: DataFrame, starts: DataFrame, max_depth: int = DEFAULT_DEPTH, down: bool = False, most: int = MOST_DEPTH) -> DataFrame:
    """start, artifact, depth, derivation, role: for each start, one row per reached artifact and derivation, at the smallest depth; the start itself at depth 0 without derivation. Of equal depths the smallest role counts. A depth over most is refused."""
    if not 1 <= max_depth <= most:
        raise ValueError(f"a depth is 1 to {most}")
    here, there = ("target", "source") if down else ("source", "target")
    steps = edges.select(F.col(here).alias("artifact"), F.col(there).alias("next"), "derivation", "role")
    front = starts.select(F.col("artifact").alias("start"), "artifact").distinct()
    seen = front
    out = [front.select("start", "artifact", F.lit(0).alias("depth"), F.lit(None).cast(edges.schema["derivation"].dataType).alias("derivation"), F.lit(None).cast("string").alias("role"))]
    for depth in range(1, max_depth + 1):
        reached = front.join(steps, "artifact").groupBy("start", F.col("next").alias("artifact"), "derivation").agg(F.min("role").alias("role"))
        reached = _cut(reached.select("start", "artifact", F.lit(depth).alias("depth"), "derivation", "role"))
        if reached.isEmpty():
            break
        out.append(reached)
        front = _cut(reached.select("start", "artifact").distinct().join(seen, ["start", "artifact"], "left_anti"))
        seen = seen.union(front)
    rows = out[0]
    for r in out[1:]:
        rows = rows.unionByName(r)
    best = rows.groupBy("start", "artifact", "derivation").agg(F.min(F.struct("depth", "role")).alias("m"))
    return best.select("start", "artifact", F.col("m.depth").alias("depth"), "derivation", F.col("m.role").alias("role"))


def layers(walked: DataFrame, down: bool = False) -> DataFrame:
    """kind, id, layer: artifacts at twice their depth, derivations one nearer; negative upwards; the nearest counts."""
    sign = 1 if down else -1
    arts = walked.select(F.lit("artifact").alias("kind"), F.col("artifact").cast("string").alias("id"), (sign * 2 * F.col("depth")).alias("layer"))
    ders = walked.where("derivation is not null").select(F.lit("derivation"), F.col("derivation").cast("string"), sign * (2 * F.col("depth") - 1))
    return arts.union(ders).groupBy("kind", "id").agg(F.min_by("layer", F.abs("layer")).alias("layer"))


def graph_edges(walked: DataFrame, edges: DataFrame) -> DataFrame:
    """subject, relation, object over what a walk reached: used, wasGeneratedBy, wasDerivedFrom."""
    reached = walked.select("derivation").where("derivation is not null").distinct()
    own = edges.join(reached, "derivation", "left_semi")
    text = lambda c: F.col(c).cast("string")
    used = own.select(text("derivation").alias("subject"), F.lit("used").alias("relation"), text("target").alias("object"))
    made = own.select(text("source"), F.lit("wasGeneratedBy"), text("derivation"))
    came = own.select(text("source"), F.lit("wasDerivedFrom"), text("target"))
    return used.union(made).union(came).distinct()


def roots(walked: DataFrame, edges: DataFrame) -> DataFrame:
    """Reached artifacts that nothing produced."""
    return walked.select("artifact").distinct().join(edges.select(F.col("source").alias("artifact")), "artifact", "left_anti")


def truncated(walked: DataFrame, edges: DataFrame, max_depth: int, down: bool = False) -> DataFrame:
    """start: walks with an artifact at the last depth beyond which an unreached derivation leads on."""
    shortest = walked.groupBy("start", "artifact").agg(F.min("depth").alias("depth")).where(F.col("depth") >= max_depth)
    beyond = shortest.join(edges.select(F.col("target" if down else "source").alias("artifact"), "derivation").distinct(), "artifact")
    return beyond.join(walked.select("start", "derivation").distinct(), ["start", "derivation"], "left_anti").select("start").distinct()


def traced(edges: DataFrame, starts: DataFrame, max_depth: int = DEFAULT_DEPTH) -> tuple[DataFrame, DataFrame]:
    """The walks up and down from starts."""
    return walk(edges, starts, max_depth), walk(edges, starts, max_depth, down=True)


def both_layers(up: DataFrame, down: DataFrame) -> DataFrame:
    """kind, id, layer over both walks: the nearest layer counts, of equally near ones that of the ancestors."""
    of = lambda df, sign, turn: layers(df, sign > 0).select("kind", "id", "layer", F.lit(turn).alias("turn"))
    return of(up, -1, 0).unionByName(of(down, 1, 1)).groupBy("kind", "id").agg(F.min_by("layer", F.struct(F.abs("layer"), "turn")).alias("layer"))


def names(walked: DataFrame, edges: DataFrame, outputs: DataFrame, bindings: DataFrame) -> DataFrame:
    """artifact, name: a made artifact's by its outputs (artifact, name), a root's by its bindings (artifact, run, first_run, name, at): the first seen run's first, then the earliest."""
    reached = walked.select("artifact").distinct()
    made = reached.join(outputs.groupBy("artifact").agg(F.min("name").alias("made")), "artifact", "left")
    order = F.struct(~F.col("run").eqNullSafe(F.col("first_run")), "at", "run")
    bound = bindings.join(reached, "artifact", "left_semi").groupBy("artifact").agg(F.min_by("name", order).alias("bound"))
    return made.join(bound, "artifact", "left").select("artifact", F.coalesce("made", "bound").alias("name"))


def nodes(up: DataFrame, down: DataFrame, origins: DataFrame) -> DataFrame:
    """kind, id, layer of all nodes: artifacts and derivations, the runs that root artifacts came from (one layer before the foremost of them), and their instruments and users (one before the run, the foremost of several).
    origins: artifact, run, instrument, user."""
    placed = both_layers(up, down)
    own = origins.withColumn("id", F.col("artifact").cast("string")).join(placed.where("kind = 'artifact'"), "id")
    runs = own.groupBy("run", "instrument", "user").agg((F.min("layer") - 1).alias("layer"))
    out = placed.unionByName(runs.groupBy(F.lit("run").alias("kind"), F.col("run").cast("string").alias("id")).agg(F.min("layer").alias("layer")))
    for kind in ("instrument", "user"):
        out = out.unionByName(runs.where(F.col(kind).isNotNull()).groupBy(F.lit(kind).alias("kind"), F.col(kind).cast("string").alias("id")).agg((F.min("layer") - 1).alias("layer")))
    return out


def processors(walked: DataFrame, edges: DataFrame, max_depth: int = MOST_DEPTH) -> DataFrame:
    """root, derivation: all derivations of the walked graph that a root's content went into, by one search from all roots."""
    reached = walked.where("derivation is not null").select("derivation").distinct()
    own = edges.join(reached, "derivation", "left_semi")
    found = walk(own, roots(walked, edges), max_depth, down=True)
    return found.where("derivation is not null").select(F.col("start").alias("root"), "derivation").distinct()


def prov_entries(walked: DataFrame, edges: DataFrame, origins: DataFrame, namespace: str = "run") -> DataFrame:
    """section, id, body: the entries of a W3C PROV-JSON document as rows, one JSON text each; null attributes are left out, relations numbered by their content within a section."""
    name = lambda kind, c: F.concat(F.lit(f"{namespace}:{kind}/"), F.col(c).cast("string"))
    typed = lambda c, kind: F.when(c.isNotNull(), F.struct(c.cast("string").alias("$"), F.lit(kind).alias("type")))
    reached = walked.where("derivation is not null").select("derivation").distinct()
    own = edges.join(reached, "derivation", "left_semi")
    first = origins.join(roots(walked, edges), "artifact", "left_semi")

    def named(df: DataFrame, section: str, ident: Column, kind: str, *more: Column) -> DataFrame:
        return df.select(F.lit(section).alias("section"), ident.alias("id"), F.to_json(F.struct(F.lit(kind).alias("prov:type"), *more)).alias("body")).distinct()

    artifact, derivation, run = name("artifact", "artifact"), name("derivation", "derivation"), name("run", "run")
    things = [
        named(walked, "entity", artifact, "Artifact", F.concat(F.lit("artifact "), F.col("artifact").cast("string")).alias("prov:label")),
        named(reached, "activity", derivation, "Computation", F.concat(F.lit("derivation "), F.col("derivation").cast("string")).alias("prov:label")),
        named(first, "activity", run, "Acquisition", typed(F.col("at"), "xsd:dateTime").alias("prov:startTime")),
        named(first.where("instrument is not null"), "agent", name("instrument", "instrument"), "prov:SoftwareAgent"),
        named(first.where("user is not null"), "agent", name("user", "user"), "prov:Person"),
    ]
    ties = [
        own.select(F.lit("used").alias("section"), F.to_json(F.struct(derivation.alias("prov:activity"), name("artifact", "target").alias("prov:entity"), typed(F.col("role"), "xsd:string").alias("prov:role"))).alias("body")),
        own.select(F.lit("wasGeneratedBy"), F.to_json(F.struct(name("artifact", "source").alias("prov:entity"), derivation.alias("prov:activity")))),
        first.select(F.lit("wasGeneratedBy"), F.to_json(F.struct(artifact.alias("prov:entity"), run.alias("prov:activity")))),
        own.select(F.lit("wasDerivedFrom"), F.to_json(F.struct(name("artifact", "source").alias("prov:generatedEntity"), name("artifact", "target").alias("prov:usedEntity")))),
        first.where("instrument is not null").select(F.lit("wasAssociatedWith"), F.to_json(F.struct(run.alias("prov:activity"), name("instrument", "instrument").alias("prov:agent")))),
        first.where("user is not null").select(F.lit("wasAssociatedWith"), F.to_json(F.struct(run.alias("prov:activity"), name("user", "user").alias("prov:agent")))),
    ]
    relations = reduce(DataFrame.union, ties).distinct()
    order = Window.partitionBy("section").orderBy("body")
    numbered = relations.select("section", F.concat(F.lit("_:"), F.col("section"), F.row_number().over(order).cast("string")).alias("id"), "body")
    return reduce(DataFrame.unionByName, things).unionByName(numbered)


def prov_json(entries: DataFrame) -> DataFrame:
    """document: the entries of prov_entries as one text. A document is made for a reader and as large as its graph; graphs at large stay rows."""
    body = F.concat(F.to_json(F.array("id")), F.lit(":"), F.col("body"))
    key = F.struct("id", F.concat(F.substr(body, F.lit(2), F.instr(body, "]:") - 2), F.lit(":"), F.col("body")).alias("text"))
    parts = entries.groupBy("section").agg(F.array_join(F.transform(F.array_sort(F.collect_list(key)), lambda x: x["text"]), ",").alias("inner"))
    whole = F.struct("section", F.concat(F.lit('"'), F.col("section"), F.lit('":{'), F.col("inner"), F.lit("}")).alias("text"))
    return parts.agg(F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.collect_list(whole)), lambda x: x["text"]), ","), F.lit("}")).alias("document"))
