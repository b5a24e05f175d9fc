"""Processors: named, versioned functions from a run's artifacts to derived ones, each output a function of its inputs alone."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import canon
from ..functions.digests import digest_set, sha256
from . import uploads


@dataclass(frozen=True)
class Processor:
    """run: artifacts (run, name, digest, size, media_type and content where it is read) to one output per run: run, name, media_type, content."""

    name: str
    version: str
    run: Callable[[DataFrame], DataFrame]
    parameters: dict = field(default_factory=dict)


def _summary(artifacts: DataFrame, head: str, key: str, metadata: bool = False) -> DataFrame:
    """One canonical JSON text per run: its artifacts in the order of their names, and totals."""
    first = F.to_json(F.struct("digest", F.col("name").alias("logicalName"), F.col("media_type").alias("mediaType")))
    more = [F.lit(',"metadata":'), F.col("metadata")] if metadata else []
    entry = F.struct("name", F.concat(F.substr(first, F.lit(1), F.length(first) - 1), *more, F.lit(',"sizeBytes":"'), F.col("size").cast("string"), F.lit('"}')).alias("text"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["text"]), ",")
    total = F.sum(F.col("size").cast("decimal(38,0)")).cast("string")
    known = F.count_if(F.col("kind") != "unknown") if metadata else F.lit(0)
    rows = artifacts.groupBy("run").agg(F.count(F.lit(1)).cast("string").alias("n"), listed.alias("listed"), total.alias("total"), known.cast("string").alias("known"))
    tail = F.concat(F.lit(',"recognisedCount":'), "known", F.lit(f',"{key}":1}}')) if metadata else F.concat(F.lit(f',"{key}":1,"totalSizeBytes":"'), "total", F.lit('"}'))
    text = F.concat(F.lit('{"artifactCount":'), "n", F.lit(',"artifacts":['), "listed", F.lit("]"), tail)
    return rows.select("run", F.lit(f"{head}.json").alias("name"), F.lit("application/json").alias("media_type"), text.alias("content"))


def _checksums(artifacts: DataFrame) -> DataFrame:
    return _summary(artifacts, "manifest", "manifestVersion")


def _described(s: str, inspected: Column) -> Column:
    """Canonical JSON of what uploads.sniff tells of each kind, in the column s."""

    def told(kind: str, **fields: str) -> Column:
        whole = F.struct(*(F.col(f"{s}.{c}").alias(k) for k, c in sorted((fields | {"type": "kind"}).items())))
        return F.when(F.col(f"{s}.kind") == kind, F.to_json(whole, {"ignoreNullFields": "false"}))

    unknown = F.to_json(F.struct(inspected.alias("inspected"), F.lit("unknown").alias("type")))
    return F.coalesce(
        told("tiff", byteOrder="byte_order", height="height", width="width"),
        told("png", bitDepth="bit_depth", colorType="colour_type", height="height", width="width"),
        told("text", columnCount="column_count", delimiter="delimiter", lineCount="line_count"),
        unknown,
    )


def _metadata(artifacts: DataFrame) -> DataFrame:
    """By the bytes of contents up to the inspected size; larger ones are unknown and not inspected."""
    small = F.coalesce(F.col("size") <= uploads.INSPECTED, F.lit(True))
    seen = artifacts.withColumn("s", uploads.sniff(F.when(small, F.col("content")))).withColumn("kind", F.coalesce("s.kind", F.lit("unknown")))
    return _summary(seen.withColumn("metadata", _described("s", small)), "metadata", "summaryVersion", metadata=True)


REGISTRY = {p.name: p for p in (Processor("checksum-manifest", "1.0.0", _checksums), Processor("metadata-extract", "1.0.0", _metadata, {"inspectionLimitBytes": uploads.INSPECTED}))}


def derived(artifacts: DataFrame, processor: Processor) -> tuple[DataFrame, DataFrame]:
    """Outputs of a processor with their digests, and the derivations (run, processor, version, parameters_digest, inputs_digest, derivation) that made them; a derivation's id is a function of its identity."""
    outputs = processor.run(artifacts).withColumn("digest", sha256(F.col("content")))
    of = artifacts.groupBy("run").agg(digest_set(F.col("digest")).alias("inputs_digest"))
    of = of.withColumns({"processor": F.lit(processor.name), "version": F.lit(processor.version), "parameters_digest": F.lit(canon.digest(processor.parameters))})
    return outputs, of.withColumn("derivation", sha256(F.concat_ws("|", "inputs_digest", "processor", "version", "parameters_digest")))


def recorded(derivations: DataFrame, existing: DataFrame) -> DataFrame:
    """derivations with created: false for those whose identity exists, or that a smaller run of the batch brings as well."""
    keys = ["inputs_digest", "processor", "version", "parameters_digest"]
    first = derivations.groupBy(*keys).agg(F.min("run").alias("_first"))
    known = existing.select(*keys).distinct().withColumn("_known", F.lit(True))
    out = derivations.join(first, keys).join(known, keys, "left")
    return out.withColumn("created", F.col("_known").isNull() & (F.col("run") == F.col("_first"))).select(*derivations.columns, "created")
