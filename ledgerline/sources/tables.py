"""Tables behind a tenant scope, and objects stored under their digests."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@dataclass(frozen=True)
class Scope:
    """Who asks. Without a tenant nothing is visible."""

    tenant: object = None
    actor_type: str | None = None
    actor_id: str | None = None


class ScopedCatalog:
    """The only way to read tenants' tables: every frame carries the scope's filter."""

    def __init__(self, spark: SparkSession, folder: str, tenant_columns: dict[str, str]):
        self.spark, self.folder, self.tenant_columns = spark, folder, tenant_columns

    def read(self, name: str, scope: Scope) -> DataFrame:
        column = self.tenant_columns[name]  # a table without a tenant column can't be read here
        frame = table(self.spark, self.folder, name)
        return frame.where(F.col(column) == F.lit(scope.tenant)) if scope.tenant is not None else frame.where(F.lit(False))

    def unscoped(self, name: str, reason: str) -> DataFrame:
        """All tenants' rows, for jobs that say why."""
        if not reason:
            raise PermissionError("a reason is needed")
        return table(self.spark, self.folder, name)

    def check_write(self, frame: DataFrame, name: str, scope: Scope) -> DataFrame:
        """Rows that the scope may not write."""
        return frame.where(~F.col(self.tenant_columns[name]).eqNullSafe(F.lit(scope.tenant)))


def objects(spark: SparkSession, path: str) -> DataFrame:
    """path, length and digest of stored objects."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", F.sha2("content", 256).alias("digest"))


def heads(spark: SparkSession, path: str) -> DataFrame:
    """path, length and time of stored objects, without their contents."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")
