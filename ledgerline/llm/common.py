"""What the training-data operators share: table access, tables in the shared folder, row keys."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_local: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where it is unset and the master is local (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = tempfile.mkdtemp(prefix="ledgerline-")
    return _local[app]


def saved(df: DataFrame, label: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Deletes a table of saved() that nothing reads any more."""
    path = getattr(df, "_saved_path", None)
    if path:
        jvm = df.sparkSession._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def key128(*cols: Column) -> list[Column]:
    """Two independent 64-bit hashes; nulls and column borders count, so that equal keys mean equal values but for odds of n^2/2^129."""
    parts = [x for c in cols for x in (c, c.isNull())]
    return [F.xxhash64(F.lit(11), *parts), F.xxhash64(F.lit(7919), *parts)]


def text_of(df: DataFrame, column: str = "text") -> Column:
    return F.coalesce(df[column].cast("string"), F.lit(""))


def keyed_rows(docs: DataFrame, *more: Column) -> DataFrame:
    """r1, r2 (the row's key: doc_id and text), and more; none of docs' own names."""
    r1, r2 = key128(docs["doc_id"], text_of(docs))
    return docs.select(r1.alias("r1"), r2.alias("r2"), *more)


def packed(docs: DataFrame) -> Column:
    """All of docs' columns in one, so that their names can't clash with others."""
    return F.struct(*(docs[c] for c in docs.columns)).alias("own")
