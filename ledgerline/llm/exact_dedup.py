"""Exact dedup by most-significant-digit radix partitioning.

A text's digit string is its length (eight bytes) and then its bytes. Every
round takes the next, ever wider, run of bytes as the digit and splits each
group by it. A group with one row is done, and so is one whose texts have
ended: its texts are equal, byte by byte, without any digest. Only rows that
still share everything read so far go into the next round, and they carry no
more than the bytes not yet read.

Groups of any size are split by a map-side combined count; the rows then join
those counts, a join whose large keys Spark's adaptive execution can split, so
a text with a third of all rows never meets in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, text_of

#: Bytes read by each round; the last width repeats until all texts have ended.
WIDTHS = (64, 1024, 16384, 262144, 4194304)


def exact_dedup(docs: DataFrame, widths: tuple[int, ...] = WIDTHS) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    The row with the largest doc_id of equal texts stays. A null text counts
    as empty, and all empty texts are equal. A null doc_id is smaller than any
    other. Of rows that repeat the largest doc_id of a group one stays; all count
    in group_size. Other columns of docs are ignored.
    """
    text = text_of(docs)
    rows = docs.select(
        docs["doc_id"].alias("doc_id"),
        F.octet_length(text).cast("long").alias("n"),
        F.sha2(text, 256).alias("text_sha256"),
        text.cast("binary").alias("rest"),
        F.lit(0).cast("long").alias("gid"),
    )
    done, read, k = [], 0, 0
    while True:
        width = widths[min(k, len(widths) - 1)]
        digit = F.substring("rest", 1, width)
        read += width
        groups = saved(
            rows.groupBy("gid", "n", digit.alias("digit"))
            .agg(F.count(F.lit(1)).alias("size"), F.max("doc_id").alias("last"))
            .where("size > 1")
            .withColumn("next", F.monotonically_increasing_id()),
            "radix-groups",
        )
        open_ = F.col("size").isNotNull() & (F.col("n") > read)
        split = (
            rows.withColumn("digit", digit)
            .join(groups.hint("merge"), ["gid", "n", "digit"], "left")  # the same plan at every size
            .select(
                "doc_id",
                "n",
                "text_sha256",
                F.when(open_, F.expr(f"substring(rest, {width + 1})")).alias("rest"),
                F.when(open_, F.col("next")).alias("gid"),
                F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("last")).alias("keep_id"),
                F.coalesce("size", F.lit(1)).alias("group_size"),
            )
        )
        if groups.where(F.col("n") > read).isEmpty():
            done.append(split.drop("rest", "n", "gid"))
            break
        split = saved(split, "radix-rows")
        done.append(split.where("gid is null").drop("rest", "n", "gid"))
        rows = split.where("gid is not null").select("doc_id", "n", "text_sha256", "rest", "gid")
        k += 1
    out = reduce(DataFrame.unionByName, done).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
    # rows that repeat a kept one are alike in all columns: they are counted, and all but one given back as not kept
    alike = out.where("kept").groupBy("doc_id", "keep_id", "group_size", "text_sha256").agg(F.count(F.lit(1)).alias("n"))
    alike = alike.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n")))).withColumn("kept", F.col("i") == 1)
    return out.where("not kept").unionByName(alike.select(*out.columns))


ORACLE = """
select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size,
  doc_id is not distinct from max(doc_id) over same as kept, sha256(coalesce(text, '')) as text_sha256
from documents window same as (partition by coalesce(text, ''))
"""
