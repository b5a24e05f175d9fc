"""Benchmark decontamination by spaced seeds.

A mask names token places, relative to a start, that count; the places between
them are ignored. Every start of every benchmark item and of every document is
hashed under each mask, and equal hashes are hits. Around a hit, item and text
are laid on each other token by token; the text is contaminated where at least
85 % of a window of WINDOW tokens (the whole item where it is shorter) agree,
so substitutions are tolerated. The masks leave out no such overlap: with up to
three substitutions in 20 tokens or two in 15, whatever their places, one of
them has a start that avoids them all (checked over all cases by a test).

Documents are read once. Their tokens are hashed, exploded and probed in one
generated-code stage against the benchmark's hashes, which are broadcast after
their number has been checked; beyond that bound the join is an ordinary one.
What leaves the stage are hits alone, already laid on the item.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keyed_rows, packed, saved, text_of

#: Token places that count.
MASKS = ((0, 1, 3, 4, 5, 6, 7), (0, 1, 3, 5, 8, 9, 10))
WINDOW, SUBSTITUTED = 20, 0.15
#: Items of fewer tokens, which no mask fits, are looked for whole, by one hash of all their tokens.
MIN_TOKENS = 8
#: Items of fewer tokens than this must agree in every token.
TOLERANT = 15
#: Rows of 16 bytes and an overhead that are broadcast at most: some 100 MB.
BROADCAST_ROWS = 1_000_000


def tokens(text: Column) -> Column:
    """64-bit hashes of the runs of letters and digits, lower-cased."""
    return F.transform(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != ""), lambda w: F.xxhash64(w))


def _seeds(rows: DataFrame, keep: list[str], masks: tuple[tuple[int, ...], ...] = MASKS) -> DataFrame:
    """rows with tokens w, exploded to seed, place: a row for each start and mask that fits."""
    rows = rows.select(*keep, F.size("w").alias("size"), F.posexplode("w").alias("place", "_token"))
    # get(w, i) is null behind the end, so the last counted place tells if the mask fits
    hashed = [
        F.when(F.col("place") + m[-1] < F.col("size"), F.xxhash64(F.lit(len(m)), F.lit(m[-1]), *(F.get(F.col("w"), F.col("place") + c) for c in m)))
        for m in masks
    ]
    return rows.withColumn("seed", F.explode(F.array(*hashed))).where("seed is not null")


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """r1, r2 (key of doc_id and text), item_id, overlap: the best window's share of equal tokens for each document and item that meet the bound."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), tokens(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("w")).where(F.size("w") > 0).distinct()
    items = saved(items, "items")
    # at most one mask for each length under MIN_TOKENS
    lengths = sorted(r[0] for r in items.select(F.size("w")).where(F.size("w") < MIN_TOKENS).distinct().collect())
    whole = tuple(tuple(range(n)) for n in lengths)
    seeds = _seeds(items.where(F.size("w") >= MIN_TOKENS), ["item_id", "w"])
    for m in whole:
        seeds = seeds.unionByName(_seeds(items.where(F.size("w") == len(m)), ["item_id", "w"], (m,)))
    seeds = saved(seeds.select("seed", "item_id", F.col("place").alias("item_place")).distinct(), "item-seeds")
    small = seeds.count() <= BROADCAST_ROWS
    rows = keyed_rows(docs, tokens(text_of(docs)).alias("w"))
    if small:
        hits = _seeds(rows, ["r1", "r2", "w"], MASKS + whole).join(F.broadcast(seeds), "seed")
        hits = hits.select("r1", "r2", "item_id", (F.col("place") - F.col("item_place")).alias("shift"), "w")
    else:  # tokens stay behind: only keys and places of hits are shuffled, and the tokens joined to what is left
        hits = _seeds(rows, ["r1", "r2", "w"], MASKS + whole).select("r1", "r2", "place", "seed").join(seeds, "seed")
        hits = hits.select("r1", "r2", "item_id", (F.col("place") - F.col("item_place")).alias("shift")).distinct()
        hits = hits.join(rows.dropDuplicates(["r1", "r2"]), ["r1", "r2"])
    item = items.select("item_id", F.col("w").alias("item"))
    hits = hits.join(F.broadcast(item) if small else item, "item_id")
    equal = F.transform("item", lambda t, i: F.when((F.col("shift") + i >= 0) & (F.get("w", F.col("shift") + i) == t), "1").otherwise("0"))
    laid = hits.select("r1", "r2", "item_id", "shift", F.array_join(equal, "").alias("equal")).distinct()
    n = F.length("equal")
    span = F.least(F.lit(WINDOW), n)
    share = F.array_max(F.transform(F.sequence(F.lit(1), n - span + 1), lambda i: F.length(F.replace(F.substr(F.col("equal"), i, span), F.lit("0"))))) / span
    need = F.when(n < TOLERANT, F.lit(1.0)).otherwise((span - F.floor(span * SUBSTITUTED)) / span)
    return laid.withColumn("overlap", share).where(F.col("overlap") >= need).groupBy("r1", "r2", "item_id").agg(F.max("overlap").alias("overlap"))


def contamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, contaminated, n_items, first_item, overlap for every row of docs.

    n_items counts the benchmark items found, first_item is the smallest of
    them (else null) and overlap the best share (else 0). Null and empty texts
    are clean, as are all texts where benchmark is empty. Items that repeat
    count once by item_id. Other columns of docs and benchmark are ignored.
    """
    found = contaminated(docs, benchmark).groupBy("r1", "r2").agg(F.countDistinct("item_id").alias("n_items"), F.min("item_id").alias("first_item"), F.max("overlap").alias("overlap"))
    return keyed_rows(docs, docs["doc_id"].alias("doc_id")).join(found, ["r1", "r2"], "left").select(
        "doc_id", F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).alias("n_items"), "first_item", F.round(F.coalesce("overlap", F.lit(0.0)), 6).alias("overlap")
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs, with its columns, without the rows that hold a benchmark passage."""
    found = contaminated(docs, benchmark).select("r1", "r2").distinct()
    return keyed_rows(docs, packed(docs)).join(found, ["r1", "r2"], "left_anti").select(*(F.col("own")[c].alias(c) for c in docs.columns))
