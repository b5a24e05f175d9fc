"""MinHash near-dedup with odd sketches.

One Arrow pass over the texts makes, of each text's shingle set, its 128-bit
signature, min-hash samples grouped into bands, and an odd sketch: a bitmap in
which each sample flips one bit, so that the population count of two bitmaps'
XOR tells in how many samples the sets differ, most precisely where they are
alike. A second bitmap is folded from the whole set the same way; the population
count of two such bitmaps' XOR never exceeds the number of shingles that only
one set has, so a pair that it rules out can't be a link. Texts of equal sets form classes; only a class's smallest doc_id goes on.

Representatives that share a band are candidates. A first round pairs each one
with the foremost of all its buckets' heads, a second with a few heads that are still in other components, and the
last with all members of its buckets that are. So the first rounds make a few
pairs for each text, however large its buckets are, a large group of near copies
is one component early, and links inside a component, which can't change it,
aren't sought. Pairs that the bitmaps don't rule out are confirmed on the
full sets, and the confirmed links give the components. A bucket's head is the
member whose own buckets hold most others: of a group of copies, the text that
they were made from.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, saved, text_of

#: Samples of each set; bands, and samples in a band (drawn at random, so bands share samples). At a similarity of exactly 0.8 a pair shares no band with odds of about 8e-5 (measured with these bands; independent ones would have 2e-6), at 0.83 of 3e-6.
SAMPLES, BANDS, ROWS = 256, 72, 8
#: Words of a sketch (64 bits each), and how far below the threshold the sketch's estimate must lie to rule out a pair: over four deviations.
SKETCH_WORDS, MARGIN = 16, 0.15
#: Shingles up to which a set's parity bitmap rules out more than its odd sketch; in the bucket join, either is compared.
SMALL = 1500
#: Heads that a text is paired with in the second round, for each component they are in.
HEADS = 4
_SEED = 20_240_607
_CHUNK = 4096
_U64 = np.uint64


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U64(27))) * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


class Shingler:
    """Sorted distinct 64-bit hashes of a text's word shingles. Words: runs of bytes other than space, tab, line feed, VT, FF and CR, with A-Z lower-cased."""

    def __init__(self, size: int, cached: int = 500_000):
        import xxhash

        self.size, self.cached, self.words, self.digest = size, cached, {}, xxhash.xxh3_64_intdigest

    def __call__(self, text: str | None) -> np.ndarray:
        words, known = (text or "").encode("utf-8", "surrogatepass").lower().split(), self.words
        if len(known) > self.cached:
            known.clear()
        for w in set(words).difference(known):
            known[w] = self.digest(w)
        h = np.fromiter(map(known.__getitem__, words), _U64, len(words))
        if not words:
            return h
        n = min(self.size, len(words))
        with np.errstate(over="ignore"):
            out = np.full(len(words) - n + 1, _U64(n))
            for k in range(n):
                out = _mixed(out * _U64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k])
        return np.unique(out)


class Sketcher:
    """Signature, band keys, odd sketch and parity bitmap of a shingle set."""

    def __init__(self):
        rng = np.random.default_rng(_SEED)
        self.a = rng.integers(0, 1 << 32, SAMPLES, np.uint32) | np.uint32(1)
        self.b = rng.integers(0, 1 << 32, SAMPLES, np.uint32)
        self.bands = np.stack([rng.permutation(SAMPLES)[:ROWS] for _ in range(BANDS)])
        self.salts = rng.integers(0, 1 << 63, SAMPLES, np.uint64)
        self.band_salts = rng.integers(0, 1 << 63, BANDS, np.uint64)

    def samples(self, shingles: np.ndarray) -> np.ndarray:
        x = (shingles >> _U64(32)).astype(np.uint32)
        low = np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
        for i in range(0, len(x), _CHUNK):
            np.minimum(low, (x[i : i + _CHUNK, None] * self.a + self.b).min(axis=0), out=low)
        return low

    def __call__(self, shingles: np.ndarray) -> tuple[list[int], list[int], list[int], list[int]]:
        with np.errstate(over="ignore"):
            sign = [int(np.bitwise_xor.reduce(_mixed(shingles * _U64(m))).astype(np.int64)) for m in (3, 0xD1342543DE82EF95)]
            low = self.samples(shingles).astype(_U64)
            keys = self.band_salts.copy()
            for k in range(ROWS):
                keys = _mixed(keys * _U64(0x9E3779B97F4A7C15) + low[self.bands[:, k]])
            bits = _mixed(low + self.salts) % _U64(SKETCH_WORDS * 64)
        odd = np.zeros(SKETCH_WORDS, _U64)
        np.bitwise_xor.at(odd, (bits >> _U64(6)).astype(np.int64), _U64(1) << (bits & _U64(63)))
        flips = np.bincount((shingles & _U64(SKETCH_WORDS * 64 - 1)).astype(np.int64), minlength=SKETCH_WORDS * 64) & 1
        parity = np.packbits(flips.astype(np.uint8), bitorder="little").view(np.int64)
        return sign, keys.astype(np.int64).tolist(), odd.astype(np.int64).tolist(), parity.tolist()


def _sketched(docs: DataFrame, size: int) -> DataFrame:
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("sig1", pa.int64()), ("sig2", pa.int64()), ("keys", pa.list_(pa.int64())), ("odd", pa.list_(pa.int64())), ("parity", pa.list_(pa.int64()))])

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, make = Shingler(size), Sketcher()
        for batch in batches:
            out = []
            for text in batch.column("text"):
                s = shingle(text.as_py())
                sign, *sketches = make(s) if len(s) else ([0, 0], None, None, None)
                out.append((len(s), *sign, *sketches))
            columns = list(zip(*out, strict=True)) if out else [()] * 6
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, f.type) for c, f in zip(columns, list(schema)[1:], strict=True))], schema=schema)

    return rows.mapInArrow(sketch, "doc_id long, n_shingles long, sig1 long, sig2 long, keys array<long>, odd array<long>, parity array<long>")


def _sets(docs: DataFrame, size: int) -> DataFrame:
    """doc_id and its full shingle set."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"))

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(size)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([shingle(t.as_py()).astype(np.int64) for t in part.column("text")], pa.list_(pa.int64()))], names=["doc_id", "shingles"])

    return rows.mapInArrow(full, "doc_id long, shingles array<long>")


def differing(a: Column, b: Column) -> Column:
    """The population count of two bitmaps' XOR, word by word, in generated code."""
    return reduce(Column.__add__, (F.bit_count(F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k)))) for k in range(SKETCH_WORDS)))


def estimate(odd_a: Column, odd_b: Column) -> Column:
    """The similarity that two odd sketches tell."""
    bits = SKETCH_WORDS * 64
    differ = differing(odd_a, odd_b)
    # more than 49 % of the bits differ only where hardly a sample agrees
    return 1 - -bits / 2 * F.log(1 - 2 * F.least(differ, F.lit(int(0.49 * bits))) / F.lit(bits)) / (2 * SAMPLES)


def _sizes_fit(percent: int) -> Column:
    return 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")


def _most_apart(percent: int) -> Column:
    """In how many shingles a link's sets differ at most; their parity bitmaps differ in no more bits."""
    return F.floor((100 - percent) * (F.col("n_a") + F.col("n_b")) / (100 + percent))


def _marks_fit(percent: int) -> Column:
    """Whether the marks of a and b leave a link possible: parity bitmaps of two small sets, odd sketches of two others; a small and a larger set aren't compared."""
    bits = SKETCH_WORDS * 64
    odd = int(bits / 2 * (1 - math.exp(-4 * SAMPLES * (1 - percent / 100 + MARGIN) / bits))) + 1
    most = F.when((F.col("n_a") <= SMALL) & (F.col("n_b") <= SMALL), _most_apart(percent)).when((F.col("n_a") > SMALL) & (F.col("n_b") > SMALL), odd).otherwise(bits)
    return differing(F.col("mark_a"), F.col("mark_b")) <= most


def _may_link(percent: int) -> Column:
    """Whether sizes, parity bitmaps and odd sketches of a and b leave a link possible."""
    bits = differing(F.col("parity_a"), F.col("parity_b")) <= _most_apart(percent)
    return _sizes_fit(percent) & bits & (estimate(F.col("odd_a"), F.col("odd_b")) >= percent / 100 - MARGIN)


def _confirmed(pairs: DataFrame, sketches: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose full sets are similar enough."""
    left, right = (sketches.select(F.col("doc_id").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("odd").alias(f"odd_{x}"), F.col("parity").alias(f"parity_{x}")) for x in "ab")
    near = pairs.join(right, "b").join(left, (left["a"] == pairs["a"]) & _may_link(percent)).select(pairs["a"], "b")
    near = saved(near, "minhash-near")
    held = near.join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb")), "b")
    held = held.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa")), "a")
    both = F.size(F.array_intersect("sa", "sb"))
    return saved(held.where(100 * both >= percent * (F.size("sa") + F.size("sb") - both)).select("a", "b"), "minhash-links")


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) for every end of links, by alternating large and small stars."""
    edges = saved(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "stars")
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # every larger neighbour of u, and no other, is tied to the smallest around u
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        after = saved(small, "stars")
        mark = lambda e: e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        same = mark(after) == mark(edges)
        dropped(edges)
        edges = after
        if same:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _apart(bucket: DataFrame, parts: DataFrame) -> DataFrame:
    """key, a, b of a bucket's head and member with their components c_a, c_b."""
    for x in "ab":
        known = parts.select(F.col("node").alias(x), F.col("component").alias(f"c_{x}"))
        bucket = bucket.join(known, x, "left").withColumn(f"c_{x}", F.coalesce(f"c_{x}", x))
    return bucket


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of docs.

    Two texts are linked when their sets of size-word shingles share at least
    percent of a hundred of their union; a text of fewer words is one shingle,
    one without words has none and is linked with nothing. component_id is the
    smallest doc_id that links lead to, itself included; kept marks that row.
    Null texts are empty. A row with a null doc_id takes no part and is kept
    with a null component_id. Rows that repeat a doc_id share a component if
    their sets are equal. Other columns are ignored.
    """
    sketched = saved(_sketched(docs, size), "minhash-sketched")
    member = ["sig1", "sig2", "n_shingles"]
    rows = saved(sketched.select("doc_id", *member), "minhash-rows")
    full = "n_shingles > 0 and doc_id is not null"
    classes = saved(rows.where(full).groupBy(*member).agg(F.min("doc_id").alias("rep")), "minhash-classes")
    reps = sketched.where(full).join(classes, member).where("doc_id = rep").dropDuplicates(["doc_id", *member])
    reps = saved(reps.select("doc_id", "n_shingles", "keys", "odd", "parity"), "minhash-reps")
    dropped(sketched)
    posted = reps.select(F.col("doc_id").alias("b"), F.explode("keys").alias("key"))
    shared = posted.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    bucket = saved(posted.join(shared.hint("merge"), "key"), "minhash-posted")
    weighed = bucket.join(bucket.groupBy("b").agg(F.sum("n").alias("weight")), "b").select("key", "b", "weight")
    heads = weighed.groupBy("key").agg(F.max(F.struct("weight", (-F.col("b")).alias("less"))).alias("head"))
    heads = heads.select("key", (-F.col("head.less")).alias("a"), F.col("head.weight").alias("weight"))
    bucket = saved(weighed.select("key", "b").join(heads, "key"), "minhash-buckets")
    met = saved(bucket.select(F.col("b").alias("doc_id")).distinct(), "minhash-met")
    sketches = saved(reps.select("doc_id", "n_shingles", "odd", "parity").join(met, "doc_id", "left_semi"), "minhash-sketches")
    # texts of the met ones are dealt by id, at every size by the same plan; of rows that repeat an id, those with the class's set count
    sets = _sets(docs.join(met.hint("merge"), "doc_id", "left_semi"), size).join(sketches.select("doc_id", "n_shingles").distinct(), "doc_id")
    sets = saved(sets.where(F.size("shingles") == F.col("n_shingles")).select("doc_id", "shingles").dropDuplicates(), "minhash-sets")
    foremost = F.max(F.struct("weight", (-F.col("a")).alias("less")))
    first = bucket.where("a <> b").groupBy("b").agg((-foremost["less"]).alias("a"))
    links = _confirmed(first, sketches, sets, percent)
    parts = saved(components(links), "minhash-parts")
    some = _apart(bucket, parts).where("a <> b and c_a <> c_b").select("a", "b", "c_a", "weight").distinct()
    some = some.withColumn("nth", F.row_number().over(Window.partitionBy("b", "c_a").orderBy(F.desc("weight"), "a"))).where(F.col("nth") <= HEADS)
    links = links.union(_confirmed(some.select("a", "b"), sketches, sets, percent))
    parts = saved(components(links), "minhash-parts")
    inside = saved(_apart(bucket, parts).select("key", "b", F.col("c_b").alias("c")), "minhash-inside")
    mixed = inside.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("key")
    marks = sketches.select(F.col("doc_id").alias("b"), "n_shingles", F.when(F.col("n_shingles") <= SMALL, F.col("parity")).otherwise(F.col("odd")).alias("mark"))
    mixed = saved(inside.join(mixed, "key").join(marks, "b"), "minhash-mixed")
    x, y = (mixed.select("key", *(F.col(c).alias(c2) for c, c2 in (("b", n), ("c", f"c_{n}"), ("n_shingles", f"n_{n}"), ("mark", f"mark_{n}")))) for n in "ab")
    # the bitmaps are compared where the ends meet, so pairs that can't link are hardly ever rows
    rest = x.join(y, (x["key"] == y["key"]) & (F.col("a") < F.col("b")) & (F.col("c_a") != F.col("c_b")) & _sizes_fit(percent) & _marks_fit(percent)).select("a", "b").distinct()
    links = links.union(_confirmed(rest, sketches, sets, percent))
    parts = saved(components(links), "minhash-parts")
    found = classes.join(parts, classes["rep"] == parts["node"], "left").select(*member, F.coalesce("component", "rep").alias("c"))
    out = rows.select("doc_id", *member).join(found, member, "left")
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("c", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


ORACLE = r"""
with recursive w as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
s as (select doc_id, case when len(w) = 0 then [] when len(w) = 1 then w else list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) end as s from w),
n as (select doc_id, len(s) as n from s),
e as (select doc_id, unnest(s) as g from s),
f as (select g, count(*) as df from e group by g),
o as (select e.doc_id, e.g, n.n, row_number() over (partition by e.doc_id order by f.df, e.g) as r from e join f using (g) join n using (doc_id)),
p as (select doc_id, g, n from o where r <= n - (80 * n + 99) // 100 + 1),
c as (select distinct a.doc_id as a, b.doc_id as b, a.n as na, b.n as nb from p a join p b using (g) where a.doc_id < b.doc_id and 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
k as (select c.a, c.b, c.na, c.nb, len(list_intersect(x.s, y.s)) as i from c join s x on x.doc_id = c.a join s y on y.doc_id = c.b),
l as (select a, b from k where 100 * i >= 80 * (na + nb - i)),
u as (select a as x, b as y from l union all select b, a from l),
r(x, c) as (select doc_id, doc_id from n union select u.y, r.c from r join u on u.x = r.x)
select n.doc_id, cast(any_value(n.n) as bigint) as n_shingles, min(r.c) as component_id, n.doc_id = min(r.c) as kept from n join r on r.x = n.doc_id group by n.doc_id
"""


def without_near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """docs, with its columns, without the rows that near_duplicates() doesn't keep; rows that repeat a kept doc_id and its set all stay."""
    gone = near_duplicates(docs, size, percent).where("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti").select(*docs.columns)
