"""Near-duplicate lines by a deletion neighbourhood.

Two lines are near duplicates when one becomes the other by inserting, deleting
or substituting at most one word. A line's variants are the line without each
one of its words and the line itself, open at each gap; a variant's key is the
hash of the words before the place and the hash of those behind it. Lines that
differ by a substitution share the variant without the word at that place; of
two that differ by a word, one without it is the other, open at that gap; and
lines that share a variant are within the bound. So the earliest line of each
variant's group is a partner of all others in it, and no pairs inside a group
are made. Partners' word distances are then verified.

Exact repeats are folded first, by a map-side combined minimum, so a line that
a third of all documents hold is one row from then on. Variants are made only
of lines that can have a partner, and only where they can differ: one edit
leaves either the first or the last half of the shorter line's words alone, so
halves are counted first, and a line's half that no other line has rules out
edits in the other half.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, packed, saved, text_of

#: Words that a line needs to be looked at (all lines but blank ones), and to be looked at for near duplicates.
MIN_WORDS, NEAR_WORDS = 1, 8
#: Words up to which hashes of a line's beginnings are made one by one; longer lines' are made in runs of as many.
RUN = 64


_BLANKS = " \t\r\x0b\f"


def words_of(line: Column) -> Column:
    """The words of a line; one empty word if it has none. Single blanks between words, as most lines have, need no pattern."""
    others = [F.contains(line, F.lit(x)) for x in ("  ", *_BLANKS[1:])]
    odd = reduce(Column.__or__, others, F.startswith(line, F.lit(" ")) | F.endswith(line, F.lit(" ")))
    return F.when(odd, F.split(F.btrim(line, F.lit(_BLANKS)), r"[ \t\r\x0B\f]+")).otherwise(F.split(line, " "))


def placed_lines(docs: DataFrame) -> DataFrame:
    """at (doc_id, r, line_no), line."""
    rows = docs.select(docs["doc_id"].alias("doc_id"), _row_key(docs).alias("r"), F.split(text_of(docs), "\n").alias("lines"))
    return rows.select("doc_id", "r", F.posexplode("lines").alias("line_no", "line")).select(F.struct("doc_id", "r", "line_no").alias("at"), "line")


def _row_key(docs: DataFrame) -> Column:
    """Tells rows of one doc_id apart by their texts."""
    return F.xxhash64(docs["doc_id"], text_of(docs))


def _halves(n: Column, words: Column) -> Column:
    """Hashes of the halves by which a line of n words meets lines of as many words and of one more or less: heads, then tails."""

    def half(end: int, shorter: Column) -> Column:
        h = F.floor(shorter / 2).cast("int")
        part = F.slice(words, F.lit(1), h) if end == 0 else F.slice(words, -h, h)
        return F.xxhash64(F.lit(end), shorter, part)

    return F.array(*(half(end, shorter) for end in (0, 1) for shorter in (n, n - 1)))


def _chain(hashes: Column) -> Column:
    """Hashes of the first 0, 1, ... all of the words: XORs of the words' hashes with their places. Long lines go by runs of words, so that their time doesn't grow with the square of their length."""
    none = F.array(F.lit(0).cast("long"))
    grown = lambda xs: F.aggregate(xs, none, lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1).bitwiseXOR(x))))
    placed = F.transform(hashes, lambda h, i: F.xxhash64(h, i))
    # a transform of an array of one binds what is used more than once
    bound = lambda x, f: F.get(F.transform(F.array(x), f), F.lit(0))
    runs = bound(placed, lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / RUN).cast("int")), lambda k: grown(F.slice(p, k * RUN + 1, F.lit(RUN)))))
    before = lambda rs: grown(F.transform(rs, lambda r: F.element_at(r, -1)))
    joined = lambda rs: F.concat(none, F.flatten(F.zip_with(rs, F.slice(before(rs), F.lit(1), F.size(rs)), lambda r, b: F.transform(F.slice(r, F.lit(2), F.size(r) - 1), lambda x: x.bitwiseXOR(b)))))
    return F.when(F.size(hashes) <= RUN, grown(placed)).otherwise(bound(runs, joined))


def within_one(a: Column, b: Column) -> Column:
    """Whether one word edit at most turns one array of words into the other: their common head and tail leave one word."""
    less, most = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))

    def head(x: Column, y: Column) -> Column:
        step = lambda s, z: F.when((s >= 0) & z, s + 1).otherwise(F.when(s >= 0, -s - 1).otherwise(s))  # noqa: E731  a run that ended at n is -n - 1
        n = F.aggregate(F.zip_with(F.slice(x, 1, less), F.slice(y, 1, less), lambda p, q: p == q), F.lit(0), step)
        return F.when(n < 0, -n - 1).otherwise(n)

    return (most - less <= 1) & (F.least(less, head(a, b) + head(F.reverse(a), F.reverse(b))) >= most - 1)


def _hashes(line: Column) -> Column:
    return F.transform(words_of(line), lambda x: F.xxhash64(x))


def _line_key(hashes: Column) -> Column:
    return F.struct(F.xxhash64(F.lit(11), hashes).alias("k1"), F.xxhash64(F.lit(7919), hashes).alias("k2"))


def repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """at: the places of lines for which an earlier line is equal or within one word edit. Earlier: by doc_id (null first), the row's key, line number."""
    lines = placed_lines(docs).select("at", _hashes(F.col("line")).alias("w")).withColumn("n", F.size("w"))
    lines = saved(lines.select("at", _line_key(F.col("w")).alias("line_key"), "n", F.when(F.col("n") >= NEAR_WORDS, _halves(F.col("n"), F.col("w"))).alias("halves")), "lines")
    # read again before it is filtered: a filter on n pushed below would hash all words twice
    lines = lines.where(F.col("n") >= min_words)
    if min_words < 2:  # a blank line has one empty word
        lines = lines.where(F.col("line_key") != _line_key(F.array(F.xxhash64(F.lit("")))))
    # of equal lines the halves are equal, so the least of (place, halves) is the earliest place with them
    firsts = lines.where(F.col("n") >= NEAR_WORDS).groupBy("line_key").agg(F.min(F.struct("at", "halves")).alias("f"))
    keys = saved(firsts.select(F.col("f.at").alias("at"), F.posexplode("f.halves").alias("end", "half")), "line-halves")
    shared = keys.groupBy("half").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("half")
    able = keys.join(shared, "half").groupBy("at").agg(F.max(F.col("end") < 2).alias("same_head"), F.max(F.col("end") >= 2).alias("same_tail"))
    # numbered in the order of places, so that the earliest of a group is its least number
    able = placed_lines(docs).join(able, "at").dropDuplicates(["at"]).orderBy("at")
    able = saved(able.withColumn("id", F.monotonically_increasing_id()), "lines-able")
    dropped(keys)
    w = able.select("id", "same_head", "same_tail", _hashes(F.col("line")).alias("w")).withColumn("n", F.size("w"))
    w = w.select("id", "n", "same_head", "same_tail", _chain(F.col("w")).alias("before"), _chain(F.reverse("w")).alias("behind"))
    h = F.floor((F.col("n") - 1) / 2).cast("int")
    # gap g lies behind the first g words; without word g + 1, the words behind the gap are one fewer
    gap = F.explode(F.sequence(F.when(F.col("same_tail"), 0).otherwise(h), F.when(F.col("same_head"), F.col("n")).otherwise(F.col("n") - h)))
    w = w.withColumn("gap", gap)
    front = F.get("before", F.col("gap"))
    tails = F.array(F.get("behind", F.col("n") - F.col("gap")), F.when(F.col("gap") < F.col("n"), F.get("behind", F.col("n") - F.col("gap") - 1)))
    variants = w.select("id", front.alias("front"), F.explode(tails).alias("rear")).where("rear is not null")
    groups = variants.groupBy("front", "rear").agg(F.min("id").alias("other"), F.max("id").alias("last")).where("other < last").drop("last")
    found = variants.join(groups, ["front", "rear"]).where("other < id").groupBy("id").agg(F.min("other").alias("other"))
    own, theirs = able.select("id", "at", "line"), able.select(F.col("id").alias("other"), F.col("line").alias("earlier"))
    late = found.join(own, "id").join(theirs, "other").where(within_one(words_of(F.col("line")), words_of(F.col("earlier"))))
    late = late.select(_line_key(_hashes(F.col("line"))).alias("line_key"), F.lit(True).alias("late")).distinct()
    first = lines.groupBy("line_key").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("c")).join(late, "line_key", "left").where("c > 1 or late")
    # written, so that the join deals it anew and a hot line's places can be split over tasks
    first = saved(first.select("line_key", "first", "late"), "lines-repeated")
    return lines.select("at", "line_key").join(first.hint("merge"), "line_key").where("late or at <> first").select("at")


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with its columns, text without the lines that repeat an earlier one, and n_lines, n_dropped, emptied.

    A line repeats an earlier one of any document that is equal or differs by
    one word inserted, deleted or substituted, whether or not that earlier line
    stays itself. Words are split at blanks. Blank lines always stay (and lines
    under min_words words); lines under NEAR_WORDS words go as exact repeats only. emptied marks
    rows that lost a line and keep no word. Null and empty texts have nothing
    to lose and come back as they are. Identical rows share one decision.
    Columns of other names, including n_lines, n_dropped or emptied, come back
    too, the last three replaced.
    """
    gone = repeated_lines(docs, min_words).groupBy("at.r", "at.doc_id").agg(F.collect_set("at.line_no").alias("gone"))
    rows = docs.select(_row_key(docs).alias("r"), packed(docs)).alias("d")
    rows = rows.join(gone.alias("g"), (F.col("d.r") == F.col("g.r")) & F.col("own.doc_id").eqNullSafe(F.col("g.doc_id")), "left")
    text = F.col("own.text").cast("string")
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    left = F.array_join(F.filter(lines, lambda _, i: ~F.array_contains("gone", i)), "\n")
    rows = rows.select("own", "gone", F.size(lines).cast("long").alias("n"), F.when(F.col("gone").isNull(), text).otherwise(left).alias("left"))
    return rows.select(
        *(F.col("left").alias("text") if c == "text" else F.col("own")[c].alias(c) for c in docs.columns if c not in ("n_lines", "n_dropped", "emptied")),
        F.col("n").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
        (F.col("gone").isNotNull() & ~F.col("left").rlike(r"[^\s]")).alias("emptied"),
    )


def line_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept (some text is left, or none was lost), text_sha256 of the text left."""
    out = dedup_lines(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", (~F.col("emptied")).alias("kept"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


#: For doc_id unique. Near lines are joined over the same variants, which DuckDB spells out as text.
ORACLE = r"""
with l as (select doc_id, i - 1 as no, ls[i] as line, list_filter(string_split_regex(ls[i], '[ \t\r\x0B\f]+'), lambda x: x <> '') as w
  from (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents), range(1, len(ls) + 1) t(i)),
k as (select *, array_to_string(w, ' ') as k, len(w) as n, struct_pack(d := doc_id, o := no) as pos from l where len(w) >= 1),
f as (select k, any_value(w) as w, any_value(n) as n, min(pos) as first from k group by k),
v as (select k, first, p, case when p < 0 then k else array_to_string(w[1:p] || w[p + 2:], ' ') end as v from f, range(-1, n) t(p) where n >= 8),
g as (select v, p, min(first) as m from v group by v, p),
gw as (select v, min(case when p < 0 then m end) as whole, min(case when p >= 0 then m end) as cut from g group by v),
late as (select distinct v.k from v join g on g.v = v.v and g.p = v.p join gw on gw.v = v.v
  where (v.p >= 0 and (g.m < v.first or gw.whole < v.first)) or (v.p < 0 and gw.cut < v.first)),
gone as (select k.doc_id, k.no from k join f on f.k = k.k left join late on late.k = k.k where k.pos <> f.first or late.k is not null),
d as (select doc_id, list(no) as gone from gone group by doc_id),
t as (select x.doc_id, len(string_split(coalesce(x.text, ''), chr(10))) as n_lines, coalesce(len(d.gone), 0) as n_dropped, case when d.gone is null then coalesce(x.text, '') else
  array_to_string(list_transform(list_filter(range(0, len(string_split(x.text, chr(10)))), lambda i: not list_contains(d.gone, i)), lambda i: string_split(x.text, chr(10))[i + 1]), chr(10)) end as t
  from documents x left join d using (doc_id))
select doc_id, cast(n_lines as bigint) as n_lines, cast(n_dropped as bigint) as n_dropped, n_dropped = 0 or regexp_matches(t, '\S') as kept, sha256(t) as text_sha256 from t
"""
