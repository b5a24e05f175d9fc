"""SentencePiece encoding and decoding over a relational lattice.

A text is cut where the model lets no piece cross: before blanks and line feeds
first, and these words again between any two characters that stand side by side
in no piece. Every distinct part that the corpus then has is encoded by
relations: its substrings up to the longest piece's length are exploded and
equi-joined to the piece table, the edges are grouped by part, and Spark's
higher-order aggregate folds them to pieces.

For a unigram model the fold is Viterbi's: the best sum of scores into each
place. For a BPE model scores are ranks of merges and not costs of a path, so
the best path is not what such a model encodes. There the state of the fold is
the set of places where pieces end, and edges come in the order of their ranks
and places: an edge whose ends are in the set, with one other between them,
joins two pieces and takes that one out. One pass is exact where every piece is
put together from better ranked ones, which is tested for each piece of the
model; parts with a piece that is not are folded by repeated passes.

Parts reach the texts in blocks. A block is a number of bytes of the input's
files. An Arrow pass gives each block's distinct parts, those of all blocks are
dealt by their text, made distinct, encoded and joined to the blocks again, and
each block's dictionary is written to the shared folder. A second Arrow pass
over the texts reads the dictionary of its block and puts the pieces of its
parts in a row, column by column. So neither texts nor the places of parts are
shuffled, and a dictionary is bounded by the bytes of a block and not by the
corpus. Rows that do not come straight from files are written to such first.
"""

from __future__ import annotations

import hashlib
import heapq
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import saved, shared_dir, text_of

MARK = "▁"
#: Bytes of input files that share a dictionary.
BLOCK_BYTES = 64 << 20
#: Characters of the longest part that is encoded by relations, and of those whose fold keeps its places in the bits of one number.
LONGEST_WORD, BITS = 4096, 62
#: Bytes of text that a task encodes at once, and parts that it gathers before it sends them on.
SLICE_BYTES, GATHERED = 4 << 20, 800_000
#: What an unknown character costs below the lowest score, in a unigram model.
UNKNOWN_PENALTY = 10.0
_NORMAL, _UNKNOWN, _CONTROL, _USER, _BYTE = 1, 2, 3, 4, 6


@dataclass(frozen=True)
class Model:
    """Pieces of a model: (text, id, score); ids of the 256 byte pieces, or none; the unknown id; what each id decodes to."""

    unigram: bool
    pieces: tuple[tuple[str, int, float], ...]
    bytes_: tuple[int, ...]
    unknown: int
    spelled: tuple[bytes, ...]

    @cached_property
    def table(self) -> dict[str, tuple[int, float]]:
        return {p: (i, s) for p, i, s in self.pieces}

    @cached_property
    def ranks(self) -> dict[str, int]:
        """Places of the pieces in the order of merging; pieces of equal scores share one."""
        order = {s: k for k, s in enumerate(sorted({s for _, _, s in self.pieces}, reverse=True))}
        return {p: order[s] for p, _, s in self.pieces}

    @cached_property
    def longest(self) -> int:
        return max(len(p) for p, _, _ in self.pieces)

    @cached_property
    def lowest(self) -> float:
        return min(s for _, _, s in self.pieces) - UNKNOWN_PENALTY

    @cached_property
    def neighbours(self) -> tuple[np.ndarray, np.ndarray]:
        """A class for each character, and for each hashed pair of classes whether they may stand side by side in a piece."""
        chars = sorted({c for p, _, _ in self.pieces if len(p) > 1 for c in p})
        of, joint = np.zeros(0x110000, np.uint16), np.zeros(_PAIRS, bool)
        of[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        pairs = {(of[ord(a)], of[ord(b)]) for p, _, _ in self.pieces for a, b in zip(p, p[1:], strict=False)}
        joint[_pair(np.array([a for a, _ in pairs], np.uint16), np.array([b for _, b in pairs], np.uint16))] = True
        return of, joint

    @cached_property
    def late(self) -> frozenset[str]:
        """Pieces that merging makes of their own text, but one pass over the edges in order does not."""
        return frozenset(p for p, _, _ in self.pieces if len(p) > 1 and one_pass(p, self.ranks) != [p] and Folder(self).merged(p) == [p])

    def fallback(self, char: str) -> list[int]:
        """Ids of text that is no piece: its bytes, or the unknown piece."""
        return [self.bytes_[b] for b in char.encode("utf-8", "surrogatepass")] if self.bytes_ else [self.unknown]


_PAIRS = 1 << 18


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a.astype(np.uint32) * np.uint32(521) + b) & np.uint32(_PAIRS - 1)


def load(path: str | None = None) -> Model:
    """The model in a file; only such with an identity normalizer and the word mark before words are taken."""
    from sentencepiece import sentencepiece_model_pb2

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    proto = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    return of_proto(proto)


def of_proto(proto) -> Model:
    n = proto.normalizer_spec
    if n.precompiled_charsmap or n.remove_extra_whitespaces or not n.add_dummy_prefix:
        raise ValueError("only models with an identity normalizer and a dummy prefix")
    if any(MARK in p.piece.lstrip(MARK) for p in proto.pieces):
        raise ValueError("a piece crosses words")
    pieces = tuple((p.piece, i, p.score) for i, p in enumerate(proto.pieces) if p.type in (_NORMAL, _USER))
    if len(proto.pieces) > _ID or max(len(p) for p, _, _ in pieces) > _LEN:
        raise ValueError("more or longer pieces than an edge can hold")
    bytes_ = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == _BYTE}
    unknown = next(i for i, p in enumerate(proto.pieces) if p.type == _UNKNOWN)
    own = {_CONTROL: lambda _: b"", _UNKNOWN: lambda _: " ⁇ ".encode(), _BYTE: lambda p: bytes([int(p[3:5], 16)])}
    spelled = tuple(own.get(p.type, lambda p: p.replace(MARK, " ").encode())(p.piece) for p in proto.pieces)
    return Model(proto.trainer_spec.model_type == 1, pieces, tuple(bytes_[b] for b in range(256)) if len(bytes_) == 256 else (), unknown, spelled)


def one_pass(word: str, ranks: dict[str, int]) -> list[str]:
    """What one pass over a word's edges, in the order of ranks and places, makes of it."""
    ends = set(range(len(word) + 1))
    edges = sorted((ranks[word[s:e]], s, e) for s in range(len(word)) for e in range(s + 2, len(word) + 1) if word[s:e] in ranks)
    for _, s, e in edges:
        inner = ends.intersection(range(s + 1, e))
        if s in ends and e in ends and len(inner) == 1:
            ends -= inner
    at = sorted(ends)
    return [word[a:b] for a, b in zip(at, at[1:], strict=False)]


#: An edge's rank, start, length and id in one number, for an order by rank and start: most values of the last three.
_START, _LEN, _ID = (1 << 14) - 1, (1 << 5) - 1, (1 << 19) - 1
_S, _L, _I = f"cast(shiftright(e, 24) & {_START} as int)", f"cast(shiftright(e, 19) & {_LEN} as int)", f"cast(e & {_ID} as int)"


#: Characters below this one are no edges of a BPE lattice; their ids are looked up by their numbers where they stay alone.
_LOW = 0x250


def substrings(words: DataFrame, longest: int, low: int = 0) -> DataFrame:
    """word, n, start, len, piece: every substring of each distinct word up to that length, but for single characters below low, and one of no length."""
    starts = words.select("word", F.length("word").alias("n")).withColumn("start", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    least = F.when(F.col("start") == 0, 0).when(F.ascii(F.substr("word", F.col("start") + 1, F.lit(1))) < low, 2).otherwise(1)
    starts = starts.withColumns({"least": least, "most": F.least(F.lit(longest), F.col("n") - F.col("start"))}).where("least <= most")
    return starts.withColumn("len", F.explode(F.sequence("least", "most"))).withColumn("piece", F.substr("word", F.col("start") + 1, F.col("len")))


def lattice(words: DataFrame, model: Model) -> DataFrame:
    """word, n (characters), edges: every piece at every place of each distinct word. Edges of a BPE model are packed and in the order of merging, those of a unigram model are structs."""
    spark, low = words.sparkSession, 0 if model.unigram else _LOW
    # no substring is empty but the one that each word has, so that no word is without an edge
    rows = [("", len(model.pieces), 0, 0.0), *((p, model.ranks[p], i, float(s)) for p, i, s in model.pieces if len(p) > 1 or ord(p) >= low)]
    pieces = spark.createDataFrame(rows, "own string, rank long, id int, score double").withColumn("key", F.xxhash64("own"))
    # joined by their hashes, as numbers, and then compared; a model's pieces have the vocabulary's fixed size
    same = F.startswith("piece", F.col("own")) & F.startswith("own", F.col("piece"))
    # in the order of words, which explode and join keep, so that edges are grouped as they come
    ordered = words.sortWithinPartitions("word")
    found = substrings(ordered, model.longest, low).withColumn("at", F.xxhash64("piece")).join(F.broadcast(pieces), (F.col("at") == F.col("key")) & same)
    packed = F.expr("shiftleft(rank, 38) | shiftleft(cast(start as long), 24) | shiftleft(cast(len as long), 19) | id")
    edge = F.struct((F.col("start") + 1).alias("start"), "len", "id", "score") if model.unigram else packed
    return found.groupBy("word").agg(F.sort_array(F.collect_list(edge)).alias("edges")).withColumn("n", F.length("word"))


def _bytes_ids(chars: Column, model: Model) -> Column:
    """Ids of a character that is no piece."""
    if not model.bytes_:
        return F.array(F.lit(model.unknown))
    ids = F.array(*map(F.lit, model.bytes_))
    raw = F.hex(F.encode(chars, "utf-8"))
    return F.transform(F.sequence(F.lit(1), F.length(raw), F.lit(2)), lambda i: F.get(ids, F.conv(F.substr(raw, i, F.lit(2)), 16, 10).cast("int")))


def _numbers(values: Iterator[int], kind: str) -> str:
    """SQL of a constant array."""
    return f"cast(split('{','.join(map(str, values))}', ',') as array<{kind}>)"


#: The state m of a fold in the bits of a number: the places that edge x spans are x.w, its ends x.t; looked up by the edge's start and length.
_SPANS = [(i >> 5, i & _LEN) for i in range((BITS + 1) << 5)]
_W, _T = (_numbers((x if x < 1 << 63 else 0 for x in v), "bigint") for v in (((2 << n) - 1 << s for s, n in _SPANS), (1 << s | 1 << s + n for s, n in _SPANS)))
_AT = f"cast(shiftright(e, 19) & {(64 << 5) - 1} as int)"
IN_BITS = {
    "edges": f"transform(slice(edges, 1, size(edges) - 1), e -> struct(e, get({_W}, {_AT}) as w, get({_T}, {_AT}) as t))", "every": "shiftrightunsigned(-1L, 63 - n)",
    "joins": "bit_count(m & x.w) = 3 and (m & x.t) = x.t", "behind": "(m & ~x.w) | x.t", "piece": "(m & x.w) = x.t", "ends": "(shiftrightunsigned(m, i) & 1L) = 1", "alone": "(shiftrightunsigned(m, i) & 3L) = 3", "pieces": "bit_count(m) - 1",
}
#: And in a string of 0 and 1, for longer parts.
_SPAN = "substr(m, x.s + 1, x.l + 1)"
IN_STRING = {
    "edges": f"transform(slice(edges, 1, size(edges) - 1), e -> struct(e, {_S} as s, {_L} as l))", "every": "repeat('1', n + 1)",
    "joins": f"x.l > 1 and startswith({_SPAN}, '1') and endswith({_SPAN}, '1') and length(replace({_SPAN}, '0', '')) = 3", "behind": "concat(substr(m, 1, x.s + 1), repeat('0', x.l - 1), substr(m, x.s + x.l + 1))",
    "piece": f"{_SPAN} = concat('1', repeat('0', x.l - 1), '1')", "ends": "substr(m, i + 1, 1) = '1'", "alone": "substr(m, i + 1, 2) = '11'", "pieces": "length(replace(m, '0', '')) - 1",
}


def _folded(model: Model, p: dict[str, str]) -> Column:
    """ids, or at where a character is no piece, from word, n and edges, by BPE: the best ranked neighbours, the leftmost first, are joined until none can be."""
    once = f"aggregate(d, {p['every']}, (m, x) -> if({p['joins']}, {p['behind']}, m))"
    first = f"get(transform(slice(filter(d, x -> {p['joins']}), 1, 1), x -> {p['behind']}), 0)"
    again = f"aggregate(sequence(1, n), {p['every']}, (m, i) -> coalesce({first}, m))"
    late = " or ".join(f"contains(word, '{q}')" for q in model.late)
    m = f"if({late}, {again}, {once})" if late else once
    low = {ord(p): i for p, i, _ in model.pieces if len(p) == 1 and ord(p) < _LOW}
    low = _numbers((low.get(c, -1) for c in range(_LOW)), "int")
    single = f"coalesce(get({low}, ascii(substr(word, i + 1, 1))), -1)"
    singles = f"filter(transform(filter(sequence(0, n - 1), i -> {p['alone']}), i -> if({single} < 0, -1L, shiftleft(cast(i as long), 24) | {1 << 19} | {single})), e -> e >= 0)"
    kept = f"sort_array(concat(transform(filter(d, x -> {p['piece']}), x -> x.e & {(1 << 38) - 1}), {singles}))"
    at = f"transform(filter(sequence(0, n - 1), i -> {p['ends']}), i -> struct(get(filter(k, e -> {_S} = i), 0) as e, substr(word, i + 1, 1) as c))"
    # transforms of arrays of one name what is used more than once
    return F.expr(f"get(transform(array({p['edges']}), d -> get(transform(array({m}), m -> get(transform(array({kept}), k -> struct(if(size(k) = {p['pieces']}, transform(k, e -> {_I}), null) as ids, if(size(k) = {p['pieces']}, null, {at}) as at)), 0)), 0)), 0)")


def fold_merges(rows: DataFrame, model: Model) -> DataFrame:
    """word, ids of the lattice's rows by BPE, by as few steps as places of a part fit in a number or not."""
    rows = rows.withColumn("f", F.when(F.col("n") <= BITS, _folded(model, IN_BITS)).otherwise(_folded(model, IN_STRING)))
    patched = F.flatten(F.transform("f.at", lambda x: F.when(x["e"].isNotNull(), F.array(x["e"].bitwiseAND(F.lit(_ID)).cast("int"))).otherwise(_bytes_ids(x["c"], model))))
    return rows.select("word", F.coalesce("f.ids", patched).alias("ids"))


def fold_viterbi(model: Model) -> tuple[Column, Column]:
    """The column `by` that holds the best edge into each place, and ids from chars and edges, by the best sum of scores; of equal sums the path whose last piece starts first. A character that is no piece costs `lowest`."""
    node = "struct<score:double,start:int,id:int>"
    first = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("start"), F.lit(-1).alias("id")).cast(node))

    def step(best: Column, end: Column) -> Column:
        here = F.filter("edges", lambda e: e["start"] + e["len"] - 1 == end)
        known = F.transform(here, lambda e: F.struct((F.get(best, e["start"] - 1)["score"] + e["score"]).alias("score"), (1 - e["start"]).alias("start"), e["id"].alias("id")))
        alone = F.exists(here, lambda e: e["len"] == 1)
        spare = F.struct((F.get(best, end - 1)["score"] + model.lowest).alias("score"), (1 - end).alias("start"), F.lit(-1).alias("id"))
        top = F.array_max(F.concat(known, F.when(alone, F.array().cast(f"array<{node}>")).otherwise(F.array(spare.cast(node))).cast(f"array<{node}>")))
        return F.concat(best, F.array(F.struct(top["score"].alias("score"), (-top["start"]).alias("start"), top["id"].alias("id")).cast(node)))

    table = F.aggregate(F.sequence(F.lit(1), F.size("chars")), first, step)
    state = "struct<at:int,ids:array<int>>"

    def back(s: Column, _: Column) -> Column:
        edge = F.get(F.col("by"), s["at"])
        ids = F.when(edge["id"] >= 0, F.array(edge["id"])).otherwise(_bytes_ids(F.get(F.col("chars"), s["at"] - 1), model))
        return F.when(s["at"] > 0, F.struct(edge["start"].alias("at"), F.concat(ids, s["ids"]).alias("ids"))).otherwise(s).cast(state)

    start = F.struct(F.size("chars").alias("at"), F.array().cast("array<int>").alias("ids")).cast(state)
    return table, F.aggregate(F.sequence(F.lit(1), F.size("chars")), start, back, lambda s: s["ids"])


def encode_words(words: DataFrame, model: Model) -> DataFrame:
    """word, ids for distinct words (with their marks) of one to LONGEST_WORD characters, wholly by relations and higher-order functions."""
    rows = lattice(words, model)
    if model.unigram:
        by, ids = fold_viterbi(model)
        real = F.filter("edges", lambda e: e["len"] > 0)
        return rows.withColumn("edges", real).withColumn("chars", F.filter(F.split("word", ""), lambda c: c != "")).withColumn("by", by).select("word", ids.alias("ids"))
    return fold_merges(rows, model)


class Folder:
    """Ids of one word in Python: of words that are too long for the relations, and to test these."""

    def __init__(self, model: Model):
        self.model = model

    def __call__(self, word: str) -> list[int]:
        if self.model.unigram:
            return self._viterbi(word)
        table = self.model.table
        return [i for p in self.merged(word) for i in ((table[p][0],) if p in table else self.model.fallback(p))]

    def merged(self, word: str) -> list[str]:
        """The word's pieces by BPE, from a heap of neighbours."""
        ranks, parts, n = self.model.ranks, list(word), len(word)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, int, str]] = []

        def offer(i: int) -> None:
            j = after[i] if i >= 0 else n
            if i >= 0 and j < n and (rank := ranks.get(parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (rank, i, j, parts[i] + parts[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, j, joined = heapq.heappop(heap)
            if parts[i] is None or parts[j] is None or after[i] != j or parts[i] + parts[j] != joined:
                continue
            parts[i], parts[j] = joined, None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(before[i])
            offer(i)
        return [p for p in parts if p is not None]

    def _viterbi(self, word: str) -> list[int]:
        table, longest, lowest = self.model.table, self.model.longest, self.model.lowest
        best: list[tuple[float, int, int]] = [(0.0, 0, -1)]
        for end in range(1, len(word) + 1):
            found = [(best[s][0] + table[p][1], -s, table[p][0]) for s in range(max(0, end - longest), end) if (p := word[s:end]) in table]
            if word[end - 1] not in table:
                found.append((best[end - 1][0] + lowest, 1 - end, -1))
            score, start, i = max(found)
            best.append((score, -start, i))
        ids, at = [], len(word)
        while at:
            _, start, i = best[at]
            ids.append([i] if i >= 0 else self.model.fallback(word[start:at]))
            at = start
        return [i for part in reversed(ids) for i in part]


def _strings(data: pa.Buffer, ends: np.ndarray) -> pa.StringArray:
    """The strings that lie in a row in data, from one of the ends to the next."""
    return pa.StringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends.astype(np.int32)), data)


def _raw(texts: pa.StringArray) -> tuple[pa.Buffer, np.ndarray, np.ndarray]:
    """An array's own bytes, as a buffer and as numbers, and where each string begins and the last one ends."""
    texts = pa.concat_arrays([texts, pa.array([], pa.string())])  # a copy that begins at 0
    ends, data = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1), texts.buffers()[2] or pa.py_buffer(b"")
    return data, np.frombuffer(data, np.uint8, int(ends[-1])), ends


def cut(texts: pa.StringArray) -> tuple[pa.StringArray, np.ndarray]:
    """The words of all texts in a row, with blanks for marks, and where each text's begin and the last ones end. Words begin at runs of blanks and at line feeds; an empty text has none."""
    if pc.any(pc.match_substring(texts, MARK)).as_py():
        texts = pc.replace_substring(texts, MARK, " ")
    empty = pc.equal(pc.binary_length(texts), 0)
    data, b, ends = _raw(pc.if_else(empty, "", pc.binary_join_element_wise(" ", texts, "")))
    blank = b == 32
    first = blank.copy()
    first[1:] &= ~blank[:-1]
    first |= b == 10
    first[ends[:-1][ends[:-1] < len(b)]] = True
    at = np.append(np.nonzero(first)[0], len(b))
    return _strings(data, at), np.searchsorted(at, ends)


def parts(words: pa.StringArray, model: Model) -> tuple[pa.StringArray, np.ndarray]:
    """The parts of all words in a row, with marks, and where each word's begin and the last ones end: cut between characters that no piece has side by side."""
    data, b, ends = _raw(pc.replace_substring(words, " ", MARK))
    at = np.nonzero((b & 0xC0) != 0x80)[0]  # where characters begin
    of, joint = model.neighbours
    kind = of[np.frombuffer(b.tobytes().decode().encode("utf-32-le"), np.uint32)]
    first = np.ones(len(kind), bool)
    first[1:] = ~joint[_pair(kind[:-1], kind[1:])]
    first[np.searchsorted(at, ends[:-1][ends[:-1] < len(b)])] = True
    at = np.append(at[first], len(b))
    return _strings(data, at), np.searchsorted(at, ends)


def _slices(batch: pa.RecordBatch, column: str) -> Iterator[tuple[pa.RecordBatch, pa.StringArray]]:
    """Runs of rows with some SLICE_BYTES of text, and their texts, nulls as empty ones."""
    texts = pc.fill_null(batch.column(column), "")
    end = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(end, (end[at - 1] if at else 0) + SLICE_BYTES, side="right")))
        yield batch.slice(at, to - at), texts.slice(at, to - at)
        at = to


def _runs(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The batch's rows by runs of one block."""
    blocks = batch.column(column).to_numpy(zero_copy_only=False)
    borders = [0, *(np.nonzero(blocks[1:] != blocks[:-1])[0] + 1).tolist(), len(blocks)] if len(blocks) else [0]
    for a, b in zip(borders, borders[1:], strict=False):
        yield int(blocks[a]), batch.slice(a, b - a)


def _from_files(docs: DataFrame) -> bool:
    """Whether rows come from one scan of files, row by row, so that a row always is in the same file."""
    plan, names = [docs._jdf.queryExecution().optimizedPlan()], []
    while plan:
        node = plan.pop()
        names.append(node.nodeName())
        plan += [node.children().apply(i) for i in range(node.children().size())]
    return names[-1] in ("LogicalRelation", "Relation") and set(names[:-1]) <= {"Project", "Filter"}


@dataclass(frozen=True)
class Texts:
    """rows: own columns, then `text` and `block` by names that none of them has; the folder of the blocks' dictionaries."""

    rows: DataFrame
    text: str
    block: str
    path: str


def _prepared(docs: DataFrame, model: Model) -> Texts:
    """Encodes all distinct words of docs, and writes them by block."""
    docs = docs if _from_files(docs) else saved(docs, "texts")
    spark, mark = docs.sparkSession, uuid.uuid4().hex
    text, block, path = f"text_{mark}", f"block_{mark}", f"{shared_dir(spark)}/dictionaries-{mark}"
    pa.fs.FileSystem.from_uri(path)  # raises here, not in a task, if executors could not open the folder
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    blocks = max(1, -(-size // BLOCK_BYTES))
    of = F.pmod(F.xxhash64(F.input_file_name(), F.floor(F.input_file_block_start() / BLOCK_BYTES)), F.lit(blocks))
    rows = docs.select(*(docs[c] for c in docs.columns), text_of(docs).alias(text), of.alias(block))

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None

        def sent() -> Iterator[pa.RecordBatch]:
            if held:
                words = pa.concat_arrays(held).unique()
                held.clear()
                words = parts(words, model)[0].unique()
                words = words.filter(pc.less_equal(pc.utf8_length(words), LONGEST_WORD))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(words), at), pa.int64()), words], names=["block", "word"])

        for batch in batches:
            for b, run in _runs(batch, block):
                if b != at:
                    yield from sent()
                    at = b
                for _, texts in _slices(run, text):
                    held.append(cut(texts)[0].unique())
                    if sum(map(len, held)) > GATHERED:
                        held[:] = [pa.concat_arrays(held).unique()]
                        if len(held[0]) > GATHERED // 2:
                            yield from sent()
        yield from sent()

    met = rows.select(text, block).mapInArrow(distinct, "block long, word string").repartition("word")
    # by the same exchange as below: with the blocks in it, the words are not another one
    words = met.groupBy("word").agg(F.min("block").alias("least")).where("least is not null").select("word")
    found = met.dropDuplicates(["word", "block"]).join(encode_words(words, model), "word").select("block", "word", "ids")
    # edges come in the order of their words: a hash map of them is slower and holds more
    hashed = "spark.sql.execution.useObjectHashAggregateExec"
    before = spark.conf.get(hashed)
    spark.conf.set(hashed, "false")
    try:
        found.repartition("block").write.partitionBy("block").parquet(path)
    finally:
        spark.conf.set(hashed, before)
    return Texts(rows, text, block, path)


class Blocks:
    """Word ids of the texts of one block after another."""

    def __init__(self, path: str, model: Model):
        self.fs, self.path = pa.fs.FileSystem.from_uri(path)
        self.model, self.block, self.fold = model, None, Folder(model)

    def _open(self, block: int) -> None:
        import pyarrow.parquet as pq

        path = f"{self.path}/block={block}"
        if self.fs.get_file_info(path).type == pa.fs.FileType.NotFound:  # its texts are empty
            self.words, self.ids = pa.array([], pa.string()), pa.array([], pa.list_(pa.int32()))
        else:
            read = pq.read_table(path, filesystem=self.fs, columns=["word", "ids"], partitioning=None).combine_chunks()
            self.words, self.ids = (read.column(c).combine_chunks() for c in ("word", "ids"))
            self.ids = pa.ListArray.from_arrays(self.ids.offsets, self.ids.values)
        self.block = block

    def __call__(self, block: int, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's begin and the last ones end."""
        if block != self.block:
            self._open(block)
            pa.default_memory_pool().release_unused()
        words, borders = cut(texts)
        met = words.dictionary_encode()
        cuts, ends = parts(met.dictionary, self.model)
        own = cuts.dictionary_encode()
        found = pc.index_in(self.words, value_set=own.dictionary)
        rows = np.nonzero(found.is_valid().to_numpy(zero_copy_only=False))[0]
        order = np.full(len(own.dictionary), -1)
        order[found.drop_null().to_numpy()] = np.arange(len(rows))
        lists, more = self.ids.take(pa.array(rows)), []
        for i in np.nonzero(order < 0)[0].tolist():
            word = own.dictionary[i].as_py()
            if len(word) <= LONGEST_WORD:
                raise RuntimeError("a part is not in its block's dictionary: the rows were not the same when read again")
            order[i] = len(rows) + len(more)
            more.append(self.fold(word))
        if more:
            lists = pa.concat_arrays([lists, pa.array(more, lists.type)])
        lists = lists.take(pa.array(order[own.indices.to_numpy()]))
        lists = pa.ListArray.from_arrays(pa.array(lists.offsets.to_numpy()[ends], pa.int32()), lists.values)
        lists = lists.take(met.indices)
        return lists.flatten().to_numpy(), lists.offsets.to_numpy()[borders]


def _decoded(ids: np.ndarray, ends: np.ndarray, spelled: pa.BinaryArray) -> pa.BinaryArray:
    """The bytes of each text's pieces."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), spelled.take(pa.array(ids))), b"")


def encoded(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """docs, with its columns, and ids: array<int> (a column of that name is replaced).

    A null text has no ids, like an empty one; rows repeat as they do in docs.
    The words' dictionaries stay in the shared folder as long as the result is read.
    """
    model = model or load()
    docs = docs.select(*(docs[c] for c in docs.columns if c != "ids"))
    names, t = docs.columns, _prepared(docs, model)
    schema = T.StructType([*docs.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))])
    path, text, block = t.path, t.text, t.block

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = Blocks(path, model)
        for batch in batches:
            for b, run in _runs(batch, block):
                for part, texts in _slices(run, text):
                    ids, ends = blocks(b, texts)
                    yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))], names=[*names, "ids"])

    return t.rows.mapInArrow(encode, schema)


def decoded(rows: DataFrame, model: Model | None = None) -> DataFrame:
    """rows, with its columns, and text from ids; null ids give an empty text, bytes that are no UTF-8 the replacement character."""
    model = model or load()
    own = rows.select(*(rows[c] for c in rows.columns if c != "text"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelled = pa.array(model.spelled, pa.binary())
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                b = batch.slice(i, 512)
                lists = pc.fill_null(b.column("ids"), pa.scalar([], b.column("ids").type))
                said = _decoded(lists.flatten().to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py(), spelled)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x.decode("utf-8", "replace").removeprefix(" ") for x in said.to_pylist()], pa.string())], names=[*b.schema.names, "text"])

    return own.mapInArrow(decode, T.StructType([*own.schema.fields, T.StructField("text", T.StringType())]))


def encoding_report(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the ids as little-endian 32-bit integers), round_trip (decoding gives the text back) for every row.

    Null texts are empty: no tokens, and a round trip. Rows that repeat get a row each; a null doc_id stays null.
    """
    model = model or load()
    t = _prepared(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]), model)
    path, text, block = t.path, t.text, t.block

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, spelled = Blocks(path, model), pa.array(model.spelled, pa.binary())
        for batch in batches:
            for b, run in _runs(batch, block):
                for part, texts in _slices(run, text):
                    ids, ends = blocks(b, texts)
                    raw = np.ascontiguousarray(ids, "<i4")
                    sha = [hashlib.sha256(raw[x:y]).hexdigest() for x, y in zip(ends.tolist(), ends[1:].tolist(), strict=False)]
                    # behind the mark before its first word, a text is given back with blanks for marks of its own
                    own = pc.if_else(pc.equal(pc.binary_length(texts), 0), "", pc.binary_join_element_wise(" ", pc.replace_substring(texts, MARK, " "), ""))
                    same = pc.equal(_decoded(ids, ends, spelled), own.cast(pa.binary()))
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(ends), pa.int64()), pa.array(sha, pa.string()), same], names=["doc_id", "n_tokens", "ids_sha256", "round_trip"])

    return t.rows.mapInArrow(report, "doc_id long, n_tokens long, ids_sha256 string, round_trip boolean")
