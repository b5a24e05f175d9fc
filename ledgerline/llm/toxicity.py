"""Toxicity by gradient-boosted trees over dense features, calibrated by isotonic regression.

The lexicon, the trees and the calibration are learned from labelled rows; no
word list is built in. Words and word beginnings that far more toxic than clean
texts hold form the lexicon; beginnings let it meet forms it has not seen. Near
copies count once there, by a min-hash of their words. Features are densities
of lexicon hits, their nearness to second-person words, shares of capitals,
punctuation and symbols, and rates of obfuscated words, also of those that spell
a lexicon word. The sample of labelled rows is bounded, so trees are grown on
the driver; texts are read and scored in Arrow functions.
"""

from __future__ import annotations

import math
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

#: The most labelled rows that are learned from (those of smallest hash), and the most lexicon entries.
SAMPLE_ROWS, LEXICON = 20_000, 600
#: Lexicon entries: lengths of word beginnings, texts that must hold one, and the least log odds ratio.
STEMS, LEAST_TEXTS, LEAST_ODDS = (4, 5, 6), 6, 2.5
TREES, DEPTH, RATE, BINS, FOLDS, L2 = 60, 3, 0.15, 32, 3, 5.0
#: Second-person words of English, German, French and Spanish.
SECOND = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch sie tu te toi ton ta tes vous votre vos usted ustedes ti tus su vosotros".split())
#: Letters that digits and symbols stand for.
LOOKS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l"})
NEAR = 5
_WORD = re.compile(r"[^\W\d_]+")
_OBFUSCATED = re.compile(r"[^\W\d_]+(?:[0-9@$!|*]+[^\W\d_]+)+|\b(?:[^\W\d_][.\-_* ]){3,}[^\W\d_]\b")
_JOINED = re.compile(r"[.\-_* ]")
_UPPER, _PUNCT = str.maketrans("", "", string.ascii_uppercase), string.punctuation
FEATURES = ("words", "full", "stem", "distinct", "near_second", "second", "capitals", "exclaims", "symbols", "obfuscated", "obfuscated_hits", "repeats")


def features(text: str, full: frozenset[str], stems: dict[int, frozenset[str]]) -> list[float]:
    """FEATURES of a text; all zero for an empty one."""
    words = _WORD.findall(text.lower())
    n = max(1, len(words))
    chars = max(1, len(text))
    where = {w for w in set(words) if w in full or any(w[:k] in s for k, s in stems.items())}
    hits = [i for i, w in enumerate(words) if w in where] if where else []
    near = sum(1 for i in hits if not SECOND.isdisjoint(words[max(0, i - NEAR) : i + NEAR + 1]))
    odd = _OBFUSCATED.findall(text)
    spelled = sum(1 for x in odd if (y := _JOINED.sub("", x.lower().translate(LOOKS))) in full or any(y[:k] in s for k, s in stems.items()))
    exact = sum(1 for i in hits if words[i] in full)
    return [
        math.log1p(len(words)),
        exact / n * 100,
        (len(hits) - exact) / n * 100,
        math.log1p(len(where)),
        near / n * 100,
        sum(map(SECOND.__contains__, words)) / n * 100,
        (len(text) - len(text.translate(_UPPER))) / chars,
        (text.count("!") + text.count("?")) / chars * 100,
        sum(text.count(c) for c in "#%&*$@") / chars * 100,
        len(odd) / n * 100,
        spelled / n * 100,
        1 - len(set(words)) / n,
    ]


@dataclass
class Trees:
    """Boosted trees of fixed depth on quantile bins, for the logistic loss."""

    start: float = 0.0
    edges: np.ndarray | None = None
    nodes: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(self.edges[j], x[:, j], side="left") for j in range(x.shape[1])], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        mean = (y.sum() + 0.5) / (len(y) + 1)
        self.start = math.log(mean / (1 - mean))
        self.edges = np.quantile(x, np.linspace(0, 1, BINS)[1:-1], axis=0).T
        b, raw = self._binned(x), np.full(len(y), self.start)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-raw))
            g, h = y - p, p * (1 - p)
            at = np.zeros(len(y), int)
            feature, cut = np.zeros(2**DEPTH - 1, int), np.full(2**DEPTH - 1, BINS)
            for level in range(DEPTH):
                first, width = 2**level - 1, 2**level
                best = np.full(width, 1e-9)
                for j in range(x.shape[1]):
                    cell = (at - first) * BINS + b[:, j]
                    sg, sh = (np.bincount(cell, v, width * BINS).reshape(width, BINS).cumsum(1) for v in (g, h))
                    gain = sg**2 / (sh + L2) + (sg[:, -1:] - sg) ** 2 / (sh[:, -1:] - sh + L2) - sg[:, -1:] ** 2 / (sh[:, -1:] + L2)
                    k = gain.argmax(1)
                    top = gain[np.arange(width), k]
                    for i in np.nonzero(top > best)[0]:
                        best[i], feature[first + i], cut[first + i] = top[i], j, k[i]
                at = 2 * at + 1 + (b[np.arange(len(y)), feature[at]] > cut[at])
            leaf = at - (2**DEPTH - 1)
            value = RATE * np.bincount(leaf, g, 2**DEPTH) / (np.bincount(leaf, h, 2**DEPTH) + L2)
            raw += value[leaf]
            self.nodes.append((feature, cut, value))
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        b, out = self._binned(x), np.full(len(x), self.start)
        for feature, cut, value in self.nodes:
            at = np.zeros(len(x), int)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (b[np.arange(len(x)), feature[at]] > cut[at])
            out += value[at - (2**DEPTH - 1)]
        return out


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the nondecreasing step fit of y by raw (pooled adjacent violators; equal raw scores are one point); between knots it is linear."""
    blocks: list[list[float]] = []
    points, of = np.unique(raw, return_inverse=True)
    n = np.bincount(of)
    for r, v, k in zip(points.tolist(), (np.bincount(of, y) / n).tolist(), n.tolist(), strict=True):
        blocks.append([v, float(k), r, r])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, n2, _, high = blocks.pop()
            v1, n1, low, _ = blocks.pop()
            blocks.append([(v1 * n1 + v2 * n2) / (n1 + n2), n1 + n2, low, high])
    ends = [(x, b[0]) for b in blocks for x in sorted({b[2], b[3]})]
    return np.array([x for x, _ in ends]), np.array([v for _, v in ends])


@dataclass
class Model:
    full: frozenset[str]
    stems: dict[int, frozenset[str]]
    trees: Trees | None
    knots: tuple[np.ndarray, np.ndarray] | None
    base: float = 0.0

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(x), self.base)
        return np.clip(np.interp(self.trees.raw(x), *self.knots), 0.0, 1.0)

    def features(self, texts: list[str]) -> np.ndarray:
        return np.array([features(t, self.full, self.stems) for t in texts], float).reshape(len(texts), len(FEATURES))


def held_out(doc_id):
    """Rows that are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """The model of the labelled rows that are not held out, at most sample_rows of them (the smallest hashes of doc_id).

    A doc_id with several labels is toxic if one of them says so; null labels
    and ids are left out. With no or only one kind of label, every score is
    that label (0 without labels).
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null")
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    # bounded by sample_rows, at 12 bytes a row
    sample = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text")).join(F.broadcast(known), "doc_id")
    sample = sample.repartition(max(8, sample.sparkSession.sparkContext.defaultParallelism), "doc_id").persist()
    try:
        n = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
        if not n.get(0) or not n.get(1):
            return Model(frozenset(), {}, None, None, 1.0 if n.get(1) else 0.0)
        words = sample.select("toxic", F.array_distinct(F.filter(F.split(F.lower("text"), r"[^\p{L}]+"), lambda w: F.length(w) >= 4)).alias("w"))
        # one min-hash of the words, alike for near copies
        words = words.withColumn("like", F.array_min(F.transform("w", lambda w: F.xxhash64(w))))
        entry = lambda w: F.array(F.struct(F.lit(0).alias("k"), w.alias("s")), *(F.struct(F.lit(k).alias("k"), F.substr(w, F.lit(1), F.lit(k)).alias("s")) for k in STEMS))
        entries = words.select("toxic", "like", F.explode("w").alias("w")).select("toxic", "like", F.explode(entry(F.col("w"))).alias("e")).where("e.k = 0 or length(e.s) = e.k").distinct()
        seen = entries.groupBy("e").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c")).where(f"t >= {LEAST_TEXTS}")
        texts = words.groupBy("toxic").agg(F.countDistinct("like").alias("n")).collect()
        n = {r["toxic"]: r["n"] for r in texts}
        odds = F.log((F.col("t") + 0.5) / (n[1] + 1)) - F.log((F.col("c") + 0.5) / (n[0] + 1))
        top = seen.withColumn("odds", odds).where(f"odds >= {LEAST_ODDS}").orderBy(F.desc(F.col("odds") * F.sqrt("t")), "e.k", "e.s").limit(LEXICON).collect()
        full = frozenset(r["e"]["s"] for r in top if r["e"]["k"] == 0)
        stems = {k: frozenset(r["e"]["s"] for r in top if r["e"]["k"] == k) for k in STEMS}
        learned = Model(full, {k: s for k, s in stems.items() if s}, None, None)

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = learned.features(b.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("toxic"), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "toxic", "x"])

        rows = sorted((r["doc_id"], r["toxic"], r["x"]) for r in sample.mapInArrow(read, "doc_id long, toxic int, x array<double>").collect())
    finally:
        sample.unpersist()
    x, y = np.array([r[2] for r in rows]), np.array([r[1] for r in rows], float)
    learned.trees = Trees().fit(x, y)
    fold, raw = np.empty(len(y), int), learned.trees.raw(x)
    for label in (0, 1):  # dealt by label, so that a fold lacks one only if it has fewer than two rows
        fold[y == label] = np.arange((y == label).sum()) % FOLDS
    for k in range(FOLDS):
        if len(set(y[fold != k])) == 2:  # else the scores of the trees of all rows stand in
            raw[fold == k] = Trees().fit(x[fold != k], y[fold != k]).raw(x[fold == k])
    learned.knots = isotonic(raw, y)
    return learned


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs. Null texts are empty and get a score too; a null doc_id is not held out; other columns are ignored."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a lexicon of LEXICON entries and TREES small trees

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                b = batch.slice(i, 1024)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(m.score(m.features(b.column("text").to_pylist())), pa.float64())], names=["doc_id", "score"])

    out = rows.mapInArrow(score, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """docs, with its columns, without the rows whose score reaches the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                b = batch.slice(i, 1024)
                texts = [t or "" for t in b.column("text").to_pylist()]
                yield b.filter(pa.array(m.score(m.features(texts)) < threshold, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
