"""A corpus cleaned in stages: toxicity, line dedup, MinHash near-dedup, benchmark decontamination, SentencePiece encoding.

Each stage works on all that the one before it kept and takes effect on it. Its
result is written as Parquet to the shared folder and read again as the next
one's documents, so a lost executor costs no more than one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import decontaminate, line_dedup, minhash, sentencepiece, toxicity
from ledgerline.llm.common import saved, table


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labels, does not reject."""
    return toxicity.without_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def lines_once(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines, of any number of words, that repeat an earlier one; a document that so loses all its words goes."""
    out = line_dedup.dedup_lines(docs, min_words=1).where(~F.col("emptied")).select(*docs.columns)
    return out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long"))


def one_of_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: shingles of five words, similarity of 0.8 or more."""
    return minhash.without_near_duplicates(docs, size=5, percent=80)


def not_leaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids and number of tokens."""
    return sentencepiece.encoded(docs).withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("toxicity", not_toxic),
    ("line_dedup", lines_once),
    ("near_dedup", one_of_near),
    ("decontaminate", not_leaked),
    ("sentencepiece", tokenized),
]

#: SQL expresses neither the classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
