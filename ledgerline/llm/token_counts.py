"""Token counts of whole texts, by batches in Arrow functions that return lengths only.

Texts are cut into segments of at most a fixed number of bytes. A cut falls
only behind ASCII white space that an ASCII letter or digit follows: the
tokenizer drops white space and never merges across it, so counts of segments
add up. Segments are encoded in batches of about the same number of bytes.
Where a text has no such place (one endless word), the segment stays whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

#: Bytes in a batch of segments, and characters in a segment of a long text.
BATCH_BYTES = 1 << 20
SEGMENT_CHARS = 1 << 14
CONTEXT = 2048
_CUT = re.compile(r"(?<=[ \n\t\r])(?=[A-Za-z0-9])")


def segments(text: str, most: int = SEGMENT_CHARS) -> Iterator[str]:
    """text in pieces that a tokenizer which drops white space counts apart; each about most characters, or up to the first safe place."""
    at = 0
    while len(text) - at > most:
        cut = _CUT.search(text, at + most)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def _counter(path: str | None):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()

    def counts(texts: list[str]) -> list[int]:
        out, owners, batch, held = [0] * len(texts), [], [], 0

        def flush() -> None:
            for owner, e in zip(owners, tokenizer.encode_batch_fast(batch, add_special_tokens=False), strict=True):
                out[owner] += len(e)
            owners.clear()
            batch.clear()

        for i, text in enumerate(texts):
            for s in segments(text):
                owners.append(i)
                batch.append(s)
                held += len(s.encode())
                if held >= BATCH_BYTES:
                    flush()
                    held = 0
        flush()
        return out

    return counts


def token_counts(docs: DataFrame, tokenizer_path: str | None = None, context: int = CONTEXT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row; a null text is empty and has no tokens. Repeated rows and ids stay; other columns are ignored."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _counter(tokenizer_path)
        for b in batches:
            texts = b.column("text").to_pylist()
            n = counts(texts)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    return rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > context)
