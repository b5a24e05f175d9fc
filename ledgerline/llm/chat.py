r"""Chat formatting with typed content parts.

A turn's content is plain text, or a list of typed parts (text, image, audio,
document). A visitor flattens the parts in order: text stays text, and any
other part becomes a numbered placeholder, with a record of its attachment and
of the tokens it expands to. Conversations are written as

    <|turn|>role\ncontent<|end|>\n

Inside a text every backslash is doubled and every control string, of this
template or another common one, gets a backslash behind its first character,
also where two of them overlap: no control string is left, and removing one
backslash of each brings the text back. Text parts that follow each other are
joined before, so that none can come of two of them. Placeholders are written
after that, so they stay control strings.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TURN, END = "<|turn|>", "<|end|>"
#: Control strings of common chat templates; any <| opens one too.
CONTROLS = ("<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<start_of_turn>", "<end_of_turn>", "<bos>", "<eos>")
_ESCAPED = re.compile("|".join((r"\\", *(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROLS))))
_UNESCAPED = re.compile(r"\\(.)", re.S)
#: Tokens: one for each image patch of so many pixels square, of so many milliseconds of audio, and for each page of a document.
IMAGE_PATCH, AUDIO_MS, PAGE_TOKENS = 28, 40, 512


def escape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return _UNESCAPED.sub(r"\1", text)


def escape_role(role: str) -> str:
    """A role in one line: a line feed becomes a backslash and an n, which no escape of a control string is."""
    return escape(role).replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return _UNESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], role)


@dataclass
class Flat:
    """What the visitor makes of one conversation's parts."""

    attachments: list[tuple[str, str, int]] = field(default_factory=list)

    def content(self, parts: list[dict | str | None]) -> str:
        """A turn's content; runs of text parts are escaped as one text. A part of an unknown type is an attachment of that type without tokens."""
        placed = {"image": self.visit_image, "audio": self.visit_audio, "document": self.visit_document}
        kind = lambda p: "text" if p is None or isinstance(p, str) else p.get("type") or "text"
        out = []
        for is_text, run in itertools.groupby(parts, lambda p: kind(p) == "text"):
            if is_text:
                out.append(escape("".join((p if isinstance(p, str) else (p or {}).get("text")) or "" for p in run)))
            else:
                out += [placed.get(kind(p), self.visit_other)(p) for p in run]
        return "".join(out)

    def visit_other(self, part: dict) -> str:
        return self._placed("other", part, 0)

    def visit_image(self, part: dict) -> str:
        sides = (part.get("width") or IMAGE_PATCH, part.get("height") or IMAGE_PATCH)
        return self._placed("image", part, math.prod(math.ceil(x / IMAGE_PATCH) for x in sides))

    def visit_audio(self, part: dict) -> str:
        return self._placed("audio", part, math.ceil((part.get("duration_ms") or AUDIO_MS) / AUDIO_MS))

    def visit_document(self, part: dict) -> str:
        return self._placed("document", part, PAGE_TOKENS * (part.get("pages") or 1))

    def _placed(self, kind: str, part: dict, tokens: int) -> str:
        self.attachments.append((kind, part.get("ref") or "", tokens))
        return f"<|{kind}_{len(self.attachments)}|>"


def format_turns(turns: list[tuple[str, list]]) -> tuple[str, list[tuple[int, int]], list[tuple[str, str, int]]]:
    """The written conversation, the spans of it that take loss (assistant contents), and its attachments."""
    out, spans, at, flat = [], [], 0, Flat()
    for role, parts in turns:
        head = f"{TURN}{escape_role(role)}\n"
        body = flat.content(parts)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, END, "\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(out), spans, flat.attachments


def parse_turns(written: str) -> list[tuple[str, str]]:
    """(role, content) of each turn, read back from a written conversation."""
    out = []
    for piece in written.split(f"{END}\n")[:-1]:
        role, _, content = piece.removeprefix(TURN).partition("\n")
        out.append((unescape_role(role), unescape(content)))
    return out


def _digests(conv_id: int | None, turns: list[tuple[str, list]]) -> tuple:
    written, spans, attached = format_turns(turns)
    read = parse_turns(written)
    loss = "".join(unescape(written[a:b]) for a, b in spans)
    sha = lambda s: hashlib.sha256(s.encode("utf-8")).hexdigest()
    return conv_id, len(read), sha("".join(f"{r}\n{c}\n" for r, c in read)), len(loss), sha(loss), len(written), len(attached), sum(x[2] for x in attached)


_DIGESTS = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_attachments", pa.int64()), ("attachment_tokens", pa.int64())])
_FORMATTED = pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()), ("loss_spans", pa.list_(pa.list_(pa.int64()))), ("attachments", pa.list_(pa.struct([("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())])))])


def _gathered(turns: DataFrame) -> DataFrame:
    """One row per conv_id with its turns in order of turn, role and text. The order sorts nulls first; a null role is user, a null text empty."""
    parts = F.col("parts") if "parts" in turns.columns else F.lit(None).cast("array<struct<type:string,text:string,ref:string,width:int,height:int,duration_ms:int,pages:int>>")
    row = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), parts.alias("parts"))
    return turns.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(row)).alias("turns"))


def _turns_of(turns: list[dict]) -> list[tuple[str, list]]:
    return [(t["role"], t["parts"] if t["parts"] else [t["text"]]) for t in turns]


def formatted(turns: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_spans, attachments: one row per conversation.

    turns: conv_id, turn, role, text and, where content is typed, parts (which
    then stands in text's place). Rows are turns: repeated ones stay, ties are
    ordered by role and text, a null text is empty, a null role is user and a
    null conv_id a conversation of its own. Other columns are ignored.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in b.to_pylist():
                text, spans, attached = format_turns(_turns_of(r["turns"]))
                rows.append({"conv_id": r["conv_id"], "formatted": text, "loss_spans": [list(s) for s in spans], "attachments": [dict(zip(("kind", "ref", "tokens"), a, strict=True)) for a in attached]})
            yield pa.RecordBatch.from_pylist(rows, schema=_FORMATTED)

    return _gathered(turns).mapInArrow(write, "conv_id long, formatted string, loss_spans array<array<long>>, attachments array<struct<kind:string,ref:string,tokens:long>>")


def chat_digests(turns: DataFrame) -> DataFrame:
    """Digests of each written conversation, read back from it; rows and ties as in formatted()."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [_digests(r["conv_id"], _turns_of(r["turns"])) for r in b.to_pylist()]
            yield pa.RecordBatch.from_pylist([dict(zip(_DIGESTS.names, x, strict=True)) for x in rows], schema=_DIGESTS)

    return _gathered(turns).mapInArrow(digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_attachments long, attachment_tokens long")


PROBE = "</s>[INST] ok [/INST]"


def with_probe(turns: DataFrame) -> DataFrame:
    """turns and conversation -1, whose texts are control strings."""
    own = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    probe = turns.sparkSession.createDataFrame([(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)], own.schema)
    return own.unionByName(probe)


#: Escapes add a character for each backslash and each control string, also where two overlap.
ORACLE = """
with t as (select conv_id, turn, role, coalesce(text, '') as text from conversations
  union all values (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
e as (select *, list_sum([(length(text) - length(replace(text, c, ''))) // length(c) for c in ['\\', '<|', '|>', '<s>', '</s>', '[INST]', '[/INST]', '<<SYS>>', '<</SYS>>', '<start_of_turn>', '<end_of_turn>', '<bos>', '<eos>']]) as escapes from t)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
  sha256(coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn, role, text), '')) as loss_sha256,
  cast(sum(length(text) + escapes + length(role) + 17) as bigint) as formatted_chars,
  cast(0 as bigint) as n_attachments, cast(0 as bigint) as attachment_tokens
from e group by conv_id
"""
