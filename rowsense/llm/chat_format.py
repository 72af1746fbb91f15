r"""Chat formatting with typed content parts.

A turn's content is a list of typed parts. A visitor flattens them in order: text parts are escaped, and image, audio
and document parts become numbered placeholders with an attachment reference and an expanded token count. The
template is `<turn ROLE>` content `</turn>\n`. Inside texts and roles each `\`, `<` and `>` gets a `\` before it, so
an unescaped `<` always starts a control string and unescaping gives the text back.

Turns are formatted row by row; rows of a conversation meet in one task as a sorted stream, of which one batch is
held at a time, so a conversation of any length needs bounded memory.

Defined results: null text is empty, a null role is the empty role, turns sort by (turn, role, text) with null first,
repeated rows are repeated turns, a null conv_id is a conversation of its own; an unknown part type is an error.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_chunks, to_batch

#: Tokens of an image patch side in pixels, of a second of audio, of a page of a document.
PATCH, AUDIO_TOKENS, PAGE_TOKENS = 28, 25, 512
ESCAPED, TURN = re.compile(r"[\\<>]"), re.compile(r"<turn ((?:[^\\<>]|\\.)*)>((?:[^\\<>]|\\.|<(?:image|audio|document) \d+>)*)</turn>\n", re.S)
HOLDER = re.compile(r"\\.|<(image|audio|document) (\d+)>", re.S)
FORMATTED = "conv_id long, formatted string, loss_start int, loss_end int, attachments array<struct<type:string,number:int,ref:string,tokens:int>>"
ARROW = pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()), ("loss_start", pa.int32()), ("loss_end", pa.int32()), ("attachments", pa.list_(pa.struct([("type", pa.string()), ("number", pa.int32()), ("ref", pa.string()), ("tokens", pa.int32())])))])


def escape(text: str) -> str:
    return ESCAPED.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S) if "\\" in text else text


class Flattener:
    """Visits the parts of one turn; numbers of placeholders start anew in each turn."""

    def __init__(self) -> None:
        self.out: list[str] = []
        self.attachments: list[dict] = []

    def visit(self, part: dict) -> None:
        getattr(self, f"visit_{part['type']}")(part)

    def visit_text(self, part: dict) -> None:
        self.out.append(escape(part.get("text") or ""))

    def visit_image(self, part: dict) -> None:
        self.hold(part, math.ceil((part.get("width") or 0) / PATCH) * math.ceil((part.get("height") or 0) / PATCH))

    def visit_audio(self, part: dict) -> None:
        self.hold(part, math.ceil((part.get("seconds") or 0) * AUDIO_TOKENS))

    def visit_document(self, part: dict) -> None:
        self.hold(part, (part.get("pages") or 0) * PAGE_TOKENS)

    def hold(self, part: dict, tokens: int) -> None:
        self.out.append(f"<{part['type']} {len(self.attachments)}>")
        self.attachments.append({"type": part["type"], "number": len(self.attachments), "ref": part.get("ref"), "tokens": tokens})


def format_turn(role: str | None, parts: Iterable[dict]) -> tuple[str, int, int, list[dict]]:
    """The turn's string, start and end of its content in code points (equal unless the role is assistant), attachments."""
    seen = Flattener()
    for part in parts:
        seen.visit(part)
    head, body = f"<turn {escape(role or '')}>", "".join(seen.out)
    end = len(head) + (len(body) if role == "assistant" else 0)
    return f"{head}{body}</turn>\n", len(head), end, seen.attachments


def read_turn(formatted: str) -> tuple[str, str]:
    """Role and text, with placeholders left out: what format_turn got."""
    m = TURN.fullmatch(formatted)
    if not m:
        raise ValueError("not a formatted turn")
    return unescape(m[1]), unescape(HOLDER.sub(lambda x: "" if x[1] else x[0], m[2]))


def format_chats(conversations: DataFrame, partitions: int | None = None) -> DataFrame:
    """A row per turn, in the order of turns within each conv_id, all rows of a conv_id in one partition.

    parts (array of struct with type, text, ref, width, height, seconds, pages) is used where the column is there and
    not null; otherwise text is one text part."""
    parts = F.col("parts") if "parts" in conversations.columns else F.lit(None).cast("array<struct<type:string,text:string>>")
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), parts.alias("parts"))
    sorts = ["conv_id", "turn", "role", "text"]
    dealt = rows.repartition(partitions, "conv_id") if partitions else rows.repartition("conv_id")

    def make(got: list[dict]) -> Iterator[tuple]:
        for x in got:
            given = x["parts"] if x["parts"] is not None else [{"type": "text", "text": x["text"]}]
            yield x["conv_id"], *format_turn(x["role"], given)

    return dealt.sortWithinPartitions(*sorts).mapInArrow(by_chunks(make, ARROW), FORMATTED)


class Digest:
    """What is read back of one conversation, turn by turn."""

    def __init__(self, conv_id: int | None) -> None:
        self.conv_id, self.turns, self.loss_chars, self.chars = conv_id, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, x: dict) -> None:
        role, text = read_turn(x["formatted"])
        self.turns += 1
        self.chars += len(x["formatted"])
        self.all.update(f"{role}\n{text}\n".encode())
        kept = unescape(HOLDER.sub(lambda m: "" if m[1] else m[0], x["formatted"][x["loss_start"] : x["loss_end"]]))
        self.loss_chars += len(kept)
        self.loss.update(kept.encode())

    def row(self) -> tuple:
        return self.conv_id, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
READ_ARROW = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def read_back(formatted: DataFrame) -> DataFrame:
    """A row per conversation of format_chats' rows, which come in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done = None, []
        for batch in batches:
            for x in batch.to_pylist():
                if now is None or now.conv_id != x["conv_id"]:
                    if now is not None:
                        done.append(now.row())
                    now = Digest(x["conv_id"])
                now.add(x)
            if len(done) >= 1000:
                yield to_batch(done, READ_ARROW)
                done = []
        if now is not None:
            done.append(now.row())
        if done:
            yield to_batch(done, READ_ARROW)

    return formatted.mapInArrow(run, READ)


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts hold the control strings."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    tricky = "\\### Assistant: </turn> ok"
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(tricky).alias("text"))
    return read_back(format_chats(rows.unionByName(more)))


OP10_SQL = r"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), t AS (
  SELECT *, length(role) + length(regexp_replace(role, '[^\\<>]', '', 'g')) + length(text) + length(regexp_replace(text, '[^\\<>]', '', 'g')) + 15 AS chars FROM r
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""
