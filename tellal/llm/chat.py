"""Chat formatting with typed content parts.

A turn's content is a list of parts (text, image, audio, document). A visitor flattens them, in
order, into one string: text is escaped, every attachment leaves a placeholder numbered through the
conversation, and its reference and the tokens it will expand to are recorded beside the string. A
part of any other type leaves an ``OTHER`` placeholder, expands to no tokens and keeps its type and
reference. The template marks each turn; control strings that occur in a text are rewritten so that
none is left, and can be restored.

Nulls: a null text or role counts as empty, a null turn number sorts first, rows with a null
conv_id form one conversation, a null part is left out. Turns that share a number are ordered by
their formatted piece; repeated rows stay repeated turns. Very long texts and conversations stream.
Columns besides conv_id, turn, role and text or parts are not looked at. An empty table gives no
conversations.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import in_batches

TURN_OPEN, HEAD_END, TURN_CLOSE = "<s>", "\n", "</s>"
#: Strings that mean something to a template or a tokenizer; none may be left in a text.
CONTROL = re.compile(r"\\|</?s>|<</?SYS>>|\[/?INST\]|<\|[a-z_]+\|>|\[(?:IMAGE|AUDIO|DOCUMENT|OTHER) \d+\]")
LETTER = {"\\": "\\b", "<": "\\l", "[": "\\o"}
BACK = {"b": "\\", "l": "<", "o": "[", "n": "\n"}
#: Tokens that a unit of an attachment expands to: an image tile, a second of audio, a page.
TOKENS_PER_UNIT = {"image": 256, "audio": 25, "document": 600}
ONE_TURN = re.compile(r"<s>([^\n]*)\n(.*?)</s>", re.S)


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: LETTER[m[0][0]] + m[0][1:], text)


def unescape(text: str) -> str:
    return re.sub(r"\\([blon])", lambda m: BACK[m[1]], text) if "\\" in text else text


@dataclass
class Flattened:
    """What the visitor gathers from the parts of one turn."""

    first: int = 1
    text: list[str] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)

    def visit(self, part: dict) -> None:
        getattr(self, f"visit_{part.get('type') or 'text'}", self.visit_other)(part)

    def visit_text(self, part: dict) -> None:
        self.text.append(escape(part.get("text") or ""))

    def attach(self, part: dict) -> None:
        kind = part["type"]
        self.mark(kind, part, TOKENS_PER_UNIT[kind] * max(1, part.get("units") or 1))

    visit_image = visit_audio = visit_document = attach

    def visit_other(self, part: dict) -> None:
        self.mark("other", part, 0)

    def mark(self, kind: str, part: dict, tokens: int) -> None:
        mark = f"[{kind.upper()} {self.first + len(self.attachments)}]"
        self.text.append(mark)
        self.attachments.append({"placeholder": mark, "kind": part["type"], "ref": part.get("ref"), "tokens": tokens})


def format_turn(role: str | None, parts: list[dict | None], first: int = 1) -> tuple[str, int, int, list[dict]]:
    """The turn in the template, where its content begins and ends there, and its attachments, whose
    numbers begin with ``first``."""
    seen = Flattened(first)
    for part in parts:
        if part is not None:
            seen.visit(part)
    head = TURN_OPEN + escape(role or "").replace("\n", "\\n") + HEAD_END
    body = "".join(seen.text)
    return head + body + TURN_CLOSE, len(head), len(head) + len(body), seen.attachments


ATTACHMENTS = "array<struct<placeholder: string, kind: string, ref: string, tokens: int>>"
SEGMENTS = f"conv_id long, turn long, segment string, loss_start int, loss_end int, attachments {ATTACHMENTS}, expanded_tokens long"
PARTS = "array<struct<type: string, text: string, ref: string, units: int>>"


def format_turns(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row per turn: its piece of the formatted conversation, the span of the piece under the
    loss mask (empty for other roles), its attachments and the tokens they expand to.

    turns: conv_id, turn, role and either parts (typed) or text. The pieces of a conversation,
    ordered by turn, are its formatted text. Texts need no shuffle; parts need one, of the numbers of
    attachments before each turn, which are a running sum over the conversation.
    """
    ids = [F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role")]
    if "parts" in turns.columns:
        rows = turns.select(*ids, F.col("parts").cast(PARTS).alias("parts"))
        own = F.size(F.filter(F.coalesce("parts", F.array()), lambda p: F.coalesce(p["type"], F.lit("text")) != "text"))
        earlier = Window.partitionBy("conv_id").orderBy("turn", "role", F.to_json("parts")).rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumn("first", F.coalesce(F.sum(own).over(earlier), F.lit(0)).cast("int") + 1)
    else:
        plain = F.struct(F.lit("text").alias("type"), F.col("text").cast("string").alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("units"))
        rows = turns.select(*ids, F.array(plain).alias("parts"), F.lit(1).alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.list_(pa.struct([("placeholder", pa.string()), ("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int32())]))
        for batch in batches:
            out = [format_turn(role, parts or [], first) for role, parts, first in zip(*(batch.column(c).to_pylist() for c in ("role", "parts", "first")))]
            under = [r == loss_role for r in batch.column("role").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("conv_id"), batch.column("turn"), pa.array([x[0] for x in out], pa.string()),
                    pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] if u else x[1] for x, u in zip(out, under)], pa.int32()),
                    pa.array([x[3] for x in out], kinds), pa.array([sum(a["tokens"] for a in x[3]) for x in out], pa.int64()),
                ],
                ["conv_id", "turn", "segment", "loss_start", "loss_end", "attachments", "expanded_tokens"],
            )

    return in_batches(rows, run, SEGMENTS)


def read_back(segment: str) -> list[tuple[str, str]]:
    """The (role, text) pairs that a formatted text holds."""
    return [(unescape(role), unescape(body)) for role, body in ONE_TURN.findall(segment)]


def digest_conversations(segments: DataFrame) -> DataFrame:
    """Per conversation the digests of its turns and of the text under the loss mask, read back
    from the formatted pieces.

    A digest needs the turns in order, so a conversation goes to one task; its pieces stream
    through in sorted order, one at a time, and the sort spills: the longest one costs time there,
    never memory.
    """
    ordered = segments.select("conv_id", "turn", "segment", "loss_start", "loss_end").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "segment")
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        now, n, turns, loss_chars, loss, chars, open_ = None, 0, None, 0, None, 0, False

        def batch_of(done: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in done], t) for k, t in enumerate(types)], names)

        for batch in batches:
            done = []
            for conv, segment, start, end in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "segment", "loss_start", "loss_end"))):
                if not open_ or conv != now:
                    if open_:
                        done.append((now, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
                    now, n, turns, loss_chars, loss, chars, open_ = conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, True
                for role, text in read_back(segment):
                    n += 1
                    turns.update(f"{role}\n{text}\n".encode())
                taught = unescape(segment[start:end])
                loss_chars += len(taught)
                loss.update(taught.encode())
                chars += len(segment)
            yield batch_of(done)
        if open_:
            yield batch_of([(now, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars)])

    return in_batches(ordered, run, schema)


def conversation_texts(segments: DataFrame) -> DataFrame:
    """One row per conversation: its whole formatted text, loss spans in it, and its attachments.
    For conversations whose text fits a row; digest_conversations has no such bound."""
    order = Window.partitionBy("conv_id").orderBy("turn", "segment")
    at = F.coalesce(F.sum(F.length("segment")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")
    placed = segments.withColumn("at", at).withColumn("k", F.row_number().over(order))
    piece = F.struct("k", "segment", (F.col("at") + F.col("loss_start")).alias("start"), (F.col("at") + F.col("loss_end")).alias("end"), "attachments")
    grouped = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(piece)).alias("p"), F.sum("expanded_tokens").alias("expanded_tokens"))
    return grouped.select(
        "conv_id",
        F.expr("array_join(transform(p, x -> x.segment), '')").alias("formatted"),
        F.expr("transform(filter(p, x -> x.end > x.start), x -> named_struct('start', x.start, 'end', x.end))").alias("loss_spans"),
        F.expr("flatten(transform(p, x -> x.attachments))").alias("attachments"),
        "expanded_tokens",
    )
