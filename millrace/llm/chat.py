"""Chat formatting with typed content parts, reversible escapes and a loss mask.

A turn's content is a list of typed parts.  A visitor flattens them into text with ordered placeholders
(``<|image:0|>``), records every attachment reference, and counts the tokens each placeholder expands to.  The
template marks turns as ``### Role: text </turn>`` lines; `escape` puts a backslash before every character of a text
that could begin a control string or a placeholder, so nothing inside a text can be read as one; `unescape` undoes it
exactly, and `parts_of` tells the text from the placeholders.

Formatting is a map over turns, so a conversation with any number of turns costs no task more than a short one.
What needs a whole conversation (its digests, read back from the formatted text) is streamed: rows are dealt by
conversation and sorted by turn inside Spark, which spills, and the reader keeps only running hashes.  A digest over a
whole conversation is a chain, so the turns of one conversation, however many, are read by one task.

Defined cases: a null text or part list is empty; a null role is the empty role; a null conversation id is a
conversation of its own; turns with equal numbers are ordered by role and text, null turns come first; repeated
turns stay; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

HEAD, COLON, END = "### ", ": ", " </turn>\n"
_NEEDS = re.compile(r"[\\#<]")
_ESCAPED = re.compile(r"\\(.)", re.S)
_ROLE_NEEDS = re.compile(r"[\\#<:]")
#: A formatted turn: role and text hold no bare control character, only escaped ones.
_TURN = re.compile(r"### ((?:[^\\#<:]|\\.)*): ((?:[^\\#<]|\\.|<\|\w+:\d+\|>)*) </turn>\n", re.S)
_PIECE = re.compile(r"<\|(\w+):(\d+)\|>|((?:[^\\<]|\\.)+)", re.S)
_NOT_KIND = re.compile(r"\W")


def escape(text: str) -> str:
    return _NEEDS.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


@dataclass
class Flattener:
    """Visits typed parts; collects text, attachments and token counts in order."""

    patch: int = 14
    audio_rate: float = 25.0
    page_tokens: int = 256
    out: list[str] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)

    def visit(self, part: dict) -> None:
        getattr(self, f"visit_{part.get('type') or 'text'}", self.visit_unknown)(part)

    def visit_text(self, part: dict) -> None:
        self.out.append(escape(part.get("text") or ""))

    def visit_image(self, part: dict) -> None:
        self.attach("image", part, math.ceil((part.get("width") or 0) / self.patch) * math.ceil((part.get("height") or 0) / self.patch))

    def visit_audio(self, part: dict) -> None:
        self.attach("audio", part, math.ceil((part.get("seconds") or 0) * self.audio_rate))

    def visit_document(self, part: dict) -> None:
        self.attach("document", part, (part.get("pages") or 0) * self.page_tokens)

    def visit_unknown(self, part: dict) -> None:
        self.attach(str(part.get("type")), part, 0)

    def attach(self, kind: str, part: dict, tokens: int) -> None:
        self.out.append(f"<|{_NOT_KIND.sub('_', kind)}:{len(self.attachments)}|>")
        self.attachments.append({"ordinal": len(self.attachments), "kind": kind, "ref": part.get("ref"), "tokens": tokens})


def flatten(parts: list[dict] | None) -> tuple[str, list[dict]]:
    """Escaped text with bare placeholders, and the attachments in order."""
    visitor = Flattener()
    for part in parts or []:
        visitor.visit(part)
    return "".join(visitor.out), visitor.attachments


def format_turn(role: str | None, body: str) -> tuple[str, int, int]:
    """The formatted turn of a flattened body, and the span of the body (for the loss mask)."""
    head = HEAD + _ROLE_NEEDS.sub(r"\\\g<0>", role or "") + COLON
    return head + body + END, len(head), len(head) + len(body)


def parse(formatted: str) -> Iterator[tuple[str, str, int, int]]:
    """(role, text, start, end of the escaped text) of every turn; the whole string must be turns."""
    at = 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"not a turn at {at}")
        yield unescape(m[1]), unescape(m[2]), m.start(2), m.end(2)
        at = m.end()


def parts_of(body: str) -> list[tuple[str, str | int]]:
    """A formatted body read back: ("text", what the text parts said) and (kind, ordinal of the attachment), in order."""
    return [("text", unescape(m[3])) if m[3] is not None else (m[1], int(m[2])) for m in _PIECE.finditer(body)]


PART = "struct<type: string, text: string, ref: string, width: int, height: int, seconds: double, pages: int>"
FORMATTED = (
    "conv_id long, turn long, role string, formatted string, loss_start int, loss_end int, "
    "attachments array<struct<ordinal: int, kind: string, ref: string, tokens: int>>, attachment_tokens long"
)


def format_turns(turns: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Format every turn.  turns: conv_id, turn, role, and either text (string) or parts (array of `PART`).

    Result: `FORMATTED`; loss_start and loss_end are the span of the text under the loss mask inside `formatted`, null
    for roles that carry no loss.  A placeholder's ordinal counts inside its turn.
    """
    typed = "parts" in turns.columns
    source = turns.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", F.col("parts") if typed else F.col("text").alias("parts")
    )
    kind = pa.list_(pa.struct([("ordinal", pa.int32()), ("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            conv, turn, roles, parts = (c for c in batch.columns)
            made = [flatten(p if typed else [{"text": p}]) for p in parts.to_pylist()]
            rows = [format_turn(r, text) for r, (text, _) in zip(roles.to_pylist(), made, strict=True)]
            loss = [r in loss_roles for r in roles.to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    conv, turn, roles, pa.array([r[0] for r in rows], pa.string()),
                    pa.array([r[1] if x else None for r, x in zip(rows, loss, strict=True)], pa.int32()),
                    pa.array([r[2] if x else None for r, x in zip(rows, loss, strict=True)], pa.int32()),
                    pa.array([a for _, a in made], kind), pa.array([sum(x["tokens"] for x in a) for _, a in made], pa.int64()),
                ],
                names=["conv_id", "turn", "role", "formatted", "loss_start", "loss_end", "attachments", "attachment_tokens"],
            )

    return source.mapInArrow(run, FORMATTED)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams formatted turns, sorted by conversation, into one row a conversation."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    now: list | None = None
    done: list[tuple] = []

    def close() -> None:
        if now:
            done.append((now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5]))

    def flush() -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], k) for i, k in enumerate(kinds)], names=names)
        done.clear()
        return batch

    for batch in batches:
        for conv, formatted, lo, hi in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_start", "loss_end")), strict=True):
            if now is None or now[0] != conv:
                close()
                now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, text, _, _ in parse(formatted):
                now[1] += 1
                now[2].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            if lo is not None:
                text = unescape(formatted[lo:hi])
                now[3] += len(text)
                now[4].update(text.encode("utf-8", "surrogatepass"))
            now[5] += len(formatted)
        if done:
            yield flush()
    close()
    if done:
        yield flush()


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """Read formatted turns back: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    dealt = formatted.select("conv_id", "turn", "role", "formatted", "loss_start", "loss_end").repartition("conv_id")
    ordered = dealt.sortWithinPartitions("conv_id", "turn", "role", "formatted")
    return ordered.mapInArrow(_digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
