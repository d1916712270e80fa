"""Chat formatting by event sourcing.

A log of events is dealt by conversation, sorted by sequence and folded: ``message`` opens
a message, ``delta`` appends streamed text to it, ``edit`` replaces its text, ``regenerate``
empties it and drops what came after it, so that new deltas refill it. What stands at the
end is rendered by a template whose control strings can't occur inside texts.

Template, one turn:  <|im_start|>ROLE\\nTEXT<|im_end|>\\n

Escape: inside roles and texts every ``<|`` becomes ``<\\|`` and every backslash run
between ``<`` and ``|`` grows by one; ``unescape`` takes one away, so any text comes back
whole. A role also has its line breaks written as ``<\\n``-like marks (see ``ESCAPES``).
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
LOSS_ROLE = "assistant"
_OPEN = re.compile(r"<(\\*)\|")
_SHUT = re.compile(r"<\\(\\*)\|")
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.DOTALL)

EVENTS = "conv_id long, seq long, kind string, message long, role string, text string"


def escape(text: str) -> str:
    """Text without control strings: one more backslash in every ``<\\...\\|``."""
    return _OPEN.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _SHUT.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    """A role stays on one line: backslash and line break are written with a backslash first."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def fold(events: Iterable[tuple[str, int, str, str]]) -> list[tuple[str, str]]:
    """Final (role, text) of each message, in order of opening, from (kind, message, role, text).

    Events on a message that was never opened, or was dropped, open it anew; unknown kinds
    count as ``message``. Null role and text are empty.
    """
    roles: dict[int, str] = {}
    texts: dict[int, list[str]] = {}
    for kind, message, role, text in events:
        if message not in texts:
            roles[message], texts[message] = role or "", []
        if kind == "regenerate":
            names = list(texts)
            for later in names[names.index(message) + 1 :]:
                del texts[later], roles[later]
            texts[message] = [text or ""]
        elif kind == "edit" or kind not in ("delta", "message"):
            texts[message] = [text or ""]
        else:
            texts[message].append(text or "")
    return [(roles[m], "".join(t)) for m, t in texts.items()]


def render(turns: Iterable[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """Formatted conversation, and the spans of code points under the loss mask."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head = f"{START}{escape_role(role)}\n"
        body = escape(text)
        if role == LOSS_ROLE:
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, END, "\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """Turns read back from a formatted conversation."""
    return [(unescape_role(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def masked(formatted: str, spans: list[tuple[int, int]]) -> str:
    """All text under the loss mask, unescaped, one span after another."""
    return "".join(unescape(formatted[a:b]) for a, b in spans)


def as_events(conversations: DataFrame) -> DataFrame:
    """The table of finished turns as a log: one ``message`` event for each row, by turn."""
    return conversations.select("conv_id", F.col("turn").alias("seq"), F.lit("message").alias("kind"), "role", "text")


def reconstruct(events: DataFrame, step, schema: str) -> DataFrame:
    """Fold each conversation and hand it on: ``step(rows)`` maps lists of (conv_id, turns) to a batch.

    ``events``: conv_id, seq, kind, role, text and optionally ``message`` (null or absent:
    every event is a message of its own). Ordered by seq, nulls last, ties by kind, role and text. Null
    conversation ids form one conversation. Rows arrive sorted, so only one conversation
    is held at a time, however many lie in a task.
    """
    named = events if "message" in events.columns else events.withColumn("message", F.lit(None).cast("long"))
    rows = named.select("conv_id", "seq", "kind", "message", "role", "text")
    order = ["conv_id", F.col("seq").asc_nulls_last(), "kind", F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_id, held, ready, size = None, None, [], 0
        alone = 0
        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in (0, 2, 3, 4, 5)]
            for conv, kind, message, role, text in zip(*cols, strict=True):
                if held is None or conv != open_id:
                    if held is not None:
                        ready.append((open_id, fold(held)))
                        if size > 1 << 20 or len(ready) >= 1000:
                            yield step(ready)
                            ready, size = [], 0
                    open_id, held = conv, []
                if message is None:
                    alone -= 1
                    message = alone
                held.append((kind, message, role, text))
                size += len(text or "")
        if held is not None:
            ready.append((open_id, fold(held)))
        if ready:
            yield step(ready)

    return rows.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(run, schema)


def format_conversations(events: DataFrame) -> DataFrame:
    """conv_id, formatted string, spans array<struct<first,last>> under the loss mask.

    Null roles and texts are empty; events go by seq, nulls last, ties by kind, role and text, and repeated
    events stay repeated. Null conversation ids form one conversation. Other columns are left aside; an
    empty table gives no rows.
    """

    def step(rows: list) -> pa.RecordBatch:
        done = [render(turns) for _, turns in rows]
        kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
        return pa.RecordBatch.from_arrays([pa.array([c for c, _ in rows], type=pa.int64()), pa.array([f for f, _ in done], type=pa.string()), pa.array([[{"first": a, "last": b} for a, b in s] for _, s in done], type=kind)], names=["conv_id", "formatted", "spans"])

    return reconstruct(events, step, "conv_id long, formatted string, spans array<struct<first: long, last: long>>")


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what can be read from formatted conversations alone."""
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                piece = batch.slice(lo, 256)
                out: list[list] = [[] for _ in range(6)]
                for conv, text, spans in zip(*(piece.column(i).to_pylist() for i in range(3)), strict=True):
                    turns = parse(text)
                    loss = masked(text, [(s["first"], s["last"]) for s in spans])
                    whole = "".join(f"{role}\n{body}\n" for role, body in turns)
                    for column, value in zip(out, (conv, len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)), strict=True):
                        column.append(value)
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(out, kinds, strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
