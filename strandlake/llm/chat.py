"""Operator 9: chat formatting by incremental rendering of a black-box template.

A template is any function from a list of messages to a string, with the function
that undoes what it does to texts, if it does anything.  The operator renders each
prefix of a conversation and compares consecutive outputs: what a prefix adds is
the span of its last turn.  Where the turn's text lies in its span is found in the
same way, by rendering the prefix with two probe texts in its place: what both
outputs begin and end with are the turn's marks.  A template that changes what it
has already written (by trimming, reordering or closing marks) is found out by the
prefixes, and the conversation is flagged; nothing is known of a template but its
outputs.

Conversations are sorted within partitions and streamed turn by turn; a worker
holds one conversation at a time.  Rendering every prefix takes time in the square
of a conversation's length.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import require

Message = tuple[str, str]


class Template(NamedTuple):
    """``render`` makes a string of messages; ``restore`` undoes what it does to a text."""

    render: Callable[[list[Message]], str]
    restore: Callable[[str], str] = str


# The control strings of the template.
OPEN = {"user": "<s>[INST] ", "assistant": "<s>[ANSW] ", "system": "<s>[SYST] "}
CLOSE = {"user": " [/INST]", "assistant": " [/ANSW]</s>", "system": " [/SYST]"}
OTHER_OPEN, OTHER_MIDDLE, OTHER_CLOSE = "<s>[ROLE] ", " [TEXT] ", " [/ROLE]"

#: What makes a control string of an opening bracket; backslashes between the two are the escape.
_CONTROL = r"(?:/?s>|/?(?:INST|ANSW|SYST|ROLE|TEXT)\])"
_PLAIN = re.compile(rf"([<\[])(\\*)(?={_CONTROL})")
_ESCAPED = re.compile(rf"([<\[])(\\*)\\(?={_CONTROL})")

#: Texts that have no character in common, and nothing that a template would trim or escape.
PROBES = ("Qa7Qa", "Zk3Zk")


def escape(text: str) -> str:
    """No control string is left in the result; ``unescape`` undoes it for any text."""
    return _PLAIN.sub(r"\1\2\\", text) if "<" in text or "[" in text else text


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2", text) if "\\" in text else text


def render_inst(messages: list[Message]) -> str:
    """The template of the library: one marked block a turn, texts escaped."""
    out = []
    for role, text in messages:
        if role in OPEN:
            out += [OPEN[role], escape(text), CLOSE[role]]
        else:
            out += [OTHER_OPEN, escape(role), OTHER_MIDDLE, escape(text), OTHER_CLOSE]
    return "".join(out)


INST = Template(render_inst, unescape)


def _common(a: str, b: str) -> int:
    """Characters that both begin with."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


class Turn(NamedTuple):
    """A turn in the output: its span, that of its text (None if it isn't there as one stretch), and its marks."""

    start: int
    end: int
    text: tuple[int, int] | None
    marks: tuple[str, str]


def locate(messages: list[Message], now: str, start: int, render: Callable[[list[Message]], str]) -> Turn:
    """The last turn in its render ``now``, from ``start`` on."""
    (role, _), history = messages[-1], messages[:-1]
    one, other = (render([*history, (role, probe)]) for probe in PROBES)
    head = _common(one, other)
    tail = len(one) - head - len(PROBES[0])
    clear = tail >= 0 and len(other) == len(one) and one[head : head + len(PROBES[0])] == PROBES[0] and one[len(one) - tail :] == other[len(other) - tail :]
    marks = one[min(start, head) : head], one[len(one) - max(tail, 0) :]
    inside = clear and start <= head <= len(now) - tail and now[:head] == one[:head] and now[len(now) - tail :] == one[len(one) - tail :]
    return Turn(start, len(now), (head, len(now) - tail) if inside else None, marks)


def read_turns(messages: list[Message], render: Callable[[list[Message]], str]) -> tuple[str, list[Turn], bool]:
    """Rendered conversation, where each turn is in it, and whether the template rewrites history.

    A turn's span runs from the end of the common part with the render before it.
    """
    before, turns, rewrites = "", [], False
    for n in range(1, len(messages) + 1):
        now = render(messages[:n])
        start = len(before) if now.startswith(before) else _common(before, now)
        rewrites |= start < len(before)
        turns.append(locate(messages[:n], now, start, render))
        before = now
    return before, turns, rewrites


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, list[Message]]]:
    key, rows = None, []
    for batch in batches:
        for conv, role, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if rows and (conv is None or conv != key):
                yield key, rows
                rows = []
            key = conv
            rows.append((role or "", text or ""))
    if rows:
        yield key, rows


def format_conversations(turns: DataFrame, template: Template = INST, *, trained_role: str = "assistant") -> DataFrame:
    """Render conversations and say which characters a loss counts.

    ``turns`` has conv_id, turn, role and text; further columns are ignored, whatever
    their names.  Rows of a conversation are taken by turn, null turns first and
    rows of one turn by role and text; repeated rows are turns each.  Null roles and
    texts are empty.  A row without conv_id belongs to no conversation and is one of
    its own, so such rows meet nowhere.  Long texts are rendered whole; an empty
    table gives an empty one.

    Returns a row for each conversation: conv_id, n_turns, formatted, turn_spans and
    loss_spans (code points of formatted, ends exclusive), rewrites_history, and what
    the output says when it is read back by the marks that were found:
    turns_sha256 (of role, newline, text, newline for each turn), loss_chars and
    loss_sha256 (of the text under the loss mask, restored), reads_back (all of it
    is what went in).  Where a template rewrites history or does not give a text as
    one stretch no mask can be trusted: loss_spans is empty and the digests and
    reads_back are null.  Where two roles have the same marks the output does not
    tell them apart, and turns_sha256 and reads_back are null.
    """
    require(turns, "conv_id", "turn", "role", "text")
    id_type = turns.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {id_type}, n_turns bigint, formatted string, turn_spans array<array<int>>, loss_spans array<array<int>>, rewrites_history boolean, turns_sha256 string, loss_chars bigint, loss_sha256 string, reads_back boolean, formatted_chars bigint"
    names = [c.split(" ")[0] for c in schema.split(", ")]
    spans_type = pa.list_(pa.list_(pa.int32()))

    def row(conv, messages: list[Message]) -> tuple:
        formatted, found, rewrites = read_turns(messages, template.render)
        spans = [(t.start, t.end) for t in found]
        if rewrites or any(t.text is None for t in found):
            return conv, len(messages), formatted, spans, [], rewrites, None, None, None, None, len(formatted)
        told, loss, masked, chars, same = hashlib.sha256(), hashlib.sha256(), [], 0, True
        role_of, told_apart = {}, True
        for turn, (role, text) in zip(found, messages):
            told_apart &= role_of.setdefault(turn.marks, role) == role
            under = template.restore(formatted[slice(*turn.text)])
            same &= under == text
            told.update(f"{role_of[turn.marks]}\n{under}\n".encode())
            if role == trained_role:
                masked.append(turn.text)
                loss.update(under.encode())
                chars += len(under)
        return conv, len(messages), formatted, spans, masked, False, told.hexdigest() if told_apart else None, chars, loss.hexdigest(), same if told_apart else None, len(formatted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None

        def peek() -> Iterator[pa.RecordBatch]:
            nonlocal kind
            for batch in batches:
                kind = batch.schema.field(0).type
                yield batch

        held, size = [], 0

        def flush() -> pa.RecordBatch:
            cols = list(zip(*held))
            types = [kind, pa.int64(), pa.string(), spans_type, spans_type, pa.bool_(), pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([[*map(list, x)] for x in c] if t == spans_type else c, t) for c, t in zip(cols, types)], names)

        for conv, messages in _conversations(peek()):
            held.append(row(conv, messages))
            size += held[-1][-1]
            if size > 4_000_000:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    rows = turns.select("conv_id", "role", "text", "turn")
    # rows of one turn: by role and text as bytes, so the order is the same everywhere
    whole = rows.where(F.col("conv_id").isNotNull()).repartition("conv_id")
    ordered = whole.sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))
    return ordered.mapInArrow(run, schema).unionByName(rows.where(F.col("conv_id").isNull()).mapInArrow(run, schema))
