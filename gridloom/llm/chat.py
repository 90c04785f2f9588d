"""Chat formatting: a finite-state machine over roles and a declarative template.

A template names, for each role, the marks around a turn's text and whether the text
bears loss. Turns run through the machine in order; each becomes segments (mark,
text, mark) with a loss flag each. Where a control string occurs inside a text, an
escape character is put after its first code point, and the escape character itself
is doubled with a digit, so a text never holds a control string and is read back
exactly. A role without a template of its own is written by name.

Rows are dealt by conversation and streamed in the order of turns: a task holds one
turn at a time, however long a conversation is.

Defined cases: null texts and null roles are empty; turns of equal number follow
each other by role and text; null turn numbers come first; a conversation whose
roles break the order is formatted all the same and marked invalid from there on; null
conversation ids are one conversation; repeated rows are turns of their own; a long
text is held whole, a long conversation turn by turn; an empty table gives no rows;
columns other than the four named are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.storage import bounded

ESCAPE = "\x1b"


@dataclass(frozen=True)
class Role:
    before: str
    after: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """Marks by role, the marks of a role without marks, and the machine: state -> role -> next state."""

    roles: dict[str, Role] = field(
        default_factory=lambda: {
            "system": Role("<<SYS>>", "<</SYS>>"),
            "user": Role("<s>[INST]", "[/INST]"),
            "assistant": Role("<ASSISTANT>", "</s>", loss=True),
        }
    )
    named: tuple[str, str, str] = ("<ROLE>", "</ROLE>", "</TURN>")
    machine: dict[str, dict[str, str]] = field(
        default_factory=lambda: {
            "start": {"system": "opened", "user": "asked"},
            "opened": {"user": "asked"},
            "asked": {"assistant": "answered"},
            "answered": {"user": "asked"},
        }
    )

    def controls(self) -> list[str]:
        marks = [m for r in self.roles.values() for m in (r.before, r.after)] + list(self.named)
        if any(len(m) < 2 or ESCAPE in m or any(m.startswith(m[-k:]) for k in range(1, len(m))) for m in marks) or len({*marks}) < len(marks):
            raise ValueError("marks must be distinct, of two code points or more, and must not end as they begin")
        return sorted(marks, key=len, reverse=True)


class Codec:
    """Writes turns as segments and reads them back from the text."""

    def __init__(self, template: Template):
        self.template = template
        marks = template.controls()
        self._inside = re.compile(f"{ESCAPE}|(?:{'|'.join(re.escape(m[0]) for m in marks)})(?={'|'.join(f'(?<={re.escape(m[0])}){re.escape(m[1:])}' for m in marks)})")
        self._mark = re.compile("|".join(map(re.escape, marks)))

    def escape(self, text: str) -> str:
        return self._inside.sub(lambda m: ESCAPE + "0" if m[0] == ESCAPE else m[0] + ESCAPE + "1", text)

    @staticmethod
    def unescape(text: str) -> str:
        return text.replace(ESCAPE + "1", "").replace(ESCAPE + "0", ESCAPE)

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        if (own := self.template.roles.get(role)) is not None:
            return [(own.before, False), (self.escape(text), own.loss), (own.after, False)]
        a, b, c = self.template.named
        return [(a, False), (self.escape(role), False), (b, False), (self.escape(text), False), (c, False)]

    def read(self, formatted: str) -> Iterator[tuple[str, str, int, int]]:
        """Role, text and the span of the escaped text, of each turn in a formatted string."""
        opens = {r.before: (name, r.after) for name, r in self.template.roles.items()}
        at = 0
        while at < len(formatted):
            first = self._mark.match(formatted, at)
            if first is None:
                raise ValueError(f"no turn begins at {at}")
            if first[0] in opens:
                role, close = opens[first[0]]
                begin = first.end()
            else:
                middle = self._mark.search(formatted, first.end())
                role, close, begin = self.unescape(formatted[first.end() : middle.start()]), self.template.named[2], middle.end()
            last = self._mark.search(formatted, begin)
            if last is None or last[0] != close:
                raise ValueError(f"the turn at {at} has no end")
            yield role, self.unescape(formatted[begin : last.start()]), begin, last.start()
            at = last.end()


_TURNS = "conv_id long, turn long, role string, state string, valid boolean, segments array<struct<text:string,loss:boolean>>"
_SEGMENT = pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())]))


def format_turns(conversations: DataFrame, template: Template | None = None, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row a turn, in order within partitions, a conversation in one partition: its segments with loss flags and the machine's verdict so far."""
    template = template or Template()
    template.controls()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, current, state = Codec(template), object(), "start"
        for batch in batches:
            rows = []
            for conv, turn, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if conv != current:
                    current, state = conv, "start"
                state = template.machine.get(state, {}).get(role, "invalid")
                rows.append((conv, turn, role, state, state != "invalid", [{"text": t, "loss": f} for t, f in codec.segments(role, text)]))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_(), _SEGMENT)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["conv_id", "turn", "role", "state", "valid", "segments"])

    rows = bounded(conversations).select(F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, _TURNS)


_DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"


def digest(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """What reads back from the segments of format_turns(): one row a conversation. Narrow: it keeps the order it gets."""
    template = template or Template()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, current, sums = Codec(template), object(), None
        out: list[tuple] = []

        def close() -> None:
            if sums is not None:
                out.append((current, sums["n"], sums["turns"].hexdigest(), sums["loss_chars"], sums["loss"].hexdigest(), sums["chars"], sums["valid"]))

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) if out else [()] * 7
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_())
            made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in _DIGEST.split(", ")])
            out.clear()
            return made

        for batch in batches:
            for conv, valid, segments in zip(batch.column(0).to_pylist(), batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True):
                if conv != current or sums is None:
                    close()
                    current, sums = conv, {"n": 0, "turns": hashlib.sha256(), "loss_chars": 0, "loss": hashlib.sha256(), "chars": 0, "valid": True}
                formatted = "".join(s["text"] for s in segments)
                at, masked = 0, []
                for s in segments:
                    if s["loss"]:
                        masked.append((at, at + len(s["text"])))
                    at += len(s["text"])
                for role, text, _, _ in codec.read(formatted):
                    sums["n"] += 1
                    sums["turns"].update(f"{role}\n{text}\n".encode())
                for begin, end in masked:
                    text = codec.unescape(formatted[begin:end])
                    sums["loss_chars"] += len(text)
                    sums["loss"].update(text.encode())
                sums["chars"] += len(formatted)
                sums["valid"] &= valid
            yield flush()
        close()
        if out:
            yield flush()

    return turns.mapInArrow(run, _DIGEST)
