"""Chat formatting: a finite-state machine over roles, and a template that says how turns are written.

``format_conversations`` walks each conversation in turn order.  The machine's
table says which role may follow which; the template gives each role its
opening and closing marker and whether its text is learnt.  What comes out are
text segments with a loss flag each; laid end to end they are the formatted
conversation.  ``read_back`` parses such segments again.

Control strings inside a text are broken up by a backslash after their first
character, and backslashes are doubled, so no text can look like a marker and
every text comes back unchanged.

Rows are spread by conversation and sorted inside partitions; both directions
stream, so memory is bounded by a turn, however long a conversation is.

Defined results: a NULL text is empty; a NULL role reads back as an empty one;
roles that the template does not name are written with the general marker;
conversations that break the turn order are formatted all the same and the
offending segments carry a ``problem``; equal turn numbers are ordered by role
and text and count as a problem; rows with a NULL id form one conversation.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prospectra.llm.common import ready_for_python


@dataclass(frozen=True)
class Turn:
    """How a role's turn is written."""
    opening: str
    closing: str
    learnt: bool = False


@dataclass(frozen=True)
class Template:
    begin: str = "<s>"
    turns: dict[str, Turn] = field(default_factory=lambda: {
        "system": Turn("<<SYS>>", "<</SYS>>"),
        "user": Turn("[INST]", "[/INST]"),
        "assistant": Turn("[OUT]", "</s>", learnt=True)})
    # A role without an entry: the role stands between these two.
    other: tuple[str, str, str] = ("[ROLE]", "[:]", "[/ROLE]")
    # Machine: state (the last role, "" at the start) to the roles that may come next.
    follows: dict[str, tuple[str, ...]] = field(default_factory=lambda: {
        "": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})

    def controls(self) -> list[str]:
        marks = [self.begin, *self.other, *[m for t in self.turns.values() for m in (t.opening, t.closing)]]
        return sorted(set(marks), key=len, reverse=True)


class Escaper:
    def __init__(self, template: Template) -> None:
        self._control = re.compile("|".join(map(re.escape, template.controls())))
        self._escaped = re.compile(r"\\(\\?)")

    def escape(self, text: str) -> str:
        text = text.replace("\\", "\\\\")
        # Breaking one control string can leave another that began inside it.
        while True:
            broken = self._control.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)
            if broken == text:
                return text
            text = broken

    def unescape(self, text: str) -> str:
        return self._escaped.sub(lambda m: m[1], text)


class Machine:
    """Follows one conversation; tells what is wrong with a turn, or None."""

    def __init__(self, template: Template) -> None:
        self._follows, self._state, self._last = template.follows, "", None

    def step(self, turn: int | None, role: str) -> str | None:
        problem = None
        if turn is None or self._last is not None and turn <= self._last:
            problem = f"turn {turn} after turn {self._last}"
        elif role not in self._follows.get(self._state, ()):
            problem = f"{role or 'no role'} after {self._state or 'the start'}"
        self._state, self._last = role, turn if turn is not None else self._last
        return problem


_SEGMENTS = "conv_id long, segment long, turn long, text string, loss boolean, problem string"
_SEGMENT_ARROW = pa.schema([("conv_id", pa.int64()), ("segment", pa.int64()), ("turn", pa.int64()), ("text", pa.string()),
                            ("loss", pa.bool_()), ("problem", pa.string())])
_DIGESTS = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, "
            "n_problems long")
_DIGEST_NAMES = [x.split()[0] for x in _DIGESTS.split(", ")]


def _write(template: Template):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        escaper, machine = Escaper(template), Machine(template)
        current, number, begun = None, 0, False
        for batch in batches:
            rows: list[tuple] = []
            for conv, turn, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if not begun or conv != current:
                    begun, current, number, machine = True, conv, 1, Machine(template)
                    rows.append((conv, 0, None, template.begin, False, None))
                role = role or ""
                problem = machine.step(turn, role)
                how = template.turns.get(role)
                if how is None:
                    opening, middle, closing = template.other
                    how = Turn(opening + escaper.escape(role) + middle, closing)
                for part, learnt, what in ((how.opening, False, problem), (escaper.escape(text or ""), how.learnt, None),
                                           (how.closing, False, None)):
                    rows.append((conv, number, turn, part, learnt, what))
                    number += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*rows), _SEGMENT_ARROW)] if rows
                else [pa.array([], f.type) for f in _SEGMENT_ARROW], schema=_SEGMENT_ARROW)
    return run


def format_conversations(rows: DataFrame, template: Template | None = None, conv_id: str = "conv_id", turn: str = "turn",
                         role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, segment, turn, text, loss, problem): the segments of every conversation, in order."""
    ready_for_python(rows)
    ordered = (rows.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"),
                           F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text"))
               .repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text"))
    return ordered.mapInArrow(_write(template or Template()), _SEGMENTS)


class Reader:
    """Parses one formatted conversation, piece by piece, and sums it up."""

    def __init__(self, template: Template, escaper: Escaper) -> None:
        self._template, self._escaper = template, escaper
        self._openings = {t.opening: (r, t.closing) for r, t in template.turns.items()}
        self._buffer, self._begun = "", False
        self.turns = self.chars = self.loss_chars = self.problems = 0
        self.turns_hash, self.loss_hash = hashlib.sha256(), hashlib.sha256()

    def feed(self, text: str, loss: bool, problem: str | None) -> None:
        self.chars += len(text)
        self.problems += problem is not None
        if loss:
            learnt = self._escaper.unescape(text)
            self.loss_chars += len(learnt)
            self.loss_hash.update(learnt.encode("utf-8", "surrogatepass"))
        self._buffer += text
        if not self._begun and self._buffer.startswith(self._template.begin):
            self._buffer, self._begun = self._buffer[len(self._template.begin):], True
        # A turn can be over only where a closing marker has just arrived.
        while self._begun and (found := self._turn()):
            role, body, end = found
            self._buffer = self._buffer[end:]
            self.turns += 1
            self.turns_hash.update(f"{role}\n{body}\n".encode("utf-8", "surrogatepass"))

    def _turn(self) -> tuple[str, str, int] | None:
        unescape = self._escaper.unescape
        opening, middle, closing = self._template.other
        if self._buffer.startswith(opening):
            at = self._buffer.find(middle)
            end = self._buffer.find(closing, at + len(middle)) if at >= 0 else -1
            if end < 0:
                return None
            return (unescape(self._buffer[len(opening):at]), unescape(self._buffer[at + len(middle):end]), end + len(closing))
        for opening, (role, closing) in self._openings.items():
            if self._buffer.startswith(opening):
                end = self._buffer.find(closing, len(opening))
                return (role, unescape(self._buffer[len(opening):end]), end + len(closing)) if end >= 0 else None
        return None

    def digest(self) -> tuple:
        return (self.turns, self.turns_hash.hexdigest(), self.loss_chars, self.loss_hash.hexdigest(), self.chars, self.problems)


def _read(template: Template):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        escaper, reader, current = Escaper(template), None, None

        def out(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.string() if n.endswith("sha256") else pa.int64() for n in _DIGEST_NAMES]
            columns = list(zip(*rows)) or [()] * len(kinds)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], _DIGEST_NAMES)

        for batch in batches:
            done = []
            for conv, _, text, loss, problem in zip(*(c.to_pylist() for c in batch.columns)):
                if reader is None or conv != current:
                    if reader is not None:
                        done.append((current, *reader.digest()))
                    reader, current = Reader(template, escaper), conv
                reader.feed(text, loss, problem)
            yield out(done)
        if reader is not None:
            yield out([(current, *reader.digest())])
    return run


def read_back(segments: DataFrame, template: Template | None = None) -> DataFrame:
    """One row per conversation, parsed from its segments: turn and loss digests, lengths, problems."""
    ready_for_python(segments)
    ordered = (segments.select("conv_id", "segment", "text", "loss", "problem")
               .repartition("conv_id").sortWithinPartitions("conv_id", "segment"))
    return ordered.mapInArrow(_read(template or Template()), _DIGESTS)
