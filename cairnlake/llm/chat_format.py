"""Chat formatting: conversations as marked text segments with a loss flag each.

A template says, for each role, which strings open and close its turn, whether
its text is learned, and after which states the role may speak; the finite-state
machine over roles that follows from it validates the order of turns. Control
strings of the template that a text holds get a backslash after their first
character, and those with backslashes there one more, so that no text forms a
marker, alone or where it meets one, and the escape can be taken back.

Rows are dealt by conversation and sorted by turn, and a task reads them as a
stream, with the state of one conversation at a time: memory is bounded by an
Arrow batch, however long a conversation is, and a sort that doesn't fit spills.
A conversation's rows are read in order by one task because its digests are
defined over all its turns in sequence; what a hot conversation costs is one pass.

Turns follow ``turn`` (null first), then role and text, so ties and repeated rows
have one order; each row is a turn. A null text or role reads as empty. Rows with
a null id are one conversation. Turns against the order are formatted as any
other, and their conversation has ``valid`` false and the place of the first of
them in ``first_bad``; roles that the template doesn't know are such turns, and
are named in the output. ``complete`` is true if the last turn is one that may
end a conversation. Empty tables give empty results; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnlake.llm.common import SLICE, give_back, pick


class Turn(NamedTuple):
    """How a role's turn looks: its markers, whether its text is learned, and the roles that it may follow (START: none)."""

    opens: str
    closes: str
    learned: bool
    follows: tuple[str | None, ...]
    ends: bool = False


#: The state before a conversation's first turn; after a turn the state is its role.
START = None
#: The default template; the strings are those of the output format.
TEMPLATE = {
    "system": Turn("[SYS]", "[/SYS]", False, (START,)),
    "user": Turn("[INST]", "[/INST]", False, (START, "system", "assistant")),
    "assistant": Turn("<s>", "</s>", True, ("user",), ends=True),
}
#: Turns of other roles: the role's name, then the text.
OTHER_OPENS, OTHER_TEXT, OTHER_CLOSES = "[ROLE]", "[TEXT]", "[/ROLE]"


class Machine:
    """A template's transitions, escapes and markers."""

    def __init__(self, template: dict[str, Turn]) -> None:
        self.template = template
        self.controls = [s for t in template.values() for s in (t.opens, t.closes)] + [OTHER_OPENS, OTHER_TEXT, OTHER_CLOSES]
        if len(set(self.controls)) < len(self.controls) or any(len(c) < 3 or c[0].isalnum() or c[-1] == c[0] or "\\" in c or c[0] in d[1:] or c[-1] in d[:-1] for c in self.controls for d in self.controls):
            raise ValueError("markers must be distinct, of three characters at least, and begin and end with characters that markers hold nowhere else")
        heads: dict[str, list[str]] = {}
        for c in self.controls:
            heads.setdefault(c[0], []).append(re.escape(c[1:]))
        each = lambda slashes: "|".join(f"(?<={re.escape(h)}){slashes}(?={rest})" for h, tails in heads.items() for rest in [r"\\*(?:" + "|".join(tails) + ")"])
        self._escape, self._unescape = re.compile(each("")), re.compile(each(r"\\"))
        self.markers = re.compile("|".join(map(re.escape, self.controls)))
        self.transitions = {(before, role) for role, turn in template.items() for before in turn.follows}

    def allows(self, state: str | None, role: str) -> bool:
        return (state, role) in self.transitions

    def escape(self, text: str) -> str:
        return self._escape.sub(r"\\", text)

    def unescape(self, text: str) -> str:
        return self._unescape.sub("", text)

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        """A turn's segments and whether each is learned."""
        if turn := self.template.get(role):
            return [(turn.opens, False), (self.escape(text), turn.learned), (turn.closes, False)]
        return [(OTHER_OPENS, False), (self.escape(role), False), (OTHER_TEXT, False), (self.escape(text), False), (OTHER_CLOSES, False)]

    def turns(self, formatted: str) -> Iterator[tuple[str, str]]:
        """(role, text) of each turn of formatted text."""
        opened = {t.opens: (role, t.closes) for role, t in self.template.items()}
        at = 0
        while at < len(formatted):
            marks = []
            for mark in self.markers.finditer(formatted, at):
                marks.append(mark)
                if mark.group() in (OTHER_CLOSES, *(c for _, c in opened.values())):
                    break
            spans = [formatted[a.end() : b.start()] for a, b in zip(marks, marks[1:])]
            at = marks[-1].end()
            if known := opened.get(marks[0].group()):
                yield known[0], self.unescape(spans[0])
            else:
                yield self.unescape(spans[0]), self.unescape(spans[1])


SEGMENTS = "array<struct<text:string,loss:boolean>>"


def _streamed(rows: DataFrame, make, schema: str) -> DataFrame:
    """mapInArrow over slices of bounded bytes with one object of state a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = make()
        for batch in batches:
            step = max(1, int(batch.num_rows * min(1, SLICE / max(1, batch.nbytes))))
            for at in range(0, batch.num_rows, step):
                yield state.take(batch.slice(at, step))
        if (last := state.end()) is not None:
            yield last
        state = None
        give_back()

    return rows.mapInArrow(run, schema)


def in_order(conversations: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turn, role, text) dealt by conversation and sorted by turn."""
    rows = pick(conversations, conv=conv_col, turn=turn_col, role=role_col, text=text_col)
    rows = rows.withColumns({c: F.coalesce(c, F.lit("")) for c in ("role", "text")})
    return rows.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text")


def format_turns(conversations: DataFrame, template: dict[str, Turn] | None = None, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_col``, place (from 0), ``segments`` (text, loss), ``in_order`` and ``may_end`` of every turn, each conversation's in sequence."""
    machine = Machine(template or TEMPLATE)
    rows = in_order(conversations, conv_col=conv_col, turn_col=turn_col, role_col=role_col, text_col=text_col)
    kind = dict(rows.dtypes)["conv"]
    parts = pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())]))

    class Writer:
        def __init__(self) -> None:
            self.conv, self.place, self.state = self, 0, START  # no conversation is the writer itself

        def take(self, batch: pa.RecordBatch) -> pa.RecordBatch:
            places, segments, good, ends = [], [], [], []
            for conv, role, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if conv != self.conv:
                    self.conv, self.place, self.state = conv, 0, START
                places.append(self.place)
                segments.append([{"text": t, "loss": learned} for t, learned in machine.segments(role, text)])
                good.append(machine.allows(self.state, role))
                ends.append(role in machine.template and machine.template[role].ends)
                self.place, self.state = self.place + 1, role
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(places, pa.int64()), pa.array(segments, parts), pa.array(good, pa.bool_()), pa.array(ends, pa.bool_())], ["conv", "place", "segments", "in_order", "may_end"])

        def end(self) -> None:
            return None

    return _streamed(rows, Writer, f"conv {kind}, place long, segments {SEGMENTS}, in_order boolean, may_end boolean").withColumnRenamed("conv", conv_col)


def read_back(turns: DataFrame, template: dict[str, Turn] | None = None, *, conv_col: str = "conv_id") -> DataFrame:
    """What the output of ``format_turns`` says of each conversation, from segments and flags alone.

    ``turns`` must come from ``format_turns`` without a shuffle between, or be dealt
    by conversation and sorted by place within partitions again.
    """
    machine = Machine(template or TEMPLATE)
    rows = turns.select(F.col(conv_col).alias("conv"), "place", "segments", "in_order", "may_end")
    kind = dict(rows.dtypes)["conv"]
    names = ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid", "first_bad", "complete"]
    kinds = [None, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.bool_()]

    class Reader:
        def __init__(self) -> None:
            self.conv, self.kind = self, None

        def begin(self, conv) -> None:
            self.conv, self.all, self.loss = conv, hashlib.sha256(), hashlib.sha256()
            self.n, self.loss_chars, self.chars, self.first_bad, self.complete = 0, 0, 0, None, False

        def row(self) -> list[tuple]:
            if self.conv is self:
                return []
            return [(self.conv, self.n, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.first_bad is None, self.first_bad, self.complete)]

        def batch(self, out: list[tuple]) -> pa.RecordBatch:
            columns = [list(c) for c in zip(*out)] or [[] for _ in names]
            return pa.RecordBatch.from_arrays([pa.array(c, k or self.kind) for c, k in zip(columns, kinds)], names)

        def take(self, batch: pa.RecordBatch) -> pa.RecordBatch:
            self.kind, out = batch.schema.field(0).type, []
            for conv, place, segments, good, ends in zip(*[c.to_pylist() for c in batch.columns]):
                if conv != self.conv:
                    out += self.row()
                    self.begin(conv)
                for role, text in machine.turns("".join(s["text"] for s in segments)):
                    self.all.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                    self.n += 1
                for s in segments:
                    self.chars += len(s["text"])
                    if s["loss"]:
                        learned = machine.unescape(s["text"])
                        self.loss_chars += len(learned)
                        self.loss.update(learned.encode("utf-8", "surrogatepass"))
                if not good and self.first_bad is None:
                    self.first_bad = place
                self.complete = ends
            return self.batch(out)

        def end(self) -> pa.RecordBatch | None:
            return self.batch(self.row()) if self.kind is not None else None

    schema = f"conv {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean, first_bad long, complete boolean"
    return _streamed(rows, Reader, schema).withColumnRenamed("conv", conv_col)
