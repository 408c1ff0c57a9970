"""Chat formatting: a finite-state machine over roles and a declarative template.

A conversation is validated turn by turn: an optional system turn, then user and
assistant turns in alternation, a user turn first.  The machine's arcs name the
segments that a turn emits; a segment has a loss flag, and only assistant texts
have it set.  A turn that the machine doesn't expect (unknown role or order) is
still emitted, through the template's `other` segments, and counted in n_errors,
so that nothing is lost.

The template marks turns with control strings.  In a text, the escape mark and every
character that begins a control string of this template get the mark before them, so no
control string survives inside a text; unescape() gives the text back.  A template is
refused if its output could not be read back: every turn must open with a control
string that begins no other role's, every text must end at one, and none may be empty
or begin with the mark.

Reader parses a formatted conversation from its characters alone, in pieces of any
size, so the digests come from the output: the turns from its control strings, the
learned text from the loss mask over it.

Rows are dealt by conv_id and sorted by turn inside a partition; the machine reads
them as a stream, so a conversation of any length needs no more memory than a turn.
The digest of a conversation depends on the order of its turns, so one task reads
each conversation; Spark's sort spills, and nothing gathers it.

Edge cases: a null text is empty, a null role is the empty role; rows without a
conv_id are left out; rows with one turn number go by role, then text; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "\\"
TEXT, ROLE = "{text}", "{role}"


@dataclass(frozen=True)
class Template:
    """Segments (text or control string, loss flag) by role; arcs: (state, role) to the next state."""

    segments: dict[str, tuple[tuple[str, bool], ...]] = field(
        default_factory=lambda: {
            "system": (("[SYS] ", False), (TEXT, False), ("[/SYS]\n", False)),
            "user": (("[INST] ", False), (TEXT, False), ("[/INST]\n", False)),
            "assistant": (("[ANS] ", False), (TEXT, True), ("</s>\n", False)),
            "other": (("[ROLE] ", False), (ROLE, False), ("[TEXT] ", False), (TEXT, False), ("[/ROLE]\n", False)),
        }
    )
    arcs: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "asked", ("start", "user"): "user", ("asked", "user"): "user",
            ("user", "assistant"): "assistant", ("assistant", "user"): "user",
        }
    )

    def __post_init__(self) -> None:
        opens = {}
        for role, parts in self.segments.items():
            names = [s for s, _ in parts]
            controls = [s for s in names if s not in (TEXT, ROLE)]
            if names.count(TEXT) != 1 or names.count(ROLE) != (role == "other"):
                raise ValueError(f"{role}: one {TEXT}, and one {ROLE} in other alone")
            if names[0] in (TEXT, ROLE) or names[-1] in (TEXT, ROLE) or any(x in (TEXT, ROLE) and y in (TEXT, ROLE) for x, y in zip(names, names[1:], strict=False)):
                raise ValueError(f"{role}: control strings must stand before, between and after its texts")
            if any(not s or s[0] == MARK for s in controls):
                raise ValueError(f"{role}: an empty control string, or one that begins with the escape mark")
            opens[role] = names[0]
        if "other" not in self.segments or any(x != y and opens[y].startswith(opens[x]) for x in opens for y in opens):
            raise ValueError("`other` is missing, or a turn's opening begins another's")

    @property
    def first_characters(self) -> str:
        return "".join(sorted({s[0] for parts in self.segments.values() for s, _ in parts if s not in (TEXT, ROLE)}))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


class Machine:
    """Formats one conversation turn by turn."""

    def __init__(self, template: Template):
        self.template, self.state, self.errors = template, "start", 0
        self.raw = re.compile(f"[{re.escape(MARK + template.first_characters)}]")

    def feed(self, role: str, text: str) -> list[tuple[str, bool]]:
        to = self.template.arcs.get((self.state, role))
        self.errors += to is None
        self.state = to or self.state
        plain = self.template.segments.get(role) if role != "other" else None
        fill = {TEXT: self._escaped(text), ROLE: self._escaped(role)}
        return [(fill.get(s, s), loss) for s, loss in (plain or self.template.segments["other"])]

    def _escaped(self, text: str) -> str:
        return self.raw.sub(lambda m: MARK + m[0], text)


class Reader:
    """Reads a formatted conversation back from its characters, in pieces that may end anywhere."""

    def __init__(self, template: Template):
        plain = f"((?:[^{re.escape(MARK + template.first_characters)}]++|{re.escape(MARK)}.)*+)"
        self.turns = [(role, re.compile("".join(plain if s in (TEXT, ROLE) else re.escape(s) for s, _ in parts), re.DOTALL)) for role, parts in template.segments.items()]
        self.rest: list[str] = []

    def feed(self, piece: str) -> Iterator[tuple[str, str]]:
        """(role, text) of the turns that are complete by now."""
        self.rest.append(piece)
        whole, at = "".join(self.rest), 0
        while at < len(whole):
            for role, pattern in self.turns:
                if m := pattern.match(whole, at):
                    groups = [unescape(g) for g in m.groups()]
                    yield (role, groups[0]) if role != "other" else (groups[0], groups[1])
                    at = m.end()
                    break
            else:
                break
        self.rest = [whole[at:]] if at < len(whole) else []

    def close(self) -> None:
        if self.rest:
            raise ValueError("not a formatted conversation")


def in_turn_order(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text dealt by conversation and sorted by turn."""
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).where("conv_id IS NOT NULL")
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def _conversations(batches: Iterator[pa.RecordBatch], template: Template) -> Iterator[tuple[int, int, str, list[tuple[str, bool]], Machine]]:
    """(conv_id, turn, role, segments, machine) of each row in order."""
    now, machine = None, Machine(template)
    for batch in batches:
        for conv, turn, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text")), strict=True):
            if conv != now:
                now, machine = conv, Machine(template)
            yield conv, turn, role, machine.feed(role, text), machine


def format_segments(rows: DataFrame, template: Template = Template()) -> DataFrame:
    """One row per segment: conv_id, turn, at (number in the turn), segment, loss."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for conv, turn, _, segments, _ in _conversations(batches, template):
            out += [(conv, turn, i, s, loss) for i, (s, loss) in enumerate(segments)]
            if len(out) >= 4096:
                yield _rows(out, _SEGMENT)
                out = []
        yield _rows(out, _SEGMENT)

    return in_turn_order(rows).mapInArrow(run, "conv_id long, turn long, at int, segment string, loss boolean")


_SEGMENT = [("conv_id", pa.int64()), ("turn", pa.int64()), ("at", pa.int32()), ("segment", pa.string()), ("loss", pa.bool_())]
_DIGEST = [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_errors", pa.int64())]


def _rows(rows: list[tuple], schema: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, schema, strict=True)], names=[n for n, _ in schema])


def format_digests(rows: DataFrame, template: Template = Template()) -> DataFrame:
    """One row per conversation, read back from the formatted turns: digests of the turns and of the text under the loss mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        now = None
        machine, reader, turns, loss, n, loss_chars, chars = None, None, None, None, 0, 0, 0

        def close() -> None:
            if now is not None:
                reader.close()
                out.append((now, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars, machine.errors))

        for conv, _, _, segments, own in _conversations(batches, template):
            if conv != now:
                close()
                if len(out) >= 4096:
                    yield _rows(out, _DIGEST)
                    out.clear()
                now, reader, turns, loss, n, loss_chars, chars = conv, Reader(template), hashlib.sha256(), hashlib.sha256(), 0, 0, 0
            machine = own
            # what is written: the characters, and the mask over them as (end, learned)
            written, mask = "".join(s for s, _ in segments), list(zip(accumulate(len(s) for s, _ in segments), (x for _, x in segments), strict=True))
            for role, text in reader.feed(written):
                turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                n += 1
            chars += len(written)
            begin = 0
            for end, learned in mask:
                if learned:
                    text = unescape(written[begin:end])
                    loss.update(text.encode("utf-8", "surrogatepass"))
                    loss_chars += len(text)
                begin = end
        close()
        yield _rows(out, _DIGEST)

    return in_turn_order(rows).mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_errors long")
