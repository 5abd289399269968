"""Chat formatting with any renderer, taken as a black box: turn spans come from comparing renderings of growing prefixes.

A conversation's rows are put in order of turn, then role, then text (so ties have a defined order; repeated rows are turns
of their own; a null turn comes first). A null role or text counts as empty. Rows with a null conversation id form one
conversation. Where a template has changed what it made of earlier turns, places are those in the last rendering, and a
conversation whose learnt texts aren't all there whole has no loss. An empty table gives an empty result; other columns are ignored. One conversation is the unit of work: its
rows meet in one task, and each of its prefixes is rendered, so the cost grows with turns times length.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Message = tuple[str, str]


@dataclass(frozen=True)
class Tagged:
    """A template of the form <turn role>text</turn>. ``&`` and ``<`` are written as entities inside roles and texts, so that
    no text can hold a control string of this template, and reading back restores every text exactly."""

    opening: str = "<turn "
    middle: str = ">"
    closing: str = "</turn>\n"

    @staticmethod
    def escape(s: str) -> str:
        return s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")

    @staticmethod
    def unescape(s: str) -> str:
        return s.replace("&gt;", ">").replace("&lt;", "<").replace("&amp;", "&")

    def __call__(self, messages: list[Message]) -> str:
        return "".join([_turn(self, r, t) for r, t in messages])

    def read(self, formatted: str) -> list[Message]:
        turn = re.compile(f"{re.escape(self.opening)}([^<>]*){re.escape(self.middle)}([^<>]*){re.escape(self.closing)}")
        return [(self.unescape(m[1]), self.unescape(m[2])) for m in turn.finditer(formatted)]


@lru_cache(1024)
def _turn(template: Tagged, role: str, text: str) -> str:
    return f"{template.opening}{template.escape(role)}{template.middle}{template.escape(text)}{template.closing}"


@dataclass(frozen=True)
class Turn:
    """Places in the formatted text: of the whole turn and of its content, which are None if the content isn't there whole.
    rewrites: earlier output changed at this turn."""

    start: int
    end: int
    content_start: int | None
    content_end: int | None
    rewrites: bool


def _common(a: str, b: str) -> int:
    """How many characters both begin with: whole slices are compared, halving what is unsettled."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def _frame(render: Callable[[list[Message]], str], head: list[Message], role: str) -> tuple[int, int]:
    """Where the content of a turn after head begins, and how much follows it: two renderings that differ in it alone say so."""
    one, other = (render([*head, (role, probe)]) for probe in "01")
    return _common(one, other), _common(one[::-1], other[::-1])


def locate(render: Callable[[list[Message]], str], messages: list[Message]) -> tuple[str, list[Turn]]:
    """Renders successive prefixes and says where each turn came to stand.

    A turn's output is what follows the part that its rendering shares with the one before; what a template puts after all
    turns moves on and belongs to none. A turn's content is what lies between the parts that stay when the content changes.
    What stays is found with probes once for each pair of neighbouring roles, and again for every turn at which it isn't found
    in its place. If a turn changes earlier output, all turns are sought anew in the last rendering.
    """
    before, turns, tail = render([]), [], 0
    frames: dict[tuple[str | None, str], tuple[str, str]] = {}
    for i, (role, text) in enumerate(messages):
        head, key = messages[:i], (messages[i - 1][0] if i else None, role)
        now = render(messages[: i + 1])
        grows = now.startswith(before)
        if not i and not grows:
            tail = _common(before[::-1], now[::-1])
        kept = len(before) - tail
        moves = not grows and now.startswith(before[:kept]) and now.endswith(before[kept:]) and len(now) >= len(before)
        rewrites = not grows and not moves
        start = len(before) if grows else kept if moves else _common(before, now)
        opening, closing = frames.get(key, (None, None))
        fits = opening is not None and not rewrites and now.startswith(opening, start) and now.endswith(closing) and len(now) - start >= len(opening) + len(closing)
        end = len(now) - (tail if moves else 0)
        if fits:
            turns.append(Turn(start, end, start + len(opening), len(now) - len(closing), False))
        else:
            at, after = _frame(render, head, role)
            turns.append(Turn(start, end, at, max(at, len(now) - after), rewrites))
            if not rewrites and at >= start:
                frames[key] = (now[start:at], now[len(now) - after :])
        before = now
    if any(t.rewrites for t in turns):
        found: list[Turn] = []
        for i, t in enumerate(turns):
            found.append(_relocated(render, messages, before, i, t.rewrites, found[-1].end if found else 0))
        turns = found
    return before, turns


def _relocated(render: Callable[[list[Message]], str], messages: list[Message], final: str, i: int, rewrites: bool, least: int) -> Turn:
    """Where a turn stands in the last rendering: what goes when it is left out, and what changes with its text. The text is there
    whole if changes at its beginning and at its end both show, and nothing else changes with it."""
    (role, text), rest = messages[i], (messages[:i], messages[i + 1 :])
    said = lambda x: render([*rest[0], (role, x), *rest[1]])
    without = render([*rest[0], *rest[1]])
    a = _common(without, final)
    z = len(final) - _common(without[a:][::-1], final[a:][::-1])
    while a > least and a < z and final[a - 1] == final[z - 1]:  # as well there, and nearer to the turn before
        a, z = a - 1, z - 1
    while a < least and z < len(final) and final[a] == final[z]:
        a, z = a + 1, z + 1
    one, other = said("0"), said("1")
    at, after = _common(one, other), _common(one[::-1], other[::-1])
    shown = one != other and said("0" + text) != said("1" + text) and said(text + "0") != said(text + "1")
    apart = at + after <= len(final) and final[:at] == one[:at] and final.endswith(one[len(one) - after :])
    return Turn(a, z, at, len(final) - after, rewrites) if shown and apart else Turn(a, z, None, None, rewrites)


def format_conversations(
    rows: DataFrame,
    template: Callable[[list[Message]], str] | None = None,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    learn: tuple[str, ...] = ("assistant",),
) -> DataFrame:
    """One row per conversation: conv, formatted, turns (array of places), loss (array of [start, end) of the contents to be
    learnt, in code points; null if one of them isn't there whole), rewrites_history."""
    template = template or Tagged()
    place = "array<struct<role:string,start:int,end:int,content_start:int,content_end:int>>"
    schema = T.StructType([T.StructField("conv", rows.schema[conv].dataType)])
    for name, kind in (("formatted", "string"), ("turns", place), ("loss", "array<struct<start:int,end:int>>"), ("rewrites_history", "boolean")):
        schema = schema.add(name, T._parse_datatype_string(kind) if "<" in kind else kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for said in batch.column(1).to_pylist():
                messages = [(x["role"], x["text"]) for x in said]
                formatted, turns = locate(template, messages)
                out[0].append(formatted)
                out[1].append([{"role": m[0], "start": t.start, "end": t.end, "content_start": t.content_start, "content_end": t.content_end} for m, t in zip(messages, turns, strict=True)])
                learnt = [t for m, t in zip(messages, turns, strict=True) if m[0] in learn]
                lost = any(t.content_start is None for t in learnt)
                out[2].append(None if lost else [{"start": t.content_start, "end": t.content_end} for t in learnt])
                out[3].append(any(t.rewrites for t in turns))
            kinds = [pa.string(), _PLACES, _SPANS, pa.bool_()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, k) for x, k in zip(out, kinds, strict=True))], schema.names)

    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    told = rows.select(F.col(conv).alias("conv"), F.struct(F.col(turn).alias("turn"), empty(role).alias("role"), empty(text).alias("text")).alias("said"))
    told = told.groupBy("conv").agg(F.sort_array(F.collect_list("said")).alias("said"))
    return told.mapInArrow(run, schema).withColumnRenamed("conv", conv)


_PLACES = pa.list_(pa.struct([("role", pa.string()), *((n, pa.int32()) for n in ("start", "end", "content_start", "content_end"))]))
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def digests(formatted: DataFrame, template: Tagged | None = None, conv: str = "conv_id") -> DataFrame:
    """What the formatted texts say when read back: turns, and the text under the loss mask."""
    template = template or Tagged()
    schema = T.StructType([T.StructField("conv", formatted.schema[conv].dataType)])
    for name, kind in (("n_turns", "long"), ("turns_sha256", "string"), ("loss_chars", "long"), ("loss_sha256", "string"), ("formatted_chars", "long")):
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, loss in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                turns = template.read(text)
                learnt = template.unescape("".join(text[x["start"] : x["end"]] for x in loss or ()))
                said = "".join(f"{r}\n{t}\n" for r, t in turns)
                rows.append((len(turns), hashlib.sha256(said.encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest(), len(text)))
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x) for x in zip(*rows, strict=True))], schema.names)

    return formatted.select(F.col(conv).alias("conv"), "formatted", "loss").mapInArrow(run, schema).withColumnRenamed("conv", conv)
