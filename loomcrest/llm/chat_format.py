"""Chat formatting by incremental black-box rendering.

A template is a function from a list of (role, text) turns to a string; nothing else is known of it. Rendering the
successive prefixes of a conversation and comparing consecutive outputs gives each turn's span; two probe texts in
the turn's place give the text's span inside it; an output that does not begin with the one before it shows a
template that rewrites history: spans then move to where the new output has their turns, and segments are cut from the
last output of all, so that joined they are the template's output for the whole conversation.

Conversations stream through sorted partitions in segments of `segment` turns. While the turns so far have at most
`history` code points (a turn counts 256 besides its own), each is rendered behind all turns before it. Beyond that a segment is rendered behind the `context`
turns before it, and must come out as behind a longer history (the conversation's first turns and as many of the last as
`history` holds); a template for which it does not, or one that rewrites history, is refused with an error there. So memory
is bounded however long a conversation is. Tokens and characters are counted in code points.

Defined results: null texts and roles are empty strings; turns of equal number go by role, then text; null turns
first; rows of null conv_id form one conversation, which is one task's stream as any other is; repeated rows are turns
of their own; a very long text is one turn and must fit in a task; conversation ids are read as long; other columns are
not looked at, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]
_ESCAPE = re.compile(r"[\\#<:]")
#: The text's group takes the blank before the turn's end as well.
_TURN = re.compile(r"### ((?:\\.|[^\\#<:])*+): ((?:\\.|[^\\#<:])*+)(?<= )</turn>\n", re.S)
_UNESCAPE = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    r"""Puts a backslash before \, #, < and :, so no control string survives inside a text."""
    return _ESCAPE.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def render(turns: list[Turn]) -> str:
    """The engine's own template: '### role: text </turn>' lines, texts and roles escaped."""
    return "".join(f"### {escape(r)}: {escape(t)} </turn>\n" for r, t in turns)


def parse(formatted: str) -> list[Turn]:
    """The turns of render()'s output; raises on anything else."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"not a turn at {at}")
        out.append((unescape(m[1]), unescape(m[2][:-1])))
        at = m.end()
    return out


def common_prefix(a: str, b: str) -> int:
    """Code points that a and b share at their beginning, by bisection on slices."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


def _probe(template: Callable[[list[Turn]], str], turns: list[Turn], k: int, now: str) -> tuple[int, int]:
    """Where turn k's text stands in now = template(turns): what two probe texts in its place leave alike, before and behind."""
    probes = [template([*turns[:k], (turns[k][0], p), *turns[k + 1 :]]) for p in ("ax", "by")]
    head = common_prefix(*probes)
    tail = common_prefix(*(p[::-1] for p in probes))
    end = max(len(now) - tail, head)
    return min(head, end), end


def locate(template: Callable[[list[Turn]], str], turns: list[Turn], context: int = 0) -> tuple[str, list[tuple[int, int, int, int]], list[int]]:
    """Renders the prefixes of turns; the first `context` turns are history already formatted.

    Returns the output behind that history, (start, end, text_start, text_end) of every new turn in it, and the
    numbers of new turns at which earlier output changed. With a history, nothing is said about spans behind such a turn;
    without one, spans are those of the last output.
    """
    grown = _Grown(template, turns[:context])
    base = len(grown.done)
    for turn in turns[context:]:
        grown.add(*turn)
    return grown.done[base:], [tuple(x - base for x in s) for s in grown.spans], grown.rewrites


class _Grown:
    """A conversation's output so far and the spans of its turns in it, kept right when the template rewrites history.

    A turn's span reaches from the end of the one before it, so spans have no gaps. After a rewrite each earlier turn is
    looked for from the end of the new output on, as it was; one that is not there as it was is probed in the new output.
    """

    def __init__(self, template: Callable[[list[Turn]], str], known: list[Turn] = ()):
        self.template, self.turns, self.known = template, list(known), len(known)
        self.done = template(self.turns) if known else ""
        self.spans: list[tuple[int, int, int, int]] = []
        self.rewrites: list[int] = []

    def add(self, role: str, text: str) -> None:
        self.turns.append((role, text))
        last = len(self.turns) - 1
        now = self.template(self.turns)
        text_start, text_end = _probe(self.template, self.turns, last, now)
        if now.startswith(self.done):
            start = len(self.done)
        else:
            self.rewrites.append(last - self.known)
            start = min(common_prefix(self.done, now), text_start) if self.known else self._moved(now, text_start)
        self.spans.append((start, len(now), max(text_start, start), max(text_end, start)))
        self.done = now

    def _moved(self, now: str, limit: int) -> int:
        """Finds the earlier turns' spans in a rewritten output whose last text begins at limit; returns where the last turn begins."""
        old, new, found = self.spans, [], None
        for k in range(len(old) - 1, -1, -1):
            a, b, c, d = old[k]
            body = self.done[a:b]
            at = now.rfind(body, 0, limit)
            if at >= 0 and (found is None or at + len(body) == limit):
                found = at + len(body) if found is None else found
                new.append((at, at + len(body), at + c - a, at + d - a))
            else:
                c2, d2 = _probe(self.template, self.turns, k, now)
                tail = 0 if found is None else limit - d2
                d2 = min(d2, limit)
                new.append((0, min(d2 + max(tail, 0), limit) if found is not None else min(d2 + b - d, limit), min(c2, d2), d2))
                found = new[-1][1] if found is None else found
                at = min(c2, d2) - (c - a)
            limit = max(at, 0)
        new.reverse()
        end = 0
        for k, (_, b, c, d) in enumerate(new):
            b = max(b, end)
            new[k] = (end, b, min(max(c, end), b), min(max(d, end), b))
            end = b
        self.spans = new
        return end if new else 0


#: What a turn counts towards `history` besides its code points.
_TURN_COST = 256


def _cost(turn: Turn) -> int:
    return _TURN_COST + sum(map(len, turn))


SEGMENT_SCHEMA = "conv_id long, segment long, formatted string, spans array<struct<role:string,start:int,end:int,text_start:int,text_end:int,loss:boolean>>, rewrites array<int>"


def _segments(rows: Iterable[tuple], template, size: int, context: int, loss_roles: frozenset[str], history: int) -> Iterator[tuple]:
    """rows: (conv_id, role, text), sorted. Yields rows of SEGMENT_SCHEMA."""
    conv, number, past, new, held, grown = object(), 0, [], [], 0, None

    def row(number: int, turns: list[Turn], out: str, spans: list, rewrites: list[int]) -> tuple:
        base = spans[0][0]
        return conv, number, out, [{"role": r, "start": a - base, "end": b - base, "text_start": c - base, "text_end": d - base, "loss": r in loss_roles} for (r, _), (a, b, c, d) in zip(turns, spans, strict=True)], rewrites

    def settled() -> Iterator[tuple]:
        """The segments of what was rendered behind the whole conversation."""
        for k in range(0, len(grown.turns), size):
            spans = grown.spans[k : k + size]
            yield row(k // size, grown.turns[k : k + size], grown.done[spans[0][0] : spans[-1][1]], spans, [r - k for r in grown.rewrites if k <= r < k + size])

    def beyond() -> tuple:
        """A segment behind a part of the conversation."""
        kept = past[-context:] if context else []
        out, spans, rewrites = locate(template, [*kept, *new], len(kept))
        if rewrites:
            raise ValueError(f"conversation {conv}, turn {number * size + rewrites[0]}: the template rewrites history, and the conversation is longer than the history of {history}")
        if template([*past, *new]) != template(past) + out:
            raise ValueError(f"conversation {conv}, segment {number}: the template looks further back than {context} turns, and the conversation is longer than the history of {history}")
        return row(number, new, out, spans, rewrites)

    def flush() -> Iterator[tuple]:
        nonlocal grown
        if held <= history and grown is not None:
            for turn in new:
                grown.add(*turn)
            return
        if grown is not None:
            if grown.rewrites:
                raise ValueError(f"conversation {conv}, turn {grown.rewrites[0]}: the template rewrites history, and the conversation is longer than the history of {history}")
            yield from settled()
            grown = None
        yield beyond()

    for cid, role, text in rows:
        if cid != conv or len(new) == size:
            if new:
                yield from flush()
            if cid != conv:
                if grown is not None:
                    yield from settled()
                number, past, held, grown = 0, [], 0, _Grown(template)
            else:
                number, past = number + 1, [*past, *new]
            conv, new = cid, []
            while held > history and len(past) > 2 * max(context, 1):  # the first turns stay, as a system turn may be there
                held -= _cost(past.pop(max(context, 1)))
        new.append((role or "", text or ""))
        held += _cost(new[-1])
    if new:
        yield from flush()
        if grown is not None:
            yield from settled()


def format_conversations(turns: DataFrame, template: Callable[[list[Turn]], str] = render, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", loss_roles: tuple[str, ...] = ("assistant",), segment: int = 16, context: int = 2, history: int = 1 << 18) -> DataFrame:
    """Rows of SEGMENT_SCHEMA: the formatted text of each conversation, cut into segments, with the spans of turns and texts.

    Offsets count code points from the segment's begin; `loss` marks turns whose text is under the loss mask.
    """
    loss = frozenset(loss_roles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True))
        names = ["conv_id", "segment", "formatted", "spans", "rewrites"]
        span = pa.struct([("role", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("text_start", pa.int32()), ("text_end", pa.int32()), ("loss", pa.bool_())])
        types = [pa.int64(), pa.int64(), pa.string(), pa.list_(span), pa.list_(pa.int32())]
        out: list[tuple] = []
        held = 0
        for r in _segments(rows, template, segment, context, loss, history):
            out.append(r)
            held += len(r[2])
            if held > 1 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
                out, held = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    rows = turns.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return rows.mapInArrow(run, SEGMENT_SCHEMA)


def digest(segments: DataFrame) -> DataFrame:
    """Per conversation, what its formatted text says when read back: turns, their hash, the text under the loss mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, out = object(), []
        for b in batches:
            for cid, formatted, spans in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if cid != conv:
                    conv = cid
                    out.append([cid, 0, hashlib.sha256(), 0, hashlib.sha256(), 0])
                row = out[-1]
                for role, text in parse(formatted):
                    row[1] += 1
                    row[2].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                for s in spans:
                    if s["loss"]:
                        said = unescape(formatted[s["text_start"] : s["text_end"]])
                        row[3] += len(said)
                        row[4].update(said.encode("utf-8", "surrogatepass"))
                row[5] += len(formatted)
        cols = list(zip(*out, strict=True)) or [()] * 6
        for i in (2, 4):
            cols[i] = [h.hexdigest() for h in cols[i]]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i in (2, 4) else pa.int64()) for i, c in enumerate(cols)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    rows = segments.repartition("conv_id").sortWithinPartitions("conv_id", "segment").select("conv_id", "formatted", "spans")
    return rows.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op6_chat_format(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    text = r"\### Assistant: </turn> ok"
    own = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    return digest(format_conversations(rows.unionByName(own)))
