r"""Chat formatting from an event log.

A conversation is a log of events ``(conv_id, seq, turn, kind, role, text)``: ``start`` opens a turn,
``delta`` appends to it, ``edit`` replaces its text and drops the turns after it, ``regenerate`` empties an
assistant turn, the latest one if it names no other, for new deltas. Events are dealt out by conversation, sorted by sequence and folded into
final messages in one pass; a conversation's messages are held, its events aren't.

A turn is rendered as ``### Role: text </turn>`` and a newline. A text's own control strings are told apart by
a backslash: ``\`` becomes ``\\``, ``###`` becomes ``\###`` and ``</turn>`` becomes ``\</turn>``, so
:func:`parse` gives back every text, whatever it holds.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import arrow
from .scratch import tasks

CONTROL = re.compile(r"\\|###|</turn>")
ESCAPED = re.compile(r"\\(\\|###|</turn>)")
#: A mark of a turn that no backslash stands before: texts have none, once escaped.
TURN = re.compile(r"### (?P<role>[^:\n]*): (?P<text>(?:[^\\#<]++|\\(?:\\|###|</turn>)|#(?!##)|<(?!/turn>))*+)</turn>\n", re.S)
TRAINED = "assistant"
FORMATTED = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("formatted", pa.string()), ("loss_spans", pa.list_(pa.int64()))])
DIGESTS = pa.schema([(n, pa.string() if n.endswith("sha256") else pa.int64()) for n in ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")])


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def role_name(role: str | None) -> str:
    """Roles are written with a capital; characters that would end the name are percent-encoded."""
    r = re.sub(r"[%:\n\\#<]", lambda m: f"%{ord(m[0]):02x}", role or "")
    return f"%{r}" if r != r.lower() or r[:1].upper().lower() != r[:1] else r[:1].upper() + r[1:]


def role_of(name: str) -> str:
    r = name[1:] if name[:1] == "%" and not re.match(r"%[0-9a-f]{2}", name) else name[:1].lower() + name[1:]
    return re.sub(r"%([0-9a-f]{2})", lambda m: chr(int(m[1], 16)), r)


def render(messages: Iterable[tuple[str, str]]) -> tuple[str, list[int]]:
    """The text of a conversation and, flat, the code-point spans of assistant texts in it."""
    out, at, spans = [], 0, []
    for role, text in messages:
        head, body = f"### {role_name(role)}: ", escape(text)
        if role == TRAINED:
            spans += [at + len(head), at + len(head) + len(body)]
        out.append(f"{head}{body} </turn>\n")
        at += len(out[-1])
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The ``(role, text)`` of each turn; the inverse of :func:`render`."""
    out, at = [], 0
    while at < len(formatted):
        m = TURN.match(formatted, at)
        if not m or m["text"][-1:] != " ":
            raise ValueError(f"no turn at {at}")
        out.append((role_of(m["role"]), unescape(m["text"][:-1])))
        at = m.end()
    return out


def fold(events: Iterable[tuple[int | None, str | None, str | None, str | None]]) -> list[tuple[str, str]]:
    """Final ``(role, text)`` messages of events ``(turn, kind, role, text)`` in sequence order.

    Turns stand in the order in which they were opened. ``start`` always opens one, and later events with its number
    are about it. A delta or edit without a number is about the turn of the event before it, a regenerate without one,
    or with that of a turn that isn't the assistant's, about the latest assistant turn. An event that finds no turn
    opens one. A null text is empty, a null kind a delta.
    """
    roles: list[str] = []
    texts: list[list[str]] = []
    place: dict[int, int] = {}
    now = -1
    for turn, kind, role, text in events:
        at = -1 if kind == "start" else now if turn is None else place.get(turn, -1)
        if kind == "regenerate" and (turn is None or at >= 0 and roles[at] != TRAINED):
            at = max((i for i, r in enumerate(roles) if r == TRAINED), default=-1)
        if at < 0:
            at = len(roles)
            roles.append(role or (TRAINED if kind == "regenerate" else ""))
            texts.append([])
            if turn is not None:
                place[turn] = at
        elif kind in ("edit", "regenerate"):
            roles[at], texts[at] = role or roles[at], []
        if kind == "edit":
            del roles[at + 1 :], texts[at + 1 :]
            place = {t: i for t, i in place.items() if i <= at}
        texts[at].append(text or "")
        now = at
    return [(role, "".join(parts)) for role, parts in zip(roles, texts, strict=True)]


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows, size = [], 0
    for (conv,), events in _streams(batches):
        messages = fold(events)
        formatted, spans = render(messages)
        rows.append((conv, len(messages), formatted, spans))
        size += len(formatted)
        if size > 4_000_000:
            yield arrow.batch(FORMATTED, rows)
            rows, size = [], 0
    yield arrow.batch(FORMATTED, rows)


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, Iterable[tuple]]]:
    """(conversation, events) with events read as they come."""
    from itertools import groupby

    flat = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
    for conv, rows in groupby(flat, lambda r: r[0]):
        yield (conv,), (r[1:] for r in rows)


def format_events(events: DataFrame) -> DataFrame:
    """One row a conversation of ``events(conv_id, seq, turn, kind, role, text)``.

    Returns ``conv_id, n_turns, formatted, loss_spans``: loss_spans has start and end of each assistant text in
    formatted, by code points. Defined cases: events with equal seq go by turn, kind, role and text, nulls first; a
    null conv_id is a conversation; what an event without a turn is about says :func:`fold`; a null or empty text is an
    empty one; an empty table gives no rows; further columns are ignored.
    """
    e = events.select("conv_id", "seq", F.col("turn").cast("long").alias("turn"), "kind", "role", "text")
    e = e.repartition(tasks(events.sparkSession), "conv_id").sortWithinPartitions("conv_id", "seq", "turn", "kind", "role", "text")
    return e.select(F.col("conv_id").cast("long"), "turn", "kind", "role", "text").mapInArrow(arrow.tidy(_format), "conv_id long, n_turns long, formatted string, loss_spans array<long>")


def as_events(conversations: DataFrame) -> DataFrame:
    """The log that a chat client would leave of rows ``(conv_id, turn, role, text)``, in the order of turn, role and text.

    An assistant's turn is opened, streams a draft, is regenerated, and streams its text in two deltas; any other turn
    is opened with a draft and edited into its text. Each row is a turn of its own, those that repeat a turn too.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select("conv_id", (F.row_number().over(order) - 1).cast("long").alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text"))
    half = F.floor(F.length("text") / 2).cast("int")
    draft = F.concat(F.reverse("text"), F.lit(" draft </turn>"))
    event = lambda kind, role, text: F.struct(F.lit(kind).alias("kind"), role.cast("string").alias("role"), text.cast("string").alias("text"))
    none = F.lit(None)
    streamed = F.array(
        event("start", F.col("role"), F.lit("")), event("delta", none, draft), event("regenerate", none, none),
        event("delta", none, F.left(F.col("text"), half)), event("delta", none, F.substring(F.col("text"), half + 1, F.length("text"))),
    )
    edited = F.array(event("start", F.col("role"), draft), event("edit", none, F.col("text")))
    log = rows.select("conv_id", "turn", F.posexplode(F.when(F.col("role") == TRAINED, streamed).otherwise(edited)).alias("step", "e"))
    # streamed events name no turn but the first: they are about the one before
    return log.select("conv_id", (F.col("turn") * 8 + F.col("step")).alias("seq"), F.when(F.col("step") == 0, F.col("turn")).alias("turn"), "e.kind", "e.role", "e.text")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for conv, formatted, spans in zip(*(c.to_pylist() for c in b.columns), strict=True):
            turns, digest = parse(formatted), hashlib.sha256()
            for role, text in turns:
                digest.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            loss, chars = hashlib.sha256(), 0
            for i in range(0, len(spans), 2):
                part = unescape(formatted[spans[i] : spans[i + 1]])
                chars += len(part)
                loss.update(part.encode("utf-8", "surrogatepass"))
            rows.append((conv, len(turns), digest.hexdigest(), chars, loss.hexdigest(), len(formatted)))
        yield arrow.batch(DIGESTS, rows)


def digests(formatted: DataFrame) -> DataFrame:
    """What a reader gets back from formatted conversations, as counts and hashes."""
    return formatted.select("conv_id", "formatted", "loss_spans").mapInArrow(arrow.tidy(_digest), arrow.ddl(DIGESTS))
