"""Substring dedup by hashing lines, paragraphs, or runs of the sentences of lines.

Units are hashed where the text is read; only ``(document, unit, last unit, digest)`` moves. Earliest occurrences come
from a pre-aggregated minimum per digest, so a line that half the corpus shares costs one row per task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrow
from .scratch import Scratch

#: Separators of the unit kinds, as patterns.
SEPARATORS = {"line": r"\n", "paragraph": r"\n[^\S\n]*(?:\n[^\S\n]*)+"}
SPACE = re.compile(r"[\x20\x09-\x0D]+")
#: Words, a letter of a script without blanks (Thai to Khmer, kana, Han) counting as one.
UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
WORDS = re.compile(f"[{UNSPACED}]|[^ {UNSPACED}]+")
#: Sentence ends before a blank; sentence ends of other scripts, with or without one; what closes around them; line ends.
STOPS, WIDE, CLOSE, LINES = r".!?\u2026\u203c\u2047-\u2049", r"\u3002\uff01\uff0e\uff1f\uff61\u061f\u06d4\u0964\u0965\u0589\u1362\u1367\u104a\u104b\u17d4", r"\"')\]}\u2019\u201d\u00bb\u203a\u300d\u300f\u3011\uff09", r"\n\r\x85\u2028\u2029"
BREAK = re.compile(f"[{LINES}]")
#: Ends of the units of passages; the group that matched, or else the place after the match, is the separator.
ENDS = re.compile(
    rf"[{STOPS}{WIDE}{LINES}](?:(?<=[{LINES}])(?:(?<=\r)\n)?|(?<=[{STOPS}])[{STOPS}{CLOSE}]*+([ \t\u3000]+)|(?<=[{WIDE}])[{STOPS}{WIDE}{CLOSE}]*+(?:([ \t\u3000]+)|(?=\S)))"
)
UNITS = pa.schema([("doc_id", pa.int64()), ("version", pa.int64()), ("unit", pa.int32()), ("last", pa.int32()), ("hi", pa.int64()), ("lo", pa.int64())])


def normal(unit: str) -> str:
    """Lower case, white space runs as one blank, none at the ends."""
    return SPACE.sub(" ", unit).strip(" ").lower()


def split_units(text: str, kind: str) -> list[tuple[int, int]]:
    """Code-point spans of the units of a text, separators left out."""
    at, spans = 0, []
    if kind == "passage":
        for m in ENDS.finditer(text):
            start, end = m.span(m.lastindex) if m.lastindex else m.span() if BREAK.match(m[0]) else (m.end(), m.end())
            spans.append((at, start))
            at = end
        return [*spans, (at, len(text))]
    for m in re.finditer(SEPARATORS[kind], text):
        spans.append((at, m.start()))
        at = m.end()
    return [*spans, (at, len(text))]


def words(unit: str) -> int:
    return unit.count(" ") + 1 if unit.isascii() else len(WORDS.findall(unit))


def runs(text: str, spans: list[tuple[int, int]], min_words: int) -> dict[tuple[int, int], str]:
    """What is compared of a text in passages: ``(first unit, last unit)`` and the words, as :func:`normal` has them.

    From each sentence on, and up to each sentence, the shortest run of ``min_words`` words, so that the sentences of
    any passage of so many words are covered by runs inside it; and whole lines of fewer words.
    """
    said = [(n, normal(text[a:b])) for n, (a, b) in enumerate(spans)]
    said = [(n, u, words(u)) for n, u in said if u]
    out: dict[tuple[int, int], str] = {}
    for i, (n, u, size) in enumerate(said):
        if size >= min_words:
            out[n, n] = u
            continue
        for step in (1, -1):
            j, total = i, size
            while total < min_words and 0 <= j + step < len(said):
                j += step
                total += said[j][2]
            if total >= min_words:
                a, b = min(i, j), max(i, j)
                out[said[a][0], said[b][0]] = " ".join(x[1] for x in said[a : b + 1])
    start = 0
    while start < len(said):  # lines
        end, total = start, said[start][2]
        while end + 1 < len(said) and not BREAK.search(text, spans[said[end][0]][1], spans[said[end + 1][0]][0]):
            end += 1
            total += said[end][2]
        if total < min_words:
            out[said[start][0], said[end][0]] = " ".join(x[1] for x in said[start : end + 1])
        start = end + 1
    return out


def _units(kind: str, min_words: int):
    signed = lambda x: x - (1 << 64) if x >> 63 else x

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow.slices(batches):
            rows: list[tuple] = []
            for doc, version, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                spans = split_units(text, kind)
                if kind == "passage":
                    compared = runs(text, spans, min_words)
                else:
                    compared = {(n, n): u for n, (a, b) in enumerate(spans) if (u := normal(text[a:b]))}
                for (n, last), unit in compared.items():
                    digest = xxhash.xxh3_128_intdigest(unit.encode("utf-8", "surrogatepass"))
                    rows.append((doc, version, n, last, signed(digest >> 64), signed(digest & (1 << 64) - 1)))
            yield arrow.batch(UNITS, rows)

    return run


def with_blank_ones(text: str, spans: list[tuple[int, int]], gone: list[int]) -> set[int]:
    """Removed units, and units without a word that nothing but removed ones stands around: they are all separator."""
    drop, blank, after_gone = set(gone), [], False
    for n, (a, b) in enumerate(spans):
        if n in drop:
            if after_gone:
                drop.update(blank)
            blank, after_gone = [], True
        elif after_gone and not normal(text[a:b]):
            blank.append(n)
        else:
            blank, after_gone = [], False
    return drop


def _cut(kind: str):
    schema = pa.schema([("doc_id", pa.int64()), ("n_units", pa.int64()), ("n_removed", pa.int64()), ("removed_spans", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow.slices(batches):
            rows = []
            for doc, text, gone in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if text is None:
                    rows.append((doc, 0, 0, "", None))
                    continue
                spans = split_units(text, kind)
                if not gone:
                    rows.append((doc, len(spans), 0, "", text))
                    continue
                out, drop = [], with_blank_ones(text, spans, gone)
                for n, (a, b) in enumerate(spans):
                    if n not in drop:  # a unit keeps the separator behind it
                        out.append(text[a : spans[n + 1][0] if n + 1 < len(spans) else b])
                left = "".join(out)
                if len(spans) - 1 in drop and out:  # the last unit went: so does the separator before it
                    last = max(set(range(len(spans))) - drop)
                    left = left[: len(left) - (spans[last + 1][0] - spans[last][1])]
                rows.append((doc, len(spans), len(drop), ",".join(f"{spans[n][0]}:{spans[n][1]}" for n in sorted(drop)), left))
            yield arrow.batch(schema, rows)

    return run, arrow.ddl(schema)


def dedup_units(docs: DataFrame, *, kind: str = "line", min_words: int = 5) -> DataFrame:
    """Each document of ``docs(doc_id, text)`` without the units that occur earlier in the corpus.

    A unit is a line or a paragraph, and every one that has a word is compared. ``passage`` finds what repeats inside
    lines: its units are the sentences of lines, which end at sentence marks, with what closes behind them, before a
    blank, and at marks of other scripts. What is compared there are the shortest runs of ``min_words`` words or more
    from each sentence on and up to each sentence, so that a short sentence goes with what stands around it, and whole
    lines of fewer words; a letter of a script without blanks is a word. Two are the same if they agree in lower case
    with white space runs as one blank. Of equal ones the earliest stays, by doc_id (null last), then by the hash of the
    text, then by place in the text. Nothing goes that isn't said earlier, but units without a word between removed ones.

    Returns ``doc_id, n_units, n_removed, removed_spans, text``: n_units counts all units and n_removed those that went,
    blank ones included; removed_spans has the code-point offsets in the original text as ``start:end``, comma-joined;
    text is what is left, or null for a null text. Defined cases: an empty text is one empty unit and stays; rows that
    repeat doc_id and text are one document and lose the same units; an empty table gives no rows; further columns are
    ignored.
    """
    scratch = Scratch(docs.sparkSession, "substring-dedup")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    named = docs.withColumn("version", F.xxhash64("text"))
    units = named.where("text is not null").select("doc_id", "version", "text").mapInArrow(arrow.tidy(_units(kind, min_words)), arrow.ddl(UNITS))
    units = scratch.save(units, "units")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "version", "unit")
    heads = units.groupBy("hi", "lo").agg(F.min(rank).alias("head"), F.count("*").alias("n")).where("n > 1").select("hi", "lo", "head")
    heads = scratch.save(heads, "heads")  # the join below then deals both sides anew, and Spark can split a digest that many units share
    same = F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("version") == F.col("head.version")) & (F.col("unit") == F.col("head.unit"))
    gone = units.join(heads, ["hi", "lo"]).where(~same)
    if kind == "passage":
        gone = gone.withColumn("unit", F.explode(F.sequence("unit", "last")))
    gone = gone.groupBy("doc_id", "version").agg(F.sort_array(F.collect_set("unit")).alias("gone")).alias("g")
    n = named.alias("n")
    out = n.join(gone, F.col("n.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col("n.version") == F.col("g.version")), "left")
    run, schema = _cut(kind)
    return out.select("n.doc_id", "text", "gone").mapInArrow(arrow.tidy(run), schema)
