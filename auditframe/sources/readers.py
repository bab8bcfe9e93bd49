"""Readers of messy files into an audited table: a row number, string columns, and what ragged rows hold beyond the header.

Lines are split where they are read; only the header, ten lines for the delimiter and a count reach the driver.
"""

from __future__ import annotations

import csv
import json
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DELIMITERS = (",", "\t", ";", "|")
#: Bytes that the encoding is told from, and characters of a JSON array that is read as one document.
HEAD, JSON_LIMIT = 1 << 20, 200_000_000


class IngestError(ValueError):
    """A file that can't be read as a table."""


def file_format(path: str) -> str:
    """By the ending alone: json, excel, parquet, or delimited."""
    end = os.path.splitext(path.rstrip("/"))[1].lower()
    return {".json": "json", ".xlsx": "excel", ".xls": "excel", ".parquet": "parquet"}.get(end, "delimited")


def encoding_of(head: bytes) -> str:
    """UTF-8 if the bytes are that and hold no NUL, else the best guess."""
    try:
        head.decode("utf-8") if len(head) < HEAD else head[: -4].decode("utf-8", "ignore")
        if b"\x00" not in head and (len(head) < HEAD or "�" not in head.decode("utf-8", "replace")[:-4]):
            return "utf-8"
    except UnicodeDecodeError:
        pass
    from charset_normalizer import from_bytes

    best = from_bytes(head).best()
    if best is None:
        raise IngestError("not a text file")
    return best.encoding


def delimiter_of(lines: list[str]) -> str:
    """The one that the most lines have as often as the first, times how often."""
    def rank(d: str) -> int:
        n = lines[0].count(d)
        return n * sum(line.count(d) == n for line in lines)

    return max(DELIMITERS, key=lambda d: (rank(d), -DELIMITERS.index(d))) if lines else ","


def split_line(line: str, delimiter: str) -> list[str]:
    return next(csv.reader([line], delimiter=delimiter), [])


def join_line(fields: list[str], delimiter: str = ",") -> str:
    import io

    out = io.StringIO()
    csv.writer(out, delimiter=delimiter, lineterminator="").writerow(fields)
    return out.getvalue()


def check_header(header: list[str]) -> None:
    twice = sorted({h for h in header if header.count(h) > 1})
    if twice:
        raise IngestError(f"columns that repeat: {', '.join(twice)}")


def deduplicate_header(header: list[str]) -> list[str]:
    """``name``, ``name_2``, ``name_3``, past names that are taken."""
    seen: set[str] = set()
    out = []
    for h in header:
        name, n = h, 1
        while name in seen or (n > 1 and name in header):
            n += 1
            name = f"{h}_{n}"
        seen.add(name)
        out.append(name)
    return out


def _split(delimiter: str):
    schema = pa.schema([("line", pa.int64()), ("fields", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fields = [split_line(t, delimiter) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fields, pa.list_(pa.string()))], schema=schema)

    return run, "line long, fields array<string>"


def numbered_lines(spark: SparkSession, path: str, encoding: str = "utf-8") -> DataFrame:
    """``(line, value)`` of lines that aren't blank, numbered in file order.

    Lines are numbered by partition and place in it: sizes of partitions are added up on the driver, and no
    line moves. A reader of another encoding takes the file as one document.
    """
    if encoding.lower().replace("-", "") not in ("utf8", "ascii"):
        def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for content in b.column(0).to_pylist():
                    lines = [(i, t) for i, t in enumerate(content.decode(encoding, "replace").splitlines()) if t.strip()]
                    yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in lines], pa.int64()), pa.array([t for _, t in lines], pa.string())], names=["line", "value"])

        return spark.read.format("binaryFile").load(path).select("content").mapInArrow(decode, "line long, value string")
    lines = spark.read.text(path).withColumn("at", F.monotonically_increasing_id())
    part = F.shiftright("at", 33)
    sizes = {r.p: r.n for r in lines.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    before, upto = {}, 0
    for p in sorted(sizes):
        before[p] = upto
        upto += sizes[p]
    start = F.create_map(*(F.lit(x) for kv in before.items() for x in kv)) if before else F.lit(None)
    at = start[part] + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) if before else F.col("at")
    lines = lines.select(at.cast("long").alias("line"), F.regexp_replace("value", "^﻿", "").alias("value"))
    return lines.where(~F.col("value").rlike(r"(?U)\A\s*\z"))


def read_delimited(spark: SparkSession, path: str, *, encoding: str | None = None, suffix_duplicates: bool = False, keep_footer: bool = False) -> DataFrame:
    """``_rid``, the header's columns and ``_overflow``: short rows are filled, more fields are joined with `` | ``.

    Physical lines are rows. A footer is the tail from the first two lines in a row with a field count that isn't
    the header's, if every line from there on has one; it is left out. If a good line follows, nothing is.
    """
    if encoding is None:
        head = spark.read.format("binaryFile").load(path).select(F.expr(f"substring(content, 1, {HEAD})").alias("h")).first()
        if head is None:
            raise IngestError("no such file")
        encoding = encoding_of(bytes(head.h))
    lines = numbered_lines(spark, path, encoding)
    first = [r.value for r in lines.orderBy("line").limit(10).collect()]
    if not first:
        raise IngestError("an empty file")
    delimiter = delimiter_of(first)
    header = split_line(first[0], delimiter)
    if suffix_duplicates:
        header = deduplicate_header(header)
    check_header(header)
    run, schema = _split(delimiter)
    rows = lines.mapInArrow(run, schema)
    top = lines.agg(F.min("line")).first()[0]
    rows = rows.where(F.col("line") > top)
    if not keep_footer:
        end = footer_start(rows, len(header))
        rows = rows.where(F.col("line") < end) if end is not None else rows
    rank = F.col("line") - top - 1
    n = len(header)
    cells = [F.coalesce(F.get("fields", F.lit(i)), F.lit("")).alias(h or f"column_{i + 1}") for i, h in enumerate(header)]
    over = F.when(F.size("fields") > n, F.concat_ws(" | ", F.slice("fields", n + 1, F.greatest(F.size("fields") - n, F.lit(1))))).otherwise("")
    return rows.select(rank.alias("_rid"), *cells, over.alias("_overflow"))


def stripped_footer_lines(spark: SparkSession, path: str, **options) -> int:
    """How many lines :func:`read_delimited` leaves out as a footer."""
    if file_format(path) != "delimited":
        return 0
    return read_delimited(spark, path, **{**options, "keep_footer": True}).count() - read_delimited(spark, path, **options).count()


def footer_start(rows: DataFrame, width: int) -> int | None:
    """Where a footer starts: the first two lines in a row of another width, if no line of the right width follows.

    Behind the last good line there are only others, so the first such pair starts a footer just if none stands before
    that line. Lines are compared with the next one by a window over ranges of line numbers, each with a line more.
    """
    odd = rows.select("line", (F.size("fields") == width).alias("fits"))
    last = odd.agg(F.max(F.when(F.col("fits"), F.col("line")))).first()[0]
    tail = odd.where(F.col("line") > (-1 if last is None else last)).agg(F.count("*"), F.min("line")).first()
    if tail[0] < 2:
        return None
    return tail[1] if last is None or not pair_before(odd, last) else None


def pair_before(odd: DataFrame, last: int, span: int = 1 << 20) -> bool:
    """Whether two neighbouring lines before line ``last``, blank ones aside, both don't fit."""
    part = F.floor(F.col("line") / span)
    ranged = odd.where(F.col("line") < last).withColumn("part", part)
    inside = ranged.withColumn("was", F.lag("fits").over(Window.partitionBy("part").orderBy("line")))
    if inside.where("not fits and not was").limit(1).count():
        return True
    # neighbours on both sides of a border between ranges: one row a range
    ends = ranged.groupBy("part").agg(F.min_by("fits", "line").alias("first"), F.max_by("fits", "line").alias("last")).orderBy("part").collect()
    return any(not a.last and not b.first for a, b in zip(ends, ends[1:], strict=False))


def stringify_value(v) -> str:
    """A JSON value as a cell."""
    if v is None:
        return ""
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, (dict, list)):
        raise IngestError("a nested value")
    if isinstance(v, float) and v.is_integer():
        return str(int(v))
    return str(v)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """An array of flat objects; columns in the order in which keys are first seen, missing ones empty."""
    row = spark.read.format("binaryFile").load(path).where(F.col("length") <= JSON_LIMIT).select("content").first()
    if row is None:
        raise IngestError("no such file, or one too large for a JSON array; write one object a line as Parquet")
    try:
        said = json.loads(bytes(row.content).decode("utf-8-sig"))
    except ValueError as e:
        raise IngestError(f"not JSON: {e}") from e
    if not isinstance(said, list) or not all(isinstance(x, dict) for x in said):
        raise IngestError("not an array of objects")
    header = list(dict.fromkeys(k for x in said for k in x))
    rows = [(i, *(stringify_value(x.get(h)) for h in header)) for i, x in enumerate(said)]
    return spark.createDataFrame(rows, ", ".join(["_rid long", *(f"`{h}` string" for h in header)]))


def read_excel(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """One sheet; which one must be said if there are several. Needs openpyxl."""
    try:
        import openpyxl
    except ImportError as e:
        raise IngestError("reading workbooks needs openpyxl") from e
    book = openpyxl.load_workbook(path, read_only=True, data_only=True)
    if sheet is None and len(book.sheetnames) > 1:
        raise IngestError(f"one of the sheets {', '.join(book.sheetnames)} has to be named")
    rows = [r for r in book[sheet or book.sheetnames[0]].iter_rows(values_only=True) if any(c is not None for c in r)]
    header = [stringify_value(c) for c in rows[0]] if rows else []
    check_header(header)
    body = [(i, *(stringify_value(c.isoformat() if hasattr(c, "isoformat") else c) for c in r[: len(header)])) for i, r in enumerate(rows[1:])]
    return spark.createDataFrame(body, ", ".join(["_rid long", *(f"`{h}` string" for h in header)]))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Typed columns, numbered in file order."""
    df = spark.read.parquet(path)
    files = {r.f: r.n for r in df.groupBy(F.col("_metadata.file_path").alias("f")).agg(F.count("*").alias("n")).collect()}
    start, upto = {}, 0
    for name in sorted(files):
        start[name] = upto
        upto += files[name]
    at = F.create_map(*(F.lit(x) for kv in start.items() for x in kv))[F.col("_metadata.file_path")] if start else F.lit(0)
    return df.select((at + F.col("_metadata.row_index")).alias("_rid"), *df.columns)


def read_table(spark: SparkSession, path: str, **options) -> DataFrame:
    read = {"json": read_json, "excel": read_excel, "parquet": read_parquet, "delimited": read_delimited}[file_format(path)]
    return read(spark, path, **options)


def read_codebook(data: bytes) -> dict[str, dict[str, str]]:
    """``{column: {code: label}}`` of a CSV with a column, a code and a label; two labels of a code are an error."""
    try:
        text = data.decode("utf-8-sig")
    except UnicodeDecodeError:
        text = data.decode("cp1252")
    rows = list(csv.reader(text.splitlines()))
    names = [h.strip().lower() for h in rows[0]] if rows else []
    places = []
    for options in (("column", "variable", "field", "name"), ("code", "value"), ("label", "meaning", "description")):
        at = next((i for i, h in enumerate(names) if h in options), None)
        if at is None:
            raise IngestError(f"no column {' or '.join(options)}")
        places.append(at)
    out: dict[str, dict[str, str]] = {}
    for r in rows[1:]:
        if len(r) <= max(places) or not r[places[0]].strip():
            continue
        column, code, label = (r[i].strip() for i in places)
        if out.setdefault(column, {}).setdefault(code, label) != label:
            raise IngestError(f"{column}: {code} has two labels")
    return out


