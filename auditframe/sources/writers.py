"""What leaves an audit: tables, a manifest, and a report."""

from __future__ import annotations

import functools
import hashlib
import html
import json
import os
import platform
import tempfile
from typing import Any

from pyspark.sql import DataFrame


def atomic_write(path: str, content: str | bytes) -> None:
    """A whole file or none: written beside its place, flushed, and moved there."""
    data = content.encode() if isinstance(content, str) else content
    fd, at = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)), prefix=".part-")
    try:
        with os.fdopen(fd, "wb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        os.replace(at, path)
    except BaseException:
        os.unlink(at)
        raise


def write_csv(rows: DataFrame, path: str, *, rid: str = "_rid") -> None:
    """Files in source order, each with a header; row numbers are left out."""
    rows.repartitionByRange(rid).sortWithinPartitions(rid).drop(rid).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def column_union(frames: list[DataFrame]) -> list[str]:
    """Columns of all tables, each where it is first seen."""
    return list(dict.fromkeys(c for f in frames for c in f.columns))


def stacked(frames: list[DataFrame]) -> DataFrame:
    """Rows of all tables under the union of their columns; what a table lacks is null."""
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames).select(*(f"`{c}`" for c in column_union(frames)))


def format_bytes(n: int) -> str:
    """``512 bytes``, ``1.5 KB``, ``2048.0 MB``: megabytes are the largest unit."""
    if n < 1 << 10:
        return f"{n} bytes"
    return f"{n / (1 << 10):.1f} KB" if n < 1 << 20 else f"{n / (1 << 20):.1f} MB"


def write_parquet(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").parquet(path)


def sha256_file(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def manifest(inputs: list[str], rules: list[str] = (), mutations: int = 0, **provenance: Any) -> dict[str, Any]:
    """Versions, hashes of inputs and rules, and how many cells changed. The run's id is a hash of all that."""
    said = {"python": platform.python_version(), "inputs": {p: sha256_file(p) for p in inputs}, "rules": {p: sha256_file(p) for p in rules}, "mutations": mutations, **provenance}
    return {"run_id": hashlib.sha256(json.dumps(said, sort_keys=True, default=str).encode()).hexdigest()[:16], **said}


def markdown_table(rows: list[dict[str, Any]]) -> str:
    if not rows:
        return "(none)\n"
    names = list(rows[0])
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    return "\n".join([f"| {' | '.join(names)} |", f"|{'---|' * len(names)}", *(f"| {' | '.join(cell(r[n]) for n in names)} |" for r in rows)]) + "\n"


def render_markdown(title: str, parts: dict[str, list[dict[str, Any]]]) -> str:
    return f"# {title}\n\n" + "\n".join(f"## {name}\n\n{markdown_table(rows)}" for name, rows in parts.items())


def render_html(title: str, parts: dict[str, list[dict[str, Any]]]) -> str:
    """A page of its own; every value is escaped."""
    e = lambda v: html.escape("" if v is None else str(v))
    body = []
    for name, rows in parts.items():
        body.append(f"<h2>{e(name)}</h2>")
        if rows:
            head = "".join(f"<th>{e(n)}</th>" for n in rows[0])
            lines = "".join("<tr>" + "".join(f"<td>{e(v)}</td>" for v in r.values()) + "</tr>" for r in rows)
            body.append(f"<table><thead><tr>{head}</tr></thead><tbody>{lines}</tbody></table>")
        else:
            body.append("<p>none</p>")
    return f"<!doctype html><html><head><meta charset='utf-8'><title>{e(title)}</title></head><body><h1>{e(title)}</h1>{''.join(body)}</body></html>"
