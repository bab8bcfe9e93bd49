"""Profile, fingerprint, drift and score of a table: functions of its column statistics."""

from __future__ import annotations

import hashlib
import json
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions import names as N
from .frame import AuditFrame


def dictionary(f: AuditFrame) -> DataFrame:
    """``(column, rows, nulls, unique, zeros, category)``, a row a column."""
    rows = [(c, s.total, s.nulls, s.unique, s.zeros, f.category[c]) for c, s in f.stats.items()]
    return f.spark.createDataFrame(rows, "column string, rows long, nulls long, unique long, zeros long, category string")


def levels(f: AuditFrame, columns: list[str], most: int = 8) -> DataFrame:
    """The most frequent values of columns: ``(column, value, n)``."""
    v = f.vc.where(F.col("column").isin(columns) & (F.col("v") != "")).groupBy("column", F.col("v").alias("value")).agg(F.sum("n").alias("n"))
    at = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), "value"))
    return v.withColumn("r", at).where(F.col("r") <= most).drop("r")


def quantiles(f: AuditFrame, columns: list[str]) -> DataFrame:
    """Exact quartiles with interpolation, over value counts."""
    from ..operators.columns import counted
    from ..operators.ordered import quantiles as at_shares

    q = at_shares(counted(f, columns), ["column"], [0.0, 0.25, 0.5, 0.75, 1.0])
    return q.select("column", *(F.col("q")[i].alias(n) for i, n in enumerate(("low", "q1", "median", "q3", "high"))))


def key_candidates(f: AuditFrame) -> DataFrame:
    """Columns without blanks in which no value repeats."""
    rows = [(c,) for c, s in f.stats.items() if not s.blanks and s.distinct == s.total]
    return f.spark.createDataFrame(rows, "column string")


def freshness(f: AuditFrame, columns: list[str]) -> DataFrame:
    """``(column, earliest, latest, n, age_days)`` of ISO dates."""
    v = f.vc.where(F.col("column").isin(columns) & X.real_date(F.col("v")).isNotNull())
    g = v.groupBy("column").agg(F.min("v").alias("earliest"), F.max("v").alias("latest"), F.sum("n").alias("n"))
    return g.withColumn("age_days", F.datediff(F.lit(f.as_of).cast("date"), F.to_date("latest")))


def entries(f: AuditFrame) -> dict[str, list]:
    return {c: [f.category[c], f.types[c], s.total, s.nulls, s.unique, s.zeros] for c, s in sorted(f.stats.items())}


def suggest_primary_key(f: AuditFrame) -> list[str]:
    """The first record id that is unique and never blank; else the first id and a record number or date beside it; else a guess.

    Ids are names of ids that are neither places nor personal data. All pairs are counted in one pass.
    """
    ids = [c for c in f.columns if N.is_id(c) and not N.is_place(c) and not N.is_pii(c)]
    alone = [c for c in ids if f.rows and not f.stats[c].blanks and f.stats[c].distinct == f.rows]
    guess = (alone or ids or [c for c in f.columns if not N.is_place(c)] or f.columns)[:1]
    if alone or not ids:
        return guess
    beside = [c for c in f.columns if c != ids[0] and N.has("record_number", c) and not N.is_pii(c) and not f.stats[c].blanks]
    if not beside or f.stats[ids[0]].blanks:
        return guess
    got = f.wide.agg(*(F.count_distinct(f.value(ids[0]), f.value(c)).alias(f"d{i}") for i, c in enumerate(beside))).first()
    pairs = sorted((f.stats[c].distinct, i) for i, c in enumerate(beside) if got[f"d{i}"] == f.rows)
    return [ids[0], beside[pairs[0][1]]] if pairs else guess


def fingerprint(f: AuditFrame) -> DataFrame:
    """Hashes of the schema and of the whole dictionary."""
    canon = lambda x: hashlib.sha256(json.dumps(x, separators=(",", ":"), sort_keys=True).encode()).hexdigest()
    d = entries(f)
    return f.spark.createDataFrame([(canon({c: e[:2] for c, e in d.items()}), canon([d, f.rows]))], "schema_sha256 string, content_sha256 string")


def drift(before: AuditFrame, after: AuditFrame) -> DataFrame:
    """``(column, change, before, after)``: added and removed columns, shifts of missing rate, distinct values and medians."""
    out = [(c, "removed", None, None) for c in before.columns if c not in after.columns] + [(c, "added", None, None) for c in after.columns if c not in before.columns]
    both = [c for c in before.columns if c in after.columns]
    med = lambda f: {r.column: r["median"] for r in quantiles(f, both).collect()}
    a, b = (med(before), med(after)) if both else ({}, {})
    for c in both:
        x, y = before.stats[c], after.stats[c]
        for what, u, v in (("missing_rate", x.nulls / max(1, x.total), y.nulls / max(1, y.total)), ("unique", float(x.unique), float(y.unique)), ("median", a.get(c), b.get(c))):
            if u is not None and v is not None and u != v and (what != "median" or abs(v - u) >= 0.15 * abs(u)):
                out.append((c, what, round(u, 6), round(v, 6)))
    return before.spark.createDataFrame(out, "column string, change string, before double, after double")


def part(flagged: float, total: float) -> int:
    return 100 if total <= 0 else round(100 * max(0.0, 1 - flagged / total) ** 2)


def worst_weighted(scores: list[float]) -> int:
    return round(0.4 * min(scores) + 0.6 * sum(scores) / len(scores))


#: Checks whose findings are scored.
SCORED = ("duplicate_rows", "missing_value_codes", "whitespace", "invisible_characters", "encoding_corruption", "numeric_representation", "lost_leading_zeros", "excel_date_serials", "scientific_notation_ids", "inconsistent_categories", "ambiguous_dates", "ragged_rows")


def quality_score(f: AuditFrame, counts: dict[str, int] | None = None) -> DataFrame:
    """``(aspect, score)``: five aspects from what the checks found, and overall, worst first among them."""
    from ..operators import CHECKS

    n = counts or {}
    for key in SCORED:
        if key not in n:
            found = CHECKS[key].run(f)
            n[key] = found.count() if found is not None else 0
    cells = f.rows * len(f.columns)
    blanks = sum(s.blanks for s in f.stats.values())
    eligible = sum(s.total for c, s in f.stats.items() if f.types[c] in ("categorical", "mixed_uncertain"))
    form = sum(n[k] for k in ("whitespace", "invisible_characters", "encoding_corruption", "numeric_representation", "lost_leading_zeros", "excel_date_serials", "scientific_notation_ids"))
    flat = sum(s.unique == 1 for s in f.stats.values())
    scores = {
        "completeness": part(blanks + n["missing_value_codes"], cells),
        "uniqueness": part(n["duplicate_rows"], f.rows),
        "validity": worst_weighted([part(n["missing_value_codes"], cells), part(form, cells)]),
        "consistency": worst_weighted([part(n["inconsistent_categories"], eligible), part(n["ambiguous_dates"], cells)]),
        "structure": round((part(n["ragged_rows"], f.rows) + part(flat, len(f.columns))) / 2),
    }
    exact = round(0.4 * min(scores.values()) + 0.6 * sum(scores.values()) / len(scores), 1)
    scores["overall"] = math.floor(exact + 0.5)
    return f.spark.createDataFrame(list(scores.items()), "aspect string, score long")


def catalogue(f: AuditFrame) -> DataFrame:
    """``(id, key, unit, severity, status, found)`` of all checks: one that can't apply is Not applicable, never Passed."""
    from ..operators import CHECKS

    counts = f.counts({key: c.run(f) for key, c in CHECKS.items()})
    status = lambda n: "Not applicable" if n is None else "Passed" if not n else "Found"
    rows = [(c.id, c.key, c.unit, c.severity, status(counts[c.key]), counts[c.key]) for c in sorted(CHECKS.values(), key=lambda c: c.id)]
    return f.spark.createDataFrame(rows, "id string, key string, unit string, severity string, status string, found long")
