"""Approved repairs, in one pass over the rows, with a log of every changed cell.

Nothing is changed that isn't named. Repairs of a cell are a fold of column expressions in a fixed order, and
each step that changes it adds an entry to the row's log, so cleaned rows and log come from one plan.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions import names as N
from ..plans.frame import AuditFrame
from .rules import chained_keys

ORDER = ("mojibake", "invisible", "whitespace", "numeric_format", "leading_zeros", "excel_dates", "date_iso", "units", "outliers", "pii_mask", "impute")
#: Repairs that are a judgment: never recommended, only approved.
JUDGMENT = {"outliers", "pii_mask", "impute"}
HIDDEN = "[personal data]"
SIMPLE: dict[str, Callable[[Column], Column]] = {"mojibake": X.fix_mojibake, "invisible": X.fix_invisible, "whitespace": X.fix_whitespace, "numeric_format": X.fix_numeric_format, "excel_dates": X.fix_excel_date, "pii_mask": X.fix_pii_mask}


def check_fixes(fixes: dict[str, Any], columns: list[str], primary_key: list[str]) -> None:
    """``{fix: [column]}``, or ``{fix: {column: parameters}}`` for those that take some."""
    for fix, by in fixes.items():
        if fix not in ORDER:
            raise ValueError(f"no fix {fix!r}; one of {', '.join(ORDER)}")
        if missing := [c for c in by if c not in columns]:
            raise ValueError(f"no column {', '.join(missing)}")
        if fix in JUDGMENT - {"pii_mask"} and set(by) & set(primary_key):
            raise ValueError(f"{fix} can't change the primary key")
        if fix not in SIMPLE and not isinstance(by, dict):
            raise ValueError(f"{fix} takes parameters for each column")


def steps(column: str, rules: dict[str, Any], fixes: dict[str, Any]) -> list[tuple[str, Callable[[Column], Column]]]:
    """What is done to a column, in order."""
    out: list[tuple[str, Callable[[Column], Column]]] = []
    codes = (rules.get("missing_values") or {}).get(column)
    if codes:
        out.append(("missing_values", lambda c: F.coalesce(F.try_element_at(F.create_map(*(F.lit(str(x)) for kv in codes.items() for x in kv)), X.strip(c)), c)))
    labels = (rules.get("category_mappings") or {}).get(column)
    if labels:
        if bad := chained_keys({str(k): str(v) for k, v in labels.items()}):
            raise ValueError(f"{column}: {', '.join(bad)} is mapped and mapped to")
        out.append(("category_mappings", lambda c: F.coalesce(F.try_element_at(F.create_map(*(F.lit(str(x)) for kv in labels.items() for x in kv)), c), c)))
    for fix in ORDER:
        by = fixes.get(fix) or {}
        if column not in by:
            continue
        p = by[column] if isinstance(by, dict) else None
        if fix == "impute":
            out.append((fix, lambda c, p=p: F.when(c == "", F.lit(str(p))).otherwise(c)))
            continue
        step = SIMPLE.get(fix) or {
            "leading_zeros": lambda c, p=p: X.fix_leading_zeros(c, int(p)),
            "date_iso": lambda c, p=p: X.fix_date_iso(c, p),
            "units": lambda c, p=p: X.fix_units(c, **p),
            "outliers": lambda c, p=p: X.fix_outliers(c, **p),
        }[fix]
        out.append((fix, lambda c, step=step: F.when(c != "", step(c)).otherwise(c)))
    return out


def clean(f: AuditFrame, rules: dict[str, Any] | None = None, fixes: dict[str, Any] | None = None) -> tuple[DataFrame, DataFrame]:
    """Cleaned rows ``(_rid, columns)`` and the log ``(row, column, original_value, new_value, rule)``.

    Columns whose names say personal data are logged without their values; of columns whose personal data is
    masked, the log is masked too.
    """
    rules, fixes = rules or {}, fixes or {}
    check_fixes(fixes, f.columns, f.primary_key)
    named = {c: f"c{i}" for i, c in enumerate(f.columns)}
    todo = {c: steps(c, rules, fixes) for c in f.columns}
    rows = f.wide.select(f.rid, *(f.cell(c).alias(f"{n}_0") for c, n in named.items()))
    # a projection for each step: a step reads its cell several times, and nested steps would repeat those before
    for k in range(max(map(len, todo.values()), default=0)):
        rows = rows.withColumns({f"{named[c]}_{k + 1}": s[k][1](F.col(f"{named[c]}_{k}")) for c, s in todo.items() if k < len(s)})
    out = rows.select(f.rid, *(F.col(f"{named[c]}_{len(s)}").alias(c) for c, s in todo.items()))
    logs = []
    for c, s in todo.items():
        for k, (rule, _) in enumerate(s):
            was, now = F.col(f"{named[c]}_{k}"), F.col(f"{named[c]}_{k + 1}")
            a, b = was, now
            if N.is_pii(c):
                a = b = F.lit(HIDDEN)
            elif c in (fixes.get("pii_mask") or ()):
                a, b = X.fix_pii_mask(was), X.fix_pii_mask(now)
            logs.append(F.when(was != now, F.struct(F.lit(c).alias("column"), a.alias("original_value"), b.alias("new_value"), F.lit(rule).alias("rule"))))
    if not logs:
        return out, f.spark.createDataFrame([], "row long, column string, original_value string, new_value string, rule string")
    found = rows.select(F.col(f.rid).alias("row"), F.explode(F.filter(F.array(*logs), lambda s: s.isNotNull())).alias("s"))
    return out, found.select("row", "s.column", "s.original_value", "s.new_value", "s.rule")


def drop_duplicates(f: AuditFrame, cleaned: DataFrame) -> DataFrame:
    """Cleaned rows without those that repeated an earlier row before cleaning."""
    from .records import duplicate_rows

    return cleaned.join(duplicate_rows(f).select(F.col("row").alias(f.rid)), f.rid, "left_anti")


def plan(f: AuditFrame, rules: dict[str, Any] | None = None, fixes: dict[str, Any] | None = None) -> DataFrame:
    """A dry run: ``(column, rule, cells)`` that would change."""
    return clean(f, rules, fixes)[1].groupBy("column", "rule").agg(F.count("*").alias("cells"))


def safety_report(f: AuditFrame, cleaned: DataFrame, log: DataFrame) -> DataFrame:
    """Whether rows, columns and primary keys are as many as before, and whether the log replayed gives the output."""
    key = f.primary_key or f.columns
    before = f.wide.agg(F.count("*").alias("n"), F.count_distinct(F.xxhash64(*(f.cell(c) for c in key))).alias("keys")).first()
    after = cleaned.agg(F.count("*").alias("n"), F.count_distinct(F.xxhash64(*(F.col(f"`{c}`") for c in key))).alias("keys")).first()
    shown = [c for c in f.columns if not N.is_pii(c)]
    # both versions of a row side by side; only cells that differ become rows, and each must be what the log says was written
    now = cleaned.select(F.col(f.rid).alias("__rid"), *(F.col(f"`{c}`").alias(f"__now{i}") for i, c in enumerate(shown)))
    cells = F.array(*(F.when(~f.cell(c).eqNullSafe(F.col(f"__now{i}")), F.struct(F.lit(c).alias("column"), F.col(f"__now{i}").alias("now"))) for i, c in enumerate(shown)))
    both = f.wide.join(now, F.col(f.rid) == F.col("__rid"))
    changed = both.select(F.col("__rid").alias("row"), F.explode(F.filter(cells, lambda s: s.isNotNull())).alias("s")).select("row", "s.*") if shown else None
    written = log.select("row", "column", F.col("new_value").alias("now")).distinct()
    unlogged = changed.join(written, ["row", "column", "now"], "left_anti").count() if shown else 0
    checks = [("row_count", before.n == after.n), ("columns", set(f.columns) == set(cleaned.columns) - {f.rid}), ("primary_keys", before["keys"] == after["keys"]), ("every_change_logged", unlogged == 0)]
    return f.spark.createDataFrame(checks, "check string, passed boolean")
