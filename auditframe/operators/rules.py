"""Rules and declared expectations, evaluated as one aggregate or one filtered pass."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..plans.frame import AuditFrame
from .columns import fences

VIOLATIONS = "severity string, rule string, column string, row long, value string"
EXPECTATIONS = ("range", "required", "unique", "allowed_values", "conditional")


def primary_key_repeats(f: AuditFrame, key: list[str]) -> DataFrame:
    """Every later row of a repeated key."""
    k = F.struct(*(f.value(c).alias(c) for c in key))
    first = f.wide.groupBy(k.alias("k")).agg(F.min(f.rid).alias("first"), F.count("*").alias("n")).where("n > 1")
    rows = f.wide.select(F.col(f.rid).alias("row"), k.alias("k")).join(first, "k").where("row > first")
    return rows.select("row", F.concat_ws("|", *(F.col(f"k.{c}") for c in key)).alias("value"))


def validate(f: AuditFrame, rules: dict[str, Any]) -> DataFrame:
    """Errors, warnings and suggestions of a rules file: ``(severity, rule, column, row, value)``.

    ``columns: {name: {type, format, minimum, maximum}}`` and ``primary_key``. A cell that is no number is not
    below a minimum, and what else is said of its column is not asked of it.
    """
    out = None

    def add(severity: str, rule: str, column: str, rows: DataFrame) -> None:
        nonlocal out
        part = rows.select(F.lit(severity).alias("severity"), F.lit(rule).alias("rule"), F.lit(column).alias("column"), "row", "value")
        out = part if out is None else out.unionByName(part)

    found: list[tuple[str, str, str, Column]] = []
    for c, spec in (rules.get("columns") or {}).items():
        if c not in f.columns:
            continue
        v, x = f.value(c), X.number(f.cell(c))
        filled = v != ""
        asked = filled if not {"minimum", "maximum"} & set(spec) else filled & x.isNotNull()
        if "minimum" in spec:
            found.append(("error", "minimum", c, x < spec["minimum"]))
        if "maximum" in spec:
            found.append(("warning", "maximum", c, x > spec["maximum"]))
        if spec.get("type") == "date":
            if spec.get("format"):
                bad = F.try_to_date(v, X.spark_format(spec["format"])).isNull()
                found.append(("error", "date_format", c, asked & bad))
            else:
                found.append(("error", "ambiguous_date", c, asked & X.is_ambiguous_date(v)))
    cells = [F.when(cond, F.struct(F.lit(s).alias("severity"), F.lit(r).alias("rule"), F.lit(c).alias("column"), f.cell(c).alias("value"))) for s, r, c, cond in found]
    if cells:
        rows = f.wide.select(F.col(f.rid).alias("row"), F.explode(F.filter(F.array(*cells), lambda s: s.isNotNull())).alias("s"))
        out = rows.select("s.severity", "s.rule", "s.column", "row", "s.value")
    if rules.get("primary_key"):
        add("error", "duplicate_primary_key", ",".join(rules["primary_key"]), primary_key_repeats(f, rules["primary_key"]))
    for c, (lo, hi) in fences(f, f.of_category("free_text")).items():
        add("suggestion", "iqr_outlier", c, f.wide.where((f.number(c) < lo) | (f.number(c) > hi)).select(F.col(f.rid).alias("row"), f.cell(c).alias("value")))
    once = [c for c in f.of_category("categorical") if f.stats[c].distinct >= 2]
    if once:
        single = f.vc.where(F.col("column").isin(once) & (F.col("v") != "")).groupBy("column", "v").agg(F.sum("n").alias("n"), F.min("first").alias("row")).where("n = 1")
        part = single.select(F.lit("suggestion").alias("severity"), F.lit("rare_value").alias("rule"), "column", "row", F.col("v").alias("value"))
        out = part if out is None else out.unionByName(part)
    return out if out is not None else f.spark.createDataFrame([], VIOLATIONS)


def check_expectation(spec: dict[str, Any], columns: list[str]) -> None:
    """Raises ValueError for a kind, column or parameter that isn't one."""
    kind = spec.get("type")
    if kind not in EXPECTATIONS:
        raise ValueError(f"no expectation {kind!r}; one of {', '.join(EXPECTATIONS)}")
    named = [spec.get("column")] + ([spec["when"]["column"], spec["then"]["column"]] if kind == "conditional" else [])
    if missing := [c for c in named if c is not None and c not in columns]:
        raise ValueError(f"no column {', '.join(missing)}")
    if kind == "range" and spec.get("min") is None and spec.get("max") is None:
        raise ValueError("a range has a min or a max")
    if kind == "allowed_values" and not spec.get("values"):
        raise ValueError("allowed_values has values")


def compare(f: AuditFrame, column: str, op: str, target: Any) -> Column:
    """Whether a cell stands in a relation to a value; null where that can't be told."""
    v, x = f.value(column), X.number(f.cell(column))
    if op == "is blank":
        return v == ""
    if op == "is not blank":
        return v != ""
    try:
        t = float(target)
        numbers = {"=": x == t, "!=": x != t, "<": x < t, "<=": x <= t, ">": x > t, ">=": x >= t}[op]
    except (TypeError, ValueError):
        numbers = F.lit(None).cast("boolean")
    texts = {"=": v == str(target), "!=": v != str(target)}.get(op)
    told = F.coalesce(numbers, texts) if texts is not None else numbers
    return F.when(v != "", told)


def evaluate_expectations(f: AuditFrame, specs: list[dict[str, Any]]) -> DataFrame:
    """``(expectation, type, column, violations, not_evaluable, evaluated)`` of each, from one aggregate; ``unique`` from value counts."""
    aggs, rows = [], []
    for i, s in enumerate(specs):
        check_expectation(s, f.columns)
        kind, c = s["type"], s.get("column")
        if kind == "unique":
            st = f.vc.where((F.col("column") == c) & (F.col("v") != "")).groupBy("v").agg(F.sum("n").alias("n")).agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
            rows.append((i, kind, c, st[0], 0, st[1]))
            continue
        if kind == "required":
            ok = f.value(c) != ""
        elif kind == "range":
            x = X.number(f.cell(c))
            ok = F.when(x.isNotNull(), (x >= s["min"] if s.get("min") is not None else F.lit(True)) & (x <= s["max"] if s.get("max") is not None else F.lit(True)))
        elif kind == "allowed_values":
            ok = F.when(f.value(c) != "", f.value(c).isin([str(v) for v in s["values"]]))
        else:
            w, t = s["when"], s["then"]
            ok = F.when(compare(f, w["column"], w["op"], w.get("value")), compare(f, t["column"], t["op"], t.get("value")))
        asked = F.lit(True)
        if kind == "range":
            asked = f.value(c) != ""
        elif kind == "allowed_values":
            asked = f.value(c) != ""
        elif kind == "conditional":
            asked = F.coalesce(compare(f, w["column"], w["op"], w.get("value")), F.lit(False))
        aggs += [F.count_if(asked & ~ok).alias(f"v{i}"), F.count_if(asked & ok.isNull()).alias(f"u{i}"), F.count_if(asked & ok.isNotNull()).alias(f"e{i}")]
        rows.append((i, kind, c or w["column"], None, None, None))
    got = f.wide.agg(*aggs).first() if aggs else None
    out = [(i, k, c, got[f"v{i}"], got[f"u{i}"], got[f"e{i}"]) if v is None else (i, k, c, v, u, e) for i, k, c, v, u, e in rows]
    return f.spark.createDataFrame(out, "expectation int, type string, column string, violations long, not_evaluable long, evaluated long")


def chained_keys(mapping: dict[str, str]) -> list[str]:
    """Keys that another key maps to: applying such a mapping twice gives something else."""
    return sorted(k for k in mapping if mapping[k] != k and any(v == k and other != k for other, v in mapping.items()))


def mapping_conflicts(missing: dict[str, str], categories: dict[str, str]) -> list[str]:
    """Values that both maps of a column rewrite, or that one map writes and either rewrites."""
    return sorted(set(missing) & set(categories) | set(chained_keys(missing | categories)))


def describe(spec: dict[str, Any]) -> str:
    """An expectation as a sentence."""
    column, kind = spec.get("column"), spec["type"]
    if kind == "conditional":
        said = [" ".join(str(part[k]) for k in ("column", "op", "value") if k in part) for part in (spec["when"], spec["then"])]
        return f"if {said[0]} then {said[1]}"
    low, high = spec.get("min"), spec.get("max")
    ranges = f"between {low} and {high}" if None not in (low, high) else f"≥ {low}" if low is not None else f"≤ {high}"
    return f"{column} is " + {"range": ranges, "required": "never blank", "unique": "unique", "allowed_values": "one of: " + ", ".join(map(str, spec.get("values", [])))}[kind]


#: Parts of a rules file, and what each says of a column.
RULE_PARTS = {"columns": dict, "primary_key": list, "missing_values": dict, "category_mappings": dict, "expectations": list}
COLUMN_RULES = {"type": str, "format": str, "minimum": (int, float), "maximum": (int, float)}


def check_rules(rules: Any, columns: list[str] | None = None) -> None:
    """Raises ValueError, with all that is wrong, for rules that would be half applied."""
    if not isinstance(rules, dict):
        raise ValueError("rules are a mapping")
    wrong = [f"unknown part {k!r}" for k in rules if k not in RULE_PARTS]
    wrong += [f"{k} is no {kind.__name__}" for k, kind in RULE_PARTS.items() if rules.get(k) is not None and not isinstance(rules[k], kind)]
    if wrong:
        raise ValueError("; ".join(wrong))
    for c, spec in (rules.get("columns") or {}).items():
        if not isinstance(spec, dict):
            wrong.append(f"{c}: no mapping")
            continue
        wrong += [f"{c}: unknown rule {k!r}" for k in spec if k not in COLUMN_RULES]
        wrong += [f"{c}: {k} is {v!r}" for k, v in spec.items() if k in COLUMN_RULES and (isinstance(v, bool) or not isinstance(v, COLUMN_RULES[k]))]
        numbers = [spec[k] for k in ("minimum", "maximum") if isinstance(spec.get(k), (int, float))]
        wrong += [f"{c}: minimum over maximum"] if len(numbers) == 2 and numbers[0] > numbers[1] else []
    missing, merged = rules.get("missing_values") or {}, rules.get("category_mappings") or {}
    for c in sorted({*missing, *merged}):
        maps = [m.get(c) or {} for m in (missing, merged)]
        if not all(isinstance(m, dict) and all(isinstance(x, str) for kv in m.items() for x in kv) for m in maps):
            wrong.append(f"{c}: values aren't mapped from strings to strings")
        elif bad := mapping_conflicts(*maps):
            wrong.append(f"{c}: {', '.join(bad)} is rewritten twice")
    named = [*(rules.get("columns") or {}), *(rules.get("primary_key") or []), *missing, *merged]
    wrong += [f"no column {c!r}" for c in dict.fromkeys(named) if columns is not None and c not in columns]
    if wrong:
        raise ValueError("; ".join(wrong))
    for spec in rules.get("expectations") or []:
        check_expectation(spec, columns if columns is not None else [spec.get("column"), *(spec[k]["column"] for k in ("when", "then") if k in spec)])
