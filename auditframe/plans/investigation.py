"""An audit from start to end: checks, score, proposed repairs, cleaning, and what is left after it."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names as N
from ..operators import CHECKS, cleaning
from ..operators.cells import leading_zero_widths
from ..operators.records import level_counts, similar_clusters, synonym_clusters
from . import profile
from .frame import AuditFrame

#: How a finding stands in the report.
HIGH = {"duplicate_rows", "conflicting_ids", "birth_date_ordering", "column_ordering", "conditional_columns", "pii_content", "future_dates", "clinical_ranges", "fips_format", "zip_format"}


@dataclass
class Investigation:
    """Findings of one table. Evidence stays distributed; the catalogue is a row a check."""

    frame: AuditFrame
    found: dict[str, DataFrame | None] = field(default_factory=dict)
    counted: dict[str, int | None] = field(default_factory=dict)

    def evidence(self, key: str) -> DataFrame | None:
        if key not in self.found:
            self.found[key] = CHECKS[key].run(self.frame)
        return self.found[key]

    def count(self, key: str) -> int | None:
        """How much a check found; None where it doesn't apply."""
        if key not in self.counted:
            e = self.evidence(key)
            self.counted[key] = None if e is None else e.count()
        return self.counted[key]

    @cached_property
    def catalogue(self) -> list[dict[str, Any]]:
        order = sorted(CHECKS.values(), key=lambda c: c.id)
        status = lambda n: "Not applicable" if n is None else "Passed" if not n else "Found"
        return [{"id": c.id, "key": c.key, "unit": c.unit, "severity": c.severity, "tier": "high" if c.key in HIGH else "review", "status": status(self.count(c.key)), "found": self.count(c.key)} for c in order]

    @cached_property
    def score(self) -> dict[str, int]:
        return {r.aspect: r.score for r in profile.quality_score(self.frame, {k: self.count(k) or 0 for k in profile.SCORED}).collect()}

    @property
    def readiness(self) -> str:
        open_ = [c for c in self.catalogue if c["status"] == "Found"]
        return "Significant issues remain" if any(c["tier"] == "high" for c in open_) else "Review recommended" if open_ else "Ready with review"

    def sample(self, key: str, rows: int = 10) -> list[dict[str, Any]]:
        """The first rows of a check's evidence; values of columns with personal data are hidden."""
        e = self.evidence(key)
        if e is None:
            return []
        shown = e.orderBy("row", "column", "value", "detail").limit(rows).collect()
        return [r.asDict() | ({"value": cleaning.HIDDEN, "detail": None} if N.is_pii(r.column or "") else {}) for r in shown]

    def propose(self) -> tuple[dict[str, Any], dict[str, Any]]:
        """Rules and fixes that follow from the findings without a judgment, none on the primary key. They run only if they are passed to :func:`clean`."""
        f = self.frame
        off = set(f.primary_key)
        columns = lambda key: sorted({r.column for r in self.evidence(key).select("column").distinct().collect()} - off) if self.evidence(key) is not None else []
        fixes: dict[str, Any] = {}
        for key, fix in (("encoding_corruption", "mojibake"), ("invisible_characters", "invisible"), ("whitespace", "whitespace"), ("numeric_representation", "numeric_format"), ("excel_date_serials", "excel_dates")):
            if found := columns(key):
                fixes[fix] = found
        if widths := {c: w for c, w in leading_zero_widths(f).items() if c not in off}:
            fixes["leading_zeros"] = widths
        units = {}
        for r in (self.evidence("mixed_units") or f.listed([])).collect():
            low, high, at = r.detail.split(" ")
            if high != "overlapping" and r.column not in off:
                factor = next(x for a, b, x in _units(f, r.column) if (a, b) == (low, high))
                units[r.column] = {"boundary": float(at), "minority_side": r.value, "factor": factor}
        if units:
            fixes["units"] = units
        numeric = lambda v: v.lstrip("-").isdigit()
        missing = {c: {v: "" if numeric(v) else "Missing" for v in codes} for c, codes in f.sentinels.items() if c not in off and f.category[c] != "id"}
        labels = {}
        for c, counts in level_counts(f, [c for c in f.columns if f.types[c] not in ("identifier", "date", "numeric") and c not in off]).items():
            groups = synonym_clusters(counts)
            covered = {v for g in groups for v in g["values"]}
            groups += [g for g in similar_clusters(counts) if g["confidence"] == "high" and not covered & set(g["values"])]
            mapped = {v: g["canonical"] for g in groups for v in g["values"] if v != g["canonical"]}
            if mapped:
                labels[c] = mapped
        return {"missing_values": missing, "category_mappings": labels}, fixes

    def clean(self, rules: dict[str, Any], fixes: dict[str, Any], *, drop_duplicates: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
        """``(rows, log, safety)``; duplicates go only if that is said and every safety check passes."""
        rows, log = cleaning.clean(self.frame, rules, fixes)
        safety = cleaning.safety_report(self.frame, rows, log)
        if drop_duplicates and safety.where("not passed").isEmpty():
            rows = cleaning.drop_duplicates(self.frame, rows)
        return rows, log, safety

    def report(self) -> dict[str, list[dict[str, Any]]]:
        parts = {"Score": [{"aspect": k, "score": v} for k, v in self.score.items()], "Readiness": [{"verdict": self.readiness}], "Checks": self.catalogue, "Columns": [r.asDict() for r in profile.dictionary(self.frame).orderBy("column").collect()]}
        for c in self.catalogue:
            if c["status"] == "Found":
                parts[f"{c['id']} {c['key']}"] = self.sample(c["key"])
        return parts


def _units(f: AuditFrame, column: str) -> list[tuple[str, str, float]]:
    from ..operators.columns import UNITS

    return UNITS[f.roles[column]]
