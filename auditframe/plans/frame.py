"""The audited table and the three things every check reads: the wide rows, value counts, column statistics.

``vc``, a written table, counts distinct cells by column, so pattern work for a column's statistics is done once a distinct value,
and its totals are one aggregation for all columns. What goes to the driver is one row a column. Evidence comes
from the wide rows in one pass without a shuffle, whatever the column's cardinality.
"""

from __future__ import annotations

import datetime
from dataclasses import dataclass
from functools import cached_property
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions import names as N
from .shared import saved

# Strings that stand for a missing value, and the share of a column above which they are an answer.
SENTINELS = ["-99", "-9", "999", "9999", "777", "7777", "n/a", "na", "n.a.", "unknown", "unk", "refused", "dk", "don't know", "not applicable", "."]
SENTINEL_SHARE = 0.25
EVIDENCE = "column string, row long, value string, detail string"


@dataclass(frozen=True)
class Bounds:
    """How much the searches over pairs read; None is all of it, which is the default. ``SMALL`` has the bounds of interactive use."""

    #: Evenly spaced rows of pairwise statistics.
    rows: int | None = None
    #: Columns of a kind in associations, in the search for likelihoods, and in rare combinations.
    columns: int | None = None
    likelihood: int | None = None
    combined: int | None = None
    #: Rows of a block that names are compared in pairs in; larger blocks hold placeholders, not persons.
    block: int = 200


SMALL = Bounds(rows=20_000, columns=30, likelihood=25, combined=20)


def stringify(df: DataFrame, rid: str = "_rid") -> DataFrame:
    """Typed columns as cells: null is empty, true and false in lower case, whole floats as integers, dates as ISO."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if name == rid:
            out.append(c.cast("long").alias(name))
            continue
        if kind in ("double", "float"):
            whole = (c == F.floor(c)) & (F.abs(c) < 1e15)
            c = F.when(whole, c.cast("decimal(18,0)").cast("string")).otherwise(c.cast("string"))
        elif kind in ("timestamp", "timestamp_ntz"):
            c = F.when(F.date_format(c, "HH:mm:ss") == "00:00:00", F.date_format(c, "yyyy-MM-dd")).otherwise(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"))
        elif kind.startswith(("array", "map", "struct", "binary", "variant")):
            raise TypeError(f"column {name} is {kind}; an audited table has plain values")
        else:
            c = c.cast("string")
        out.append(F.coalesce(c, F.lit("")).alias(name))
    return df.select(*out)


class AuditFrame:
    """A table under audit. ``rid`` numbers rows in source order; ``overflow`` has what ragged rows hold beyond the header."""

    def __init__(self, df: DataFrame, *, rid: str = "_rid", overflow: str = "_overflow", as_of: str | None = None, primary_key: list[str] = (), codes: dict[str, dict[str, str]] | None = None, bounds: Bounds = Bounds()) -> None:
        self.rid, self.overflow = rid, overflow if overflow in df.columns else None
        self.columns = [c for c in df.columns if c not in (rid, overflow)]
        self.wide = stringify(df, rid)
        self.spark = df.sparkSession
        self.as_of = as_of or datetime.datetime.now(datetime.UTC).date().isoformat()
        self.primary_key, self.codes, self.bounds = list(primary_key), codes or {}, bounds
        #: What evidence was asked for: ``(column, condition)``, and whether each condition reads its column alone.
        self.conditions: WeakKeyDictionary[DataFrame, tuple[list[tuple[str, Column]], bool]] = WeakKeyDictionary()

    @cached_property
    def vc(self) -> DataFrame:
        """``(column, raw, v, x, n, first)``: a cell, stripped, as a number, how often and first where."""
        long = self.wide.unpivot([self.rid], self.columns, "column", "raw")
        counts = long.groupBy("column", "raw").agg(F.count("*").alias("n"), F.min(self.rid).alias("first"))
        return saved(counts.withColumn("v", X.strip(F.col("raw"))).withColumn("x", X.number(F.col("v"))), "vc")

    @cached_property
    def stats(self) -> dict[str, Row]:
        """Totals of each column."""
        v, n, x = F.col("v"), F.col("n"), F.col("x")
        # a row a stripped value first: patterns are tried once a value, and values are counted as rows
        blank = F.col("raw") == ""
        values = self.vc.groupBy("column", "v").agg(
            F.sum("n").alias("n"), F.sum(F.when(blank, n).otherwise(0)).alias("null"), F.max(F.length("raw")).alias("longest"), F.first("x").alias("x")
        )
        share = lambda cond: F.coalesce(F.sum(F.when(cond, n)), F.lit(0))
        nb = v != ""
        numeric, decorated = x.isNotNull(), v.rlike(X.DECORATED)
        digits = v.rlike(r"^\d+$")
        aggs = {
            "total": F.sum("n"),
            "nulls": F.sum("null"),
            "blanks": share(~nb),
            "unique": F.count_if(n > F.col("null")),
            "distinct": F.count_if(nb),
            "distinct_cells": F.count("*"),
            "numeric": share(numeric & nb),
            "zeros": share(x == 0),
            "iso": share(X.is_iso(v)),
            "date_like": share(X.is_date_like(v)),
            "datetime": share(v.rlike(X.DATETIME)),
            "scientific": share(v.rlike(X.SCIENTIFIC)),
            "long_digits": share(digits & (F.length(v) >= 8) & ~v.rlike(X.SCIENTIFIC)),
            "digits": share(digits),
            "leading_zero": share(v.rlike(r"^0\d+$")),
            "decorated": share(nb & ~numeric & decorated),
            "letters": share(v.rlike("[A-Za-z]")),
            "longest": F.max("longest"),
        }
        got = {r.column: r for r in values.groupBy("column").agg(*(c.alias(k) for k, c in aggs.items())).collect()}
        return {c: got.get(c) or Row(column=c, **dict.fromkeys(aggs, 0)) for c in self.columns}

    @cached_property
    def rows(self) -> int:
        return max((s.total for s in self.stats.values()), default=0)

    @cached_property
    def category(self) -> dict[str, str]:
        """id, categorical or free_text."""
        cap = min(50, max(10, int(0.05 * self.rows)))
        return {c: "id" if N.is_id(c) or s.leading_zero else "categorical" if s.unique <= cap else "free_text" for c, s in self.stats.items()}

    @cached_property
    def types(self) -> dict[str, str]:
        """identifier, date, numeric, categorical or mixed_uncertain."""
        out = {}
        for c, s in self.stats.items():
            filled = s.total - s.nulls
            said = "mixed_uncertain" if not filled else "date" if s.date_like == filled else "numeric" if s.numeric == filled else "categorical" if self.category[c] == "categorical" else "mixed_uncertain"
            out[c] = "identifier" if self.category[c] == "id" else said
        return out

    @cached_property
    def roles(self) -> dict[str, str | None]:
        return {c: None if self.category.get(c) == "id" else N.role(c) for c in self.columns}

    @cached_property
    def sentinels(self) -> dict[str, list[str]]:
        """Missing-value codes of each column: listed strings that are a quarter of its values at most, and a codebook's no-answer codes."""
        found = self.vc.where(X.fold(F.col("v")).isin(SENTINELS)).groupBy("column", "v").agg(F.sum("n").alias("n")).collect()
        out: dict[str, list[str]] = {}
        for r in sorted(found, key=lambda r: (r.column, r.v)):
            s = self.stats[r.column]
            if r.n / (s.total - s.nulls) <= SENTINEL_SHARE:
                out.setdefault(r.column, []).append(r.v)
        for column, labels in self.codes.items():
            if column in self.columns:
                codes = [k for k, label in labels.items() if any(w in label.casefold() for w in ("refused", "don't know", "not sure", "missing", "not asked", "no answer"))]
                out[column] = sorted({*out.get(column, []), *codes})
        return out

    def with_role(self, *roles: str) -> list[str]:
        return [c for c in self.columns if self.roles[c] in roles]

    def of_category(self, *kinds: str) -> list[str]:
        return [c for c in self.columns if self.category.get(c) in kinds]

    def cell(self, column: str) -> Column:
        return F.col(f"`{column}`")

    def value(self, column: str) -> Column:
        """A cell without white space at the ends."""
        return X.strip(self.cell(column))

    def number(self, column: str) -> Column:
        """A cell's number, unless it is a missing-value code."""
        codes = self.sentinels.get(column, [])
        x = X.number(self.cell(column))
        return F.when(~self.value(column).isin(codes), x) if codes else x

    def evidence(self, found: list[tuple[str, Column, Column | None]], *, shown: bool = True, alone: bool = True) -> DataFrame:
        """Cells as evidence: for each ``(column, condition, detail)`` the rows where it holds, in one pass.

        The cell itself is told only if it is ``shown``; conditions that read further columns than their own aren't ``alone``.
        """
        cells = [
            F.when(cond, F.struct(F.lit(c).alias("column"), (self.cell(c) if shown else F.lit(None).cast("string")).alias("value"), (F.lit(None) if detail is None else detail).cast("string").alias("detail")))
            for c, cond, detail in found
        ]
        if not cells:
            return self.spark.createDataFrame([], EVIDENCE)
        rows = self.wide.select(self.rid, F.explode(F.filter(F.array(*cells), lambda s: s.isNotNull())).alias("s"))
        out = rows.select("s.column", F.col(self.rid).alias("row"), "s.value", "s.detail")
        self.conditions[out] = [(c, cond) for c, cond, _ in found], alone
        return out

    def counts(self, found: dict[str, DataFrame | None]) -> dict[str, int | None]:
        """How many rows each evidence has, None where there is none.

        Conditions on one column are tried once a distinct cell, all in one pass over ``vc``; those on more columns in one over the rows.
        """
        out = dict.fromkeys(found)
        for one in (True, False):
            flat = [(k, c, cond) for k, e in found.items() if e is not None and e in self.conditions and self.conditions[e][1] == one for c, cond in self.conditions[e][0]]
            own = sorted({c for _, c, _ in flat})
            if one:
                rows = self.vc.select(F.col("n").alias("__n"), *(F.when(F.col("column") == c, F.col("raw")).alias(c) for c in own))
                aggs = [F.sum(F.when(self.cell(c).isNotNull(), F.when(cond, F.col("__n")))) for _, c, cond in flat]
            else:
                rows, aggs = self.wide, [F.count_if(cond) for _, _, cond in flat]
            got = rows.agg(*(a.alias(str(i)) for i, a in enumerate(aggs))).first() if flat else ()
            for (k, _, _), n in zip(flat, got, strict=True):
                out[k] = (out[k] or 0) + (n or 0)
        return {k: n if e is None or n is not None else e.count() for (k, n), e in zip(out.items(), found.values(), strict=True)}

    def listed(self, rows: list[tuple]) -> DataFrame:
        """Findings about columns, as evidence without a row."""
        return self.spark.createDataFrame([(c, None, v, d) for c, v, d in rows], EVIDENCE)
