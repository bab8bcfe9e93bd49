"""Checks and repairs of single rows over a stream: they keep no state, so they run on each micro-batch as they are."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..functions import exprs as X
from ..operators.cleaning import steps
from ..plans.frame import stringify

#: Conditions that need no statistics of the column.
CONDITIONS: dict[str, Callable[[Any], Any]] = {
    "whitespace": lambda c: c.rlike(X.PADDED),
    "invisible_characters": lambda c: c.rlike(X.INVISIBLE),
    "encoding_corruption": lambda c: X.mojibake_repair(c).isNotNull(),
    "ambiguous_dates": lambda c: X.is_ambiguous_date(X.strip(c)),
    "pii_content": lambda c: c.rlike(X.SSN) | c.rlike(X.EMAIL) | c.rlike(X.PHONE),
}


def flagged(stream: DataFrame, keys: list[str] = ()) -> DataFrame:
    """``(keys, column, check)`` for each cell of a stream that a condition holds for."""
    cells = stringify(stream.drop(*keys)).columns
    text = stringify(stream)
    found = F.array(*(F.when(cond(F.col(f"`{c}`")), F.struct(F.lit(c).alias("column"), F.lit(name).alias("check"))) for c in cells for name, cond in CONDITIONS.items()))
    return text.select(*keys, F.explode(F.filter(found, lambda s: s.isNotNull())).alias("s")).select(*keys, "s.column", "s.check")


def cleaned(stream: DataFrame, rules: dict[str, Any], fixes: dict[str, Any]) -> DataFrame:
    """A stream with approved repairs applied."""
    rows = stringify(stream)
    for c in rows.columns:
        for _, step in steps(c, rules, fixes):
            rows = rows.withColumn(c, step(F.col(f"`{c}`")))
    return rows


def audit_batches(stream: DataFrame, run: Callable[[DataFrame, int], None]) -> DataStreamWriter:
    """For checks that need a column's statistics: ``run(batch, number)`` audits each micro-batch as a table."""
    return stream.writeStream.foreachBatch(run)
