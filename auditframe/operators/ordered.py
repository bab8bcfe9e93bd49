"""Order statistics without a global sort: values are dealt over ranges, ranges are counted, and only ranges are sorted.

A window over one column's values is one task, however large the column. Here approximate cuts, a sketch that tasks
merge, deal each key's values over ``RANGES`` ranges; prefix sums over the ranges' counts are exact, and so is the sum
inside a range. Results don't depend on where the cuts fall.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGES = 128


def running(rows: DataFrame, keys: list[str], x: str = "x", n: str = "n") -> DataFrame:
    """``rows(keys, x, n)``, a row a value, with ``upto``, the counts of a key's values up to this one, ``total`` and ``below``, the value before.

    Keys are columns, pairs of columns or strata; a row a key and range is joined back, broadcast where Spark finds it small.
    """
    rows = rows.where(F.col(x).isNotNull())
    shares = [i / RANGES for i in range(1, RANGES)]
    cuts = rows.groupBy(*keys).agg(F.percentile_approx(x, shares, 10 * RANGES).alias("__cuts"))
    ranged = rows.join(cuts, keys)
    ranged = ranged.withColumn("__range", F.size(F.filter("__cuts", lambda c: c < F.col(x)))).drop("__cuts")
    sums = ranged.groupBy(*keys, "__range").agg(F.sum(n).alias("__sum"), F.max(x).alias("__top"))
    along = Window.partitionBy(*keys).orderBy("__range")
    sums = sums.select(*keys, "__range", (F.sum("__sum").over(along) - F.col("__sum")).alias("__before"), F.sum("__sum").over(Window.partitionBy(*keys)).alias("total"), F.lag("__top").over(along).alias("__under"))
    inside = Window.partitionBy(*keys, "__range").orderBy(x)
    out = ranged.join(sums, [*keys, "__range"])
    out = out.withColumn("upto", F.col("__before") + F.sum(n).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    return out.withColumn("below", F.coalesce(F.lag(x).over(inside), "__under")).drop("__range", "__before", "__under")


def at_place(place: Column, x: str = "x") -> Column:
    """The value at a place from 0, over :func:`running`'s rows of a key."""
    return F.min(F.when(F.col("upto") > place, F.col(x)))


def quantiles(rows: DataFrame, keys: list[str], shares: list[float], x: str = "x", n: str = "n") -> DataFrame:
    """``(keys, q, total)``: exact quantiles, interpolated between neighbours, of ``rows(keys, x, n)``."""
    counted = running(rows.groupBy(*keys, x).agg(F.sum(n).alias(n)), keys, x, n)
    total = F.col("total")
    ends = [c for p in shares for place in [p * (total - 1)] for c in (at_place(F.floor(place), x), at_place(F.ceil(place), x))]
    found = counted.groupBy(*keys, "total").agg(*(c.alias(f"__{i}") for i, c in enumerate(ends)))
    q = []
    for i, p in enumerate(shares):
        low, high, rest = F.col(f"__{2 * i}"), F.col(f"__{2 * i + 1}"), p * (total - 1) - F.floor(p * (total - 1))
        q.append(F.when(low == high, low).otherwise((1 - rest) * low + rest * high))
    return found.select(*keys, F.array(*q).alias("q"), "total")
