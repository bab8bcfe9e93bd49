"""Checks of whole columns and pairs of columns, from statistics and one-pass aggregates."""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions import names as N
from ..plans.frame import AuditFrame
from ..plans.shared import saved
from .ordered import at_place, quantiles, running
from .registry import check

#: Levels of a column in rare combinations.
LEVELS = 12
#: Order statistics and splits that overlapping units are looked for in.
STATISTICS, SPLITS = 5000, 200
# Two units of a quantity and their factor, by role.
UNITS = {"WEIGHT": [("kg", "lb", 2.20462)], "HEIGHT": [("cm", "in", 2.54), ("m", "ft", 3.28084)], "INCOME": [("dollars", "thousands of dollars", 1000.0)], "DISTANCE": [("mi", "km", 1.60934)]}


def r6(x: float | None) -> str | None:
    """Six digits behind the point, without those that say nothing."""
    return None if x is None else f"{x:.6f}".rstrip("0").rstrip(".")


def sampled(f: AuditFrame) -> DataFrame:
    """All rows, or, where the frame's bounds say so, those at ``int(i * n / rows)``."""
    most = f.bounds.rows
    if most is None or f.rows <= most:
        return f.wide
    at = f.spark.range(most).select((F.col("id") * F.lit(f.rows / most)).cast("long").alias("__at"))
    ranked = placed(f)
    return ranked.join(at, ranked.__place == at.__at, "left_semi").drop("__place")


def placed(f: AuditFrame) -> DataFrame:
    """Rows with their place in source order from 0."""
    ids = running(f.wide.select(F.lit(0).alias("__k"), F.col(f.rid).alias("__x"), F.lit(1).alias("__n")), ["__k"], "__x", "__n")
    return f.wide.join(ids.select("__x", (F.col("upto") - 1).alias("__place")), F.col(f.rid) == F.col("__x")).drop("__x")


def counted(f: AuditFrame, columns: list[str]) -> DataFrame:
    """``(column, x, n)``: the numbers of columns, without codes, and how often."""
    return f.vc.where(F.col("column").isin(columns) & code_free(f) & F.col("x").isNotNull()).groupBy("column", "x").agg(F.sum("n").alias("n"))


@check("DF-05", "substantial_missingness", "columns")
def substantial_missingness(f: AuditFrame) -> DataFrame:
    pct = lambda s: round(100 * (s.total - s.nulls) / s.total, 2)
    return f.listed([(c, None, r6(pct(s))) for c, s in f.stats.items() if s.total and pct(s) < 90])


@check("DF-06", "missingness_concentration", "pairs", "suggestion")
def missingness_concentration(f: AuditFrame) -> DataFrame:
    """Medians of a numeric column where another is missing and where it isn't, a fifth apart or more."""
    targets = [c for c in f.columns if f.stats[c].blanks >= 5 and f.stats[c].total - f.stats[c].blanks >= 5]
    numeric = [c for c in f.of_category("free_text") if f.stats[c].numeric >= 10]
    pairs = [(t, c) for t in targets for c in numeric if t != c]
    if not pairs:
        return f.listed([])
    # a row a column and number first, with what is missing beside it; targets are told apart in what is left
    cells = F.array(*(F.struct(F.lit(c).alias("column"), f.number(c).alias("x")) for c in numeric))
    missing = F.concat(*(F.when(f.value(t) == "", "1").otherwise("0") for t in targets)).alias("missing")
    values = f.wide.select(F.explode(F.filter(cells, lambda s: s.x.isNotNull())).alias("s"), missing).select("s.*", "missing")
    values = saved(values.groupBy("column", "missing", "x").agg(F.count("*").alias("n")), "missing")
    apart = F.explode(F.array(*(F.struct(F.lit(t).alias("target"), (F.substring("missing", i + 1, 1) == "1").alias("gone")) for i, t in enumerate(targets))))
    values = values.select("column", "x", "n", apart.alias("s")).select("s.*", "column", "x", "n").where("target <> column").groupBy("target", "column", "gone", "x").agg(F.sum("n").alias("n"))
    got = {(r.target, r.column, r.gone): (r.q[0], r.total) for r in quantiles(values, ["target", "column", "gone"], [0.5]).collect()}
    out = []
    for t, c in pairs:
        (a, na), (b, nb) = got.get((t, c, True), (None, 0)), got.get((t, c, False), (None, 0))
        if na >= 5 and nb >= 5 and b and abs(a - b) / abs(b) >= 0.2:
            out.append((t, c, f"{r6(a)} {r6(b)}"))
    return f.listed(out)


@check("DF-07", "missingness_co_occurrence", "pairs", "suggestion")
def missingness_co_occurrence(f: AuditFrame) -> DataFrame:
    use = [c for c in f.columns if f.stats[c].blanks >= 5]
    pairs = list(combinations(use, 2))
    both = f.wide.agg(*(F.count_if((f.value(a) == "") & (f.value(b) == "")).alias(str(i)) for i, (a, b) in enumerate(pairs))).first() if pairs else ()
    out = []
    for (a, b), n in zip(pairs, both, strict=True):
        if n >= 5 and n / min(f.stats[a].blanks, f.stats[b].blanks) >= 0.5:
            out.append((a, b, str(n)))
    return f.listed(out)


@check("DF-26", "zero_variance", "columns")
def zero_variance(f: AuditFrame) -> DataFrame:
    return f.listed([(c, None, None) for c, s in f.stats.items() if s.unique == 1])


@check("DF-25", "ragged_rows", "rows")
def ragged_rows(f: AuditFrame) -> DataFrame | None:
    """Rows with more fields than the header; short rows don't count. A table without an overflow column has none."""
    if f.overflow is None:
        return f.listed([])
    over = f.wide.where(F.col(f.overflow) != "")
    return over.select(F.lit("").alias("column"), F.col(f.rid).alias("row"), F.col(f.overflow).alias("value"), F.lit(None).cast("string").alias("detail"))


@check("DF-31", "survey_weights", "columns", "suggestion")
def survey_weights(f: AuditFrame) -> DataFrame | None:
    use = N.survey_weights(f.columns)
    return f.listed([(c, None, None) for c in use]) if use else None


@check("DF-18", "age_as_year", "columns", "error")
def age_as_year(f: AuditFrame) -> DataFrame | None:
    use = f.with_role("AGE")
    if not use:
        return None
    year = int(f.as_of[:4])
    counts = {r.column: (r.y, r.n) for r in f.vc.where(F.col("column").isin(use) & (F.col("v") != "")).groupBy("column").agg(F.sum(F.when(X.is_year(F.col("v"), year), F.col("n")).otherwise(0)).alias("y"), F.sum("n").alias("n")).collect()}
    return f.listed([(c, None, f"{y} {n}") for c, (y, n) in counts.items() if n >= 5 and y / n >= 0.5])


def fences(f: AuditFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Tukey's fences of columns that hold nothing but numbers and codes, from exact quartiles."""
    use = []
    for c in columns:
        s = f.stats[c]
        if s.total - s.nulls and not N.is_pii(c):
            use.append(c)
    if not use:
        return {}
    filled = f.vc.where(F.col("column").isin(use) & (F.col("raw") != "") & code_free(f))
    plain = [r.column for r in filled.groupBy("column").agg(F.count_if(F.col("x").isNull()).alias("other"), F.sum("n").alias("n")).collect() if not r.other and r.n >= 4]
    got = quantiles(counted(f, plain), ["column"], [0.25, 0.75]).collect() if plain else []
    return {r.column: (r.q[0] - 1.5 * (r.q[1] - r.q[0]), r.q[1] + 1.5 * (r.q[1] - r.q[0])) for r in got}


def code_free(f: AuditFrame) -> Column:
    """Rows of ``vc`` that aren't missing-value codes."""
    out = F.lit(False)
    for c, codes in f.sentinels.items():
        out = out | ((F.col("column") == c) & F.col("v").isin(codes))
    return ~out


@check("DF-15", "statistical_outliers", "cells", "suggestion")
def statistical_outliers(f: AuditFrame) -> DataFrame:
    limits = fences(f, f.of_category("free_text"))
    return f.evidence([(c, (f.number(c) < lo) | (f.number(c) > hi), None) for c, (lo, hi) in limits.items()])


@check("DF-16", "top_coding", "cells", "suggestion")
def top_coding(f: AuditFrame) -> DataFrame:
    """Cells at a column's largest value, if one in twenty is."""
    limits = fences(f, f.of_category("free_text"))
    vc = f.vc.where(F.col("column").isin(list(limits)) & code_free(f) & F.col("x").isNotNull())
    tops = vc.groupBy("column").agg(F.max(F.struct("x")).getField("x").alias("top"), F.sum("n").alias("total"))
    at = vc.join(tops, "column").where("x = top").groupBy("column", "top", "total").agg(F.sum("n").alias("n")).collect()
    return f.evidence([(r.column, f.number(r.column) == r.top, None) for r in at if r.n / r.total >= 0.05 and r.n > 1])


@check("DF-36", "heaping", "columns", "suggestion")
def heaping(f: AuditFrame) -> DataFrame | None:
    """Columns of measurements two fifths of which or more end in 0 or 5 at their resolution."""
    use = [c for c in f.of_category("free_text") if f.types[c] != "date" and f.stats[c].numeric >= 50 and not N.is_pii(c)]
    if not use:
        return None
    x, n = F.col("x"), F.col("n")
    part = lambda cond: F.coalesce(F.sum(F.when(cond, n)), F.lit(0))
    aggs = [part(x.isNotNull()).alias("all"), part(x == F.floor(x)).alias("whole"), F.min("x").alias("lo"), F.max("x").alias("hi")]
    for unit in (1, 10, 100, 1000):
        aggs += [part(x % unit == 0).alias(f"u{unit}"), part((x == F.floor(x)) & (F.abs(x) >= 10 * unit)).alias(f"b{unit}"), part((x == F.floor(x)) & (F.abs(x) >= 10 * unit) & (x % (5 * unit) == 0)).alias(f"h{unit}")]
    out = []
    for r in f.vc.where(F.col("column").isin(use) & code_free(f)).groupBy("column").agg(*aggs).collect():
        if r["all"] < 50 or r["whole"] / r["all"] < 0.9:
            continue
        unit = next((u for u in (1000, 100, 10, 1) if r[f"u{u}"] / r["whole"] >= 0.95), 1)
        if r[f"b{unit}"] >= 50 and (r["hi"] - r["lo"]) / unit >= 20 and r[f"h{unit}"] / r[f"b{unit}"] >= 0.4:
            out.append((r.column, str(unit), r6(r[f"h{unit}"] / r[f"b{unit}"])))
    return f.listed(out)


@check("DF-37", "redundant_columns", "columns", "suggestion")
def redundant_columns(f: AuditFrame) -> DataFrame:
    """Pairs of columns that say the same, as they are or one to one, blank counted as a value."""
    use = [c for c, s in f.stats.items() if 1 < s.distinct_cells <= s.total / 2]
    pairs = [(a, b) for a, b in combinations(use, 2) if f.stats[a].distinct_cells == f.stats[b].distinct_cells]
    out = []
    if pairs:
        aggs = []
        for i, (a, b) in enumerate(pairs):
            aggs += [F.count_distinct(F.struct(f.value(a), f.value(b))).alias(f"d{i}"), F.bool_and(f.value(a) == f.value(b)).alias(f"e{i}")]
        got = f.wide.agg(*aggs).first()
        out = [(a, b, "identical" if got[f"e{i}"] else "recoded") for i, (a, b) in enumerate(pairs) if got[f"d{i}"] == f.stats[a].distinct_cells]
    return f.listed(out)


@check("DF-47", "datetime_issues", "columns")
def datetime_issues(f: AuditFrame) -> DataFrame | None:
    use = [c for c, s in f.stats.items() if s.total > s.blanks and s.datetime / (s.total - s.blanks) >= 0.5]
    if not use:
        return None
    v, n = F.col("v"), F.col("n")
    part = lambda i: F.regexp_extract(v, X.DATETIME, i)
    hour, minute, second = (part(i).try_cast("int") for i in (4, 5, 6))
    midnight = (hour == 24) & (minute == 0) & (F.coalesce(second, F.lit(0)) == 0)
    bad = ~midnight & ((hour > 23) | (minute > 59) | (F.coalesce(second, F.lit(0)) > 60))
    zone = F.upper(F.regexp_replace(part(7), ":", ""))
    got = f.vc.where(F.col("column").isin(use) & v.rlike(X.DATETIME)).groupBy("column").agg(
        F.sum(F.when(part(7) == "", n).otherwise(0)).alias("naive"), F.sum(F.when(part(7) != "", n).otherwise(0)).alias("aware"),
        F.count_distinct(F.when(part(7) != "", F.when(zone == "Z", "+0000").otherwise(zone))).alias("zones"), F.sum(F.when(bad, n).otherwise(0)).alias("impossible"),
    )
    out = []
    for r in got.collect():
        if r.naive and r.aware:
            out.append((r.column, "mixed", f"{r.naive} {r.aware}"))
        if r.zones > 1:
            out.append((r.column, "offsets", str(r.zones)))
        if r.impossible:
            out.append((r.column, "impossible", str(r.impossible)))
    return f.listed(out)


@check("DF-11", "temporal_gaps", "columns", "suggestion")
def temporal_gaps(f: AuditFrame) -> DataFrame | None:
    """The longest run without a date, if it is long for the column's rhythm."""
    use = [c for c in f.columns if f.types[c] == "date" and f.roles[c] != "DATE_OF_BIRTH"]
    if not use:
        return None
    dates = f.vc.where(F.col("column").isin(use)).select("column", X.real_date(F.col("v")).alias("d")).where("d is not null").distinct()
    w = Window.partitionBy("column").orderBy("d")
    gaps = dates.withColumn("before", F.lag("d").over(w)).where("before is not null").withColumn("gap", F.datediff("d", "before"))
    counted = gaps.groupBy("column", "gap").agg(F.count("*").alias("n"), F.min("before").alias("start")).collect()  # distinct lengths, not dates
    by: dict[str, list] = {}
    for r in counted:
        by.setdefault(r.column, []).append((r.gap, r.n, r.start))
    out = []
    for c, runs in by.items():
        runs.sort()
        total = sum(n for _, n, _ in runs)
        if total + 1 < 5:
            continue
        at = lambda i: next(g for g, n, _ in cumulative(runs) if n > i)  # noqa: B023, E731
        median = (at((total - 1) // 2) + at(total // 2)) / 2
        least = max(1.75 * median, median + 3)
        usual = [(g, n) for g, n, _ in runs if g < least]
        m = sum(n for _, n in usual)
        if m >= 20:
            mean = sum(g * n for g, n in usual) / m
            sd = math.sqrt(sum(n * (g - mean) ** 2 for g, n in usual) / m)
            if mean > 1 and sd / mean >= 0.3:
                p95 = next(g for g, n, _ in cumulative([(g, n, None) for g, n in usual]) if n > min(m - 1, int(0.95 * m)))
                least = max(least, 1 + math.log(0.05 / total) / math.log(1 - 1 / mean), p95 + 1)
        long, _, start = runs[-1]
        if long >= least:
            out.append((c, start.isoformat(), str(long)))
    return f.listed(out)


def cumulative(runs: list[tuple]) -> list[tuple]:
    out, upto = [], 0
    for g, n, s in runs:
        upto += n
        out.append((g, upto, s))
    return out


def bimodal_splits(f: AuditFrame, columns: list[str]) -> dict[str, tuple[float, float, float, int, int]]:
    """The largest ratio between neighbouring positive values with three or more on each side: ``(below, above, ratio, n below, n above)``."""
    steps = running(counted(f, columns).where("x > 0"), ["column"]).withColumn("under", F.col("upto") - F.col("n"))
    steps = steps.where("under >= 3 and total - under >= 3").withColumn("ratio", F.col("x") / F.col("below"))
    best = steps.groupBy("column").agg(F.max(F.struct("ratio", (-F.col("x")).alias("x"), "below", "under", "total")).alias("b")).collect()
    return {r.column: (r.b.below, -r.b.x, r.b.ratio, r.b.under, r.b.total - r.b.under) for r in best}


def side_medians(f: AuditFrame, splits: dict[str, float], least: float = -math.inf) -> dict[str, tuple[float, float]]:
    """The medians of each column's numbers over ``least`` below and from a split on."""
    at = F.create_map(*(F.lit(v) for kv in splits.items() for v in kv))
    sides = counted(f, list(splits)).where(F.col("x") > least).withColumn("high", F.col("x") >= at[F.col("column")])
    got = {(r.column, r.high): r.q[0] for r in quantiles(sides, ["column", "high"], [0.5]).collect()}
    return {c: (got[c, False], got[c, True]) for c in splits}


@check("DF-17", "mixed_units", "columns", "error")
def mixed_units(f: AuditFrame) -> DataFrame | None:
    """Columns with two clusters whose medians differ by the factor between two units: those, and the boundary."""
    use = f.with_role(*UNITS)
    if not use:
        return None
    out = []
    splits = bimodal_splits(f, use)
    medians = side_medians(f, {c: s[1] for c, s in splits.items()}, 0.0) if splits else {}
    for c, (_, above, ratio, n_low, n_high) in splits.items():
        low_median, high_median = medians[c]
        for low_unit, high_unit, factor in UNITS[f.roles[c]]:
            if ratio >= 1.1 and abs(high_median / low_median - factor) / factor <= 0.05:
                out.append((c, "low" if n_low < n_high else "high", f"{low_unit} {high_unit} {r6(above)}"))
                break
        else:
            split = overlapping_split(f, c)
            if split:
                out.append((c, split[0], f"{split[1]} overlapping {r6(split[2])}"))
    return f.listed(out)


def overlapping_split(f: AuditFrame, column: str) -> tuple[str, str, float] | None:
    """A split of overlapping clusters after which the values spread much less, over ``STATISTICS`` order statistics and ``SPLITS`` splits at most."""
    rows = counted(f, [column]).where("x > 0")
    total = rows.agg(F.sum("n")).first()[0] or 0
    if total < 40:
        return None
    # order statistics at evenly spaced places, all of them if there are no more: a value finds the places it covers
    last = min(total, STATISTICS) - 1
    step = (total - 1) / last
    near = F.sequence(F.greatest(F.floor((F.col("upto") - F.col("n") - 1) / step) - 1, F.lit(0)), F.least(F.ceil(F.col("upto") / step) + 1, F.lit(last)))
    met = running(rows, ["column"]).select("x", "upto", "n", F.explode(near).alias("i"))
    place = F.least(F.col("i") * step, F.lit(float(total - 1)))
    covering = lambda k: F.max(F.when((F.col("upto") > k) & (F.col("upto") - F.col("n") <= k), F.col("x")))
    got = met.groupBy("i").agg(covering(F.floor(place)).alias("low"), covering(F.ceil(place)).alias("high")).collect()
    xs = sorted(r.low + (r.high - r.low) * (r.i * step % 1) for r in got)
    cv = lambda v: math.sqrt(sum((a - sum(v) / len(v)) ** 2 for a in v) / len(v)) / (sum(v) / len(v))
    whole = cv(xs)
    best = None
    for low, high, factor in UNITS[f.roles[column]]:
        for i in range(3, len(xs) - 2, max(1, len(xs) // SPLITS)):
            a, b = xs[:i], xs[i:]
            if abs(b[len(b) // 2] / a[len(a) // 2] - factor) / factor > 0.05:
                continue
            one = [v * factor for v in a] + b if len(a) < len(b) else a + [v / factor for v in b]
            spread = cv(one)
            if spread <= 0.72 * whole and (best is None or spread < best[0]):
                best = (spread, "low" if len(a) < len(b) else "high", f"{low} {high}", b[0])
    return best[1:] if best else None


@check("DF-46", "temperature_units", "cells", "error")
def temperature_units(f: AuditFrame) -> DataFrame | None:
    """Cells of the minority cluster of a temperature column that holds Celsius and Fahrenheit."""
    use = N.named("temperature", f.columns)
    if not use:
        return None
    steps = running(counted(f, use), ["column"]).withColumn("under", F.col("upto") - F.col("n"))
    steps = steps.where("total >= 6 and under >= 3 and total - under >= 3")
    best = {r.column: r.b for r in steps.groupBy("column").agg(F.max(F.struct((F.col("x") - F.col("below")).alias("gap"), "under", "x", "total")).alias("b")).collect()}
    if not best:
        return f.evidence([])
    at = F.create_map(*(F.lit(v) for c, b in best.items() for v in (c, b.x)))
    sides = running(counted(f, list(best)).withColumn("warm", F.col("x") >= at[F.col("column")]), ["column", "warm"])
    middle = {(r.column, r.warm): r.x for r in sides.groupBy("column", "warm", "total").agg(at_place(F.floor(F.col("total") / 2)).alias("x")).collect()}
    found = []
    for c, b in best.items():
        low, high, few_low = middle[c, False], middle[c, True], b.under < b.total - b.under
        if low > 0 and abs((high - 32) / 1.8 - low) / low <= 0.1:
            found.append((c, f.number(c) < b.x if few_low else f.number(c) >= b.x, F.lit("celsius" if few_low else "fahrenheit")))
    return f.evidence(found)


@check("DF-35", "total_mismatch", "rows")
def total_mismatch(f: AuditFrame) -> DataFrame | None:
    """Rows whose total isn't the sum of its parts, where it is in four fifths or more."""
    use = N.total_candidates(f.columns)
    if not use:
        return None
    off = []
    for whole, parts in use:
        t, said = f.number(whole), sum((f.number(p) for p in parts[1:]), f.number(parts[0]))
        off.append(F.abs(t - said) > F.greatest(F.lit(0.01), 0.001 * F.abs(t)))
    got = f.wide.agg(*(agg.alias(f"{k}{i}") for i, bad in enumerate(off) for k, agg in (("n", F.count(bad)), ("bad", F.count_if(bad))))).first()
    sums = [i for i in range(len(use)) if got[f"n{i}"] >= 10 and got[f"bad{i}"] <= 0.2 * got[f"n{i}"]]
    return f.evidence([(use[i][0], off[i], F.lit(",".join(use[i][1]))) for i in sums], alone=False)


@check("DF-32", "group_missingness", "pairs", "suggestion")
def group_missingness(f: AuditFrame) -> DataFrame | None:
    """Columns missing at different rates in the groups of another: its levels, or below its median and from it on."""
    targets = [c for c, s in f.stats.items() if 0 < s.blanks < s.total]
    levels = [c for c in f.of_category("categorical") if 2 <= f.stats[c].distinct <= 10]
    numeric = [c for c in f.of_category("free_text") if f.types[c] == "numeric" or f.stats[c].numeric > 0.8 * f.stats[c].total]
    if not targets or not levels + numeric:
        return None
    rows = sampled(f)
    numbers = F.array(*(F.struct(F.lit(c).alias("column"), f.number(c).alias("x")) for c in numeric)) if numeric else None
    values = None
    if numeric:  # all rows are counted in vc
        values = counted(f, numeric) if rows is f.wide else rows.select(F.explode(numbers).alias("s")).select("s.*").where("x is not null").groupBy("column", "x").agg(F.count("*").alias("n"))
    cuts = {r.column: r.q[0] for r in quantiles(values, ["column"], [0.5]).collect()} if numeric else {}
    groups = {c: F.when(f.value(c) != "", f.value(c)) for c in levels}
    groups |= {c: F.when(f.number(c) < cuts[c], "below").when(f.number(c) >= cuts[c], "from") for c in numeric if c in cuts}
    flags = [F.sum(F.col("gone")[i]).alias(f"t{i}") for i in range(len(targets))]
    gone = F.array(*((f.value(t) == "").cast("int") for t in targets)).alias("gone")
    rows = rows.select(gone, *(g.alias(f"g{i}") for i, g in enumerate(groups.values())))
    sets = F.array(*(F.struct(F.lit(c).alias("by"), F.col(f"g{i}").alias("level")) for i, c in enumerate(groups)))
    got = rows.select(F.explode(F.filter(sets, lambda g: g.level.isNotNull())).alias("g"), "gone").groupBy("g.by", "g.level").agg(F.count("*").alias("n"), *flags).collect()
    out = []
    for i, t in enumerate(targets):
        for c in groups:
            rates = [(r[f"t{i}"] / r.n, r.n, r.level) for r in got if r["by"] == c and r.n >= 20]
            if c == t or not 2 <= len(rates) <= 10:
                continue
            hi, lo = max(rates), min(rates)
            pooled = (hi[0] * hi[1] + lo[0] * lo[1]) / (hi[1] + lo[1])
            se = math.sqrt(pooled * (1 - pooled) * (1 / hi[1] + 1 / lo[1]))
            if hi[0] - lo[0] >= 0.15 and (lo[0] == 0 or hi[0] / lo[0] >= 1.5) and se > 0 and (hi[0] - lo[0]) / se >= 3:
                out.append((t, c, f"{hi[2]} {r6(hi[0])} {lo[2]} {r6(lo[0])}"))
    return f.listed(out)
