"""Descriptive insights: associations, trends, concentration, likelihood gaps, summaries.

Pairs of columns are dealt out as keys of one grouped plan; what comes back is a row for each pair or level.
"""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions import names as N
from ..plans.frame import AuditFrame
from .columns import counted, sampled
from .ordered import at_place, quantiles, running


def numeric_columns(f: AuditFrame) -> list[str]:
    return [c for c in f.columns if f.category[c] == "free_text" and f.types[c] == "numeric"][: f.bounds.columns]


def group_columns(f: AuditFrame) -> list[str]:
    return [c for c in f.of_category("categorical") if 2 <= f.stats[c].distinct <= 50][: f.bounds.columns]


def pairs_of(f: AuditFrame, rows: DataFrame, columns: list[str]) -> DataFrame:
    """``(a, b, x, y)`` of rows where both numbers of a pair are there."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :] if not N.related(a, b)]
    values = rows.select(F.array(*(f.number(c) for c in columns)).alias("v"))
    place = {c: i for i, c in enumerate(columns)}
    cells = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col("v")[place[a]].alias("x"), F.col("v")[place[b]].alias("y")) for a, b in pairs))
    return values.select(F.explode(cells).alias("p")).select("p.*").where("x is not null and y is not null")


def spearman(pairs: DataFrame) -> DataFrame:
    """``(a, b, n, rho)`` of ``(a, b, x, y)``: Pearson's correlation of average ranks, from counts of equal pairs of values.

    An average rank is a running count less half the ties, and the mean of ranks is known, so sums stay small.
    """
    joint = pairs.groupBy("a", "b", "x", "y").agg(F.count("*").alias("n"))
    ranked = joint
    for v in ("x", "y"):
        steps = running(joint.groupBy("a", "b", v).agg(F.sum("n").alias("n")), ["a", "b"], v)
        ranked = ranked.join(steps.select("a", "b", v, (F.col("upto") - (F.col("n") - 1) / 2 - (F.col("total") + 1) / 2).alias(f"r{v}")), ["a", "b", v])
    rx, ry, n = F.col("rx"), F.col("ry"), F.col("n")
    return ranked.groupBy("a", "b").agg(F.sum("n").alias("n"), F.try_divide(F.sum(n * rx * ry), F.sqrt(F.sum(n * rx * rx)) * F.sqrt(F.sum(n * ry * ry))).alias("rho"))


def correlations(f: AuditFrame, least: float = 0.3) -> DataFrame:
    """Pairs of numeric columns with thirty rows and a rank correlation of ``least`` or more, over the sampled rows."""
    columns = numeric_columns(f)
    rho = spearman(pairs_of(f, sampled(f), columns))
    return rho.where(f"n >= 30 and abs(rho) >= {least}").select("a", "b", "n", F.round("rho", 6).alias("rho"))


def eta_squared(f: AuditFrame, groups: list[str], measures: list[str]) -> DataFrame:
    """``(measure, by, n, eta2)``: the share of a measure's variation between the groups of five rows or more."""
    rows = sampled(f)
    sets = F.array(*(F.struct(F.lit(g).alias("by"), f.value(g).alias("level")) for g in groups))
    values = F.array(*(F.struct(F.lit(m).alias("measure"), f.number(m).alias("x")) for m in measures))
    long = rows.select(sets.alias("s"), values.alias("v")).select(F.explode("s").alias("s"), "v").select("s.*", F.explode("v").alias("v")).select("by", "level", "v.measure", "v.x").where("level <> '' and x is not null")
    by = long.groupBy("measure", "by", "level").agg(F.count("*").alias("n"), F.sum("x").alias("sx"), F.sum(F.col("x") * F.col("x")).alias("sxx")).where("n >= 5")
    all_ = by.groupBy("measure", "by").agg(F.sum("n").alias("n"), F.sum("sx").alias("sx"), F.sum("sxx").alias("sxx"), F.sum(F.col("sx") * F.col("sx") / F.col("n")).alias("between"), F.count("*").alias("levels"))
    mean = F.col("sx") * F.col("sx") / F.col("n")
    return all_.where("levels >= 2 and n >= 30").select("measure", "by", "n", F.round((F.col("between") - mean) / (F.col("sxx") - mean), 6).alias("eta2")).where("eta2 is not null")


def cramers_v(f: AuditFrame, columns: list[str]) -> DataFrame:
    """``(a, b, n, v)`` of pairs of category columns; the chi-square counts cells that no row has."""
    rows = sampled(f)
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    cells = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), f.value(a).alias("x"), f.value(b).alias("y")) for a, b in pairs))
    joint = rows.select(F.explode(cells).alias("p")).select("p.*").where("x <> '' and y <> ''").groupBy("a", "b", "x", "y").agg(F.count("*").alias("o"))
    w = lambda *c: F.sum("o").over(Window.partitionBy("a", "b", *c))
    m = joint.withColumn("nx", w("x")).withColumn("ny", w("y")).withColumn("n", w())
    # sum over all cells of (o - e)^2 / e is n (sum of o^2 / (nx ny) - 1), where empty cells add nothing
    got = m.groupBy("a", "b", "n").agg(F.sum(F.col("o") * F.col("o") / (F.col("nx") * F.col("ny"))).alias("s"), F.count_distinct("x").alias("kx"), F.count_distinct("y").alias("ky"))
    k = F.least("kx", "ky") - 1
    return got.where("least(kx, ky) >= 2 and n >= 30").select("a", "b", "n", F.round(F.sqrt(F.greatest(F.col("s") - 1, F.lit(0.0)) / k), 6).alias("v"))


def trends(f: AuditFrame, date: str, measures: list[str]) -> DataFrame:
    """``(measure, period, n, mean)`` by year, if dates span two years, else by month."""
    d = f.wide.where(f.value(date).rlike(r"^\d{4}-\d{2}-\d{2}$"))
    lo, hi = d.agg(F.min(f.value(date)), F.max(f.value(date))).first()
    long_ = lo is not None and (int(hi[:4]) - int(lo[:4])) * 365 + (int(hi[5:7]) - int(lo[5:7])) * 30 >= 730
    period = F.substring(f.value(date), 1, 4 if long_ else 7)
    values = F.array(*(F.struct(F.lit(m).alias("measure"), f.number(m).alias("x")) for m in measures))
    long = d.select(period.alias("period"), F.explode(values).alias("v")).select("period", "v.*").where("x is not null")
    return long.groupBy("measure", "period").agg(F.count("*").alias("n"), F.round(F.avg("x"), 6).alias("mean"))


def date_trends(f: AuditFrame, measures: list[str], least: float = 0.3) -> DataFrame:
    """``(date, measure, n, rho, direction)``: rank correlations of measures with a date, ``least`` or more, over thirty rows or more.

    The date is the first date column with thirty ISO dates over two periods (years from two years on, else months).
    """
    dates = [c for c in f.columns if f.types[c] == "date" and f.roles[c] != "DATE_OF_BIRTH"] if measures else []
    spans = [(F.count_if(X.is_iso(f.value(c))), F.min(F.when(X.is_iso(f.value(c)), f.value(c))), F.max(F.when(X.is_iso(f.value(c)), f.value(c)))) for c in dates]
    got = f.wide.agg(*(x.alias(f"{k}{i}") for i, three in enumerate(spans) for k, x in zip(("n", "lo", "hi"), three, strict=True))).first() if dates else None
    for i, c in enumerate(dates):
        if got[f"n{i}"] < 30:
            continue
        first, last = (datetime.date.fromisoformat(got[f"{k}{i}"]) for k in ("lo", "hi"))
        if first.year == last.year and ((last - first).days >= 730 or first.month == last.month):
            continue
        day = F.unix_date(X.real_date(f.value(c))).cast("double")
        values = F.array(*(F.struct(F.lit(m).alias("b"), f.number(m).alias("y")) for m in measures))
        pairs = sampled(f).select(F.lit(c).alias("a"), day.alias("x"), F.explode(values).alias("v")).select("a", "x", "v.*").where("x is not null and y is not null")
        rho = spearman(pairs).where(f"n >= 30 and abs(rho) >= {least}")
        return rho.select(F.col("a").alias("date"), F.col("b").alias("measure"), "n", F.round("rho", 6).alias("rho"), F.when(F.col("rho") > 0, "increasing").otherwise("decreasing").alias("direction"))
    return f.spark.createDataFrame([], "date string, measure string, n long, rho double, direction string")


def concentration(f: AuditFrame, measures: list[str]) -> DataFrame:
    """``(measure, n, share)``: the part of a column's total that its largest tenth of rows holds, from value counts."""
    v = f.vc.where(F.col("column").isin(measures) & (F.col("x") >= 0)).groupBy("column", "x").agg(F.sum("n").alias("n"))
    steps = running(v, ["column"])
    # of a value's rows, those among the last tenth by value
    held = F.greatest(F.lit(0), F.least(F.col("n"), F.col("upto") - (F.col("total") - F.floor(F.col("total") / 10))))
    sums = steps.groupBy(F.col("column").alias("measure"), F.col("total").alias("n")).agg(F.sum(held * F.col("x")).alias("top"), F.sum(F.col("x") * F.col("n")).alias("whole"))
    return sums.where("n >= 30 and whole > 0").select("measure", "n", F.round(F.col("top") / F.col("whole"), 6).alias("share"))


def summaries(f: AuditFrame, measures: list[str]) -> DataFrame:
    """``(measure, n, mean, sd, skew, low, median, high)``; skew is the mean cube of what is left over the sample sd."""
    v = f.vc.where(F.col("column").isin(measures) & F.col("x").isNotNull())
    n, x = F.col("n"), F.col("x")
    s = v.groupBy("column").agg(F.sum("n").alias("all"), (F.sum(n * x) / F.sum("n")).alias("m"), F.min("x").alias("low"), F.max("x").alias("high"))
    middle = quantiles(v.groupBy("column", "x").agg(F.sum("n").alias("n")), ["column"], [0.5]).select("column", F.col("q")[0].alias("median"))
    s = s.join(F.broadcast(middle), "column")
    t = v.join(s, "column").groupBy("column", "all", "m", "low", "high", "median").agg(F.sum(n * F.pow(x - F.col("m"), 2)).alias("s2"), F.sum(n * F.pow(x - F.col("m"), 3)).alias("s3"))
    sd = F.sqrt(F.col("s2") / (F.col("all") - 1))
    out = t.where("all >= 30").select(F.col("column").alias("measure"), F.col("all").alias("n"), F.round("m", 6).alias("mean"), F.round(sd, 6).alias("sd"), F.round(F.col("s3") / F.col("all") / F.pow(sd, 3), 6).alias("skew"), "low", "median", "high")
    return out


def dominant_values(f: AuditFrame) -> DataFrame:
    """``(column, value, share)`` of category columns four fifths of which are one value."""
    use = [c for c in f.of_category("categorical") if f.stats[c].distinct >= 2]
    v = f.vc.where(F.col("column").isin(use) & (F.col("v") != "")).groupBy("column", "v").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("column")
    return v.withColumn("all", F.sum("n").over(w)).where("all >= 30 and n >= 0.8 * all").select("column", F.col("v").alias("value"), F.round(F.col("n") / F.col("all"), 6).alias("share"))


def likelihood_gaps(f: AuditFrame, targets: list[str], groups: list[str]) -> DataFrame:
    """``(target, outcome, by, level, n, rate, overall)``: groups of thirty rows or more where an outcome is half again as likely, with z of 3 or more."""
    rows = sampled(f)
    pairs = [(t, g) for t in targets for g in groups if t != g and not N.related(t, g)]
    cells = F.array(*(F.struct(F.lit(t).alias("target"), F.lit(g).alias("by"), f.value(t).alias("outcome"), f.value(g).alias("level")) for t, g in pairs))
    joint = rows.select(F.explode(cells).alias("p")).select("p.*").where("outcome <> '' and level <> ''").groupBy("target", "by", "outcome", "level").agg(F.count("*").alias("hits"))
    w = lambda *c: F.sum("hits").over(Window.partitionBy("target", "by", *c))
    m = joint.withColumn("n", w("level")).withColumn("of_outcome", w("outcome")).withColumn("all", w())
    rate, overall = F.col("hits") / F.col("n"), F.col("of_outcome") / F.col("all")
    rest = (F.col("of_outcome") - F.col("hits")) / (F.col("all") - F.col("n"))
    se = F.sqrt(overall * (1 - overall) * (1 / F.col("n") + 1 / (F.col("all") - F.col("n"))))
    m = m.withColumns({"rate": rate, "overall": overall, "z": (rate - rest) / se})
    m = m.where("n >= 30 and all > n and overall between 0.03 and 0.7 and rate >= 1.5 * overall and z >= 3")
    best = m.withColumn("r", F.row_number().over(Window.partitionBy("target", "by").orderBy(F.desc("z"), "outcome", "level"))).where("r = 1")
    return best.select("target", "outcome", "by", "level", "n", F.round("rate", 6).alias("rate"), F.round("overall", 6).alias("overall"))


def standardized_ratio(f: AuditFrame, group: str, level: str, target: str, outcome: str, stratum: str) -> DataFrame:
    """Observed over expected outcomes of a group, expected from the rates of the others in each stratum: ``(observed, expected, ratio, coverage)``."""
    rows = sampled(f).select((f.value(group) == level).alias("mine"), (f.value(target) == outcome).cast("int").alias("hit"), f.value(stratum).alias("s")).where("s <> ''")
    by = rows.groupBy("s").agg(F.count_if("mine").alias("n"), F.coalesce(F.sum(F.when(F.col("mine"), F.col("hit"))), F.lit(0)).alias("got"), F.count_if(~F.col("mine")).alias("others"), F.avg(F.when(~F.col("mine"), F.col("hit"))).alias("rate"))
    total = by.agg(F.sum("n").alias("all"), F.sum(F.when(F.col("others") >= 10, F.col("n"))).alias("n"), F.sum(F.when(F.col("others") >= 10, F.col("got"))).alias("observed"), F.sum(F.when(F.col("others") >= 10, F.col("n") * F.col("rate"))).alias("expected"))
    return total.select("observed", F.round("expected", 6).alias("expected"), F.round(F.try_divide("observed", "expected"), 6).alias("ratio"), F.round(F.try_divide("n", "all"), 6).alias("coverage"))


def quantile_bands(f: AuditFrame, column: str, bands: int = 5) -> DataFrame:
    """``(band, n)``: values cut at the ordered values ``n * b // bands``, from value counts."""
    v = f.vc.where((F.col("column") == column) & F.col("x").isNotNull()).groupBy("column", "x").agg(F.sum("n").alias("n"))
    steps = running(v, ["column"])
    cuts = steps.groupBy("column").agg(*(at_place(F.floor(F.col("total") * b / bands)).alias(f"cut{b}") for b in range(1, bands)))
    band = sum(((F.col("x") >= F.col(f"cut{b}")).cast("int") for b in range(1, bands)), F.lit(0))
    return v.join(F.broadcast(cuts), "column").withColumn("band", band).groupBy("band").agg(F.sum("n").alias("n"))
