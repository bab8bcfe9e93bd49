"""What a table says: adjusted statistics, verdicts about confounders, cards in order of weight, coded units.

Statistics within strata are the same grouped plans with the stratum in the key; verdicts and the choice of cards
are arithmetic on the few rows those plans return.
"""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions import names as N
from ..plans.frame import AuditFrame
from . import statistics as S
from .columns import counted, sampled
from .ordered import quantiles

#: Lift from which a likelihood is told; cards in all, of a kind, and about the same columns.
LIFT, CARDS, OF_KIND, OF_PAIR = 1.5, 12, 4, 2


def stratified(f: AuditFrame, column: str) -> DataFrame:
    """The sampled rows with their stratum ``__s``: categories as they are, with those on fewer than ten rows pooled; numbers in five bands."""
    if f.types[column] == "numeric" and f.category[column] == "free_text":
        got = quantiles(f.vc.where((F.col("column") == column) & F.col("x").isNotNull()), ["column"], [b / 5 for b in range(1, 5)]).first()
        q = got.q if got else []
        return sampled(f).withColumn("__s", sum(((f.number(column) >= c).cast("int") for c in q), F.lit(0)).cast("string"))
    few = f.vc.where((F.col("column") == column) & (F.col("v") != "")).groupBy(F.col("v").alias("__few")).agg(F.sum("n").alias("__n")).where("__n < 10")
    rows = sampled(f).withColumn("__v", f.value(column)).join(few, F.col("__v") == F.col("__few"), "left")
    return rows.withColumn("__s", F.when(F.col("__few").isNotNull(), "other").otherwise(F.col("__v"))).drop("__v", "__few", "__n")


def within_strata_spearman(f: AuditFrame, a: str, b: str, by: str) -> DataFrame:
    """``(a, b, n, rho)``: rank correlations inside strata of ten rows or more, weighed by their rows."""
    rows = stratified(f, by).select(F.lit(a).alias("a"), F.col("__s").alias("b"), f.number(a).alias("x"), f.number(b).alias("y")).where("b <> '' and x is not null and y is not null")
    each = S.spearman(rows).where("n >= 10 and rho is not null and not isnan(rho)")
    return each.agg(F.sum("n").alias("n"), F.round(F.try_divide(F.sum(F.col("n") * F.col("rho")), F.sum("n")), 6).alias("rho")).select(F.lit(a).alias("a"), F.lit(b).alias("b"), "n", "rho")


def within_strata_eta_squared(f: AuditFrame, measure: str, group: str, by: str) -> DataFrame:
    """``(measure, by, n, eta2)``: variation between groups inside strata over all variation inside strata."""
    rows = stratified(f, by).select(F.col("__s").alias("s"), f.value(group).alias("g"), f.number(measure).alias("x")).where("s <> '' and g <> '' and x is not null")
    cell = rows.groupBy("s", "g").agg(F.count("*").alias("n"), F.sum("x").alias("sx"), F.sum(F.col("x") * F.col("x")).alias("sxx"))
    each = cell.groupBy("s").agg(F.sum("n").alias("n"), (F.sum(F.col("sx") * F.col("sx") / F.col("n")) - F.sum("sx") * F.sum("sx") / F.sum("n")).alias("between"), (F.sum("sxx") - F.sum("sx") * F.sum("sx") / F.sum("n")).alias("total")).where("n >= 10")
    return each.agg(F.sum("n").alias("n"), F.round(F.try_divide(F.sum("between"), F.sum("total")), 6).alias("eta2")).select(F.lit(measure).alias("measure"), F.lit(group).alias("by"), "n", "eta2")


def epsilon_squared(f: AuditFrame, groups: list[str], measures: list[str]) -> DataFrame:
    """Eta squared without what groups explain by chance, zero at least: ``(measure, by, n, epsilon2)``."""
    eta = S.eta_squared(f, groups, measures)
    levels = f.spark.createDataFrame([(g, f.stats[g].distinct) for g in groups], "by string, k long")
    e = F.col("eta2") - (1 - F.col("eta2")) * (F.col("k") - 1) / (F.col("n") - F.col("k"))
    return eta.join(F.broadcast(levels), "by").where("n > k").select("measure", "by", "n", F.round(F.greatest(F.lit(0.0), e), 6).alias("epsilon2"))


def determines(f: AuditFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """``(by, target, lambda)``: how much better a target is guessed by its most frequent value in each group than overall."""
    cells = F.array(*(F.struct(F.lit(g).alias("by"), F.lit(t).alias("target"), f.value(g).alias("x"), f.value(t).alias("y")) for g, t in pairs))
    joint = sampled(f).select(F.explode(cells).alias("p")).select("p.*").where("x <> '' and y <> ''").groupBy("by", "target", "x", "y").agg(F.count("*").alias("n"))
    best = joint.groupBy("by", "target", "x").agg(F.max("n").alias("m"), F.sum("n").alias("n")).groupBy("by", "target").agg(F.sum("m").alias("m"), F.sum("n").alias("n"))
    mode = joint.groupBy("by", "target", "y").agg(F.sum("n").alias("n")).groupBy("by", "target").agg(F.max("n").alias("top"))
    return best.join(mode, ["by", "target"]).select("by", "target", F.round(F.coalesce(F.try_divide(F.col("m") - F.col("top"), F.col("n") - F.col("top")), F.lit(0.0)), 6).alias("lambda"))


def part_of_whole(f: AuditFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """``(a, b, share)``: on how many of the rows with both numbers a is at most b."""
    aggs = [F.round(F.avg((f.number(a) <= f.number(b)).cast("int")), 6).alias(str(i)) for i, (a, b) in enumerate(pairs)]
    got = f.wide.agg(*aggs).first()
    return f.spark.createDataFrame([(a, b, got[str(i)]) for i, (a, b) in enumerate(pairs)], "a string, b string, share double")


def effect_verdict(crude: float, adjusted: float, floor: float) -> str:
    """Whether an effect is explained by a confounder, partly, or holds, from its size before and after adjustment."""
    left = 0.5 if crude >= floor else 0.25
    gone = crude > 0 and adjusted < floor and adjusted <= left * crude
    return "explained" if gone else "partly" if adjusted < 0.5 * crude else "holds"


def ratio_verdict(crude: float, adjusted: float) -> str:
    """The same for a ratio, by its excess over one."""
    left = 0.5 if crude >= LIFT else 0.25
    gone = adjusted < LIFT and adjusted - 1 <= left * (crude - 1)
    return "explained" if gone else "partly" if adjusted - 1 < 0.5 * (crude - 1) else "holds"


def clip(x: float) -> float:
    return round(min(1.0, max(0.0, x)), 6)


def cards(f: AuditFrame) -> list[dict[str, Any]]:
    """What is worth telling, with scores from 0 to 1, before the choice of :func:`select_cards`."""
    numeric, groups = S.numeric_columns(f), [c for c in S.group_columns(f) if f.types[c] == "categorical"][: f.bounds.likelihood]
    out: list[dict[str, Any]] = []

    def tell(kind: str, columns: tuple[str, ...], score: float, text: str) -> None:
        out.append({"kind": kind, "columns": columns, "score": clip(score), "text": text})

    for r in S.dominant_values(f).collect():
        tell("dominant", (r.column,), 0.2 + r.share - 0.8, f"{r.column} is {r.value} on {r.share:.0%} of rows")
    if len(numeric) > 1:
        for r in S.correlations(f).collect():
            tell("relationship", (r.a, r.b), 0.3 + 0.6 * abs(r.rho), f"{r.a} and {r.b} go {'together' if r.rho > 0 else 'apart'} (rho {r.rho:.2f})")
    if numeric:
        for r in S.concentration(f, numeric).where("share >= 0.3").collect():
            tell("concentration", (r.measure,), 0.35 + 0.8 * (r.share - 0.3), f"a tenth of rows hold {r.share:.0%} of {r.measure}")
        for r in S.summaries(f, numeric).collect():
            tell("distribution", (r.measure,), 0.25, f"{r.measure}: median {r['median']:g}, mean {r['mean']:g}")
    if numeric and groups:
        for r in S.eta_squared(f, groups, numeric).where("eta2 >= 0.06").collect():
            tell("group difference", (r.measure, r["by"]), 0.3 + 0.6 * r.eta2**0.5, f"{r.measure} differs by {r['by']} (eta squared {r.eta2:.2f})")
    if len(groups) > 1:
        targets = [c for c in groups if f.stats[c].distinct <= 6]
        for r in S.likelihood_gaps(f, targets, groups).collect() if targets else []:
            tell("likelihood", (r.target, r["by"]), 0.35 + min(r.rate - r.overall, 0.4) + min(r.rate / r.overall - 1, 3) / 12, f"{r.target} is {r.outcome} on {r.rate:.0%} where {r['by']} is {r.level}, {r.overall:.0%} overall")
    return out


def select_cards(told: list[dict[str, Any]]) -> list[dict[str, Any]]:
    """The best cards: few of a kind, few about the same columns; ties by kind and columns."""
    out: list[dict[str, Any]] = []
    kinds: dict[str, int] = {}
    pairs: dict[frozenset, int] = {}
    for c in sorted(told, key=lambda c: (-c["score"], c["kind"], c["columns"])):
        k, p = c["kind"], frozenset(c["columns"])
        if len(out) < CARDS and kinds.get(k, 0) < OF_KIND and pairs.get(p, 0) < OF_PAIR:
            out.append(c)
            kinds[k], pairs[p] = kinds.get(k, 0) + 1, pairs.get(p, 0) + 1
    return out


def key_insights(f: AuditFrame) -> DataFrame:
    rows = [(c["kind"], ",".join(c["columns"]), c["score"], c["text"]) for c in select_cards(cards(f))]
    return f.spark.createDataFrame(rows, "kind string, columns string, score double, text string")


def coded_ranges(labels: dict[str, dict[str, str]]) -> dict[str, tuple[float, float, float, str]]:
    """``{column: (low, high, offset, unit)}`` of codebook rows for a range whose label names a unit and what is to be taken off."""
    out = {}
    for column, codes in labels.items():
        for code, label in codes.items():
            span = re.fullmatch(r"\s*(\d+(?:\.\d+)?)\s*-\s*(\d+(?:\.\d+)?)\s*", code)
            off = re.search(r"value\s*(?:minus|-|−)\s*(\d+(?:\.\d+)?)", label, re.I)
            unit = "kg" if re.search(r"\b(kg|kilograms?)\b", label, re.I) else "cm" if re.search(r"\b(cm|centimet(er|re)s?)\b", label, re.I) else None
            if span and off and unit and float(span[1]) < float(span[2]):
                out[column] = (float(span[1]), float(span[2]), float(off[1]), unit)
    return out


def fix_coded_units(c: Column, column: str, spec: tuple[float, float, float, str]) -> Column:
    """Cells of a coded range in the column's own unit: pounds from kilograms; feet and inches (511 is 5 ft 11 in) or inches from centimetres."""
    low, high, offset, unit = spec
    x = X.number(c)
    m = x - offset
    inches = F.bround(m / 2.54, 0).cast("int")
    if unit == "kg" and re.search(r"(^|_)(lb|lbs|pounds?)(_|$)", column, re.I):
        new = F.bround(m * 2.20462, 0).cast("int").cast("string")
    elif unit == "cm" and re.search(r"(^|_)ft_?in(_|$)", column, re.I):
        new = F.concat(F.floor(inches / 12).cast("string"), F.lpad((inches % 12).cast("string"), 2, "0"))
    elif unit == "cm" and re.search(r"(^|_)(in|inch|inches)(_|$)", column, re.I):
        new = inches.cast("string")
    else:
        return c
    return F.when(x.between(low, high), new).otherwise(c)


def looks_like_codes(f: AuditFrame, column: str) -> bool:
    """Whole numbers of which there are few: twelve at most, or twenty that come back ten times each."""
    s = f.stats[column]
    n = s.total - s.blanks
    if not n or s.numeric != n:
        return False
    whole = f.vc.where((F.col("column") == column) & F.col("x").isNotNull()).agg(F.bool_and(F.col("x") == F.floor("x"))).first()[0]
    return bool(whole) and (s.distinct <= 12 and s.distinct < n or s.distinct <= 20 and n / s.distinct >= 10)


def monotone(f: AuditFrame, columns: list[str], span: int = 1 << 20) -> set[str]:
    """Columns whose numbers only rise, or only fall, in row order. Rows are compared within ranges of ``span`` row numbers, and then range with range."""
    if not columns:
        return set()
    numbers = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), f.number(c).alias("x")) for c in columns))).alias("s")
    rows = f.wide.select(F.col(f.rid).alias("rid"), numbers).select("rid", F.expr(f"rid div {span}").alias("span"), "s.*").where("x is not null")
    rows = rows.withColumn("last", F.lag("x").over(Window.partitionBy("column", "span").orderBy("rid")))
    along = lambda x: (F.bool_and(F.coalesce(x >= F.col("last"), F.lit(True))), F.bool_and(F.coalesce(x <= F.col("last"), F.lit(True))))
    up, down = along(F.col("x"))
    ranges = rows.groupBy("column", "span").agg(F.min_by("x", "rid").alias("start"), F.max_by("x", "rid").alias("end"), up.alias("up"), down.alias("down"))
    ranges = ranges.withColumn("last", F.lag("end").over(Window.partitionBy("column").orderBy("span")))
    up, down = along(F.col("start"))
    return {r.column for r in ranges.groupBy("column").agg((F.bool_and("up") & up | F.bool_and("down") & down).alias("one_way")).where("one_way").collect()}


def blank_only_where(f: AuditFrame, column: str, numeric: list[str]) -> DataFrame:
    """``(by, low, high)``: numeric columns whose values on rows where ``column`` is blank lie apart from all others, five rows on each side.

    A column that counts rows, nearly all distinct and rising or falling down the table, says nothing but where blanks begin.
    """
    gone = f.value(column) == ""
    aggs = []
    for i, c in enumerate(numeric):
        x = f.number(c)
        for k, cond in (("b", gone), ("f", ~gone)):
            v = F.when(cond, x)
            aggs += [F.min(v).alias(f"lo{k}{i}"), F.max(v).alias(f"hi{k}{i}"), F.count(v).alias(f"n{k}{i}")]
    got = f.wide.agg(*aggs).first() if aggs else None
    out = []
    for i, c in enumerate(numeric):
        if c != column and got[f"nb{i}"] >= 5 and got[f"nf{i}"] >= 5 and (got[f"hib{i}"] < got[f"lof{i}"] or got[f"lob{i}"] > got[f"hif{i}"]):
            out.append((c, got[f"lob{i}"], got[f"hib{i}"]))
    counts_rows = monotone(f, [c for c, *_ in out if f.stats[c].distinct >= 0.9 * f.stats[c].numeric])
    out = [x for x in out if x[0] not in counts_rows]
    return f.spark.createDataFrame(out, "by string, low double, high double")


def impute_value(f: AuditFrame, column: str) -> str | None:
    """What an approved fill would write: the median of a numeric column to four places, else the most frequent value, of equals the first."""
    v = f.vc.where((F.col("column") == column) & (F.col("v") != ""))
    if f.types[column] == "numeric":
        got = quantiles(counted(f, [column]), ["column"], [0.5]).first()
        return None if got is None else f"{round(got.q[0], 4):g}"
    top = v.groupBy("v").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "v").first()
    return None if top is None or N.is_pii(column) else top.v


def is_fill_candidate(f: AuditFrame, column: str) -> bool:
    """Whether filling a column's blanks makes sense: it holds numbers, or categories each of which comes back once on average."""
    s = f.stats[column]
    filled = s.total - s.blanks
    return filled > 0 and (f.types[column] == "numeric" or f.types[column] == "categorical" and s.distinct <= max(2, filled // 2))
