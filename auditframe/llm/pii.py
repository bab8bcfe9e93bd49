r"""Personal data: candidate spans, boosted trees, calibrated thresholds; DataFrame operations only.

Generators of high recall propose spans that may overlap. Those of the four strict kinds that pass their
checks are the base and always stay. The others are scored by boosted regression trees over format and
context, and those past a threshold with the wanted precision are added.

What the trees learn is not what the checks say: base spans of the corpus are written otherwise, as people hide or
space them, at their places in their texts; candidates there are personal data, and candidates of the texts as they
are that meet no base span are taken for none. Trees are fitted on counts of feature vectors, of which there are few, from a bounded
sample, and compiled to one SQL expression. Texts are searched once, where they are read, and never shuffled.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch, tasks

KINDS = ("email", "ip", "card", "phone")
#: Java patterns of the generators. Possessive quantifiers keep long runs linear; where a match may start is
#: said by what stands before it or, after a match, by its end.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "mail": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:\(at\)|\[at\]|\{at\}|@)\x20?[A-Za-z0-9-]++(?:\x20?(?:\(dot\)|\[dot\]|\{dot\}|\x20dot\x20|\.)\x20?[A-Za-z0-9-]++)++",
    "quad": r"(?<![0-9])[0-9]++(?:\x20?(?:\(\.\)|\[\.\]|\(dot\)|\[dot\]|\.)\x20?[0-9]++){3}",
    "digits": r"(?<![0-9])[0-9](?:[\x20()./-]{0,3}+[0-9])++",
}
#: What a text must hold for its generator to run.
NEEDS = {
    "email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]", "mail": r"[@(\[{](?:at[)\]}])?",
    "quad": r"[0-9]\x20?[(\[.](?:dot|\.)?[)\]]?\x20?[0-9]", "digits": r"[0-9]{2}|[0-9][\x20()./-]{1,3}[0-9]",
}
#: How a base span is written otherwise, by kind, as pairs of a pattern and what it becomes; each span in one of these ways.
HIDDEN = {
    "email": [[("@", " [at] "), (r"\.", " [dot] ")], [("@", "(at)"), (r"\.", "(dot)")], [("@", " {at} "), (r"\.(?=[^.]*$)", " dot ")], [("@", " @ ")]],
    "ip": [[(r"\.", "[.]")], [(r"\.", " [dot] ")], [(r"\.(?=[^.]*$)", "(.)"), (r"\.(?!\))", "(.)")], [(r"\.", " . ")]],
    "card": [[("[^0-9]", ""), ("([0-9]{4})(?=[0-9])", "$1.")], [("[^0-9]", ""), ("([0-9]{4})(?=[0-9])", "$1 - ")], [("[^0-9]", ""), ("([0-9]{4})(?=[0-9])", "$1/")], [("[^0-9]", ""), ("([0-9]{4})(?=[0-9])", "$1  ")]],
    "phone": [[(r"^\+", "")], [(r"^\+", "00")], [(r"^\+", ""), ("[^0-9]+", ".")], [(r"^\+", "("), (r"[^0-9(]+", ") ")]],
}
#: Distinct feature vectors, most frequent first, that trees are fitted on; candidates they are counted over, and spans written otherwise.
VECTORS, SAMPLE, WRITTEN = 4000, 200_000, 50_000
#: The precision is that on the sample, where hidden personal data of the texts counts as none: that of what is added is higher.
TREES, DEPTH, RATE, PRECISION, SUPPORT = 25, 3, 0.4, 0.8, 20
FEATURES = ("f_kind", "f_digits", "f_length", "f_separators", "f_plus", "f_at", "f_dots", "f_groups", "f_longest", "f_zero", "f_letter_before", "f_letter_after", "f_call", "f_pay", "f_write", "f_line_end")


def candidates(docs: DataFrame) -> DataFrame:
    """``(row, doc_id, kind, start, end, span, before, after, first)`` of every generator's matches, and a row for each text without any.

    Every text has one row that says first; its kind is null if it is no match. Leftmost matches that don't overlap, for each generator; offsets are code points, the end is exclusive.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    parts = []
    for kind, pattern in PATTERNS.items():
        both = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("span"))
        cut = F.transform(both, lambda x: F.struct(F.lit(kind).alias("kind"), F.length(x["gap"]).alias("gap"), x["span"].alias("span"), F.right(x["gap"], F.lit(24)).alias("before"), F.left(x["gap"], F.lit(8)).alias("head")))  # noqa: B023
        none = F.array().cast("array<struct<kind:string,gap:int,span:string,before:string,head:string>>")
        parts.append(F.when(text.rlike(NEEDS[kind]), cut).otherwise(none))
    found = F.when(text.rlike("[0-9@]|[(\\[{]at[)\\]}]"), F.concat(*parts))
    # rows are numbered before their spans are dealt out: in one select, Spark would number the spans
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    rows = numbered.select("row", "doc_id", F.posexplode_outer(found).alias("n", "c"))
    rows = rows.select("row", "doc_id", "n", "c.*").repartition(tasks(docs.sparkSession), "row")
    along = Window.partitionBy("row", "kind").orderBy("n")
    length = F.coalesce(F.length("span"), F.lit(0))
    rows = rows.withColumn("end", F.sum(F.col("gap") + length).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("after", F.lead("head").over(along)).withColumn("start", F.col("end") - length)
    return rows.where("kind is null or span is not null or n = 0").select("row", "doc_id", F.when(F.col("span").isNotNull(), F.col("kind")).alias("kind"), "start", "end", "span", "before", "after", (F.coalesce("n", F.lit(0)) == 0).alias("first"))


def digits_of(span: Column) -> Column:
    return F.regexp_replace(span, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the check digit is right."""
    at = F.sequence(F.lit(1), F.length(digits))

    def step(total: Column, i: Column) -> Column:
        x = F.ascii(F.substring(digits, i, F.lit(1))) - 48
        return total + F.when((F.length(digits) - i) % 2 == 1, 2 * x - F.when(x > 4, 9).otherwise(0)).otherwise(x)

    return F.aggregate(at, F.lit(0), step) % 10 == 0


def passes(kind: Column, span: Column) -> Column:
    """The strict check of a candidate of one of ``KINDS``; false for other generators'."""
    d = digits_of(span)
    parts = F.transform(F.split(span, r"\."), lambda x: F.regexp_replace(x, "^0+(?=[0-9])", ""))
    small = F.forall(parts, lambda x: (F.length(x) < 3) | ((F.length(x) == 3) & (x <= "255")))
    card = F.when(F.length(d).between(14, 19), luhn(d)).otherwise(False)
    return F.when(kind == "email", F.lit(True)).when(kind == "ip", small).when(kind == "card", card).when(kind == "phone", F.length(d).between(10, 15)).otherwise(False)


def featured(rows: DataFrame) -> DataFrame:
    """Small whole numbers about the form of a span and what stands around it."""
    s, before, after = F.col("span"), F.coalesce("before", F.lit("")), F.coalesce("after", F.lit(""))
    flag = lambda c: c.cast("int")
    values = {
        "f_kind": F.when(F.col("kind").isin("mail", "email"), 0).when(F.col("kind").isin("quad", "ip"), 1).otherwise(2),
        "f_longest": F.least(F.array_max(F.transform(F.split(s, r"[^0-9]+"), lambda x: F.length(x))), F.lit(20)),
        "f_zero": flag(s.startswith("0")),
        "f_digits": F.least(F.length(digits_of(s)), F.lit(24)),
        "f_length": F.least(F.floor(F.length(s) / 3), F.lit(16)).cast("int"),
        "f_separators": F.least(F.length(F.regexp_replace(s, r"[^\x20()./-]", "")), F.lit(8)),
        "f_plus": flag(s.startswith("+") | before.endswith("+")),
        "f_at": flag(F.contains(s, F.lit("@"))),
        "f_dots": F.least(F.length(F.regexp_replace(s, r"[^.]", "")), F.lit(5)),
        "f_groups": F.least(F.size(F.split(s, r"[^0-9A-Za-z]+")), F.lit(8)),
        "f_letter_before": flag(before.rlike(r"\p{L}$")),
        "f_letter_after": flag(after.rlike(r"^\p{L}")),
        "f_call": flag(before.rlike(r"(?i)(?:tel|phone|call|fax|mobil|dial|contact)")),
        "f_pay": flag(before.rlike(r"(?i)(?:card|visa|credit|kredit|account|pay)")),
        "f_write": flag(before.rlike(r"(?i)(?:mail|write|contact|reach)")),
        "f_line_end": flag(after.rlike(r"^(?:$|\n)")),
    }
    return rows.withColumns(values)


@dataclass
class Tree:
    """A leaf's value, or a feature, the largest value that goes left, and two trees."""

    value: float = 0.0
    feature: int = -1
    at: int = 0
    left: Tree | None = None
    right: Tree | None = None

    def of(self, x: tuple[int, ...]) -> float:
        return self.value if self.feature < 0 else (self.left if x[self.feature] <= self.at else self.right).of(x)

    def sql(self) -> str:
        return repr(self.value) + "D" if self.feature < 0 else f"(case when {FEATURES[self.feature]} <= {self.at} then {self.left.sql()} else {self.right.sql()} end)"


def grow(x: list[tuple[int, ...]], g: list[float], h: list[float], use: list[int], depth: int) -> Tree:
    """A tree of least squares on gradients ``g`` with weights ``h``."""
    sg, sh = sum(g[i] for i in use), sum(h[i] for i in use)
    leaf = Tree(value=round(RATE * sg / (sh + 1.0), 6))
    if not depth:
        return leaf
    best, pick = 1e-6, None
    for f in range(len(FEATURES)):
        bins: dict[int, list[float]] = {}
        for i in use:
            b = bins.setdefault(x[i][f], [0.0, 0.0])
            b[0] += g[i]
            b[1] += h[i]
        lg = lh = 0.0
        for v in sorted(bins)[:-1]:
            lg, lh = lg + bins[v][0], lh + bins[v][1]
            gain = lg**2 / (lh + 1) + (sg - lg) ** 2 / (sh - lh + 1) - sg**2 / (sh + 1)
            if gain > best:
                best, pick = gain, (f, v)
    if pick is None:
        return leaf
    f, v = pick
    return Tree(feature=f, at=v, left=grow(x, g, h, [i for i in use if x[i][f] <= v], depth - 1), right=grow(x, g, h, [i for i in use if x[i][f] > v], depth - 1))


@dataclass
class Boosted:
    prior: float
    trees: list[Tree]
    #: Log odds from which a span of a kind is added; a kind that isn't here gets none.
    thresholds: dict[str, float]

    def of(self, x: tuple[int, ...]) -> float:
        return self.prior + sum(t.of(x) for t in self.trees)

    def score(self) -> Column:
        return F.expr(" + ".join([f"{self.prior!r}D", *(t.sql() for t in self.trees)]))


def fit(counts: list[tuple[str, tuple[int, ...], int, int, int, int]]) -> Boosted:
    """From ``(kind, features, positives, all, positives held out, all held out)`` of each feature vector.

    Trees are fitted on the first two counts. A kind's threshold lies below the lowest score from which the held-out
    candidates have the wanted precision, if ``SUPPORT`` of them do, halfway to the next one.
    """
    x = [c[1] for c in counts]
    pos, n = [float(c[2]) for c in counts], [float(c[3]) for c in counts]
    rate = (sum(pos) + 1) / (sum(n) + 2)
    model = Boosted(round(math.log(rate / (1 - rate)), 6), [], {})
    z = [model.prior] * len(x)
    for _ in range(TREES if x else 0):
        p = [1 / (1 + math.exp(-max(-40.0, min(40.0, v)))) for v in z]
        tree = grow(x, [a - b * q for a, b, q in zip(pos, n, p, strict=True)], [b * q * (1 - q) for b, q in zip(n, p, strict=True)], list(range(len(x))), DEPTH)
        model.trees.append(tree)
        z = [v + tree.of(f) for v, f in zip(z, x, strict=True)]
    for kind in {c[0] for c in counts}:
        good = total = 0
        mine = sorted(((model.of(c[1]), c[4], c[5]) for c in counts if c[0] == kind), reverse=True)
        for i, (v, a, b) in enumerate(mine):
            good, total = good + a, total + b
            if (i + 1 == len(mine) or mine[i + 1][0] < v) and total >= SUPPORT and good >= PRECISION * total:
                below = mine[i + 1][0] if i + 1 < len(mine) else v - 2
                model.thresholds[kind] = round((v + below) / 2, 6)
    return model


def said_kind(kind: Column) -> Column:
    """The kind of personal data that a candidate would be: by its generator, and by its digits between cards and phones."""
    return F.when(kind.isin("email", "mail"), "email").when(kind.isin("ip", "quad"), "ip").when((kind != "phone") & (F.col("f_digits") >= 14), "card").otherwise("phone")


def written_otherwise(base: DataFrame) -> DataFrame:
    """``(doc_id, text, at)``: places of base spans ``(kind, span, before, after, h)`` with the span as :data:`HIDDEN` writes it."""
    new = F.lit(None).cast("string")
    for kind, ways in HIDDEN.items():
        for i, way in enumerate(ways):
            text = F.col("span")
            for pattern, becomes in way:
                text = F.regexp_replace(text, pattern, becomes)
            new = F.when((F.col("kind") == kind) & (F.pmod("h", F.lit(2 * len(ways))) >= 2 * i), text).otherwise(new)
    before, after = F.coalesce("before", F.lit("")), F.coalesce("after", F.lit(""))
    return base.select(F.col("h").alias("doc_id"), F.concat(before, new, after).alias("text"), F.length(before).alias("at"), (F.length(before) + F.length(new)).alias("upto"), F.col("kind").alias("true_kind"))


def learn(rows: DataFrame, base: DataFrame) -> Boosted:
    """Trees and thresholds from candidates of the texts that meet no base span, and of base spans written otherwise."""
    said = said_kind(F.col("kind"))
    held = lambda h: (F.pmod(h, F.lit(2)) == 1).cast("int")
    none = rows.where("kind is not null and not base and not meets").withColumn("h", F.xxhash64("row", "start", "kind")).orderBy("h", "row", "start", "kind").limit(SAMPLE)
    none = none.select("as_kind", *FEATURES, F.lit(0).alias("truth"), held(F.col("h")).alias("held"))
    texts = written_otherwise(base)
    # a span's hash is its text's id: places are joined to the candidates found there
    found = featured(candidates(texts.select("doc_id", "text")).where("kind is not null")).withColumn("as_kind", said)
    there = texts.groupBy("doc_id").agg(F.min("at").alias("at"), F.min("upto").alias("upto"), F.min("true_kind").alias("true_kind"))
    # a candidate that covers what was written, give or take what stands around it, is personal data of its kind
    met = found.join(there, "doc_id").where("as_kind = true_kind and start <= at + 1 and `end` >= upto - 1")
    met = met.where(~F.coalesce(passes(F.col("kind"), F.col("span")), F.lit(False)))
    met = met.select("as_kind", *FEATURES, F.lit(1).alias("truth"), held(F.col("doc_id")).alias("held"))
    counts = none.unionByName(met).groupBy("as_kind", *FEATURES).agg(F.sum(F.col("truth") * (1 - F.col("held"))), F.sum(1 - F.col("held")), F.sum(F.col("truth") * F.col("held")), F.sum("held"), F.count("*").alias("n"))
    k = len(FEATURES) + 1
    return fit([(r[0], tuple(r[1:k]), *r[k : k + 4]) for r in counts.orderBy(F.desc("n"), "as_kind", *FEATURES).limit(VECTORS).collect()])


def personal_data(docs: DataFrame) -> DataFrame:
    """Personal data in each row of ``docs(doc_id, text)``.

    Returns ``doc_id, n_email, n_ip, n_card, n_phone`` (base spans of each kind), ``base_sha256`` (of the base
    spans as ``kind:start:end``, by start, then kind in the order of ``KINDS``, comma-joined), ``spans`` (all
    spans, joined likewise) and ``n_added``. Added spans overlap no base span and none another: candidates that do are
    one span, of the kind that scores best. Defined cases: a null text is empty; repeated rows get a row each; an empty
    table gives no rows; without candidates or base spans nothing is added; further columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "pii")
    rows = candidates(docs.select("doc_id", "text"))
    rows = featured(rows.withColumn("base", F.coalesce(passes(F.col("kind"), F.col("span")), F.lit(False))))
    rows = rows.withColumn("as_kind", F.when(F.col("base"), F.col("kind")).otherwise(said_kind(F.col("kind"))))
    # whether a span meets a base span of its text: spans in order, the farthest end so far from the left and the nearest
    # start from the right
    by = Window.partitionBy("row").orderBy("start", "end", "kind")
    reach = F.max(F.when(F.col("base"), F.col("end"))).over(by.rowsBetween(Window.unboundedPreceding, -1))
    ahead = F.min(F.when(F.col("base"), F.col("start"))).over(by.rowsBetween(1, Window.unboundedFollowing))
    rows = rows.withColumn("meets", F.coalesce(reach > F.col("start"), F.lit(False)) | F.coalesce(ahead < F.col("end"), F.lit(False)))
    # what the trees may learn from is kept with base spans of a bounded sample of hashes, no more
    kept = F.when(F.col("base"), F.struct("span", "before", "after"))
    rows = scratch.save(rows.withColumn("kept", kept).drop("span", "before", "after"), "candidates")
    base = rows.where("base").select("kind", "kept.*", F.xxhash64("row", "start", "kind").alias("h")).orderBy("h").limit(WRITTEN)
    model = learn(rows, scratch.save(base, "written"))

    least = F.coalesce(*(F.when(F.col("as_kind") == kind, F.lit(v)) for kind, v in sorted(model.thresholds.items())), F.lit(float("inf")))
    rows = rows.drop("kept").withColumn("score", model.score())
    rows = rows.withColumn("extra", F.col("kind").isNotNull() & ~F.col("base") & ~F.col("meets") & (F.col("score") >= least))
    # overlapping ones become one: a span starts a new one if it starts where all before it have ended
    along = Window.partitionBy("row", "extra").orderBy("start", "end", "kind")
    opens = F.coalesce(F.col("start") >= F.max("end").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    rows = rows.withColumn("one", F.when(F.col("extra"), F.sum(opens.cast("int")).over(along)))
    merged = Window.partitionBy("row", "extra", "one")
    best = F.max(F.struct("score", (F.col("end") - F.col("start")).alias("n"), "as_kind")).over(merged)["as_kind"]
    rows = rows.withColumns({"from": F.when(F.col("extra"), F.min("start").over(merged)).otherwise(F.col("start")), "to": F.when(F.col("extra"), F.max("end").over(merged)).otherwise(F.col("end")), "final": F.when(F.col("extra"), best).otherwise(F.col("as_kind"))})
    final = F.col("final")
    place = F.when(final == "email", 0).when(final == "ip", 1).when(final == "card", 2).otherwise(3)
    span = F.struct(F.col("from").alias("start"), place.alias("place"), F.col("to").alias("end"), F.concat_ws(":", final, F.col("from"), F.col("to")).alias("said"))
    listed = lambda c: F.concat_ws(",", F.transform(F.array_sort(c), lambda x: x["said"]))
    out = rows.groupBy("row", "doc_id").agg(
        *(F.count_if(F.col("base") & (F.col("kind") == kind)).alias(f"n_{kind}") for kind in KINDS),
        F.collect_list(F.when(F.col("base"), span)).alias("base_spans"),
        F.collect_set(F.when(F.col("base") | F.col("extra"), span)).alias("all_spans"),
        F.size(F.collect_set(F.when(F.col("extra"), F.col("one")))).cast("long").alias("n_added"),
    )
    return out.select("doc_id", *(f"n_{kind}" for kind in KINDS), F.sha2(listed("base_spans"), 256).alias("base_sha256"), listed("all_spans").alias("spans"), "n_added")
