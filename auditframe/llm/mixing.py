"""Mixing sources to target weights, with DataFrame operations only.

Every document gets a hash-random key. Keys are uniform, so equal key ranges are an even range sort of each
source, a hot one included: word counts are summed by (source, key range), prefix sums over the ranges of a
source find the range its budget ends in, and only the rows of that range are sorted to find the exact cut.
What results is one row per source, so documents are compared with their source's cut where they stand and
texts are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

WORD = r"[^\x20\x09-\x0D]+"
#: Hexadecimal digits of the key that name a range: 4096 ranges a source.
RANGE_DIGITS = 3


def words(text: Column) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix_key(doc_id: Column, source: Column, seed: int) -> Column:
    """32 hexadecimal digits, uniform over documents, the same in each run."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("")), F.coalesce(source, F.lit(""))))


def cyclic_weights(sources: DataFrame, cycle: int = 3) -> DataFrame:
    """``(source, weight)``: sources by code point, null last, weigh 1..cycle, repeating. One row per source."""
    at = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last()))
    return sources.select("source").distinct().select("source", ((at - 1) % cycle + 1).cast("double").alias("weight"))


def targets(totals: DataFrame, weights: DataFrame, share: float = 1.0, max_epochs: int = 3) -> DataFrame:
    """``(source, source_size, target)`` from ``totals(source, source_size)``.

    ``share`` of all words is dealt by weight. A target stops at ``max_epochs`` times its source, and what is
    over goes to the others by weight: with sources in the order of limit by weight, the full ones are a
    prefix, and what is left by the weights of the rest is everyone else's rate. Works on one row per source.
    """
    t = totals.alias("t").join(weights.alias("w"), F.col("t.source").eqNullSafe(F.col("w.source"))).select("t.source", "source_size", "weight")
    one = Window.partitionBy(F.lit(0))
    order = one.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    t = t.withColumn("limit", (F.col("source_size") * max_epochs).cast("double"))
    t = t.withColumn("pool", F.sum("source_size").over(one).cast("double") * F.lit(float(share)))
    t = t.withColumn("before", F.coalesce(F.sum("limit").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    t = t.withColumn("open", F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    t = t.withColumn("rate", (F.col("pool") - F.col("before")) / F.col("open"))
    t = t.withColumn("rate", F.max(F.when(F.col("rate") * F.col("weight") <= F.col("limit"), F.col("rate"))).over(one))
    return t.select("source", "source_size", F.least("limit", F.coalesce(F.col("rate") * F.col("weight"), F.col("limit"))).alias("target"))


def cuts(sized: DataFrame, weights: DataFrame, share: float = 1.0, max_epochs: int = 3) -> DataFrame:
    """One row per source of ``sized(source, size, key)``: how many whole epochs it gives and where the last one ends.

    ``epochs`` whole passes, then every key below ``cut_key``; the words of ``cut_key`` itself (``cut_size``
    of them) give ``cut_words``.
    """
    ranges = sized.groupBy("source", F.substring("key", 1, RANGE_DIGITS).alias("span")).agg(F.sum("size").alias("words"))
    totals = ranges.groupBy("source").agg(F.sum("words").alias("source_size"))
    plan = targets(totals, weights, share, max_epochs)
    plan = plan.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    plan = plan.withColumn("rest", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
    by = Window.partitionBy("source").orderBy("span").rowsBetween(Window.unboundedPreceding, 0)
    upto = ranges.withColumn("upto", F.sum("words").over(by)).alias("r")
    p = plan.alias("p")
    ends = upto.join(p, F.col("r.source").eqNullSafe(F.col("p.source"))).where("rest > 0 and upto >= rest and upto - words < rest")
    ends = ends.select("p.source", "span", "rest", (F.col("upto") - F.col("words")).alias("before")).alias("e")
    s = sized.alias("s")
    near = s.join(ends, F.col("s.source").eqNullSafe(F.col("e.source")) & (F.substring("s.key", 1, RANGE_DIGITS) == F.col("e.span")))
    near = near.groupBy(F.col("e.source").alias("source"), "rest", "before", "key").agg(F.sum("size").alias("cut_size"))
    along = Window.partitionBy("source").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    near = near.withColumn("end", F.col("before") + F.sum("cut_size").over(along))
    near = near.where("`end` >= rest and `end` - cut_size < rest")
    near = near.select("source", F.col("key").alias("cut_key"), "cut_size", (F.col("rest") - F.col("end") + F.col("cut_size")).alias("cut_words")).alias("n")
    return p.join(near, F.col("p.source").eqNullSafe(F.col("n.source")), "left").select("p.source", "source_size", "target", "epochs", "cut_key", "cut_size", "cut_words")


def mix(docs: DataFrame, weights: DataFrame | None = None, *, share: float = 1.0, max_epochs: int = 3, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """The measured documents and the cuts of ``docs(doc_id, text, source)``.

    Returns ``(doc_id, source, size, key, source_size, target, epochs, taken)`` for every row, and the table
    of :func:`cuts`. Defined cases: a null or blank text has size 0 and takes 0; null is a source like any
    other; rows that repeat a doc_id share a key and, at the cut, split its words in proportion; an empty
    table gives no rows; further columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    sized = docs.select("doc_id", "source", words(F.col("text")).alias("size"), mix_key(F.col("doc_id"), F.col("source"), seed).alias("key"))
    sized = scratch.save(sized, "sized")
    weights = cyclic_weights(sized) if weights is None else weights
    at = scratch.save(cuts(sized, weights, share, max_epochs), "cuts")
    s, c = sized.alias("s"), at.alias("c")
    part = F.when(F.col("key") < F.col("cut_key"), F.col("size")).when(F.col("key") == F.col("cut_key"), F.expr("size * cut_words div greatest(cut_size, 1)")).otherwise(0)
    out = s.join(c, F.col("s.source").eqNullSafe(F.col("c.source")))
    return out.select("doc_id", "s.source", "size", "key", "source_size", "target", "epochs", (F.col("epochs") * F.col("size") + part).cast("long").alias("taken")), at


def mixed(docs: DataFrame, weights: DataFrame | None = None, *, share: float = 1.0, max_epochs: int = 3, seed: int = 0) -> DataFrame:
    """The mix itself: rows of ``docs``, all columns, each as often as the mix takes it, whole texts only.

    The document a budget ends in is taken if at least half of it is within the budget.
    """
    _, at = mix(docs, weights, share=share, max_epochs=max_epochs, seed=seed)
    d, c = docs.withColumn("__key", mix_key(F.col("doc_id"), F.col("source"), seed)).alias("d"), at.alias("c")
    extra = F.col("__key") < F.col("cut_key")
    extra = extra | ((F.col("__key") == F.col("cut_key")) & (F.col("cut_words") * 2 >= F.col("cut_size")))
    copies = F.col("epochs") + F.coalesce(extra, F.lit(False)).cast("long")
    out = d.join(c, F.col("d.source").eqNullSafe(F.col("c.source"))).withColumn("__copies", copies).where("__copies > 0")
    out = out.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int"))))
    return out.select(*(F.col(f"d.`{x}`") for x in docs.columns))
