"""Programs over two tables: keys they share, orphans, coverage, merging, reconciling, crosswalks.

Keys are compared without white space at the ends; a blank key meets nothing. Where a key repeats, its first row
in source order counts; repeats are removed before the join, so no key multiplies rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions import names as N
from ..plans.frame import AuditFrame


def key_of(column: str) -> Column:
    v = X.strip(F.col(f"`{column}`"))
    return F.when(v != "", v)


def keys(f: AuditFrame, column: str) -> DataFrame:
    return f.wide.select(key_of(column).alias("key")).where("key is not null").groupBy("key").agg(F.count("*").alias("n"))


def first_rows(f: AuditFrame, column: str) -> DataFrame:
    """The first row of each key, found by its smallest row number."""
    first = f.wide.select(key_of(column).alias("__key"), f.rid).where("__key is not null").groupBy("__key").agg(F.min(f.rid).alias("__first"))
    rows = f.wide.withColumn("__key", key_of(column))
    return rows.join(first, (rows["__key"] == first["__key"]) & (rows[f.rid] == first["__first"])).select(rows["*"])


def referential_integrity(parent: AuditFrame, parent_key: str, child: AuditFrame, child_key: str) -> DataFrame:
    """Child keys without a parent, and how many rows have them."""
    return keys(child, child_key).join(keys(parent, parent_key), "key", "left_anti").select("key", "n")


def key_coverage(parent: AuditFrame, parent_key: str, child: AuditFrame, child_key: str) -> DataFrame:
    """Distinct child keys, those with a parent, and their share."""
    theirs = keys(parent, parent_key).select("key", F.lit(1).alias("hit"))
    both = keys(child, child_key).join(theirs, "key", "left")
    return both.agg(F.count("*").alias("distinct_keys"), F.count("hit").alias("covered")).select("distinct_keys", "covered", F.expr("round(try_divide(double(covered), distinct_keys), 6)").alias("coverage"))


def key_cardinality(parent: AuditFrame, parent_key: str, child: AuditFrame, child_key: str) -> DataFrame:
    """How many child rows a parent has at most, and what that makes of the relation."""
    met = keys(child, child_key).join(keys(parent, parent_key).select("key"), "key", "left_semi")
    most = met.agg(F.coalesce(F.max("n"), F.lit(0)).alias("most"), F.count("*").alias("matched"))
    return most.select("most", "matched", F.when(F.col("most") == 0, "no_matches").when(F.col("most") == 1, "one_to_one").otherwise("one_to_many").alias("relation"))


def key_uniqueness(f: AuditFrame, column: str) -> DataFrame:
    k = keys(f, column)
    return k.agg(F.sum("n").alias("total"), F.count("*").alias("distinct_keys"), F.count_if(F.col("n") > 1).alias("duplicated"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("rows_of_duplicated"))


def shared_keys(a: AuditFrame, b: AuditFrame, least: float = 0.5) -> DataFrame:
    """Columns of two tables with the same name, case and underscores aside, or an id's, whose values overlap by half or more.

    ``(column_a, column_b, overlap, distinctness)``; overlap is the share of the smaller set, distinctness the
    larger of both columns' distinct shares, half at least.
    """
    norm = lambda c: c.lower().replace("_", "").replace(" ", "")
    tail = lambda c: norm(c.split("_", 1)[1]) if "_" in c and len(c.split("_", 1)[0]) <= 2 else norm(c)
    pairs = [(x, y) for x in a.columns for y in b.columns if norm(x) == norm(y) or tail(x) == tail(y)]
    out = []
    for x, y in pairs:
        sa, sb = a.stats[x], b.stats[y]
        if min(sa.distinct, sb.distinct) == 0:
            continue
        distinctness = max(sa.distinct / (sa.total - sa.blanks), sb.distinct / (sb.total - sb.blanks))
        if distinctness < 0.5 or (min(a.rows, b.rows) < 20 and not (N.is_id(x) or N.is_id(y))):
            continue
        met = keys(a, x).join(keys(b, y).select("key"), "key", "left_semi").count()
        if met / min(sa.distinct, sb.distinct) >= least:
            out.append((x, y, round(met / min(sa.distinct, sb.distinct), 6), round(distinctness, 6)))
    out.sort(key=lambda r: (-r[2], -r[3], r[0], r[1]))
    return a.spark.createDataFrame(out, "column_a string, column_b string, overlap double, distinctness double")


def merge(parent: AuditFrame, parent_key: str, child: AuditFrame, child_key: str, *, how: str = "left", labels: tuple[str, str] = ("a", "b")) -> DataFrame:
    """Child rows with the columns of their key's first parent row; shared names get a label, the parent's key goes."""
    p, c = labels
    shared = set(parent.columns) & set(child.columns)
    theirs = first_rows(parent, parent_key).select("__key", *(F.col(f"`{x}`").alias(f"{x} ({p})" if x in shared else x) for x in parent.columns if x != parent_key))
    ours = child.wide.select(child.rid, key_of(child_key).alias("__key"), *(F.col(f"`{x}`").alias(f"{x} ({c})" if x in shared - {parent_key} or (x == parent_key and x != child_key and x in shared) else x) for x in child.columns))
    out = ours.join(theirs, "__key", "left" if how == "left" else "inner")
    return out.drop("__key")


def reconcile(a: AuditFrame, key_a: str, b: AuditFrame, key_b: str, columns: list[str]) -> DataFrame:
    """For each column, how many shared records agree and differ: ``(column, matches, discrepancies)``."""
    x = first_rows(a, key_a).select("__key", *(X.strip(F.col(f"`{c}`")).alias(f"a{i}") for i, c in enumerate(columns)))
    y = first_rows(b, key_b).select("__key", *(X.strip(F.col(f"`{c}`")).alias(f"b{i}") for i, c in enumerate(columns)))
    cells = F.array(*(F.struct(F.lit(c).alias("column"), (F.col(f"a{i}") == F.col(f"b{i}")).alias("same")) for i, c in enumerate(columns)))
    both = x.join(y, "__key").select(F.explode(cells).alias("s"))
    return both.groupBy("s.column").agg(F.count_if("s.same").alias("matches"), F.count_if(~F.col("s.same")).alias("discrepancies"))


def repeated_key_consistency(f: AuditFrame, key: str, columns: list[str]) -> DataFrame:
    """Keys on several rows, and for each column how many of those keys hold more than one value."""
    k = f.wide.select(key_of(key).alias("key"), *(X.strip(F.col(f"`{c}`")).alias(f"v{i}") for i, c in enumerate(columns))).where("key is not null")
    # two values differ if the smallest and the largest do: no sets are gathered
    groups = k.groupBy("key").agg(F.count("*").alias("n"), *(F.min(f"v{i}").alias(f"lo{i}") for i in range(len(columns))), *(F.max(f"v{i}").alias(f"hi{i}") for i in range(len(columns)))).where("n > 1")
    cells = F.array(*(F.struct(F.lit(c).alias("column"), (F.col(f"lo{i}") != F.col(f"hi{i}")).alias("differs")) for i, c in enumerate(columns)))
    return groups.select(F.explode(cells).alias("s")).groupBy("s.column").agg(F.count("*").alias("repeated_keys"), F.count_if("s.differs").alias("inconsistent"))


def crosswalk(f: AuditFrame, column_map: dict[str, str], value_map: dict[str, dict[str, str]] | None = None) -> DataFrame:
    """Columns renamed and values recoded for one source; rows are never joined. Values without an entry stay."""
    out = []
    for c in f.columns:
        v = F.col(f"`{c}`")
        codes = (value_map or {}).get(c)
        if codes:
            v = F.coalesce(F.try_element_at(F.create_map(*(F.lit(str(x)) for kv in codes.items() for x in kv)), X.strip(v)), v)
        out.append(v.alias(column_map.get(c, c)))
    return f.wide.select(f.rid, *out)
