"""A bounded sample of documents of each class, by a hash of doc_id: two jobs, however many classes there are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sample_ids(rows: DataFrame, label: str, sample: int, chars: int, seed: int, classes: int, total: int) -> dict[tuple, None]:
    """``(class, doc_id)`` of at most ``sample`` documents of each class of ``rows(label, doc_id, n)`` and ``chars`` characters of each.

    Counts say what share of a class is twice the sample; the documents whose hash is below that share are read, and the
    first by hash are taken. A class whose first document is longer than its characters gets the shortest one read. With
    many classes each has its part of ``total`` characters. Rows that repeat a doc_id are one. More than ``classes`` classes are a
    ValueError.
    """
    one = rows.groupBy(label, "doc_id").agg(F.max("n").alias("n")).withColumn("h", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)))
    counts = one.groupBy(label).agg(F.count("*").alias("count")).orderBy(F.desc("count"), label).limit(classes + 1).collect()
    if len(counts) > classes:
        raise ValueError(f"{label} has more than {classes} values; none is left out, so raise the bound or merge some")
    if not counts:
        return {}
    chars = min(chars, total // len(counts))
    sample = max(1, min(sample, chars // 1000))
    least = min(1.0, 2 * sample / counts[-1]["count"]) * (1 << 30)
    shares = rows.sparkSession.createDataFrame([(r[0], min(1.0, 2 * sample / r["count"]) * (1 << 30)) for r in counts], one.select(F.col(label).alias("__of"), F.lit(0.0).alias("__share")).schema)
    some = one.where(F.col("h") < least).join(F.broadcast(shares), F.col(label) == F.col("__of")).where("h < __share").select(label, "h", "doc_id", "n").collect()
    read: dict[object, list] = {}
    for r in sorted(some, key=lambda r: (r.h, r.doc_id)):
        read.setdefault(r[0], []).append(r)
    out: dict[tuple, None] = {}
    for value, mine in read.items():
        room, taken = chars, []
        for r in mine:
            if len(taken) < sample and r.n <= room:
                room -= r.n
                taken.append(r)
        out.update(dict.fromkeys((value, r.doc_id) for r in taken or [min(mine, key=lambda r: r.n)]))
    return out
