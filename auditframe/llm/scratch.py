"""Shared helpers: intermediate tables in the folder the cluster shares, and connected components.

Intermediate results are Parquet tables below ``spark.checkpoint.dir``. They cut lineage, survive a
lost executor and are readable by every executor and the driver. What an operator leaves goes when the process ends.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.shared import delete, new_path


class Scratch:
    """Named Parquet tables of one operator run; ``drop`` removes those that no later step reads."""

    def __init__(self, spark: SparkSession, operator: str) -> None:
        self.spark = spark
        self.root = new_path(spark, operator)

    def save(self, frame: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        frame.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(frame.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            delete(self.spark, f"{self.root}/{name}")


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def components(scratch: Scratch, edges: DataFrame, name: str = "cc", rounds: int = 60) -> DataFrame:
    """Smallest reachable id of every node of ``edges(a, b)``, as ``(id, component)``.

    Alternating large-star and small-star over tables in the shared folder: each round hangs a node's
    neighbours on the smallest id it knows, until the edge list stops changing. Minima are pre-aggregated
    before they are shuffled and neighbours are joined, never gathered, so a hub costs no more than its edges.
    """
    spark = scratch.spark

    def hang(links: DataFrame, large: bool) -> DataFrame:
        both = links.select("a", "b")
        if large:
            both = both.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        else:
            both = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        least = least.select("a", F.least("a", "m").alias("m"))
        # the minima stand by ``a``; a key of its own makes the join deal both sides anew, so that Spark can split a hub
        key = F.xxhash64("a")
        hub = least.select(key.alias("k"), F.col("a").alias("c"), "m")
        moved = both.withColumn("k", key).join(hub, "k").where("a = c").drop("k", "c")
        if large:
            moved = moved.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            moved = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        return moved.where("a <> b").distinct()

    mark = lambda t: tuple(t.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first())
    now = scratch.save(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-0")
    was, k = None, 0
    while k < rounds:
        k += 1
        after = scratch.save(hang(hang(now, True), False), f"{name}-{k}")
        if k > 1:
            scratch.drop(f"{name}-{k - 1}")
        now, seen = after, mark(after)
        if seen == was or seen[0] == 0:
            break
        was = seen
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    ends = edges.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    return ends.join(now.select(F.col("a").alias("id"), F.col("b").alias("component")), "id", "left").select("id", F.coalesce("component", "id").alias("component"))
