"""Connected components of an edge table, by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blamesplit.llm.staging import written

ROUNDS = 40


def connected(edges: DataFrame) -> DataFrame:
    """(id, root) for every node of `edges` (a, b), two longs: root is the component's smallest node.

    Each round hangs larger neighbours, then smaller ones, on the least neighbour (two aggregations
    and joins); the rounds needed grow with the logarithm of the longest path. Only two numbers per
    round reach the driver. Raises if `ROUNDS` do not settle it.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    for _ in range(ROUNDS):
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == before:
            roots = now.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct()
            return now.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(roots)
        before = seen
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # minima are tables: joins then read plain shuffles, which Spark splits where a hub is hot
        least = written(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = written(large.where("a <> b").distinct())
        down = written(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(down, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
        now = written(small.select("e.*").where("a <> b").distinct())
    raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
