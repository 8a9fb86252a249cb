"""Sums over the lattice of subsets, for games of many players."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Players settled in one pass; a group then holds 2^12 coalitions.
CHUNK = 12


def subset_sums(rows: DataFrame, k: int, chunk: int = CHUNK) -> DataFrame:
    """(mask, total) for all 2^k masks: the sum of `value` over the rows (mask, value) whose mask
    lies inside. Masks of null or with bits beyond k take no part.

    The zeta transform, player by player. A pass groups coalitions that agree in all players but
    `chunk` of them and adds up inside each group, so k players take k / chunk shuffles of the
    lattice and no group grows with it.
    """
    spark = rows.sparkSession
    inside = rows.where((F.col("mask") >= 0) & (F.col("mask") < (1 << k)))
    given = inside.groupBy("mask").agg(F.sum(F.col("value").cast("double")).alias("total"))
    now = spark.range(1 << k).select(F.col("id").alias("mask")).join(given, "mask", "left")
    now = now.select("mask", F.coalesce("total", F.lit(0.0)).alias("total"))
    for low in range(0, k, chunk):
        bits = min(chunk, k - low)
        rest = F.col("mask").bitwiseAND(F.lit(~(((1 << bits) - 1) << low)).cast("long"))
        now = now.groupBy(rest.alias("rest")).applyInArrow(_settled(bits), "mask long, total double")
    return now


def _settled(bits: int) -> Callable[[pa.Table], pa.Table]:
    """Adds up a group of 2^bits coalitions, each in place of its own value."""

    def settle(table: pa.Table) -> pa.Table:
        masks = table["mask"].to_numpy()
        order = np.argsort(masks)
        sums = table["total"].to_numpy()[order]
        for j in range(bits):
            halves = sums.reshape(-1, 2, 1 << j)
            halves[:, 1] += halves[:, 0]
        return pa.table({"mask": masks[order], "total": sums})

    return settle


def coverage_game(items: DataFrame, k: int, scenario: str) -> DataFrame:
    """game(scenario, mask, u, v) of k players: v counts the items that a coalition covers.

    `items` has (mask): for each item, the players that hold it. A coalition misses the items whose
    holders all lie outside it.
    """
    counted = items.groupBy("mask").agg(F.count("*").alias("value"))
    everyone = (1 << k) - 1
    missed = subset_sums(counted, k).select(F.lit(everyone).cast("long").bitwiseXOR(F.col("mask")).alias("mask"), "total")
    n = counted.agg(F.sum("value").cast("double").alias("items"))
    covered = missed.join(F.broadcast(n)).withColumn("v", F.coalesce("items", F.lit(0.0)) - F.col("total"))  # one row
    return covered.select(F.lit(scenario).alias("scenario"), "mask", F.col("v").alias("u"), "v")
