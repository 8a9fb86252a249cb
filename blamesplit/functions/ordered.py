"""Exact order statistics and prefix sums that never gather a whole group into one task.

There is one route for every size and every orderable type. Equal values are counted together
before a shuffle, so ties (even a third of all rows) cost one row per task. What is left is
range-partitioned by group and value: each partition is a slice of the order, and a group with many
values spans many slices. The slices are written once, so that all later steps agree on them. Only
one total per group and slice is ordered per group; values are ordered inside their slice.

Nulls and NaN have no place in an order and are left out.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from blamesplit.functions.stage import stage

BEFORE = (Window.unboundedPreceding, -1)
WORK_COLUMNS = {"v", "n", "slot", "rank", "lo", "hi", "part", "below", "size"}


def present(df: DataFrame, column: str) -> Column:
    """The value is neither null nor NaN."""
    there = F.col(column).isNotNull()
    return there & ~F.isnan(column) if dict(df.dtypes)[column] in ("double", "float") else there


def in_slices(counted: DataFrame, by: Sequence[str], order: str, slices: int | None = None) -> DataFrame:
    """`counted` with `part`, a slice of the order by (by, order); the slices are settled."""
    if slices is None:
        slices = int(counted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = counted.repartitionByRange(slices, *by, order)
    return stage(dealt.withColumn("part", F.spark_partition_id()))


def running_total(
    sliced: DataFrame, by: Sequence[str], order: str, measure: str, out: str
) -> DataFrame:
    """Add `out`: the sum of `measure` over rows of the same group with a smaller `order`.

    One row per (by, order) is expected, from `in_slices`. The totals of a group's slices are summed
    up in one window: as many rows as the table has slices, whatever the data.
    """
    totals = sliced.groupBy(*by, "part").agg(F.sum(measure).alias("__total"))
    across = Window.partitionBy(*by).orderBy("part").rowsBetween(*BEFORE)
    offsets = totals.select(
        *by, "part", F.coalesce(F.sum("__total").over(across), F.lit(0)).alias("__offset")
    )
    inside = Window.partitionBy(*by, "part").orderBy(order).rowsBetween(*BEFORE)
    return (
        sliced.withColumn("__inside", F.coalesce(F.sum(measure).over(inside), F.lit(0)))
        .join(offsets, [*by, "part"])
        .withColumn(out, F.col("__inside") + F.col("__offset"))
        .drop("__inside", "__offset")
    )


def values_of(df: DataFrame, by: Sequence[str], column: str) -> DataFrame:
    """(*by, v): the values of a column that have a place in its order."""
    taken = WORK_COLUMNS & set(by)
    if taken:
        raise ValueError(f"grouping columns may not be named {sorted(taken)}")
    return df.where(present(df, column)).select(*by, F.col(column).alias("v"))


def ranked(values: DataFrame, by: Sequence[str]) -> DataFrame:
    """(*by, v, n, below, size): distinct values, their rows, the rows before, the group's rows."""
    if not by:
        raise ValueError("give at least one grouping column (a constant will do)")
    counted = in_slices(values.groupBy(*by, "v").agg(F.count("*").alias("n")), by, "v")
    sizes = counted.groupBy(*by).agg(F.sum("n").alias("size"))
    return running_total(counted, by, "v", "n", "below").join(sizes, list(by))


def holds(rank: Column) -> Column:
    """The row covers ranks below ... below + n - 1; is the wanted one among them?"""
    return (rank >= F.col("below")) & (rank < F.col("below") + F.col("n"))


def exact_quantiles(
    df: DataFrame, column: str, wanted: Mapping[str, float], by: Sequence[str]
) -> DataFrame:
    """Exact quantiles with linear interpolation per group: (*by, *wanted), all from one ordering."""
    return quantiles_of_values(values_of(df, by, column), wanted, by)


def exact_quantile(df: DataFrame, column: str, q: float, by: Sequence[str], out: str) -> DataFrame:
    return exact_quantiles(df, column, {out: q}, by)


def quantiles_of_values(values: DataFrame, wanted: Mapping[str, float], by: Sequence[str]) -> DataFrame:
    spots = {name: (F.col("size") - 1) * F.lit(float(q)) for name, q in wanted.items()}
    ends, results = [], []
    for name, spot in spots.items():
        ends += [
            F.max(F.when(holds(F.floor(spot)), F.col("v"))).alias(f"__lo_{name}"),
            F.max(F.when(holds(F.ceil(spot)), F.col("v"))).alias(f"__hi_{name}"),
        ]
        low, high = F.col(f"__lo_{name}"), F.col(f"__hi_{name}")
        results.append((low + (high - low) * (spot - F.floor(spot))).alias(name))
    found = ranked(values, by).groupBy(*by).agg(F.max("size").alias("size"), *ends)
    return found.select(*by, *results)


def head_fraction(df: DataFrame, key: str, keep: float, by: Sequence[str] = ()) -> DataFrame:
    """Keep the first floor(n * keep) rows of each group in the order of the unique `key`.

    The cut is one order statistic per group, so rows are filtered by a threshold, not ranked.
    """
    if keep >= 1.0:
        return df
    groups = list(by) or ["__all"]
    rows = df if by else df.withColumn("__all", F.lit(0))
    sizes = rows.groupBy(*groups).agg(F.floor(F.count("*") * F.lit(float(keep))).alias("__first"))
    placed = ranked(values_of(rows, groups, key), groups).join(sizes, groups)
    last = placed.where(holds(F.col("__first") - 1)).select(*groups, F.col("v").alias("__last"))
    kept = rows.join(last, groups).where(F.col(key) <= F.col("__last")).drop("__last")
    return kept if by else kept.drop("__all")


def first_rows(df: DataFrame, by: Sequence[str], order: Sequence[str], limit: int, spread: int = 64):
    """The first `limit` rows of each group in a total order.

    Two steps: each of `spread` slices of a group keeps its own first `limit` rows, then the
    group is cut from at most spread * limit candidates.  A hot group is shared by many tasks.
    """
    slices = df.withColumn("__slice", F.pmod(F.xxhash64(*order), F.lit(spread)))
    inner = Window.partitionBy(*by, "__slice").orderBy(*order)
    outer = Window.partitionBy(*by).orderBy(*order)
    return (
        slices.withColumn("__n", F.row_number().over(inner))
        .where(F.col("__n") <= limit)
        .drop("__slice", "__n")
        .withColumn("__n", F.row_number().over(outer))
        .where(F.col("__n") <= limit)
        .drop("__n")
    )
