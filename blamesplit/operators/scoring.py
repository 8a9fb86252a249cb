"""Score attributions against known culprits.

`attribution(scenario, method, op, phi)`: harm is negative. `culprits(scenario, op)`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

RUN = ["scenario", "method"]
RANK_DIGITS = 9  # blame is compared at this precision, so ties do not hang on summation order


def blame_ranking(attribution: DataFrame, keys: list[str] = RUN) -> DataFrame:
    """Add `rank`: most negative first, ties by operator name."""
    order = Window.partitionBy(*keys).orderBy(F.round("phi", RANK_DIGITS), "op")
    return attribution.withColumn("rank", F.row_number().over(order).cast("long"))


def scores(attribution: DataFrame, culprits: DataFrame, keys: list[str] = RUN) -> DataFrame:
    """(*keys, p_at_1, mrr, mass): precision at 1, reciprocal rank, share of harm on culprits."""
    known = culprits.distinct().withColumn("__guilty", F.lit(True))
    ranked = blame_ranking(attribution, keys).join(known, ["scenario", "op"], "left")
    guilty = F.col("__guilty").isNotNull()
    phi = F.round("phi", RANK_DIGITS)
    harm = F.when(phi < 0, -phi).otherwise(0.0)
    first = F.min(F.when(guilty, F.col("rank")))
    on_culprits = F.sum(F.when(guilty, harm).otherwise(0.0))
    return ranked.groupBy(*keys).agg(
        F.coalesce(first == 1, F.lit(False)).cast("double").alias("p_at_1"),
        F.coalesce(1.0 / first, F.lit(0.0)).alias("mrr"),
        F.when(F.sum(harm) > 0, on_culprits / F.sum(harm)).otherwise(0.0).alias("mass"),
    )


def precision_at_1(attribution: DataFrame, culprits: DataFrame) -> DataFrame:
    return scores(attribution, culprits).select(*RUN, "p_at_1")


def reciprocal_rank(attribution: DataFrame, culprits: DataFrame) -> DataFrame:
    return scores(attribution, culprits).select(*RUN, "mrr")


def blame_mass(attribution: DataFrame, culprits: DataFrame) -> DataFrame:
    return scores(attribution, culprits).select(*RUN, "mass")
