"""Content fingerprints of tables and of the worlds of a frame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from blamesplit.functions.local import local_table
from blamesplit.plans.worlds import W, WorldFrame

BITS = 22  # of the lower parts of a hash; the highest part holds the other 20 and the sign
MASK = (1 << BITS) - 1


def fingerprint(df: DataFrame, by: Sequence[str | Column], columns: list[str], *others: Column) -> DataFrame:
    """Order-insensitive content fingerprint per group: rows, hash sum, hash xor, and `others` in the same pass.

    Duplicates count (a plain xor would cancel them). Compare fingerprints for equality only.
    """
    # the hash skips nulls, so their places are hashed as well
    row_hash = F.xxhash64(*[F.col(c) for c in columns], *[F.col(c).isNull() for c in columns])
    hashed = df.withColumn("__hash", row_hash)
    # the sum of 64-bit hashes from three sums of parts: no decimal per row, no overflow below 2^41 rows
    low, mid = F.col("__hash").bitwiseAND(F.lit(MASK)), F.shiftright("__hash", BITS).bitwiseAND(F.lit(MASK))
    parts = [F.sum(F.shiftright("__hash", 2 * BITS)), F.sum(mid), F.sum(low)]
    high, middle, least = (p.cast("decimal(38,0)") for p in parts)
    unit = F.lit(1 << BITS).cast("decimal(8,0)")
    total = (((high * unit).cast("decimal(38,0)") + middle).cast("decimal(38,0)") * unit).cast("decimal(38,0)") + least
    return hashed.groupBy(*by).agg(
        F.count("*").alias("n_rows"), total.cast("decimal(38,0)").alias("hash_sum"), F.bit_xor("__hash").alias("hash_xor"), *others
    )


def world_fingerprints(frame: WorldFrame) -> DataFrame:
    """(w, n_rows, fingerprint) for each world of a frame; empty worlds are listed too.

    The schema counts: worlds with other columns differ even if the values agree.
    """
    return printed(frame, fingerprint(frame.df, [W], frame.columns))


def world_fingerprints_of_parts(frame: WorldFrame, parts: DataFrame) -> DataFrame:
    """The same from fingerprints of parts of the worlds' rows, as many rows per world as there are."""
    total = F.sum("hash_sum").cast("decimal(38,0)")
    whole = parts.groupBy(W).agg(F.sum("n_rows").alias("n_rows"), total.alias("hash_sum"), F.bit_xor("hash_xor").alias("hash_xor"))
    return printed(frame, whole)


def printed(frame: WorldFrame, found: DataFrame) -> DataFrame:
    types = dict(frame.df.dtypes)
    schemas = [
        (w, ",".join(f"{c}:{types[c]}" for c in frame.columns_in(w))) for w in frame.worlds
    ]
    listed = local_table(frame.df.sparkSession, f"{W} long, columns string", schemas)
    text = F.concat_ws(
        "|",
        "columns",
        F.coalesce(F.col("n_rows"), F.lit(0)).cast("string"),
        F.coalesce(F.col("hash_sum").cast("string"), F.lit("0")),
        F.coalesce(F.col("hash_xor"), F.lit(0)).cast("string"),
    )
    return listed.join(found, W, "left").select(
        W, F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.sha2(text, 256).alias("fingerprint")
    )
