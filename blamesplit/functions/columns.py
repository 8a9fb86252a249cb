"""Column expressions with the null rules of the feature pipelines."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

# Fixed values of the deterministic row selector (a multiplicative hash of an integer key).
KEY_FACTOR = 48271
SEED_FACTOR = 69621
BUCKETS = 1000


def clip(value: Column, low: float, high: float) -> Column:
    """Clip to [low, high]; a null stays null."""
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(low)), F.lit(high)))


def one_hot(column: str, vocabulary: Iterable[str], prefix: str) -> list[Column]:
    """One 0/1 column per fixed vocabulary value; an unknown or null value gives all zeros."""
    return [
        F.coalesce(F.col(column) == F.lit(v), F.lit(False)).cast("int")
        .alias(f"{prefix}_{v.replace(' ', '_')}")
        for v in vocabulary
    ]


def ratio_above(numerator: Column, denominator: Column, limit: float) -> Column:
    """1 when numerator / denominator > limit; a zero or null denominator gives 0."""
    ratio = numerator / F.nullif(denominator, F.lit(0.0))
    return F.coalesce(ratio > F.lit(limit), F.lit(False)).cast("int")


def elapsed(start: str, end: str, unit_seconds: Column | float) -> Column:
    """Elapsed time in a chosen unit, fractions kept."""
    micros = F.timestamp_diff("MICROSECOND", F.col(start), F.col(end))
    unit = unit_seconds if isinstance(unit_seconds, Column) else F.lit(float(unit_seconds))
    return micros / F.lit(1e6) / unit


def selected(key: Column, rate: Column | float, seed: int) -> Column:
    """Deterministic Bernoulli row selector: the same key, rate and seed always agree.

    Plain BIGINT arithmetic, so any SQL engine reproduces it; use `selected_hash` for keys that
    are not integers.  Note that it is linear in the key: different seeds shift the selection.
    """
    slot = F.pmod(key.cast("long") * KEY_FACTOR + seed * SEED_FACTOR, F.lit(BUCKETS))
    return slot < _slots(rate)


def selected_hash(keys: list[Column], rate: Column | float, seed: int) -> Column:
    """Row selector for keys of any type."""
    return F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(BUCKETS)) < _slots(rate)


def _slots(rate: Column | float) -> Column:
    rate = rate if isinstance(rate, Column) else F.lit(float(rate))
    return F.round(rate * BUCKETS)


def noise(key: Column, seed: int) -> Column:
    """Deterministic noise in [-1, 1] drawn from an integer key."""
    draw = F.pmod(key.cast("long") * KEY_FACTOR + seed * SEED_FACTOR, F.lit(2001))
    return (draw - 1000) / F.lit(1000.0)


def rounded_score(value: Column, digits: int) -> Column:
    """`F.round` of a double, the same to the last bit, without decimal arithmetic for most rows.

    A value below 1e9 units that is not within 1e-6 units of a tie rounds to the nearest whole number of
    units, and that number divided by a power of ten is the double nearest to the decimal. Others, and
    missing ones, are left to `F.round`.
    """
    units = F.abs(value) * F.lit(10.0**digits)
    whole = F.floor(units + 0.5) / F.lit(10.0**digits)
    plain = (units < 1e9) & (F.abs(units - F.floor(units) - 0.5) > 1e-6)
    return F.when(plain, F.when(value < 0, 0.0 - whole).otherwise(whole)).otherwise(F.round(value, digits))


def nan_to_null(df: DataFrame) -> DataFrame:
    """Treat NaN as missing: done once at the source boundary."""
    floats = {n for n, t in df.dtypes if t in ("double", "float")}
    return df.select(
        *[F.when(~F.isnan(c), F.col(c)).alias(c) if c in floats else F.col(c) for c in df.columns]
    )


def align(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Give `df` exactly `columns`: missing ones become 0.0, surplus ones go."""
    have = set(df.columns)
    return df.select(
        *[F.col(c).cast("double").alias(c) if c in have else F.lit(0.0).alias(c) for c in columns]
    )


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    kinds = ("tinyint", "smallint", "int", "bigint", "float", "double")
    skip = set(exclude)
    return [
        n for n, t in df.dtypes if n not in skip and (t in kinds or t.startswith("decimal"))
    ]
