"""Equi-joins whose hot keys are measured first and dealt over as many tasks as they need.

A key is hot if it holds more than one of `parts` equal shares of the left rows. A frequent-items
sketch (one grouped aggregate, merged like a sum) finds all of these, and there are fewer than
`parts` of them, whatever the size of the data. A key with k shares is cut into k pieces: its left
rows are dealt over them and its right rows are repeated for each. All other keys have one piece,
so that the right side is not repeated for them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

#: Keys that the sketch follows for each share; it sees every hot key by a wide margin.
TRACKED = 64


def key_hash(keys: Sequence[str]) -> Column:
    return F.xxhash64(*keys)


def hot_keys(df: DataFrame, keys: Sequence[str], parts: int) -> DataFrame:
    """(key_hash, n, pieces): the keys of `df` that hold more than 1 / `parts` of its rows.

    Null keys count as values, as their rows travel too. Counts are exact up to `TRACKED` * `parts`
    * 0.75 distinct keys and close beyond. Keys that share a hash share their pieces, which costs a
    few repeated rows and changes no result. An empty table has no hot key.
    """
    tracked = TRACKED * parts
    found = df.select(key_hash(keys).alias("key")).agg(
        F.expr(f"approx_top_k(key, {parts}, {tracked})").alias("top"), F.count(F.lit(1)).alias("total")
    )
    each = found.select(F.explode("top").alias("top"), "total")
    hot = each.select(F.col("top.item").alias("key_hash"), F.col("top.count").alias("n"), "total")
    hot = hot.where(F.col("n") * parts > F.col("total"))
    return hot.select("key_hash", "n", F.ceil(F.col("n") * parts / F.col("total")).cast("int").alias("pieces"))


def dealt(
    left: DataFrame, right: DataFrame, keys: Sequence[str], parts: int, salt: str = "__salt"
) -> tuple[DataFrame, DataFrame]:
    """Both sides with the further join key `salt`: 0 but for the hot keys of `left`.

    Left rows choose their piece by a hash of all their columns, so a task that runs again deals
    them alike; rows that are equal in all columns stay together.
    """
    found = hot_keys(left, keys, parts).select(F.col("key_hash").alias("__hash"), F.col("pieces").alias("__pieces"))
    hot = F.broadcast(found)  # under `parts` rows

    def marked(df: DataFrame) -> DataFrame:
        hashed = df.withColumn("__hash", key_hash(keys)).join(hot, "__hash", "left")
        return hashed.withColumn("__pieces", F.coalesce("__pieces", F.lit(1)))

    row = F.xxhash64(*left.columns, F.lit("row"))
    l = marked(left).withColumn(salt, F.pmod(row, F.col("__pieces")).cast("int"))
    r = marked(right).withColumn(salt, F.explode(F.sequence(F.lit(0), F.col("__pieces") - 1)))
    return l.drop("__hash", "__pieces"), r.drop("__hash", "__pieces")


def split_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str, parts: int) -> DataFrame:
    """`left.join(right, keys, how)`, inner or left, with the hot keys of `left` cut into pieces."""
    if how not in ("inner", "left"):
        raise ValueError(f"join type {how!r} would repeat rows of the right side")
    l, r = dealt(left, right, keys, parts)
    return l.join(r, [*keys, "__salt"], how).drop("__salt")
