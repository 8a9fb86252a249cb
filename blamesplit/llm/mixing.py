"""Mixing sources to target weights by hash thresholds, without sorting documents.

Every document has a 60-bit hash of its id and text. Words are summed by source and the leading
bits of the hash; running sums over these few buckets show in which bucket a source's budget ends.
Only that bucket is opened, by the next bits, and at last by single hashes. A document is taken
when its hash lies at or below its source's threshold, so budgets nest: a larger budget takes all
that a smaller one takes. A target above the source's size takes every document once or more and
repeats those below the threshold once more.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blamesplit.llm.staging import written

WORD = r"[^\x20\x09-\x0D]+"
HASH_BITS = 60
#: Bits read at each level; what two levels leave is a millionth of a source.
STEP_BITS = 10
LEVELS = 2
MOST_REPEATS = 3
#: Sources whose thresholds (a row of five numbers each) are broadcast.
FEW_SOURCES = 10_000
#: Rows of one source are dealt over so many keys when they meet their threshold.
SALTS = 64


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def place_hash(doc_id: Column, text: Column) -> Column:
    """60 bits of MD5 over id and text; equal rows share them."""
    said = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(said), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), most: int = MOST_REPEATS) -> DataFrame:
    """(key, source, source_size) with `target`: shares by weight, none above `most` times its source.

    Weights repeat over the sources in code-point order, null last. The target is the smaller of the
    cap and level * weight; the level is the largest of those that result when the sources of least
    cap per weight are held at their caps. One row per source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.row_number().over(order) - 1) % len(weights) + 1)
    df = sizes.withColumn("__w", w).withColumn("__cap", F.col("source_size") * F.lit(most))
    least = Window.orderBy(F.col("__cap") / F.col("__w"), F.col("source").asc_nulls_last())
    before, everything = least.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("__cap").over(before), F.lit(0))
    share = F.sum("__w").over(everything) - F.coalesce(F.sum("__w").over(before), F.lit(0.0))
    df = df.withColumn("__level", left.cast("double") / share)
    level = F.max("__level").over(everything)
    return df.withColumn("target", F.least(F.col("__cap").cast("double"), level * F.col("__w"))).drop("__w", "__cap", "__level")


def _hashed(df: DataFrame, doc_id: str, text: str, source: str) -> DataFrame:
    """`df` with the key of its source, the document's size and hash, and the salt of its join."""
    name = F.col(source).cast("string")
    df = df.withColumn("__key", F.coalesce(F.concat(F.lit("s"), name), F.lit("null")))
    df = df.withColumn("__size", word_count(F.col(text).cast("string")))
    df = df.withColumn("__h", place_hash(F.col(doc_id), F.col(text).cast("string")))
    return df.withColumn("__salt", (F.col("__h") % SALTS).cast("int"))


def thresholds(base: DataFrame, weights: Sequence[float]) -> DataFrame:
    """(key, source_size, target, full, cut) for each source of rows (key, size, h): documents are
    taken `full` times, and once more where h <= cut."""
    hist = _histogram(base, 1)
    sizes = hist.groupBy("key").agg(F.sum("words").alias("source_size"))
    sizes = sizes.withColumn("source", F.when(F.col("key") != "null", F.expr("substring(key, 2)")))
    targets = source_targets(sizes, weights)
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    targets = targets.withColumn("full", full)
    rest = F.col("target") - F.col("full") * F.col("source_size")
    targets = written(targets.withColumn("rest", rest))

    open_ = _boundary(hist.join(targets.select("key", "rest").withColumn("before", F.lit(0).cast("long")), "key"), 1)
    for level in range(2, LEVELS + 1):
        inside = _inside(base, open_, level - 1)
        open_ = _boundary(_histogram(inside, level).join(open_.drop("prefix"), "key"), level)
    last = _inside(base, open_, LEVELS).groupBy("key", "h").agg(F.sum("size").alias("words"))
    last = last.join(open_.drop("prefix"), "key")
    upto = Window.partitionBy("key").orderBy("h").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    middle = F.col("before") + F.sum("words").over(upto) - F.col("words") / 2
    last = last.withColumn("__in", middle <= F.col("rest"))
    cuts = last.groupBy("key").agg(F.max(F.when(F.col("__in"), F.col("h"))).alias("cut"))
    width = HASH_BITS - LEVELS * STEP_BITS
    opened = open_.select("key", (F.shiftleft("prefix", width) - 1).alias("__floor"))
    cuts = targets.join(opened, "key", "left").join(cuts, "key", "left")
    return cuts.select("key", "source_size", "target", "full", F.coalesce("cut", "__floor", F.lit(-1)).alias("cut"))


def _dealt(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """Rows (__key, __salt, __h, ...) with their source's thresholds and `__repeats`. Each source's
    rows are dealt over `SALTS` keys."""
    cuts = cuts.withColumnsRenamed({c: f"__{c}" for c in cuts.columns})
    cuts = cuts.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.join(cuts, ["__key", "__salt"]).withColumn("__repeats", F.col("__full") + (F.col("__h") <= F.col("__cut")).cast("int"))


def mix(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[float] = (5, 2, 1)) -> DataFrame:
    """One row per document: (doc_id, source, size, source_size, target, repeats, taken).

    `size` counts words, `taken` = repeats * size. A source's taken words differ from its target by
    half a document at most, or by half a group of rows equal in id and text, which go together. A
    null or wordless text has size 0 and takes 0; a null source is a source of its own; an empty
    table gives no rows. Other columns of `df` are not read.
    """
    narrow = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), F.col(text).alias("text"))
    base = written(_hashed(narrow, "doc_id", "text", "source").drop("text"))
    cuts = thresholds(base.select(F.col("__key").alias("key"), F.col("__size").alias("size"), F.col("__h").alias("h")), weights)
    return _dealt(base, cuts).select(
        "doc_id", "source", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"),
        F.col("__repeats").alias("repeats"), (F.col("__size") * F.col("__repeats")).alias("taken"),
    )


def mixed(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[float] = (5, 2, 1)) -> DataFrame:
    """The rows of `df`, with all columns, as often as the mix takes them.

    A null or wordless text has size 0 and stays once for each whole time its source is taken, and
    once more by its hash; rows equal in id and text go together; an empty table stays empty. The
    columns travel in one struct, so they may have any name.
    """
    boxed = df.select(F.struct("*").alias("row"))
    rows = _hashed(boxed, f"row.{doc_id}", f"row.{text}", f"row.{source}")
    base = written(rows.select(F.col("__key").alias("key"), F.col("__size").alias("size"), F.col("__h").alias("h")))
    cuts = written(thresholds(base, weights))
    if cuts.count() <= FEW_SOURCES:
        cuts = F.broadcast(cuts)
        rows = rows.join(cuts.withColumnsRenamed({c: f"__{c}" for c in cuts.columns}), "__key")
        rows = rows.withColumn("__repeats", F.col("__full") + (F.col("__h") <= F.col("__cut")).cast("int"))
    else:
        rows = _dealt(rows, cuts)
    times = F.explode(F.array_repeat(F.lit(1), F.col("__repeats")))  # an empty array drops the row
    return rows.withColumn("__time", times).select("row.*")


def _prefix(level: int) -> Column:
    return F.shiftright("h", HASH_BITS - level * STEP_BITS)


def _histogram(rows: DataFrame, level: int) -> DataFrame:
    return rows.groupBy("key", _prefix(level).alias("prefix")).agg(F.sum("size").alias("words"))


def _inside(base: DataFrame, open_: DataFrame, level: int) -> DataFrame:
    """The documents in each source's boundary bucket of a level."""
    return base.withColumn("prefix", _prefix(level)).join(open_.select("key", "prefix"), ["key", "prefix"], "left_semi").drop("prefix")


def _boundary(hist: DataFrame, level: int) -> DataFrame:
    """(key, rest, prefix, before): the first bucket whose running sum passes the budget."""
    upto = Window.partitionBy("key").orderBy("prefix").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = hist.withColumn("__upto", F.col("before") + F.sum("words").over(upto))
    df = df.where((F.col("__upto") > F.col("rest")) & (F.col("__upto") - F.col("words") <= F.col("rest")))
    return df.select("key", "rest", "prefix", (F.col("__upto") - F.col("words")).alias("before"))


ORACLE = """
WITH d AS (
  SELECT doc_id, source,
    CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')), 1, 15) AS BIGINT) AS h
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST(CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS w FROM s),
l AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER b, 0) AS DOUBLE)
      / (sum(w) OVER () - coalesce(sum(w) OVER b, 0.0)) AS level
  FROM w WINDOW b AS (ORDER BY 3 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(CAST(3 * source_size AS DOUBLE), max(level) OVER () * w) AS target FROM l),
q AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS q FROM t),
g AS (SELECT source, h, CAST(sum(size) AS BIGINT) AS words FROM d GROUP BY source, h),
c AS (SELECT source, h, CAST(sum(words) OVER (PARTITION BY source ORDER BY h) AS BIGINT) - words / 2.0 AS middle FROM g)
SELECT d.doc_id, d.size, q.source_size, q.target,
  d.size * (q.q + CASE WHEN c.middle <= q.target - q.q * q.source_size THEN 1 ELSE 0 END) AS taken
FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source
JOIN c ON d.source IS NOT DISTINCT FROM c.source AND d.h = c.h
"""
