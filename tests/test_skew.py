"""Joins with measured hot keys against plain joins, and how rows are dealt."""

import pytest
from pyspark.sql import functions as F

from blamesplit.functions import skew

PARTS = 16


def tables(spark):
    """Half of the left rows have key 7, a tenth has none, the others are spread."""
    key = F.expr("CASE WHEN id % 2 = 0 THEN 7 WHEN id % 10 = 1 THEN NULL ELSE id % 3001 END")
    left = spark.range(20_000).select(F.col("id").alias("row"), key.alias("k"), F.lit("x").alias("s"))
    right = spark.range(0, 4000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    return left, right.unionByName(spark.createDataFrame([(7, -1), (None, 0)], "k long, v long"))


@pytest.mark.parametrize("how", ["inner", "left"])
def test_equals_the_plain_join(spark, how):
    left, right = tables(spark)
    got = skew.split_join(left, right, ["k"], how, PARTS)
    want = left.join(right, ["k"], how)
    assert got.columns == want.columns
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_only_hot_keys_are_cut(spark):
    left, right = tables(spark)
    hot = {r.key_hash: (r.n, r.pieces) for r in skew.hot_keys(left, ["k"], PARTS).collect()}
    assert sorted(hot.values()) == [(2000, 2), (10_000 + left.where("k = 7 AND row % 2 = 1").count(), 9)]
    l, r = skew.dealt(left, right, ["k"], PARTS)
    most = l.groupBy("k", "__salt").count().agg({"count": "max"}).first()[0]
    assert most < 1.25 * 20_000 / PARTS  # the plain join has 10,000 rows of one key
    assert r.count() == right.count() + 2 * 8 + 1
    assert r.where("k <> 7 AND __salt > 0").isEmpty()


def test_the_sketch_finds_a_hot_key_among_many(spark):
    """More distinct keys than the sketch follows, dealt over many partitions."""
    df = spark.range(400_000).select(F.expr("CASE WHEN id % 8 = 0 THEN -1 ELSE id END AS k")).repartition(40)
    (found,) = skew.hot_keys(df, ["k"], PARTS).collect()
    assert found.key_hash == df.where("k = -1").select(skew.key_hash(["k"])).first()[0]
    assert 45_000 <= found.n <= 50_000 and found.pieces == 2


def test_edges(spark):
    left, right = tables(spark)
    none = left.where("row < 0")
    assert skew.hot_keys(none, ["k"], PARTS).isEmpty()
    assert skew.split_join(none, right, ["k"], "left", PARTS).isEmpty()
    assert skew.split_join(left, right.where("v > 99999"), ["k"], "left", PARTS).count() == 20_000
    two = skew.split_join(left, right.withColumn("s", F.lit("x")), ["k", "s"], "inner", PARTS)
    assert two.count() == left.join(right, "k").count()
    with pytest.raises(ValueError):
        skew.split_join(left, right, ["k"], "full", PARTS)
