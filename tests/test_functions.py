"""Null rules, date parts, selectors, and the order statistics on skewed data."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from blamesplit.functions import columns as fc
from blamesplit.functions import ordered
from blamesplit.functions import utility as ut


def one(df, *exprs):
    return df.select(*exprs).collect()


def test_clip_keeps_null(spark):
    df = spark.createDataFrame([(None,), (5,), (40,), (200,)], "x int")
    assert [r[0] for r in one(df, fc.clip(F.col("x"), 18, 90))] == [None, 18, 40, 90]


def test_one_hot_unknown_and_null_are_all_zero(spark):
    df = spark.createDataFrame([("A B",), ("C",), (None,)], "c string")
    rows = one(df, *fc.one_hot("c", ["A B", "D"], "p"))
    assert rows[0].asDict() == {"p_A_B": 1, "p_D": 0}
    assert tuple(rows[1]) == tuple(rows[2]) == (0, 0)


def test_ratio_with_zero_or_null_denominator(spark):
    df = spark.createDataFrame([(3.0, 10.0), (1.0, 0.0), (1.0, None), (2.0, 10.0)], "a double, b double")
    assert [r[0] for r in one(df, fc.ratio_above(F.col("a"), F.col("b"), 0.2))] == [1, 0, 0, 0]


def test_elapsed_keeps_fractions_and_weekday_starts_monday(spark):
    df = spark.sql(
        "SELECT TIMESTAMP_NTZ '2024-01-08 10:00:00' a, TIMESTAMP_NTZ '2024-01-08 10:00:30.5' b"
    )
    row = one(df, fc.elapsed("a", "b", 60.0).alias("m"), F.weekday("a").alias("d"))[0]
    assert row.m == pytest.approx(30.5 / 60) and row.d == 0


def test_nan_becomes_null(spark):
    df = spark.createDataFrame([(float("nan"), 1), (2.0, 2)], "x double, k int")
    assert [r.x for r in fc.nan_to_null(df).collect()] == [None, 2.0]


def test_align_fills_and_drops(spark):
    df = spark.createDataFrame([(1, "x")], "a int, extra string")
    assert fc.align(df, ["a", "b"]).collect()[0].asDict() == {"a": 1.0, "b": 0.0}


def test_selector_share_and_repeatability(spark):
    df = spark.range(20_000)
    pick = lambda: df.where(fc.selected(F.col("id"), 0.3, 5))
    assert abs(pick().count() / 20_000 - 0.3) < 0.01
    assert pick().exceptAll(pick()).count() == 0
    by_text = df.where(fc.selected_hash([F.col("id").cast("string")], 0.3, 5))
    assert abs(by_text.count() / 20_000 - 0.3) < 0.02
    assert df.where(fc.selected(F.col("id"), 1.0, 5)).count() == 20_000
    assert df.where(fc.selected(F.col("id"), 0.0, 5)).count() == 0


@pytest.fixture(scope="module")
def skewed(spark):
    """Two groups; a third of all rows holds one value; some nulls."""
    x = F.when(F.col("id") % 3 == 0, 7.0).otherwise((F.col("id") * 7919 % 10007) / 10.0)
    return spark.range(6000).select(
        F.when(F.col("id") % 5 == 0, "small").otherwise("big").alias("k"),
        F.when(F.col("id") % 11 != 0, x).alias("x"),
        "id",
    )


@pytest.mark.parametrize("slices", [1, 3, 200])
def test_exact_quantiles(spark, skewed, slices):
    pdf = skewed.toPandas()
    with_nan = skewed.unionByName(spark.range(3).select(F.lit("big").alias("k"), F.lit(float("nan")).alias("x"), "id"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", slices)
    try:
        rows = ordered.exact_quantiles(with_nan, "x", {"a": 0.0, "b": 0.5, "c": 0.75, "d": 1.0}, ["k"]).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    for name, q in (("a", 0.0), ("b", 0.5), ("c", 0.75), ("d", 1.0)):
        assert {r.k: r[name] for r in rows} == pytest.approx(pdf.groupby("k")["x"].quantile(q).to_dict())


@pytest.mark.parametrize("keep", [0.0, 0.3, 0.999, 1.0])
def test_head_fraction(skewed, keep):
    kept = ordered.head_fraction(skewed, "id", keep, ["k"]).toPandas()
    pdf = skewed.toPandas()
    for k, part in pdf.groupby("k"):
        expected = sorted(part["id"])[: int(len(part) * keep)]
        assert sorted(kept[kept["k"] == k]["id"]) == expected


def test_head_fraction_by_a_text_key(skewed):
    named = skewed.withColumn("name", F.concat(F.lit("n"), F.lpad(F.col("id").cast("string"), 6, "0")))
    kept = ordered.head_fraction(named, "name", 0.2, ["k"]).toPandas()
    for k, part in named.toPandas().groupby("k"):
        assert sorted(kept[kept["k"] == k]["name"]) == sorted(part["name"])[: int(len(part) * 0.2)]


def test_head_fraction_of_a_whole_table(skewed):
    assert ordered.head_fraction(skewed, "id", 0.25).count() == 1500


def test_first_rows_of_a_hot_group(spark):
    df = spark.range(5000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 7).cast("string")).alias("day"),
        (5000 - F.col("id")).alias("t"), "id",
    )
    kept = ordered.first_rows(df, ["day"], ["t", "id"], 20, spread=8).toPandas()
    for day, part in df.toPandas().groupby("day"):
        expected = part.sort_values(["t", "id"])["id"].head(20).tolist()
        assert sorted(kept[kept["day"] == day]["id"]) == sorted(expected)


def plain_auc(s, y):
    pos, neg = s[y == 1], s[y == 0]
    wins = (pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()
    return wins / (len(pos) * len(neg))


def test_auc_with_ties(skewed):
    df = skewed.where("x IS NOT NULL").withColumn("y", (F.col("id") * 31 % 4 == 0).cast("int"))
    found = {r.k: r.auc for r in ut.roc_auc(df, ["k"], "x", "y").collect()}
    for k, part in df.toPandas().groupby("k"):
        assert found[k] == pytest.approx(plain_auc(part["x"].to_numpy(), part["y"].to_numpy()))


def test_auc_leaves_out_what_has_no_rank(spark):
    nan = float("nan")
    rows = [("a", None, 1), ("a", nan, 0), ("a", 1.0, 0), ("a", 2.0, 1), ("a", 2.0, 0), ("a", 5.0, None), ("a", 0.0, 7), ("b", None, 1), ("c", 1.0, 1)]
    found = {r.k: r.auc for r in ut.roc_auc(spark.createDataFrame(rows, "k string, s double, y int"), ["k"], "s", "y").collect()}
    assert found == {"a": 0.75, "b": None, "c": None}


def test_auc_of_equal_scores_is_one_half(spark):
    df = spark.range(10).select(F.lit(1).alias("k"), F.lit(2.0).alias("s"), (F.col("id") % 2).alias("y"))
    assert ut.roc_auc(df, ["k"], "s", "y").collect()[0].auc == 0.5


def test_standardize_uses_population_sd_of_train(spark):
    train = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    other = spark.createDataFrame([(4.0, 7.0)], "a double, b double")
    scaled = ut.standardize(train, [other], ["a", "b"])
    assert tuple(scaled[1].collect()[0]) == (2.0, 2.0)
    assert np.allclose([r.a for r in scaled[0].collect()], [-1, 1])


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_roc_auc_keeps_no_copy_of_its_rows(spark):
    """Scores go through two shuffles, sliced by quantiles of a sample; nothing is written in between."""
    rows = [(g, float(i * 37 % 101), i % 3 == 0) for g in ("a", "b", None) for i in range(400)] + [("c", None, True), ("d", 1.0, True)]
    df = spark.createDataFrame(rows, "k string, x double, y boolean").withColumn("y", F.col("y").cast("int"))
    found = ut.roc_auc(df, ["k"], "x", "y")
    assert not re.search(r"ExistingRDD\[[^\]]*part#", plan_of(found))
    pos = [x for k, x, y in rows if k == "a" and y]
    neg = [x for k, x, y in rows if k == "a" and not y]
    want = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))
    got = {r.k: r.auc for r in found.collect()}
    assert got == {"a": pytest.approx(want, abs=1e-12), "b": pytest.approx(want, abs=1e-12), "c": None, "d": None}
    text = df.withColumn("x", F.format_string("%05.1f", "x"))  # no quantiles: any order will do
    assert {r.k: r.auc for r in ut.roc_auc(text.where("k = 'a'"), ["k"], "x", "y").collect()} == {"a": pytest.approx(want, abs=1e-12)}
    assert ut.roc_auc(df.where("k = 'b'"), [], "x", "y").collect()[0].auc == pytest.approx(want, abs=1e-12)


def test_rounded_score_is_round(spark):
    near = spark.range(-3000, 3000).select(((F.col("id") + 0.5) / 1e6).alias("x"))
    wide = spark.range(20_000).select(((F.rand(3) - 0.5) * F.pow(F.lit(10.0), F.col("id") % 14 - 8)).alias("x"))
    odd = spark.createDataFrame([(float("nan"),), (None,), (-0.0,), (-1e-9,), (float("inf"),), (1e300,), (1.0000005,)], "x double")
    both = near.unionByName(wide).unionByName(odd).select(F.round("x", 6).alias("a"), fc.rounded_score(F.col("x"), 6).alias("b"))
    assert both.where("not (a <=> b) or string(a) <> string(b)").count() == 0


def test_customers_are_dealt_before_worlds_repeat_them(spark):
    """A small customer file is one task, and every row of it is repeated for each world."""
    from blamesplit.plans import customer_value
    from blamesplit.plans.replay import Replay

    orders = spark.createDataFrame([], "o_orderkey long, o_custkey long, o_totalprice double, o_orderdate timestamp_ntz")
    customer = spark.range(40).select(F.col("id").alias("c_custkey"), F.lit(1.0).alias("c_acctbal"), F.lit("BUILDING").alias("c_mktsegment"))
    pipeline = customer_value.build({"orders": orders, "customer": customer.coalesce(1)}.__getitem__)
    frame = Replay(pipeline).node("load_customers")
    assert f"RoundRobinPartitioning({spark.conf.get('spark.sql.shuffle.partitions')})" in plan_of(frame.df)
    assert frame.df.groupBy("w").count().select("count").distinct().collect() == [(40,)]
