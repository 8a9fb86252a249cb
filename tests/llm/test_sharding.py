"""Sharding against the Spark-free permutation, and its edge cases."""

import zlib
from collections import Counter

import pytest

from blamesplit.llm import sharding

SCHEMA = "doc_id long, text string, extra string, total long, place int"


@pytest.mark.parametrize("n", [1, 2, 3, 5, 7, 40, 97, 1000, 4097])
def test_permutation_is_one_to_one_and_invertible(n):
    places = [sharding.permuted(i, n, 7) for i in range(n)]
    assert sorted(places) == list(range(n))
    assert [sharding.original(p, n, 7) for p in places] == list(range(n))


def check(rows, found, shards):
    assert Counter((r.doc_id, r.text_crc32) for r in found) == Counter(
        (i, None if t is None else zlib.crc32(t.encode())) for i, t, *_ in rows
    )
    n = len(rows)
    assert sorted(r.row_number for r in found) == list(range(n))
    for r in found:
        place = sharding.permuted(r.row_number, n, 7)
        assert (r.shard, r.slot) == (place % shards, place // shards)
    for s in range(shards):
        slots = sorted(r.slot for r in found if r.shard == s)
        assert slots == list(range(len(slots))) and n // shards <= len(slots) <= n // shards + 1


def test_places_follow_from_row_numbers(spark):
    rows = [(i, f"text {i} é", "x", 1, 2) for i in range(500)]
    rows += [(None, None, None, None, None)] * 5 + [(None, "", "", 0, 0), (3, "text 3 é", "y", 1, 2), (-4, "z" * 100_000, "", 0, 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    found = sharding.shuffle_into_shards(df.repartition(7), shards=11).collect()
    check(rows, found, 11)
    again = sharding.shuffle_into_shards(df.repartition(3), shards=11).collect()
    assert sorted(map(str, found)) == sorted(map(str, again))
    assert next(r.size for r in found if r.text_crc32 is None) == 16


def test_empty_table(spark):
    assert sharding.shuffle_into_shards(spark.createDataFrame([], SCHEMA)).collect() == []


def test_many_equal_rows(spark):
    rows = [(1, "a", "", 0, 0)] * 1000
    check(rows, sharding.shuffle_into_shards(spark.createDataFrame(rows, SCHEMA)).collect(), 40)


def test_copies_of_one_row_are_written_by_many_tasks(spark):
    """Rows past CHUNK copies leave one task only as chunks; the numbers stay gapless."""
    n = 20 * sharding.CHUNK + 5
    one = spark.range(n).selectExpr("1L AS doc_id", "2L AS size", "3L AS text_crc32")
    few = spark.range(300).selectExpr("id AS doc_id", "4L AS size", "NULL AS text_crc32")
    found = sharding.numbered(one.unionByName(few), ["doc_id", "size", "text_crc32"])
    parts = found.selectExpr("spark_partition_id() AS p", "size", "row_number", "total").cache()
    each = [r.n for r in parts.where("size = 2").groupBy("p").agg({"*": "count"}).withColumnRenamed("count(1)", "n").collect()]
    assert len(each) > 1 and max(each) < n
    got = parts.agg({"row_number": "max", "*": "count", "total": "min"}).first().asDict()
    assert set(got.values()) == {n + 299, n + 300}
    assert parts.select("row_number").distinct().count() == n + 300
    parts.unpersist()


def test_sql(spark):
    import duckdb

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    want = con.execute(sharding.oracle_sql())
    names = [d[0] for d in want.description]
    got = sharding.shuffle_into_shards(spark.read.parquet(f"{folder}/documents.parquet"))
    rows = [tuple({**r.asDict(), "law": "rows", "grown_shard": None}[n] for n in names) for r in got.collect()]
    assert sorted(rows, key=str) == sorted(want.fetchall(), key=str)
