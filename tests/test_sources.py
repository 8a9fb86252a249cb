"""Loading rules and file round trips."""

import json
import os
from datetime import date

import pytest
from pyspark.sql import functions as F

from blamesplit.sources import files
from blamesplit.sources import tables as src


def test_column_case_is_mapped_to_the_contract(spark):
    df = spark.createDataFrame([(1, 2, 3)], "KEY int, value int, Other int")
    assert src.canonical_columns(df, ["Key", "VALUE"]).columns == ["Key", "VALUE", "Other"]


def test_contract_lists_everything_that_is_missing(spark, tables):
    with pytest.raises(src.DataMissing, match=r"\['x', 'y'\]"):
        src.load(tables, "region", ["r_name", "x", "y"])
    with pytest.raises(src.DataMissing, match="missing table"):
        src.load(tables, "no_such_table", ["a"])
    assert src.load(tables, "region", ["R_NAME"]).columns == ["R_NAME"]


def test_days_go_by_content_and_bad_text_is_left_out(spark):
    df = spark.createDataFrame(
        [("2024-01-08 00:00:00",), ("2024-01-08 23:59:59.9",), ("2024-01-09 00:00:00",), ("junk",), (None,)],
        "t string",
    )
    assert src.on_day(df, "t", date(2024, 1, 8)).count() == 2


def test_day_filter_reaches_the_scan(tables):
    day = src.on_day(tables("events").select("ts", "user_id"), "ts", date(2024, 1, 8))
    plan = day._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in plan
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint>" in plan


def test_cap_takes_the_first_rows(tables):
    events = tables("events")
    day = src.load_day(events, "ts", date(2024, 1, 8), ["ts", "event_id"], 5)
    whole = src.load_day(events, "ts", date(2024, 1, 8), ["ts", "event_id"], None)
    expected = [r.event_id for r in whole.orderBy("ts", "event_id").limit(5).collect()]
    assert sorted(r.event_id for r in day.collect()) == sorted(expected)
    assert day.columns == whole.columns


def test_census_lists_empty_days(tables):
    rows = src.partition_census(tables("events"), "ts", [date(2024, 1, 2), date(2030, 1, 1)]).collect()
    found = {str(r.day): (r.n_rows > 0, r.thin) for r in rows}
    assert found == {"2024-01-02": (True, True), "2030-01-01": (False, True)}


def test_csv_null_text_is_declared(spark, tmp_path):
    path = str(tmp_path / "z.csv")
    with open(path, "w") as out:
        out.write("zone,name\n1,N/A\n2,Old Town\n")
    rows = src.read_csv(spark, path, "zone long, name string", null="N/A").collect()
    assert [(r.zone, r.name) for r in rows] == [(1, None), (2, "Old Town")]


@pytest.mark.parametrize("kind", ["parquet", "csv"])
def test_table_round_trip(spark, tmp_path, kind):
    path = str(tmp_path / kind)
    files.write_table(spark.range(10).withColumn("x", F.col("id") * 2), path, kind)
    back = spark.read.option("header", True).format(kind).load(path)
    assert back.selectExpr("sum(CAST(x AS long))").collect()[0][0] == 90


def test_csv_report_round_trip(spark, tmp_path):
    path = str(tmp_path / "report")
    rows = spark.createDataFrame(
        [("a", True, 0.5), ("b", False, 0.1), ("c", True, None)], "name string, valid boolean, ratio double"
    )
    files.write_csv_report(rows, path)
    assert len([f for f in os.listdir(path) if f.endswith(".csv")]) == 1
    back = files.read_csv_report(spark, path, {"ratio": "double"}, "valid")
    assert sorted((r.name, r.ratio) for r in back.collect()) == [("a", 0.5), ("c", None)]
    assert files.read_csv_report(spark, path, {}, "no_such_column").count() == 3


def test_incident_json(spark, tmp_path):
    path = str(tmp_path / "incident")
    card = spark.createDataFrame(
        [("s", "x", -0.2, True, False, -0.3), ("s", "y", 0.0, False, True, -0.3)],
        "scenario string, op string, phi double, is_culprit boolean, anchored boolean, delta double",
    )
    files.write_incident_json(card, path, ["scenario", "delta"])
    (part,) = [f for f in os.listdir(path) if f.endswith(".json")]
    with open(os.path.join(path, part)) as f:
        found = json.loads(f.read())
    assert found == {
        "scenario": "s", "delta": -0.3, "attribution": {"x": -0.2, "y": 0.0},
        "culprits": ["x"], "sources": ["y"],
    }
