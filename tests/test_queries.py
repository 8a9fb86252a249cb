"""The registry, and a cross-section of queries against their SQL on the small tables."""

import math

import duckdb
import pytest

import __spark_entry__ as suite
from suite.queries import QUERIES
from tests.conftest import DATA

TABLES = "region nation customer supplier part orders lineitem events documents labels".split()
CHECKED = [
    "partition_cap", "quantile_threshold", "head_fraction", "join_fanout_ratio", "perturb_null_mnar",
    "perturb_fanout_biased", "encode_trips", "hybrid_replay", "active_frontier", "utility_lda", "utility_lr", "utility_lr_pair", "roc_auc_missing",
    "join_hot_zone", "join_hot_stats", "hot_zones", "shapley_anchored", "shapley_mc", "node_drift", "topological_orders", "incident_report",
    "gate_catalogue", "trip_fault_catalogue",
]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    return str(v)


def test_every_query_has_sql():
    assert not set(QUERIES) - set(suite.oracle_sql())
    assert set(suite.oracle_sql()) <= set(suite.queries())


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, duck, name):
    df = suite.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    found = sorted(tuple(cell(r[c]) for c in columns) for r in df.collect())
    cursor = duck.execute(suite.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    places = [names.index(c) for c in columns]
    assert found == sorted(tuple(cell(r[i]) for i in places) for r in cursor.fetchall())


def test_gate_reports_every_scenario(spark, duck):
    df = suite.queries()["report_gate"](spark, DATA)
    found = sorted(tuple(map(cell, r)) for r in df.collect())
    cursor = duck.execute(suite.oracle_sql()["report_gate"])
    assert [d[0] for d in cursor.description] == df.columns
    assert found == sorted(tuple(map(cell, r)) for r in cursor.fetchall())
    sizes = {"harmful": 8, "compound": 3, "benign": 2}
    methods = ["shapley", "shapley_mc", "loo", "stagewise_a", "stagewise_b", "drift"]
    assert {r[:3] for r in found} == {(g, m, str(n)) for g, n in sizes.items() for m in methods}


def test_entry(spark):
    rows = suite.entry(spark).collect()
    assert len(rows) == 7 and rows[0].gap < 1e-9
