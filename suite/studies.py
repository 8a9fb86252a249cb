"""Pipelines and incidents the registered queries run on (metadata only, no data)."""

from __future__ import annotations

from blamesplit.plans import catalogue, customer_value, fan_in, trips
from blamesplit.plans.reports import Incident, Study

INCIDENT_FAULTS = {
    "agg_transactions": [{"amount_scale": 0.01}],
    "encode_features": [{"drop_columns": ("total_amount", "txn_count")}],
}
INCIDENT = Incident(
    "unit_change+schema_drift",
    {"agg_transactions": 1, "encode_features": 1},
    ("agg_transactions", "encode_features"),
)
UNIT_FAULT = {"agg_transactions": [{"amount_scale": 0.01}]}
UNIT_INCIDENT = Incident("unit_change", {"agg_transactions": 1}, ("agg_transactions",))
SCALE_WIDTHS = [1, 2, 3, 4, 5, 6, 8, 10]
CORRUPT = 0.95
ORDER_SCENARIOS = [
    ("unit_change",),
    ("predicate_flip",),
    ("schema_drift",),
    ("unit_change", "predicate_flip"),
]


#: Thousands of worlds: 32 thresholds x 8 scales x 8 schemas x two years of each source.
MANY_FAULTS = {
    "filter_active": [{"min_txn": k} for k in range(2, 33)],
    "agg_transactions": [{"amount_scale": x} for x in (0.5, 2.0, 0.1, 10.0, 0.01, 100.0, 3.0)],
    "encode_features": [
        {"drop_columns": c}
        for c in (("income",), ("tenure_days",), ("txn_count",), ("avg_amount",), ("income", "tenure_days"), ("income", "txn_count"), ("tenure_days", "avg_amount"))
    ],
}


def incident(spark=None, tables=None) -> Study:
    return Study(spark, customer_value.build(tables, INCIDENT_FAULTS), [INCIDENT], tables)


def unit_change(spark=None, tables=None) -> Study:
    return Study(spark, customer_value.build(tables, UNIT_FAULT), [UNIT_INCIDENT], tables)


def gate(spark=None, tables=None) -> Study:
    variants, incidents = catalogue.named_incidents(
        catalogue.CUSTOMER_FAULTS, catalogue.GATE_SCENARIOS
    )
    return Study(spark, customer_value.build(tables, variants), incidents, tables)


def orders(spark=None, tables=None) -> Study:
    variants, incidents = catalogue.named_incidents(catalogue.CUSTOMER_FAULTS, ORDER_SCENARIOS)
    return Study(spark, customer_value.build(tables, variants), incidents, tables)


def ladder(spark=None, tables=None) -> Study:
    variants, incidents = catalogue.sweep_incidents(catalogue.CUSTOMER_SWEEPS)
    return Study(spark, customer_value.build(tables, variants), incidents, tables)


def customer_faults(spark=None, tables=None) -> Study:
    variants, incidents = catalogue.named_incidents(
        catalogue.CUSTOMER_FAULTS, [(name,) for name in catalogue.CUSTOMER_FAULTS]
    )
    return Study(spark, customer_value.build(tables, variants), incidents, tables)


def trip_faults(spark=None, tables=None) -> Study:
    variants, incidents = catalogue.named_incidents(
        catalogue.TRIP_FAULTS, [(name,) for name in catalogue.TRIP_FAULTS]
    )
    return Study(spark, trips.build(tables, variants), incidents, tables)


def trip_ladder(spark=None, tables=None) -> Study:
    variants, incidents = catalogue.sweep_incidents(catalogue.TRIP_SWEEPS)
    return Study(spark, trips.build(tables, variants), incidents, tables)


def width(m: int, spark=None, tables=None, sums=None) -> Study:
    pipeline = fan_in.build(tables, m, fault_branch=0, corrupt=CORRUPT, sums=sums)
    return Study(spark, pipeline, [Incident(f"m={m}", {"agg_0": 1}, ("agg_0",))], tables)
