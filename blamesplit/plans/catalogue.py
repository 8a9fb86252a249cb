"""Fault catalogues: which operator breaks how, as parameter sets per incident.

Fixed values throughout; they are the published scenario tables, with thresholds in the units of
the tables used here where the column differs.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from blamesplit.functions.local import local_table
from blamesplit.plans.reports import Incident

Fault = tuple[str, Mapping]

CUSTOMER_FAULTS: dict[str, Fault] = {
    "unit_change": ("agg_transactions", {"amount_scale": 0.01}),
    "schema_drift": ("encode_features", {"drop_columns": ("income", "total_amount")}),
    "predicate_flip": ("filter_active", {"min_txn": 3}),
    "join_fanout_uniform": ("join_features", {"duplicate_rate": 0.35}),
    "null_spike_mcar": ("clean_customers", {"null_rate": 0.55, "null_mode": "mcar"}),
    "join_fanout_biased": (
        "join_features",
        {"duplicate_rate": 0.9, "duplicate_bias": "high_spend", "duplicate_factor": 5},
    ),
    "null_spike_mnar": ("clean_customers", {"null_rate": 0.9, "null_mode": "mnar"}),
    "starve_rows_a": ("clean_customers", {"null_rate": 0.80, "null_mode": "mcar"}),
    "starve_rows_b": ("filter_active", {"min_txn": 4}),
}

GATE_SCENARIOS: list[tuple[str, ...]] = [
    ("unit_change",),
    ("schema_drift",),
    ("predicate_flip",),
    ("join_fanout_biased",),
    ("null_spike_mnar",),
    ("join_fanout_uniform",),
    ("null_spike_mcar",),
    ("unit_change", "predicate_flip"),
    ("null_spike_mnar", "schema_drift"),
    ("starve_rows_a", "starve_rows_b"),
]
BENIGN_FAULTS = {"join_fanout_uniform", "null_spike_mcar"}

CUSTOMER_SWEEPS: dict[str, tuple[str, list[tuple[str, Mapping]]]] = {
    "unit_change": (
        "agg_transactions",
        [(f"{s}x", {"amount_scale": s}) for s in (0.9, 0.7, 0.5, 0.2, 0.05, 0.01)],
    ),
    "schema_drift": (
        "encode_features",
        [
            ("drop " + "+".join(cols), {"drop_columns": cols})
            for cols in (
                ("avg_amount",),
                ("tenure_days",),
                ("total_amount",),
                ("income",),
                ("income", "total_amount"),
                ("income", "total_amount", "tenure_days"),
            )
        ],
    ),
    "predicate_flip": (
        "filter_active",
        [(f"min_txn={k}", {"min_txn": k}) for k in (2, 3, 4, 6, 8, 10)],
    ),
    "null_spike_mnar": (
        "clean_customers",
        [
            (f"{round(r * 100)}%", {"null_rate": r, "null_mode": "mnar"})
            for r in (0.2, 0.4, 0.6, 0.8, 0.95, 1.0)
        ],
    ),
    "join_fanout_biased": (
        "join_features",
        [
            (
                f"x{k}",
                {"duplicate_rate": 0.9, "duplicate_bias": "high_spend", "duplicate_factor": k},
            )
            for k in (1, 2, 5, 10, 20)
        ],
    ),
}

TRIP_FAULTS: dict[str, Fault] = {
    "unit_change": ("derive_time", {"duration_unit": 3_600.0}),
    "predicate_flip": ("filter_valid", {"min_fare": 50_000.0}),
    "broken_join_key": ("join_pu_zone", {"corrupt_ids": 0.6}),
    "join_fanout": ("join_do_zone", {"duplicate_zones": 0.8}),
    "schema_drift": ("encode", {"drop_columns": ("trip_distance", "duration")}),
}

TRIP_SWEEPS: dict[str, tuple[str, list[tuple[str, Mapping]]]] = {
    "unit_change": (
        "derive_time",
        [(f"/{k}", {"duration_unit": 86_400.0 / k}) for k in (2, 6, 24, 1440)],
    ),
    "predicate_flip": (
        "filter_valid",
        [(f"fare>{k}", {"min_fare": float(k)}) for k in (20_000, 40_000, 50_000, 60_000)],
    ),
    "broken_join_key": (
        "join_pu_zone",
        [(f"{round(r * 100)}%", {"corrupt_ids": r}) for r in (0.2, 0.5, 0.8, 1.0)],
    ),
    "join_fanout": (
        "join_do_zone",
        [(f"{round(r * 100)}%", {"duplicate_zones": r}) for r in (0.2, 0.5, 1.0)],
    ),
    "schema_drift": (
        "encode",
        [
            ("drop " + "+".join(cols), {"drop_columns": cols})
            for cols in (
                ("hour",),
                ("trip_distance",),
                ("trip_distance", "duration"),
                ("trip_distance", "duration", "fare_amount"),
            )
        ],
    ),
}


def sweep_incidents(sweeps) -> tuple[dict[str, list[Mapping]], list[Incident]]:
    """Variants per operator and one incident per severity level."""
    variants: dict[str, list[Mapping]] = {}
    incidents = []
    for kind, (op, ladder) in sweeps.items():
        for level, params in ladder:
            variants.setdefault(op, []).append(params)
            incidents.append(
                Incident(f"{kind}/{level}", {op: len(variants[op])}, (op,), group=kind)
            )
    return variants, incidents


def named_incidents(
    faults: Mapping[str, Fault], scenarios: list[tuple[str, ...]]
) -> tuple[dict[str, list[Mapping]], list[Incident]]:
    """Variants and incidents of named fault combinations; faults of one operator merge."""
    variants: dict[str, list[Mapping]] = {}
    incidents = []
    for names in scenarios:
        merged: dict[str, dict] = {}
        for name in names:
            op, params = faults[name]
            merged.setdefault(op, {}).update(params)
        choice = {}
        for op, params in merged.items():
            known = variants.setdefault(op, [])
            if params not in known:
                known.append(params)
            choice[op] = known.index(params) + 1
        culprits = tuple(faults[name][0] for name in names)
        group = "benign" if set(names) & BENIGN_FAULTS else "harmful"
        incidents.append(Incident("+".join(names), choice, culprits, group))
    return variants, incidents


def parameters(params: Mapping) -> str:
    return ", ".join(f"{k}={v}" for k, v in sorted(params.items()))


def scenario_table(
    spark: SparkSession, faults: Mapping[str, Fault], scenarios: list[tuple[str, ...]]
) -> DataFrame:
    """(scenario, fault, op, params, benign): a row for each fault of each scenario."""
    rows = [
        ("+".join(names), name, faults[name][0], parameters(faults[name][1]), name in BENIGN_FAULTS)
        for names in scenarios
        for name in names
    ]
    schema = "scenario string, fault string, op string, params string, benign boolean"
    return local_table(spark, schema, rows)


def catalogue_table(spark: SparkSession, sweeps) -> DataFrame:
    """(fault_type, severity, op, params) of a ladder."""
    rows = [
        (kind, level, op, parameters(params))
        for kind, (op, ladder) in sweeps.items()
        for level, params in ladder
    ]
    return local_table(spark, "fault_type string, severity string, op string, params string", rows)
