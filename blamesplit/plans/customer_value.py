"""Seven-operator customer pipeline: who is a high-value customer?

Two sources (customers, one year of orders), a cleaner, an aggregate, a left join, an activity
filter and an encoder. The label is lifetime spend above a fixed limit; it is read from the
untouched order history, which contains the window the features come from.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, functions as F

from blamesplit.functions.columns import clip, one_hot, selected
from blamesplit.plans.pipeline import Operator, Pipeline
from blamesplit.plans.worlds import State, WorldFrame

# Vocabulary, label limit, years of the three runs, selector seeds.
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
HIGH_VALUE_SPEND = 2_500_000.0
TENURE_LIMIT = 3000
REFERENCE_YEAR, INCIDENT_YEAR, PROBE_YEAR = 1996, 1999, 1998
NULL_SEED, DUPLICATE_SEED = 7, 11
UNITS = 10_000  # amounts are summed as BIGINT ten-thousandths, so sums do not depend on order

Tables = Callable[[str], DataFrame]


def load_customers(tables: Tables):
    """All customers in every run; the run's year is the day at which their tenure is taken."""

    def body(inputs, state: State) -> WorldFrame:
        history = (
            tables("orders")
            .groupBy(F.col("o_custkey").alias("customer_id"))
            .agg(
                F.min("o_orderdate").alias("first_order"),
                F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"),
            )
        )
        # few bytes make few tasks, and every row is repeated for many worlds further on: deal them anew
        customers = tables("customer").select(F.col("c_custkey").alias("customer_id"), "c_acctbal", "c_mktsegment")
        tasks = int(customers.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        everyone = state.partition(customers.repartition(tasks), lambda p: F.lit(True))
        as_of = state.by_state(
            {c: F.to_date(F.lit(f"{y + 1}-01-01")) for c, y in state.values("year").items()}
        )
        return everyone.rows(
            lambda df: df.join(history, "customer_id", "left").select(
                "w",
                "customer_id",
                F.col("c_acctbal").alias("income"),
                F.col("c_mktsegment").alias("segment"),
                F.coalesce(F.datediff(as_of, F.to_date("first_order")), F.lit(0))
                .cast("long")
                .alias("tenure_days"),
                F.coalesce(F.col("cents") > int(HIGH_VALUE_SPEND * 100), F.lit(False))
                .cast("long")
                .alias("label"),
            )
        )

    return body


def load_transactions(tables: Tables):
    def body(inputs, state: State) -> WorldFrame:
        def in_year(p):
            day = F.col("o_orderdate")
            return (day >= F.lit(f"{p['year']}-01-01").cast("timestamp_ntz")) & (
                day < F.lit(f"{p['year'] + 1}-01-01").cast("timestamp_ntz")
            )

        orders = tables("orders").select("o_custkey", "o_totalprice", "o_orderdate")
        return state.partition(orders, in_year).rows(
            lambda df: df.select(
                "w", F.col("o_custkey").alias("customer_id"), F.col("o_totalprice").alias("amount")
            )
        )

    return body


def null_spike(before: WorldFrame, state: State) -> WorldFrame:
    """Blank a share of incomes: at random, or only those above the median."""
    frame = state.enter(before)
    if not state.any("null_rate", 0.0):
        return frame
    hit = selected(F.col("customer_id"), state.value("null_rate", 0.0), NULL_SEED)
    if state.any("null_mode", "mcar"):
        read = state.worlds_with(frame, "null_mode", "mnar")
        frame = frame.with_quantile("income", 0.5, "median_income", before, read)
        above = F.col("income") > F.col("median_income")
        hit = hit & ((state.value("null_mode", "mcar") != "mnar") | F.coalesce(above, F.lit(False)))
    blanked = F.when(~hit, F.col("income"))
    return frame.rows(lambda df: df.withColumn("income", blanked).drop("median_income"))


def clean_customers(inputs: Mapping[str, WorldFrame], state: State) -> WorldFrame:
    frame = null_spike(inputs["load_customers"], state)
    return frame.rows(
        lambda df: df.na.drop(subset=["income"]).withColumn(
            "tenure_days", clip(F.col("tenure_days"), 0, TENURE_LIMIT)
        )
    )


def agg_transactions(inputs: Mapping[str, WorldFrame], state: State) -> WorldFrame:
    """Spend per customer; `amount_scale` is the silent unit change."""
    scaled = F.col("amount") * UNITS * state.value("amount_scale", 1.0)
    spend = state.enter(inputs["load_transactions"]).rows(
        lambda df: df.withColumn("units", F.round(scaled).cast("long"))
    )
    sums = spend.group_by(
        ["customer_id"], F.sum("units").alias("units"), F.count("amount").alias("txn_count")
    )
    total = F.col("units") / F.lit(float(UNITS))
    return sums.rows(
        lambda df: df.select(
            "w",
            "customer_id",
            total.alias("total_amount"),
            "txn_count",
            (F.col("units") / (F.col("txn_count") * F.lit(float(UNITS)))).alias("avg_amount"),
        )
    )


def fan_out(before: WorldFrame, state: State) -> WorldFrame:
    """Repeat a share of the right-hand rows, evenly or only among the top quarter of spend."""
    frame = state.enter(before)
    if not state.any("duplicate_rate", 0.0):
        return frame
    hit = selected(F.col("customer_id"), state.value("duplicate_rate", 0.0), DUPLICATE_SEED)
    if state.any("duplicate_bias"):
        read = state.worlds_with(frame, "duplicate_bias", "high_spend")
        frame = frame.with_quantile("total_amount", 0.75, "top_quarter", before, read)
        biased = F.coalesce(state.value("duplicate_bias") == "high_spend", F.lit(False))
        hit = hit & (~biased | (F.col("total_amount") >= F.col("top_quarter")))
    copies = F.when(hit, state.value("duplicate_factor", 1) + 1).otherwise(1)
    return frame.rows(
        lambda df: df.withColumn("copy", F.explode(F.sequence(F.lit(1), copies))).drop(
            "copy", "top_quarter"
        )
    )


def join_features(inputs: Mapping[str, WorldFrame], state: State) -> WorldFrame:
    right = fan_out(inputs["agg_transactions"], state)
    joined = inputs["clean_customers"].join(right, ["customer_id"], "left")
    return joined.rows(
        lambda df: df.na.fill(0.0, ["total_amount", "avg_amount"]).na.fill(0, ["txn_count"])
    )


def filter_active(inputs: Mapping[str, WorldFrame], state: State) -> WorldFrame:
    keep = F.col("txn_count") >= state.value("min_txn", 1)
    return state.enter(inputs["join_features"]).rows(lambda df: df.where(keep))


FEATURES = ["income", "tenure_days", "total_amount", "txn_count", "avg_amount"]


def encode_features(inputs: Mapping[str, WorldFrame], state: State) -> WorldFrame:
    """One-hot over the fixed vocabulary; `drop_columns` is schema drift."""
    encoded = state.enter(inputs["filter_active"]).rows(
        lambda df: df.select("w", *FEATURES, *one_hot("segment", SEGMENTS, "segment"), "label")
    )
    return encoded.without(state.field, state.values("drop_columns", ()))


def build(
    tables: Tables,
    faults: Mapping[str, list[Mapping]] | None = None,
    reference: int = REFERENCE_YEAR,
    incident: int = INCIDENT_YEAR,
) -> Pipeline:
    """Assemble the DAG; `faults` lists the incident variants of each faulted operator."""
    faults = faults or {}

    def op(name, parents, body, base, wide=False):
        variants = tuple({**base, **extra} for extra in faults.get(name, ()))
        return Operator(name, parents, body, base, variants, wide)

    years = {"reference": {"year": reference}, "variants": ({"year": incident},)}
    return Pipeline(
        [
            Operator("load_customers", (), load_customers(tables), **years, wide=True),
            Operator("load_transactions", (), load_transactions(tables), **years),
            op("clean_customers", ("load_customers",), clean_customers, {}),
            op("agg_transactions", ("load_transactions",), agg_transactions, {}, wide=True),
            op("join_features", ("clean_customers", "agg_transactions"), join_features, {}, wide=True),
            op("filter_active", ("join_features",), filter_active, {"min_txn": 1}),
            op("encode_features", ("filter_active",), encode_features, {"drop_columns": ()}),
        ],
        sink="encode_features",
    )


def probe(tables: Tables) -> DataFrame:
    """Clean feature table of a third year, all operators at reference."""
    from blamesplit.plans.replay import Replay

    return Replay(build(tables, reference=PROBE_YEAR, incident=PROBE_YEAR)).sink().world(0)
