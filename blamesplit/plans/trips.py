"""Nine-operator trip pipeline with a lookup joined under two roles and per-zone aggregates.

A trip is a shipped line item: it leaves the supplier's nation (pickup zone) on the order date and
reaches the customer's nation (drop-off zone) on the ship date. The fare is the extended price.
The label says whether the price after discount is above a fixed limit; the discounted price
itself is dropped before modelling, since it would give the label away.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import partial

from pyspark.sql import DataFrame, functions as F

from blamesplit.functions.columns import elapsed, one_hot, selected
from blamesplit.functions.skew import split_join
from blamesplit.plans.pipeline import Operator, Pipeline
from blamesplit.plans.replay import Replay
from blamesplit.plans.worlds import State, WorldFrame

# Vocabulary, label limit, unmatched zone, half-years of the three runs, seeds.
REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
NET_LIMIT = 50_000.0
UNKNOWN_ZONE = 9999
DAY_SECONDS = 86_400.0
LONGEST = 1e5
REFERENCE_HALF = ("1997-01-01", "1997-07-01")
INCIDENT_HALF = ("1998-07-01", "1999-01-01")
PROBE_HALF = ("1999-01-01", "1999-07-01")
CORRUPT_SEED, DUPLICATE_SEED = 5, 13
HOT_ZONE_SPREAD = 8  # one zone may hold a third of all trips; the per-zone tables are small
SALT = ("trip_id",)  # one column, so that others are only read where they are used

Tables = Callable[[str], DataFrame]
MEASURES = [
    "trip_distance", "duration", "hour", "dow", "passenger_count", "fare_amount",
    "zone_mean_fare", "zone_trip_count",
]


def load_trips(tables: Tables, parts: int | None = None):
    def matched(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
        return left.join(right, key) if parts is None else split_join(left, right, [key], "inner", parts)

    def body(inputs, state: State) -> WorldFrame:
        def in_half(p):
            day = F.col("l_shipdate")
            low, high = (F.lit(d).cast("timestamp_ntz") for d in p["half"])
            return (day >= low) & (day < high)

        orders = tables("orders").select("o_orderkey", "o_custkey", "o_orderdate")
        customer = tables("customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("do_zone"))
        supplier = tables("supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("pu_zone"))
        lines = state.partition(tables("lineitem"), in_half)
        return lines.rows(
            lambda df: matched(
                matched(df, supplier, "l_suppkey").join(orders, F.col("l_orderkey") == orders["o_orderkey"]),
                customer,
                "o_custkey",
            ).select(
                "w",
                (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("trip_id"),
                F.col("o_orderdate").alias("pickup_at"),
                F.col("l_shipdate").alias("dropoff_at"),
                F.col("l_linenumber").cast("double").alias("passenger_count"),
                F.col("l_quantity").alias("trip_distance"),
                F.col("pu_zone").cast("long").alias("pu_zone"),
                F.col("do_zone").cast("long").alias("do_zone"),
                F.col("l_returnflag").alias("payment_type"),
                F.col("l_extendedprice").alias("fare_amount"),
                (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net_amount"),
            )
        )

    return body


def load_zones(tables: Tables):
    def body(inputs, state: State) -> WorldFrame:
        region = tables("region").select("r_regionkey", F.col("r_name").alias("region"))
        nation = tables("nation").select(
            F.col("n_nationkey").cast("long").alias("zone"), "n_regionkey"
        )
        zones = nation.join(region, nation["n_regionkey"] == region["r_regionkey"])
        return state.partition(zones.select("zone", "region"), lambda p: F.lit(True))

    return body


def filter_valid(inputs: Mapping[str, WorldFrame], state: State) -> WorldFrame:
    """Paid trips with a sane fare and distance; `min_fare` is the predicate flip."""
    keep = (
        (F.col("payment_type") != "N")
        & (F.col("fare_amount") > state.value("min_fare", 0.0))
        & (F.col("trip_distance") > 0)
        & (F.col("trip_distance") < 100)
        & F.col("passenger_count").isNotNull()
    )
    return state.enter(inputs["load_trips"]).rows(lambda df: df.where(keep))


def derive_time(inputs: Mapping[str, WorldFrame], state: State) -> WorldFrame:
    """Duration, hour and weekday; `duration_unit` (seconds per unit) is the unit change."""
    unit = state.value("duration_unit", DAY_SECONDS)
    return state.enter(inputs["filter_valid"]).rows(
        lambda df: df.withColumns(
            {
                "duration": elapsed("pickup_at", "dropoff_at", unit),
                "hour": F.hour("pickup_at").cast("long"),
                "dow": F.weekday("pickup_at").cast("long"),
            }
        ).where(F.col("duration").between(0, LONGEST))
    )


def zone_stats(inputs: Mapping[str, WorldFrame], state: State) -> WorldFrame:
    """Mean fare and trip count per pickup zone; fares are summed as BIGINT cents."""
    cents = F.sum(F.round(F.col("fare_amount") * 100).cast("long"))
    return inputs["derive_time"].group_by(
        ["pu_zone"],
        (cents / (F.count("fare_amount") * F.lit(100.0))).alias("zone_mean_fare"),
        F.count("*").alias("zone_trip_count"),
    )


def zone_role(zones: WorldFrame, role: str) -> WorldFrame:
    """The lookup under one role: key and region renamed."""
    return zones.rows(
        lambda df: df.select(
            "w", F.col("zone").alias(f"{role}_zone"), F.col("region").alias(f"{role}_region")
        )
    )


def join_pu_zone(inputs: Mapping[str, WorldFrame], state: State, parts: int | None = None) -> WorldFrame:
    """Attach the pickup region; `corrupt_ids` sends a share of keys to an unmatched zone."""
    trips = state.enter(inputs["derive_time"])
    if state.any("corrupt_ids", 0.0):
        broken = selected(F.col("trip_id"), state.value("corrupt_ids", 0.0), CORRUPT_SEED)
        key = F.when(broken, F.lit(UNKNOWN_ZONE)).otherwise(F.col("pu_zone"))
        trips = trips.rows(lambda df: df.withColumn("pu_zone", key))
    return trips.join(zone_role(inputs["load_zones"], "pu"), ["pu_zone"], "left", HOT_ZONE_SPREAD, parts, SALT)


def join_do_zone(inputs: Mapping[str, WorldFrame], state: State, parts: int | None = None) -> WorldFrame:
    """Attach the drop-off region; `duplicate_zones` doubles a share of the lookup."""
    zones = state.enter(zone_role(inputs["load_zones"], "do"))
    if state.any("duplicate_zones", 0.0):
        twice = selected(F.col("do_zone"), state.value("duplicate_zones", 0.0), DUPLICATE_SEED)
        copies = F.sequence(F.lit(1), F.when(twice, 2).otherwise(1))
        zones = zones.rows(lambda df: df.withColumn("copy", F.explode(copies)).drop("copy"))
    return inputs["join_pu_zone"].join(zones, ["do_zone"], "left", HOT_ZONE_SPREAD, parts, SALT)


def join_stats(inputs: Mapping[str, WorldFrame], state: State, parts: int | None = None) -> WorldFrame:
    joined = inputs["join_do_zone"].join(inputs["zone_stats"], ["pu_zone"], "left", HOT_ZONE_SPREAD, parts, SALT)
    return joined.rows(lambda df: df.na.fill(0.0, ["zone_mean_fare"]).na.fill(0, ["zone_trip_count"]))


def encode(inputs: Mapping[str, WorldFrame], state: State) -> WorldFrame:
    """Model columns, both region roles one-hot, label; then rows with gaps go."""
    label = F.coalesce(F.col("net_amount") > NET_LIMIT, F.lit(False)).cast("long")
    encoded = state.enter(inputs["join_stats"]).rows(
        lambda df: df.select(
            "w", *MEASURES,
            *one_hot("pu_region", REGIONS, "pu"), *one_hot("do_region", REGIONS, "do"),
            label.alias("label"),
        )
    )
    return encoded.without(state.field, state.values("drop_columns", ())).drop_incomplete()


def build(
    tables: Tables,
    faults: Mapping[str, list[Mapping]] | None = None,
    reference: tuple[str, str] = REFERENCE_HALF,
    incident: tuple[str, str] = INCIDENT_HALF,
    parts: int | None = None,
) -> Pipeline:
    """The pipeline; with `parts`, its joins measure their hot keys and cut these into pieces of
    about 1 / `parts` of the rows, where they would salt each zone alike. A lookup of zones is a small
    table, so what it is joined to is not worth keeping, unless the hot keys were measured for it."""
    faults = faults or {}

    def op(name, parents, body, base, wide=False, totals=False):
        variants = tuple({**base, **extra} for extra in faults.get(name, ()))
        return Operator(name, parents, body, base, variants, wide, totals)

    return Pipeline(
        [
            Operator("load_trips", (), load_trips(tables, parts), {"half": reference}, ({"half": incident},), wide=True),
            Operator("load_zones", (), load_zones(tables)),
            op("filter_valid", ("load_trips",), filter_valid, {"min_fare": 0.0}),
            op("derive_time", ("filter_valid",), derive_time, {"duration_unit": DAY_SECONDS}),
            op("zone_stats", ("derive_time",), zone_stats, {}, wide=True, totals=True),
            op("join_pu_zone", ("derive_time", "load_zones"), partial(join_pu_zone, parts=parts), {}, wide=parts is not None),
            op("join_do_zone", ("join_pu_zone", "load_zones"), partial(join_do_zone, parts=parts), {}, wide=parts is not None),
            op("join_stats", ("join_do_zone", "zone_stats"), partial(join_stats, parts=parts), {}, wide=parts is not None),
            op("encode", ("join_stats",), encode, {"drop_columns": ()}),
        ],
        sink="encode",
    )


def probe_pipeline(tables: Tables) -> Pipeline:
    return build(tables, reference=PROBE_HALF, incident=PROBE_HALF)


def probe(tables: Tables, given: Mapping[str, WorldFrame] | None = None) -> DataFrame:
    """Trips of a third half-year, all operators at reference; `given` are `wide_sources` of `probe_pipeline`."""
    return Replay(probe_pipeline(tables), given=given).sink().world(0)
