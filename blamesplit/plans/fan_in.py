"""Fan-in of m branches: n = 3m + 3 operators, one row per user.

The first branches load one event type of one week each, summed per user; further ones load the
same types from the beginning up to the end of that week. The branches are joined on the user. The
label marks users whose total over the whole month is above a fixed limit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from blamesplit.functions.columns import noise
from blamesplit.plans.pipeline import Operator, Pipeline
from blamesplit.plans.replay import Replay
from blamesplit.plans.worlds import State, WorldFrame

# Branches, label limit, first days of the three weeks, size and seed of the noise.
BRANCHES = ["click", "error", "purchase", "signup", "view"]
HEAVY_USER = 3_300.0
REFERENCE_WEEK, INCIDENT_WEEK, PROBE_WEEK = date(2024, 1, 1), date(2024, 1, 15), date(2024, 1, 8)
NOISE_SIZE, NOISE_SEED = 500.0, 99
MOST_BRANCHES = 2 * len(BRANCHES)

Tables = Callable[[str], DataFrame]


def column_of(kind: str, b: int, week: date) -> str:
    return f"{kind}{b}_{week:%Y%m%d}"


def user_sums(tables: Tables, weeks: Iterable[date], branches: Iterable[int], total: bool = True) -> DataFrame:
    """One row per user: cents and events of every branch in every week, and the month's `total` cents.

    One pass over the events, whatever the number of branches and weeks.
    """
    cents = F.round(F.col("value") * 100).cast("long")
    events = tables("events").select("user_id", "event_type", "ts", cents.alias("cents"))
    aggregates = [F.sum("cents").alias("total")] if total else []
    either = F.lit(False)
    for b in branches:
        for week in sorted(set(weeks)):
            low, high = (F.lit(str(d)).cast("timestamp_ntz") for d in (week, week + timedelta(days=7)))
            inside = (F.col("event_type") == BRANCHES[b % len(BRANCHES)]) & (F.col("ts") < high)
            if b < len(BRANCHES):
                inside = inside & (F.col("ts") >= low)
            either = either | inside
            aggregates += [
                F.sum(F.when(inside, F.col("cents"))).alias(column_of("x", b, week)),
                F.count(F.when(inside, F.lit(1))).alias(column_of("w", b, week)),
            ]
    kept = events.where("user_id IS NOT NULL")
    return (kept if total else kept.where(either)).groupBy("user_id").agg(*aggregates)


def load_branch(tables: Tables, b: int, sums: DataFrame | None = None):
    """Cents and events of each user with events in the state's week; `sums` are `user_sums` that hold them."""

    def body(inputs, state: State) -> WorldFrame:
        weeks = state.values("week")
        users = user_sums(tables, weeks.values(), [b], total=not b) if sums is None else sums
        picked = lambda kind: state.by_state({c: F.col(column_of(kind, b, week)) for c, week in weeks.items()})
        columns = [(picked("x") / F.lit(100.0)).alias(f"x{b}"), picked("w").cast("double").alias(f"w{b}")]
        if not b:
            columns.append((F.col("total") > int(HEAVY_USER * 100)).cast("long").alias("label"))
        present = state.partition(users, lambda p: F.col(column_of("w", b, p["week"])) > 0)
        return present.rows(lambda df: df.select("w", F.col("user_id").alias("entity_id"), *columns))

    return body


def clean_branch(b: int):
    def body(inputs, state: State) -> WorldFrame:
        keep = F.col(f"w{b}") > state.value("floor", 0.0)
        return state.enter(inputs[f"load_{b}"]).rows(lambda df: df.where(keep))

    return body


def mix_noise(value, share, key, seed):
    """(1 - share) * value + share * noise; the noise is a hash of the key."""
    return (1 - share) * value + share * (noise(key, seed) * NOISE_SIZE)


def agg_branch(b: int):
    def body(inputs, state: State) -> WorldFrame:
        frame = state.enter(inputs[f"clean_{b}"])
        if not state.any("corrupt", 0.0):
            return frame
        mixed = mix_noise(
            F.col(f"x{b}"), state.value("corrupt", 0.0), F.col("entity_id"), NOISE_SEED + b
        )
        return frame.rows(lambda df: df.withColumn(f"x{b}", mixed))

    return body


def join_all(m: int):
    def body(inputs, state: State) -> WorldFrame:
        branches = [inputs[f"agg_{b}"] for b in range(m)]
        return reduce(lambda left, right: left.join(right, ["entity_id"]), branches)

    return body


def filter_rows(inputs: Mapping[str, WorldFrame], state: State) -> WorldFrame:
    return state.enter(inputs["join_all"]).head_fraction(
        "entity_id", state.values("keep", 1.0), state.field
    )


def encode(inputs: Mapping[str, WorldFrame], state: State) -> WorldFrame:
    frame = inputs["filter_rows"]
    kept = [c for c in frame.columns if c[0] in "xw" and c[1:].isdigit()]
    return frame.rows(lambda df: df.select("w", *kept, "label"))


def build(
    tables: Tables,
    m: int,
    fault_branch: int = 0,
    corrupt: float = 0.0,
    reference: date = REFERENCE_WEEK,
    incident: date = INCIDENT_WEEK,
    sums: DataFrame | None = None,
) -> Pipeline:
    """The pipeline of m branches. Pipelines that are given the same kept `sums` (`user_sums` of all
    their weeks and branches) read the events once between them."""
    if not 1 <= m <= MOST_BRANCHES:
        raise ValueError(f"m must be 1 to {MOST_BRANCHES}")
    ops = []
    for b in range(m):
        variants = ({"corrupt": corrupt},) if b == fault_branch and corrupt else ()
        ops += [
            Operator(f"load_{b}", (), load_branch(tables, b, sums), {"week": reference}, ({"week": incident},), wide=sums is None),
            Operator(f"clean_{b}", (f"load_{b}",), clean_branch(b), {"floor": 0.0}),
            Operator(f"agg_{b}", (f"clean_{b}",), agg_branch(b), {"corrupt": 0.0}, variants),
        ]
    ops += [
        Operator("join_all", tuple(f"agg_{b}" for b in range(m)), join_all(m), wide=True),
        Operator("filter_rows", ("join_all",), filter_rows, {"keep": 1.0}),
        Operator("encode", ("filter_rows",), encode),
    ]
    return Pipeline(ops, sink="encode")


def probe(tables: Tables, m: int, sums: DataFrame | None = None) -> DataFrame:
    pipeline = build(tables, m, reference=PROBE_WEEK, incident=PROBE_WEEK, sums=sums)
    return Replay(pipeline).sink().world(0)
