"""ROC AUC of one table under many linear scores: runs of equal scores, cut into slices of the order.

Spark deals the rows and shuffles the runs; a task scores a block of rows in one world after the
other, and a group is one slice of one world's order, whose length does not grow with the table.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from decimal import ROUND_HALF_UP, Context, Decimal

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks need no copy of the package for these few steps

BLOCK = 1 << 16  # rows that are scored at once
SLICE = 1 << 18  # rows that a slice of an order should hold
SPREAD = 64  # sampled rows for each slice, to cut the order by
LEAST_SAMPLE = 2_000
BATCH = 1 << 18  # scores in a batch that leaves a task
RUNS = "w long, part int, s array<double>, pos array<long>, neg array<long>"
SLICES = "w long, part int, pos long, neg long, wins double"

Weights = Sequence[tuple[int, Sequence[float]]]


def rounded(values: np.ndarray, digits: int) -> np.ndarray:
    """`F.round` of doubles, to the same bits: half up on the shortest decimal form.

    A value well away from a tie rounds to the nearest whole number of units; near ones and very
    large ones go through decimals.
    """
    units = np.abs(values) * 10.0**digits
    whole = np.floor(units + 0.5) / 10.0**digits
    out = np.where(values < 0, 0.0 - whole, whole)
    plain = (units < 1e15) & (np.abs(units - np.floor(units) - 0.5) > 1e-6 + units * 1e-15)
    unit, exact = Decimal(1).scaleb(-digits), Context(prec=400, rounding=ROUND_HALF_UP)
    for k in np.flatnonzero(~plain):
        if np.isfinite(values[k]):
            out[k] = float(Decimal(repr(float(values[k]))).quantize(unit, context=exact))
        else:
            out[k] = values[k]
    return out


def scores(columns: Sequence[np.ndarray], weights: Sequence[float], digits: int | None) -> np.ndarray:
    """The linear score of every row, summed in the order of the columns."""
    total = np.zeros(len(columns[0]))
    with np.errstate(invalid="ignore", over="ignore"):
        for x, k in zip(columns, weights, strict=True):
            total = total + k * x
        return total if digits is None else rounded(total, digits)


def features_of(block: pa.Table, features: Sequence[str]) -> list[np.ndarray]:
    """The feature columns as doubles; a missing value counts as 0."""
    return [block[c].fill_null(0.0).to_numpy() for c in features]


def cuts(probe: DataFrame, features: Sequence[str], weights: Weights, digits: int | None, rows: int, slices: int) -> list[np.ndarray]:
    """Per world the scores that part its order into slices, quantiles of a sample of the probe.

    They decide where the work goes, never the result. The sample has a fixed number of rows for
    each slice, so the driver sees no more of a larger probe than that.
    """
    asked = max(LEAST_SAMPLE, SPREAD * slices)
    some = probe.select(*features).sample(min(1.0, asked / max(rows, 1)), seed=1).limit(2 * asked).toArrow()
    columns = features_of(some, features)
    places = np.arange(1, slices) / slices
    found = []
    for _, vector in weights:
        s = scores(columns, vector, digits)
        s = np.sort(s[~np.isnan(s)])
        found.append(np.unique(s[(places * len(s)).astype(int)]) if len(s) else s)
    return found


def runs_of(features: Sequence[str], label: str, weights: Weights, digits: int | None, edges: Sequence[np.ndarray]):
    """Arrow step from probe rows to RUNS: the distinct scores of a block in each slice of each world."""

    def block_runs(block: pa.Table) -> Iterator[pa.RecordBatch]:
        columns, y = features_of(block, features), block[label].to_numpy()
        held: list[tuple] = []
        for (w, vector), edge in zip(weights, edges, strict=True):
            s = scores(columns, vector, digits)
            there = ~np.isnan(s)
            s, inverse = np.unique(s[there], return_inverse=True)
            if not len(s):
                continue
            pos = np.bincount(inverse, weights=y[there], minlength=len(s)).astype(np.int64)
            neg = np.bincount(inverse, minlength=len(s)) - pos
            ends = [0, *np.searchsorted(s, edge, side="right"), len(s)]  # a score equal to an edge is below it
            for part, (a, b) in enumerate(zip(ends, ends[1:])):
                if a < b:
                    held.append((w, part, s[a:b], pos[a:b], neg[a:b]))
            if sum(len(h[2]) for h in held) >= BATCH:
                yield run_batch(held)
                held = []
        if held:
            yield run_batch(held)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            waiting.append(batch)
            if sum(b.num_rows for b in waiting) >= BLOCK:
                yield from block_runs(pa.Table.from_batches(waiting))
                waiting = []
        if waiting:
            yield from block_runs(pa.Table.from_batches(waiting))

    return step


def run_batch(held: Sequence[tuple]) -> pa.RecordBatch:
    offsets = pa.array(np.concatenate([[0], np.cumsum([len(h[2]) for h in held])]).astype(np.int32))
    listed = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([h[k] for h in held]))) for k in (2, 3, 4)]
    keys = [pa.array([h[0] for h in held], pa.int64()), pa.array([h[1] for h in held], pa.int32())]
    return pa.RecordBatch.from_arrays([*keys, *listed], ["w", "part", "s", "pos", "neg"])


def ranked_slice(runs: pa.Table) -> pa.Table:
    """One slice of one world: its positives, negatives, and twice the pairs won inside it, ties half."""
    s, pos, neg = (runs[c].combine_chunks().flatten().to_numpy() for c in ("s", "pos", "neg"))
    s, inverse = np.unique(s, return_inverse=True)
    counted = []
    for n in (pos, neg):
        total = np.zeros(len(s), np.int64)
        np.add.at(total, inverse, n)
        counted.append(total)
    pos, neg = counted
    below = np.cumsum(neg) - neg
    wins = float(np.sum(pos.astype(float) * (2 * below + neg)))
    return pa.table(
        {"w": runs["w"][:1], "part": runs["part"][:1], "pos": pa.array([pos.sum()]), "neg": pa.array([neg.sum()]), "wins": pa.array([wins])}
    )


def world_slices(
    probe: DataFrame, features: Sequence[str], label: str, weights: Weights, digits: int | None, rows: int
) -> DataFrame:
    """(w, part, pos, neg, wins): the slices of every world's order of the probe; `label` is 0 or 1.

    A world has a slice for every SLICE rows, and all worlds together have some for every task.
    """
    tasks = int(probe.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slices = max(1, -(-4 * tasks // len(weights)), -(-rows // SLICE))
    edges = cuts(probe, features, weights, digits, rows, slices)
    runs = probe.select(*features, F.col(label).cast("long").alias(label)).mapInArrow(runs_of(features, label, weights, digits, edges), RUNS)
    return runs.groupBy("w", "part").applyInArrow(ranked_slice, SLICES)
