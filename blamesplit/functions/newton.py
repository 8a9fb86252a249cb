"""Logistic regressions of many worlds, fitted together by Newton steps over one tagged table.

A step sends the current coefficients (worlds x features, small) to the tasks; each Arrow batch
adds its rows' gradient and curvature per world, Spark sums them by (world, cell), and the driver
solves one features-sized linear system per world.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

from blamesplit.plans.worlds import W

MAX_STEPS = 500
TOLERANCE = 1e-9


def fit_worlds(
    rows: DataFrame,
    scaling: Mapping[int, Mapping[str, tuple[float, float]]],
    features: list[str],
    label: str,
) -> dict[int, dict[str, float]]:
    """Weights per world on the original scale: w -> {feature: weight}.

    `scaling` gives (mean, sd) of the features a world has; others stay out of its model.
    """
    size = len(features) + 1
    shift, factor = {}, {}
    for w, columns in scaling.items():
        shift[w] = np.array([columns[c][0] if c in columns else 0.0 for c in features])
        factor[w] = np.array([1.0 / columns[c][1] if c in columns else 0.0 for c in features])
    beta = {w: np.zeros(size) for w in scaling}
    penalty = np.diag([0.0] + [1.0] * len(features))
    best = {w: np.inf for w in scaling}
    step = {w: np.zeros(size) for w in scaling}
    open_worlds = set(scaling)
    data = rows.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        for _ in range(MAX_STEPS):
            todo = {w: beta[w] for w in open_worlds}
            sums = curvature(data, todo, shift, factor, features, label)
            for w in sorted(open_worlds):
                loss, gradient, hessian = sums[w]
                loss += 0.5 * beta[w] @ penalty @ beta[w]
                if loss > best[w] + 1e-9 * abs(best[w]):
                    step[w] = step[w] / 2  # overshot: take half of the last step instead
                    beta[w] = beta[w] + step[w]
                else:
                    best[w] = loss
                    slope = gradient + penalty @ beta[w]
                    step[w] = np.linalg.solve(hessian + penalty + 1e-12 * np.eye(size), slope)
                    beta[w] = beta[w] - step[w]
                if np.abs(step[w]).max() < TOLERANCE:
                    open_worlds.discard(w)
            if not open_worlds:
                break
        else:
            raise RuntimeError(f"no convergence in {MAX_STEPS} steps for worlds {sorted(open_worlds)}")
    finally:
        data.unpersist()
    return {
        w: {c: float(beta[w][i + 1] * factor[w][i]) for i, c in enumerate(features) if c in scaling[w]}
        for w in scaling
    }


def curvature(data, beta, shift, factor, features, label):
    """w -> (loss, gradient, hessian) at `beta`, summed by Spark."""
    size = len(features) + 1
    cells = 1 + size + size * size

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            worlds = batch.column(0).to_numpy(zero_copy_only=False)
            y_all = batch.column(1).to_numpy(zero_copy_only=False)
            x_all = np.column_stack(
                [batch.column(i + 2).fill_null(0.0).to_numpy(zero_copy_only=False) for i in range(len(features))]
            )
            for w in np.unique(worlds):
                w = int(w)
                if w not in beta:
                    continue
                here = worlds == w
                x, y = x_all[here], y_all[here]
                z = np.empty((len(x), size))
                z[:, 0] = 1.0
                z[:, 1:] = (x - shift[w]) * factor[w]
                eta = z @ beta[w]
                p = 1.0 / (1.0 + np.exp(-np.clip(eta, -500, 500)))
                out = totals.setdefault(w, np.zeros(cells))
                out[0] += float(np.sum(np.logaddexp(0.0, eta) - y * eta))
                out[1 : 1 + size] += z.T @ (p - y)
                out[1 + size :] += (z.T @ (z * (p * (1 - p))[:, None])).ravel()
        if totals:
            keys = sorted(totals)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(keys, cells), pa.int64()),
                    pa.array(np.tile(np.arange(cells), len(keys)), pa.int32()),
                    pa.array(np.concatenate([totals[k] for k in keys]), pa.float64()),
                ],
                names=[W, "cell", "value"],
            )

    columns = data.select(W, label, *features)
    sums = columns.mapInArrow(partial, f"{W} long, cell int, value double")
    table = sums.groupBy(W, "cell").agg(F.sum("value").alias("value")).toArrow()
    found = {w: np.zeros(cells) for w in beta}
    for w, cell, value in zip(*[table.column(i).to_pylist() for i in range(3)]):
        found[w][cell] = value
    return {
        w: (v[0], v[1 : 1 + size], v[1 + size :].reshape(size, size)) for w, v in found.items()
    }
