"""AUC of one probe under many linear scores against the ranking of scored rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from blamesplit.functions import ranks
from blamesplit.functions import utility as ut
from blamesplit.plans.worlds import WorldFrame

WEIGHTS = {0: {"a": 1.0, "b": -2.5}, 1: {"a": 0.001}, 2: {"a": 1e4, "b": 3e5}, 3: {}, 5: {"a": 1.0, "b": -2.5}, 6: {"b": float("inf")}}


@pytest.fixture(scope="module")
def probe(spark):
    rng = np.random.default_rng(5)
    rows = [(None if k % 11 == 0 else float(a), float(k % 3 - 1), None if k % 17 == 0 else int(a + k % 3 > 1)) for k, a in enumerate(rng.normal(0, 2, 900))]
    return spark.createDataFrame(rows + [(0.25, 0.0, k % 2) for k in range(400)], "a double, b double, label int")


def scored(probe, digits):
    """(w, score, label) as plain columns."""
    parts = []
    for w, k in WEIGHTS.items():
        score = F.lit(0.0)
        for c in ("a", "b"):
            score = score + F.lit(k.get(c, 0.0)) * F.coalesce(F.col(c), F.lit(0.0))
        score = score if digits is None else F.round(score, digits)
        parts.append(probe.select(F.lit(w).cast("long").alias("w"), score.alias("score"), "label"))
    df = parts[0]
    for part in parts[1:]:
        df = df.unionByName(part)
    return df


@pytest.mark.parametrize("digits", [None, 1, 6])
@pytest.mark.parametrize(("block", "length"), [(1 << 16, 1 << 18), (64, 50)])
def test_linear_auc_is_the_ranking_of_scores(spark, probe, monkeypatch, digits, block, length):
    monkeypatch.setattr(ranks, "BLOCK", block)
    monkeypatch.setattr(ranks, "SLICE", length)
    monkeypatch.setattr(ranks, "BATCH", 4 * block)
    want = {r.w: r.auc for r in ut.roc_auc(scored(probe, digits), ["w"], "score", "label").collect()}
    empty = spark.createDataFrame([], "w long, a double, b double, label int")
    sink = WorldFrame(empty, frozenset(range(8)), 7)
    got = {r.w: r.u for r in ut.linear_auc(sink, WEIGHTS, probe, digits=digits).collect()}
    assert got == {w: pytest.approx(want[w], abs=1e-12) if want.get(w) is not None else 0.5 for w in range(8)}


def test_longer_probes_have_more_slices(spark, probe, monkeypatch):
    """No task gets a share of the probe that grows with it, and equal scores stay together."""
    monkeypatch.setattr(ranks, "SLICE", 40)
    numbers = ut.align(probe, ["a", "b", "label"]).where("label IN (0, 1)")
    n = numbers.count()
    slices = ranks.world_slices(numbers, ["a", "b"], "label", [(0, (1.0, 0.5))], 6, n).collect()
    held = [r.pos + r.neg for r in slices]
    assert sum(held) == n and len(held) > 20
    assert sorted(held)[-2] < 200 and max(held) >= 400  # one score has 400 rows


def test_rounding_is_round(spark):
    near = [(k + 0.5) / 1e6 for k in range(-500, 500)]
    far = [float(x) for x in np.random.default_rng(2).normal(0, 1, 4000) * 10.0 ** np.tile(np.arange(-8, 12), 200)]
    odd = [float("inf"), -float("inf"), -0.0, -1e-9, 1e300, 1.0000005, 9007199254.740993]
    values = near + far + odd
    want = [r.x for r in spark.createDataFrame([(x,) for x in values], "x double").select(F.round("x", 6).alias("x")).collect()]
    with np.errstate(over="ignore", invalid="ignore"):
        got = ranks.rounded(np.array(values), 6).tolist()
    assert [v for v, a, b in zip(values, got, want, strict=True) if a != b] == []
