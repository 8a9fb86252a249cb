"""Utilities: batch-fitted logistic regression, guards, Python utilities."""

import numpy as np
import pytest

from blamesplit.functions import newton
from blamesplit.functions import utility as ut
from blamesplit.plans.worlds import WorldFrame


@pytest.fixture(scope="module")
def sink(spark):
    """World 0 learns from both columns, world 1 has lost `b`, world 2 is too small."""
    rng = np.random.default_rng(3)
    rows = []
    for w, n in ((0, 300), (1, 200), (2, 20)):
        a, b = rng.normal(2, 3, n), rng.normal(-1, 0.5, n)
        y = (a / 3 + 2 * b + rng.normal(0, 1, n) > -1.3).astype(int)
        rows += [
            (w, float(x), float(z) if w != 1 else None, 5.0, int(k)) for x, z, k in zip(a, b, y)
        ]
    df = spark.createDataFrame(rows, "w long, a double, b double, same double, label int")
    return WorldFrame(df, frozenset([0, 1, 2]), 3, {"b": frozenset([(3, 1)])})


def newton_solution(x, y):
    """Coefficients of the penalised regression by plain Newton steps on one matrix."""
    sd = x.std(axis=0)
    sd[sd == 0] = 1
    z = np.column_stack([np.ones(len(x)), (x - x.mean(axis=0)) / sd])
    pen = np.diag([0.0] + [1.0] * x.shape[1])
    beta = np.zeros(z.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-z @ beta))
        beta -= np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + pen, z.T @ (p - y) + pen @ beta)
    return beta[1:] / sd


def test_batch_fit_equals_newton_per_world(sink):
    features = ["a", "b", "same"]
    stats = ut.moments(ut.class_statistics(sink, features), features)
    scaling = {
        w: {c: ut.mean_and_sd(stats[w], c) for c in ut.features_in(sink, w)} for w in (0, 1)
    }
    found = newton.fit_worlds(sink.df.where("w < 2"), scaling, features, "label")
    pdf = sink.df.toPandas()
    for w, cols in ((0, features), (1, ["a", "same"])):
        part = pdf[pdf.w == w]
        expected = newton_solution(part[cols].to_numpy(), part.label.to_numpy())
        assert list(found[w]) == cols
        assert [found[w][c] for c in cols] == pytest.approx(list(expected), abs=1e-8)


def test_batch_utility_equals_mllib(sink):
    probe = sink.df.where("w = 0").drop("w")
    found = {r.w: r.u for r in ut.logistic_utility(sink, probe).collect()}
    assert found[2] == 0.5
    for w in (0, 1):
        assert found[w] == pytest.approx(ut.single_logistic_auc(sink.world(w), probe), abs=1e-6)


def test_guards(sink, spark):
    checks = {r.w: (r.n_rows, r.n_classes, r.trainable) for r in ut.guards(sink).collect()}
    assert checks == {0: (300, 2, True), 1: (200, 2, True), 2: (20, 2, False)}
    one_class = WorldFrame(sink.df.where("label = 1"), sink.required, 3, sink.absent)
    assert not any(r.trainable for r in ut.guards(one_class).collect())
    bare = WorldFrame(sink.df.select("w", "label"), sink.required, 3)
    assert not any(r.trainable for r in ut.guards(bare).collect())
    unlabelled = WorldFrame(sink.df.drop("label"), sink.required, 3)
    assert not any(r.trainable for r in ut.guards(unlabelled).collect())


@pytest.mark.parametrize("n, expected", [(49, False), (50, True)])
def test_fifty_rows_are_enough(spark, n, expected):
    df = spark.range(n).selectExpr("0L AS w", "id AS x", "id % 2 AS label")
    assert ut.guards(WorldFrame(df, frozenset([0]))).collect()[0].trainable is expected


def test_python_and_metric_utilities(sink):
    from pyspark.sql import functions as F

    count = ut.Fold(
        lambda table: table.num_rows.to_bytes(8, "little"),
        lambda a, b: (int.from_bytes(a, "little") + int.from_bytes(b, "little")).to_bytes(8, "little"),
        lambda state: int.from_bytes(state, "little"),
    )
    rows = {r.w: r.u for r in ut.python_utility(sink, count).collect()}
    many = WorldFrame(sink.df.repartition(13), sink.required | {4}, 7, sink.absent)
    assert {r.w: r.u for r in ut.python_utility(many, count).collect()} == rows | {4: 0.5}
    assert rows == {0: 300.0, 1: 200.0, 2: 20.0}
    assert {r.w: r.u for r in ut.metric_utility(sink, F.count("*")).collect()} == rows


def test_missing_values_and_odd_labels(spark):
    rows = [(0, float(i % 17), None if i % 2 else float(i % 5), int(i % 17 > 8)) for i in range(200)]
    schema = "w long, a double, b double, label int"
    frame = WorldFrame(spark.createDataFrame(rows, schema), frozenset([0]))
    weights = ut.logistic_weights(frame)[0]
    assert weights["a"] > 0 and np.isfinite(weights["b"])
    void = [(w, a, None if y else b, y) for w, a, b, y in rows]
    gone = WorldFrame(spark.createDataFrame(void, schema), frozenset([0]))
    assert ut.discriminant_utility(gone, gone.df.drop("w")).collect()[0].u == pytest.approx(1.0)
    odd = WorldFrame(spark.createDataFrame(rows + [(0, 1.0, 1.0, 2)], schema), frozenset([0]))
    with pytest.raises(ValueError, match="labels must be 0 or 1"):
        ut.logistic_weights(odd)


def test_equal_sinks_are_fitted_once(spark, monkeypatch):
    one = spark.range(300).selectExpr("id % 7 AS a", "int(id % 7 > 2 OR id % 11 = 0) AS label")
    both = one.selectExpr("explode(array(0L, 1L)) AS w", "*")
    seen = []
    fit = newton.fit_worlds
    monkeypatch.setattr(ut, "fit_worlds", lambda rows, scaling, *rest: seen.append(sorted(scaling)) or fit(rows, scaling, *rest))
    weights = ut.logistic_weights(WorldFrame(both, frozenset([0, 1]), 1))
    assert seen == [[0]] and weights[0] == weights[1]
