"""Graph search against brute force: recall, exact scores, ties and odd rows."""

import math

import numpy as np

from blamesplit.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>, label int, shard string, node int"


def answers(df, queries, k=10, rows=neighbours.SHARD_ROWS):
    return neighbours.search(neighbours.index(df, shard_rows=rows), queries, k)


def test_recall_at_the_registered_shard_size():
    """A whole shard of clusters, of many tight clusters, and without any structure."""
    rng = np.random.default_rng(1)
    n = neighbours.SHARD_ROWS
    few, many = rng.normal(size=(40, 64)), rng.normal(size=(400, 64))
    for x in (
        few[rng.integers(0, 40, n)] * 3 + rng.normal(size=(n, 64)),
        many[rng.integers(0, 400, n)] * 3 + 0.2 * rng.normal(size=(n, 64)),
        rng.normal(size=(n, 64)),
    ):
        g = neighbours.built(x.astype(np.float32))
        asked = np.arange(0, n, 100)
        d = (x**2).sum(1)[None] - 2 * x[asked] @ x.T
        d[np.arange(len(asked)), asked] = np.inf
        true = np.argsort(d, 1)[:, :10]
        found, _ = g.search(x[asked].astype(np.float32), neighbours.SEARCH_BEAM)
        assert np.mean([len(set(t) & set(f)) / 10 for t, f in zip(true.tolist(), found.tolist(), strict=True)]) >= 0.95


def test_doubles_stay_doubles_and_ids_may_repeat(spark):
    rows = [(100, [1e39, 1.0]), (1, [1e39, 3.5]), (2, [1e39 * (1 + 1e-12), 1.0]), (200, [0.1, 0.2]), (200, [0.5, 0.2]), (200, [0.1, 0.2]), (3, [0.1, 0.3])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = answers(df, df.where("vec_id % 100 = 0"), k=1).collect()
    got = sorted((r.query_id, r.vec_id, round(r.score, 12)) for r in found)
    assert got == [(100, 1, 2.5), (200, 3, 0.1), (200, 3, round(math.dist([0.5, 0.2], [0.1, 0.3]), 12))]


def test_recall_and_scores(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    queries = df.where("vec_id % 100 = 0")
    found = answers(df, queries).cache()
    assert neighbours.recall(df, found, queries) >= 0.95
    vectors = {r.vec_id: np.array(r.embedding, float) for r in df.collect()}
    rows = found.collect()
    assert len(rows) == 10 * queries.count()
    for r in rows:
        assert r.vec_id != r.query_id
        assert math.isclose(r.score, math.dist(vectors[r.query_id], vectors[r.vec_id]), rel_tol=1e-12)


def test_graph_is_within_its_degree():
    x = np.random.default_rng(1).normal(size=(900, 8)).astype(np.float32)
    g = neighbours.built(x)
    assert g.edges.shape == (900, neighbours.DEGREE) and (g.edges < 900).all()
    assert not (g.edges == np.arange(900)[:, None]).any()
    found, _ = g.search(x[:50], 32)
    assert (found[:, 0] == np.arange(50)).mean() > 0.95


def test_ties_and_odd_rows(spark):
    e = [1.0, 2.0]
    rows = [(i, e, 0, "s", 1) for i in range(100, 160)] + [(200, [1.0, 2.5], 0, "", 0), (300, [0.0, 0.0], 0, "", 0), (400, None, 0, "", 0)]
    rows += [(500, [1.0, None], 0, "", 0), (600, [float("nan"), 1.0], 0, "", 0), (700, [float("inf"), 1.0], 0, "", 0), (None, e, 0, "", 0), (800, [], 0, "", 0), (900, [3.0], 0, "", 0), (901, [5.0], 0, "", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = answers(df, df.where("vec_id % 100 = 0 or vec_id is null")).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        by.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert by == {100: [(i, 0.0) for i in range(101, 111)], 200: [(i, 0.5) for i in range(100, 110)], 900: [(901, 2.0)]}


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert answers(df, df).collect() == []
    one = spark.createDataFrame([(100, [1.0, 0.0], 0, "", 0)], SCHEMA)
    assert answers(one, one).collect() == []
