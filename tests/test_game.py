"""Attribution methods against brute force on random games."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from blamesplit.functions.local import local_table
from blamesplit.operators import game as g
from blamesplit.plans import reports

OPS = ["a", "b", "c", "d"]
BIT = {op: 1 << i for i, op in enumerate(OPS)}
ANCHORED = {"a", "d"}


def brute(v, free, held=0):
    """Average marginal contribution over all orders of the free players."""
    phi = dict.fromkeys(free, 0.0)
    for order in itertools.permutations(free):
        mask = held
        for op in order:
            phi[op] += v[mask | BIT[op]] - v[mask]
            mask |= BIT[op]
    return {op: x / math.factorial(len(free)) for op, x in phi.items()}


@pytest.fixture(scope="module")
def world(spark):
    rng = random.Random(5)
    values = {
        "additive": {m: sum((k + 1) * (m >> k & 1) for k in range(4)) / 8 for m in range(16)},
        "random": {m: (0.0 if m == 0 else rng.uniform(-1, 1)) for m in range(16)},
        "both_needed": {m: -1.0 if m & 6 == 6 else 0.0 for m in range(16)},
    }
    rows = [(s, m, v + 0.5, v) for s, vs in values.items() for m, v in vs.items()]
    game = local_table(spark, "scenario string, mask long, u double, v double", rows)
    players = [(s, op, BIT[op], op in ANCHORED, True) for s in values for op in OPS]
    # an operator that never changes anything, and is not part of the masks
    players += [(s, "zz_idle", 16, False, False) for s in values]
    schema = "scenario string, op string, bit long, anchored boolean, sensitive boolean"
    return values, game, local_table(spark, schema, players)


def by_scenario(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.scenario, {})[r.op] = r.phi
    return out


def test_exact_shapley_equals_all_permutations(world):
    values, game, players = world
    found = by_scenario(g.exact_shapley(game, players))
    for s, v in values.items():
        expected = {**brute(v, OPS), "zz_idle": 0.0}
        assert found[s] == pytest.approx(expected, abs=1e-12)
        assert sum(found[s].values()) == pytest.approx(v[15], abs=1e-12)


def test_anchored_shapley_equals_brute_force(world):
    values, game, players = world
    held = sum(BIT[o] for o in ANCHORED)
    found = by_scenario(g.anchored_shapley(game, players))
    for s, v in values.items():
        expected = {**brute(v, ["b", "c"], held), "a": 0.0, "d": 0.0, "zz_idle": 0.0}
        assert found[s] == pytest.approx(expected, abs=1e-12)
        assert sum(found[s].values()) == pytest.approx(v[15] - v[held], abs=1e-12)


def test_no_free_player_gives_no_rows(world):
    _, game, players = world
    everyone = players.withColumn("anchored", F.lit(True))
    assert g.anchored_shapley(game, everyone).count() == 0


def test_leave_one_out(world):
    values, game, players = world
    found = by_scenario(g.leave_one_out(game, players))
    for s, v in values.items():
        expected = {op: v[15] - v[15 & ~BIT[op]] for op in OPS} | {"zz_idle": 0.0}
        assert found[s] == pytest.approx(expected)


def test_boundary_identities(world):
    _, game, players = world
    for row in reports.boundary_check(game, players).collect():
        assert row.max_gap < 1e-12, row


def test_sampling_is_exact_for_additive_games_and_close_otherwise(world):
    values, game, players = world
    exact = by_scenario(g.exact_shapley(game, players))
    found = by_scenario(g.sampled_shapley(game, g.no_anchor(players), 600, 3))
    assert found["additive"] == pytest.approx(exact["additive"], abs=1e-12)
    assert found["random"] == pytest.approx(exact["random"], abs=0.1)
    for s, v in values.items():
        assert sum(found[s].values()) == pytest.approx(v[15], abs=1e-12)
    anchored = by_scenario(g.sampled_shapley(game, players, 300, 3))
    exact_anchored = by_scenario(g.anchored_shapley(game, players))
    assert anchored["random"] == pytest.approx(exact_anchored["random"], abs=0.1)
    assert anchored["random"]["a"] == 0.0


def test_permutations_place_every_player_evenly(world):
    _, _, players = world
    one = players.where("scenario = 'random'")
    orders = g.permutations(one, 1000, 0)
    assert orders.groupBy("perm").agg(F.count_distinct("op").alias("n")).where("n <> 5").count() == 0
    spots = orders.groupBy("op", "pos").count().collect()
    assert len(spots) == 25
    assert all(130 < r["count"] < 270 for r in spots)


def test_stagewise_walks_one_order(world, spark):
    values, game, players = world
    order = [("random", 1, i + 1, op, BIT[op]) for i, op in enumerate(["c", "a", "d", "b"])]
    orders = local_table(spark, "scenario string, order_id long, pos long, op string, bit long", order)
    found = by_scenario(g.stagewise(game, players, orders, ["order_id"]))["random"]
    v, mask = values["random"], 0
    for _, _, _, op, bit in order:
        assert found[op] == pytest.approx(v[mask | bit] - v[mask])
        mask |= bit


def test_two_faults_needed_together_share_the_harm(world):
    _, game, players = world
    found = by_scenario(g.exact_shapley(game, players))["both_needed"]
    assert found == pytest.approx({"a": 0, "b": -0.5, "c": -0.5, "d": 0, "zz_idle": 0})
    double = by_scenario(g.leave_one_out(game, players))["both_needed"]
    assert double["b"] + double["c"] == pytest.approx(-2.0)


def lattice(spark, n, scenario="s"):
    schema = "scenario string, op string, bit long, anchored boolean, sensitive boolean"
    players = local_table(spark, schema, [(scenario, f"p{i:02}", 1 << i, False, True) for i in range(n)])
    game = spark.range(1 << n).select(
        F.lit(scenario).alias("scenario"), F.col("id").alias("mask"), F.lit(0.0).alias("u"),
        F.bit_count("id").cast("double").alias("v"),
    )
    return game, players


def test_weights_of_many_players(spark):
    """In a game that counts its players each is worth 1, also where 21! has no place in a BIGINT."""
    rows = g.shapley_weights(spark).where("n_free IN (21, 63)").collect()
    for n in (21, 63):
        mine = {r.size: r.weight for r in rows if r.n_free == n}
        assert sum(mine[k] * math.comb(n - 1, k) for k in range(n)) == pytest.approx(1)
    game, players = lattice(spark, 12)
    assert [r.phi for r in g.exact_shapley(game, players).collect()] == pytest.approx([1.0] * 12)


@pytest.mark.parametrize("gone", [0, 2, 3])
def test_a_gap_in_the_game_is_an_error(spark, gone):
    game, players = lattice(spark, 2)
    short = game.where(F.col("mask") != gone)
    orders = local_table(spark, "scenario string, order_id long, pos long, op string, bit long", [("s", 1, 1, "p01", 2), ("s", 1, 2, "p00", 1)])
    results = [g.exact_shapley(short, players), g.stagewise(short, players, orders, ["order_id"]), g.sampled_shapley(short, g.no_anchor(players), 20, 1)]
    if gone != 0:
        results.append(g.leave_one_out(short, players))
    for df in results:
        with pytest.raises(Exception, match="the game (has no value for|lacks) coalition"):
            df.collect()


def test_blame_over_all_orders_by_downsets(spark, world):
    """Extremes and first-blamed counts equal a walk along every order."""
    from types import SimpleNamespace

    from blamesplit.operators import lineage, scoring

    values, game, players = world
    edges = [("a", "b"), ("c", "d")]
    nodes = local_table(spark, "op string, bit long", list(BIT.items()))
    steps = lineage.downset_steps(nodes, local_table(spark, "parent string, child string", edges))
    orders = [o for o in itertools.permutations(OPS) if all(o.index(p) < o.index(c) for p, c in edges)]
    assert lineage.count_orders(steps) == len(orders)
    here = players.where("op <> 'zz_idle'")
    blame = g.step_blame(game, here, steps)
    culprits = local_table(spark, "scenario string, op string", [("random", "b")])
    study = SimpleNamespace(culprits=lambda: culprits, pipeline=SimpleNamespace(names=OPS))
    low, high, first = {}, {}, {}
    for s, v in values.items():
        for order in orders:
            mask, phi = 0, {}
            for op in order:
                phi[op] = v[mask | BIT[op]] - v[mask]
                mask |= BIT[op]
                low[s, op] = min(low.get((s, op), 9), phi[op])
                high[s, op] = max(high.get((s, op), -9), phi[op])
            top = min(phi, key=lambda o: (round(phi[o], 9), o))
            first[s, top] = first.get((s, top), 0) + 1
    found = reports.order_dependence(study, blame, len(orders), game, here).collect()
    assert {(r.scenario, r.op): (r.stagewise_min, r.stagewise_max) for r in found} == {k: (low[k], high[k]) for k in low}
    assert {r.n_orders for r in found} == {len(orders)}
    assert {(r.scenario, r.op): r.n_orders for r in reports.order_top_blamed(study, blame).collect()} == first


@pytest.mark.parametrize("chunk", [1, 2, 5])
def test_subset_sums_equal_brute_force(spark, chunk):
    from blamesplit.operators import lattice

    rng = random.Random(chunk)
    rows = [(rng.randrange(32), rng.randrange(9)) for _ in range(40)] + [(None, 5), (40, 5)]
    found = lattice.subset_sums(spark.createDataFrame(rows, "mask long, value long"), 5, chunk)
    want = {m: sum(x for k, x in rows if k is not None and k < 32 and k & m == k) for m in range(32)}
    assert {r.mask: r.total for r in found.collect()} == want


def test_many_coalitions_are_made_by_the_executors(spark, monkeypatch, tables):
    from blamesplit.plans import fan_in

    pipeline = fan_in.build(tables, 3, 0, 0.9)
    scenarios = {s: (pipeline, {n: 1 for n in pipeline.fields if n != skip}) for s, skip in (("a", ""), ("b", "load_0"))}
    few = sorted(map(tuple, g.coalition_worlds(spark, scenarios).collect()))
    monkeypatch.setattr(g, "MAX_LOCAL_ROWS", 1)
    assert sorted(map(tuple, g.coalition_worlds(spark, scenarios).collect())) == few
