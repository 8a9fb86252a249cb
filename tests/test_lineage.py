"""Closure, depth and orders on a diamond with a dead end."""

import pytest

from blamesplit.functions.local import local_table
from blamesplit.operators import lineage

EDGES = [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("b", "side"), ("e", "c")]
OPS = ["a", "b", "c", "d", "e", "side"]


@pytest.fixture(scope="module")
def graph(spark):
    nodes = local_table(spark, "op string, bit long", [(o, 1 << i) for i, o in enumerate(OPS)])
    return nodes, local_table(spark, "parent string, child string", EDGES)


def ops(df):
    return sorted(r.op for r in df.collect())


def test_closure_sources_children(graph):
    nodes, edges = graph
    assert ops(lineage.ancestors(nodes, edges, "d", 6)) == ["a", "b", "c", "d", "e"]
    assert ops(lineage.sources(nodes, edges)) == ["a", "e"]
    assert ops(lineage.children(edges, "b")) == ["d", "side"]


def test_depth_is_the_longest_path(graph):
    found = {r.op: r.depth for r in lineage.depth(*graph, 6).collect()}
    assert found == {"a": 0, "e": 0, "b": 1, "c": 1, "d": 2, "side": 2}


def all_orders():
    found = []

    def grow(path):
        if len(path) == len(OPS):
            found.append(path)
        for op in OPS:
            if op not in path and all(p in path for p, c in EDGES if c == op):
                grow(path + [op])

    grow([])
    return found


@pytest.mark.parametrize("limit", [1, 5, 1000])
def test_orders_are_complete_and_lexicographic(graph, limit):
    rows = lineage.topological_orders(*graph, len(OPS), limit).orderBy("order_id", "pos").collect()
    found = {}
    for r in rows:
        found.setdefault(r.order_id, []).append(r.op)
    assert list(found.values()) == all_orders()[:limit]
    assert list(found) == list(range(1, len(found) + 1))


def test_a_wide_and_a_long_graph(spark):
    """33 operators of ten branches, and a chain of 40: plans stay small and levels stop early."""
    wide = [(f"{a}_{b}", f"{c}_{b}") for b in range(10) for a, c in (("load", "clean"), ("clean", "agg"))]
    wide += [(f"agg_{b}", "join") for b in range(10)] + [("join", "filter"), ("filter", "encode")]
    chain = [(f"n{i:02}", f"n{i + 1:02}") for i in range(39)]
    for edges, sink, deepest in ((wide, "encode", 5), (chain, "n39", 39)):
        names = sorted({x for e in edges for x in e})
        nodes = local_table(spark, "op string, bit long", [(n, 1 << i) for i, n in enumerate(names)])
        table = local_table(spark, "parent string, child string", edges)
        assert ops(lineage.ancestors(nodes, table, sink, len(names))) == names
        found = {r.op: r.depth for r in lineage.depth(nodes, table, len(names)).collect()}
        assert len(found) == len(names) and found[sink] == deepest


def test_downsets_stand_for_all_orders(graph):
    """Steps, their counts and the number of orders against the enumeration."""
    steps = lineage.downset_steps(*graph)
    want = {}
    for order in all_orders():
        for k, op in enumerate(order):
            before = want.setdefault((sum(1 << OPS.index(o) for o in order[:k]), op), set())
            before.add(tuple(order[:k]))
    assert {(r.done, r.op): int(r.orders) for r in steps.collect()} == {k: len(v) for k, v in want.items()}
    assert lineage.count_orders(steps) == len(all_orders())


def test_orders_of_many_free_operators_are_counted(spark):
    """Two chains of ten: 20 choose 10 orders, but only 121 downsets."""
    edges = [(f"{c}{i}", f"{c}{i + 1}") for c in "xy" for i in range(9)]
    names = sorted({o for e in edges for o in e})
    nodes = local_table(spark, "op string, bit long", [(o, 1 << i) for i, o in enumerate(names)])
    steps = lineage.downset_steps(nodes, local_table(spark, "parent string, child string", edges))
    assert lineage.count_orders(steps) == 184756 and steps.count() == 220
