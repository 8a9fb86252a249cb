"""Questions about a pipeline's edge table: closure, sources, children, orders, depth.

All take `nodes(op, bit, ...)` and `edges(parent, child)`, metadata of at most some dozens of rows.
Closures grow level by level; each level is settled, so a plan never holds more than one step, and
they stop as soon as nothing is new. Diamonds do not multiply paths.
"""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from blamesplit.functions.local import MAX_LOCAL_ROWS, local_table
from blamesplit.functions.stage import stage

COUNT = "decimal(38,0)"  # orders of a few dozen operators outgrow a BIGINT


def settled(df: DataFrame) -> DataFrame:
    """A few rows of metadata, kept as a local table."""
    return local_table(df.sparkSession, df.schema, [tuple(r) for r in df.collect()])


def ancestors(nodes: DataFrame, edges: DataFrame, sink: str, levels: int) -> DataFrame:
    """(op): operators that reach the sink, the sink included."""
    edges = settled(edges)
    reached = new = settled(nodes.where(F.col("op") == sink).select("op"))
    for _ in range(levels - 1):
        up = edges.join(new, edges["child"] == new["op"]).select(F.col("parent").alias("op"))
        new = settled(up.distinct().join(reached, "op", "left_anti"))
        if new.isEmpty():
            break
        reached = settled(reached.unionByName(new))
    return reached


def sources(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(op): operators without parents, the default anchor."""
    return nodes.select("op").join(
        edges.select(F.col("child").alias("op")).distinct(), "op", "left_anti"
    )


def children(edges: DataFrame, op: str) -> DataFrame:
    return edges.where(F.col("parent") == op).select(F.col("child").alias("op"))


def depth(nodes: DataFrame, edges: DataFrame, levels: int) -> DataFrame:
    """(op, depth): longest path from a source, sources at 0."""
    edges = settled(edges)
    deepest = settled(nodes.select("op", F.lit(0).cast("long").alias("depth")))
    for level in range(levels - 1):
        # operators that some path of this many steps reaches
        here = deepest.where(F.col("depth") == level)
        step = edges.join(here, edges["parent"] == here["op"]).select(F.col("child").alias("op")).distinct()
        step = settled(step.withColumn("depth", F.lit(level + 1).cast("long")))
        if step.isEmpty():
            break
        deepest = settled(deepest.unionByName(step).groupBy("op").agg(F.max("depth").alias("depth")))
    return deepest


def kept(df: DataFrame) -> DataFrame:
    """A table that later steps read several times: local if it is small, else a checkpoint."""
    rows = df.take(MAX_LOCAL_ROWS + 1)
    return local_table(df.sparkSession, df.schema, [tuple(r) for r in rows]) if len(rows) <= MAX_LOCAL_ROWS else stage(df)


def downset_steps(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(done, op, bit, orders): every step that some topological order takes, once.

    `done` is the set of operators before the step, closed under parents (a downset); `orders` is in
    how many ways it can be put in order. What a step does depends on `done` alone, so statements
    about all orders need a row per downset and operator, not a row per order.
    """
    listed = {r.op: r.bit for r in nodes.collect()}
    needs = dict.fromkeys(listed, 0)
    for r in edges.collect():
        needs[r.child] |= listed[r.parent]
    ready = F.array(*[
        F.struct(F.lit(o).alias("op"), F.lit(b).cast("long").alias("bit"), F.lit(needs[o]).cast("long").alias("needs"))
        for o, b in sorted(listed.items())
    ])
    done = F.col("done")
    fits = lambda s: (done.bitwiseAND(s["bit"]) == 0) & (done.bitwiseAND(s["needs"]) == s["needs"])
    now = local_table(nodes.sparkSession, f"done long, orders {COUNT}", [(0, Decimal(1))])
    steps = []
    for _ in listed:
        taken = now.select("done", "orders", F.explode(F.filter(ready, fits)).alias("s"))
        steps.append(kept(taken.select("done", "s.op", "s.bit", "orders")))
        now = steps[-1].groupBy(done.bitwiseOR(F.col("bit")).alias("done")).agg(F.sum("orders").cast(COUNT).alias("orders"))
    return reduce(DataFrame.unionByName, steps)


def count_orders(steps: DataFrame) -> int:
    """How many topological orders the graph has: the ways to take its last step."""
    ends = steps.groupBy(F.col("done").bitwiseOR(F.col("bit")).alias("all")).agg(F.sum("orders").alias("orders"))
    last = ends.orderBy(F.col("all").desc()).first()
    return int(last.orders) if last else 1


def topological_orders(nodes: DataFrame, edges: DataFrame, n: int, limit: int | None) -> DataFrame:
    """(order_id, pos, op, bit): the first `limit` topological orders (None: all), lexicographic by name.

    Orders grow one operator per step. Keeping the `limit` smallest prefixes of each length is
    exact, because every prefix that respects the edges can be completed.
    """
    rank = F.row_number().over(Window.orderBy("op")).cast("long") - 1
    coded = nodes.select("op", "bit", rank.alias("idx"))
    coded = coded.withColumn("code", F.lpad(F.col("idx").cast("string"), 3, "0"))
    needs = edges.join(coded, edges["parent"] == coded["op"]).groupBy("child").agg(
        F.sum("bit").alias("needs")
    )
    ready = coded.join(needs, coded["op"] == needs["child"], "left").select(
        "op", "bit", "code", "idx", F.coalesce("needs", F.lit(0).cast("long")).alias("needs")
    )
    start = F.lit("").alias("path"), F.lit(0).cast("long").alias("done"), F.array().cast("array<string>").alias("ops")
    paths = nodes.groupBy().agg(F.count("*").alias("c")).select(*start)
    for _ in range(n):
        fits = (F.col("done").bitwiseAND(F.col("bit")) == 0) & (
            F.col("done").bitwiseAND(F.col("needs")) == F.col("needs")
        )
        grown = (
            paths.withColumn("idx", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
            .join(ready, "idx")
            .where(fits)
            .select(
                F.concat("path", "code").alias("path"),
                F.col("done").bitwiseOR(F.col("bit")).alias("done"),
                F.concat("ops", F.array("op")).alias("ops"),
            )
        )
        paths = grown if limit is None else grown.orderBy("path").limit(limit)
    numbered = paths.withColumn(
        "order_id", F.row_number().over(Window.orderBy("path")).cast("long")
    ).select("order_id", F.posexplode("ops").alias("p", "op"))
    return numbered.select("order_id", (F.col("p") + 1).cast("long").alias("pos"), "op").join(
        coded.select("op", "bit"), "op"
    )
