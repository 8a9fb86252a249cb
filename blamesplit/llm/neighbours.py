"""Approximate nearest neighbours by robust-pruned directed graphs, one for each shard.

Every valid vector belongs to one shard of about `SHARD_ROWS` vectors, chosen by a hash. In a shard,
equal vectors share a node. The graph starts from random edges; nodes are inserted in batches: a
greedy beam search proposes neighbours, starting from the nearest of many entry nodes, as clusters
that lie apart need an entry each; and robust pruning keeps a diverse few: walking outwards, a candidate is dropped if a kept one is nearer to it,
by the factor `ALPHA`, than the node itself. Edges are then mirrored, and nodes with too many are
pruned again. The graphs are a table of their own, so a lost executor costs no index.

Queries travel to the shards: every shard gets each query, and its graph is only copied for each
further `QUERY_ROWS` of them, which bounds a unit of work. It is a beam search on the shard's graph,
with exact distances in double precision for what it finds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blamesplit.llm.jaccard import units
from blamesplit.llm.staging import written

SHARD_ROWS, QUERY_ROWS = 8192, 65_536
DEGREE, BUILD_BEAM, SEARCH_BEAM, ALPHA = 32, 64, 192, 1.2
#: Nodes that are expanded, and searches that run, at once.
EXPANDED, BATCH = 4, 512
#: Entry nodes of a graph, and those nearest to a query from which its search starts.
ENTRIES, STARTS = 512, 8


class Graph:
    """Distinct vectors as nodes, and each node's out-edges; -1 fills up."""

    def __init__(self, x: np.ndarray, edges: np.ndarray):
        # by a power of two, which rounds nothing, so that squares stay finite
        self.scale = x.dtype.type(2.0 ** int(np.frexp(np.abs(x).max(initial=0))[1]))
        self.x, self.edges = x / self.scale, edges
        x = self.x
        self.norm = np.einsum("nd,nd->n", x, x)
        # entries spread like the nodes themselves, so every cluster of some size holds one
        self.entries = np.random.default_rng(5).permutation(len(x))[:ENTRIES]

    def distances(self, q: np.ndarray, q_norm: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """Squared distances of each query to its own list of nodes; far for -1."""
        d = q_norm[:, None] + self.norm[nodes] - 2 * np.matmul(self.x[nodes], q[:, :, None])[:, :, 0]
        return np.where(nodes < 0, np.inf, np.maximum(d, 0))

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The nodes that a beam search keeps for each query, nearest first, and squared distances,
        scaled like the graph."""
        q = q / self.scale
        n, q_norm = len(q), np.einsum("nd,nd->n", q, q)
        nodes = np.full((n, beam), -1, np.int64)
        far = np.full((n, beam), np.inf, q.dtype)
        done = np.ones((n, beam), bool)
        if not len(self.x):
            return nodes, far
        d = q_norm[:, None] + self.norm[self.entries] - 2 * q @ self.x[self.entries].T
        first = np.argsort(d, 1, kind="stable")[:, : min(STARTS, beam)]
        begun = first.shape[1]
        nodes[:, :begun] = self.entries[first]
        far[:, :begun] = np.maximum(np.take_along_axis(d, first, 1), 0)
        done[:, :begun] = False
        going = np.arange(n)
        while len(going):
            at = np.argsort(np.where(done[going], np.inf, far[going]), 1, kind="stable")[:, :EXPANDED]
            some = np.take_along_axis(nodes[going], at, 1)
            fresh = np.take_along_axis(~done[going], at, 1)
            marked = done[going]
            np.put_along_axis(marked, at, True, 1)
            new = np.where(fresh[:, :, None], self.edges[some], -1).reshape(len(going), -1)
            new.sort(1)
            new[:, 1:][new[:, 1:] == new[:, :-1]] = -1
            new[(new[:, :, None] == nodes[going][:, None, :]).any(2)] = -1
            d = self.distances(q[going], q_norm[going], new)
            every = np.concatenate([nodes[going], new], 1)
            dist = np.concatenate([far[going], d], 1)
            seen = np.concatenate([marked, new < 0], 1)
            best = np.argsort(dist, 1, kind="stable")[:, :beam]
            nodes[going] = np.take_along_axis(every, best, 1)
            far[going] = np.take_along_axis(dist, best, 1)
            done[going] = np.take_along_axis(seen, best, 1) | (nodes[going] < 0)
            going = going[~done[going].all(1)]
        return nodes, far

    def pruned(self, own: np.ndarray, candidates: np.ndarray) -> np.ndarray:
        """Robust pruning: DEGREE of each row of candidates at most (-1 fills up), for nodes `own`."""
        c = np.where(candidates == own[:, None], -1, candidates)
        c = np.sort(c, 1)
        c[:, 1:][c[:, 1:] == c[:, :-1]] = -1
        d = self.distances(self.x[own], self.norm[own], c)
        order = np.argsort(d, 1, kind="stable")
        c, d = np.take_along_axis(c, order, 1), np.take_along_axis(d, order, 1)
        x = self.x[c]
        between = np.maximum(self.norm[c][:, :, None] + self.norm[c][:, None, :] - 2 * np.matmul(x, x.transpose(0, 2, 1)), 0)
        alive, kept = c >= 0, np.zeros(c.shape, bool)
        count = np.zeros(len(c), np.int64)
        for i in range(c.shape[1]):
            take = alive[:, i] & (count < DEGREE)
            kept[:, i] = take
            count += take
            alive &= ~(take[:, None] & (ALPHA**2 * between[:, i] <= d))
        out = np.full((len(c), DEGREE), -1, np.int64)
        row, col = np.nonzero(kept)
        out[row, (np.cumsum(kept, 1) - 1)[row, col]] = c[row, col]
        return out


def built(x: np.ndarray, seed: int = 3) -> Graph:
    """The graph of distinct vectors."""
    n = len(x)
    rng = np.random.default_rng(seed)
    g = Graph(x, np.full((n, DEGREE), -1, np.int64))
    if n < 2:
        return g
    g.edges[:, : DEGREE // 2] = rng.integers(0, n, (n, DEGREE // 2))
    order = rng.permutation(n)
    for k in range(0, n, BATCH):
        own = order[k : k + BATCH]
        found, _ = g.search(x[own], min(BUILD_BEAM, n))
        g.edges[own] = g.pruned(own, np.concatenate([found, g.edges[own]], 1))
        _mirrored(g, own)
    return g


def _mirrored(g: Graph, own: np.ndarray) -> None:
    """Adds the back-edges of `own`'s edges; nodes with more than DEGREE edges are pruned."""
    source = np.repeat(own, DEGREE)
    target = g.edges[own].reshape(-1)
    source, target = source[target >= 0], target[target >= 0]
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    nodes, first, counts = np.unique(target, return_index=True, return_counts=True)
    slot = np.arange(len(target)) - np.repeat(first, counts)
    for low in range(0, int(counts.max(initial=0)), DEGREE):
        here = (slot >= low) & (slot < low + DEGREE)
        more = np.full((len(nodes), DEGREE), -1, np.int64)
        more[np.searchsorted(nodes, target[here]), slot[here] - low] = source[here]
        some = np.flatnonzero((more >= 0).any(1))
        for k in range(0, len(some), BATCH):
            part = some[k : k + BATCH]
            both = np.concatenate([g.edges[nodes[part]], more[part]], 1)
            both.sort(1)
            both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
            full = (both >= 0).sum(1) > DEGREE
            short = -np.sort(-both, 1)[:, :DEGREE]
            if full.any():
                short[full] = g.pruned(nodes[part][full], both[full])
            g.edges[nodes[part]] = short


def _valid(v: Column) -> Column:
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return v.isNotNull() & ~bad & F.exists(v, lambda c: c != 0)


def _vectors(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """Valid rows (vec_id, v). Floats stay floats; other numbers become doubles."""
    kind = "array<float>" if dict(df.dtypes)[vector] == "array<float>" else "array<double>"
    v = F.col(vector).cast(kind)
    return df.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & _valid(F.col("v")))


def index(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The graphs of all valid vectors, as a table in the shared folder: one row for each node:
    (dim, shard, node, ids, v, edges). Every row is indexed.

    Vectors that are null, empty, zero, or hold a null or non-finite component take no part, nor do
    rows without id. Vectors of other lengths live in graphs of their own.
    """
    vectors = _vectors(df, vec_id, vector)
    kind = dict(vectors.dtypes)["v"]
    shards = max(1, -(-vectors.count() // shard_rows))
    keyed = vectors.select(F.size("v").alias("dim"), F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards)).cast("int").alias("shard"), "vec_id", "v")
    dealt = keyed.repartition(shards, "dim", "shard").sortWithinPartitions("dim", "shard", "vec_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in units(batches, 2):
            ids = unit["vec_id"].to_numpy()
            x = unit["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
            distinct, node = np.unique(x, axis=0, return_inverse=True)
            node = node.reshape(-1)
            g = built(distinct)
            by = np.argsort(node, kind="stable")
            counts = np.bincount(node, minlength=len(distinct))
            offsets = pa.array(np.append(0, np.cumsum(counts)).astype(np.int32))
            n, dim = distinct.shape
            degree = (g.edges >= 0).sum(1)
            edges = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(degree)).astype(np.int32)), pa.array(g.edges[g.edges >= 0].astype(np.int32)))
            vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, n * dim + 1, dim, dtype=np.int32)), pa.array(distinct.reshape(-1)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, dim, np.int32)), pa.array(np.full(n, unit["shard"][0].as_py(), np.int32)), pa.array(np.arange(n, dtype=np.int32)), pa.ListArray.from_arrays(offsets, pa.array(ids[by])), vectors, edges],
                ["dim", "shard", "node", "ids", "v", "edges"],
            )

    return written(dealt.mapInArrow(run, f"dim int, shard int, node int, ids array<long>, v {kind}, edges array<int>"))


def search(graphs: DataFrame, queries: DataFrame, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each valid query the `k` nearest found, or all if fewer,
    by Euclidean distance, ties to the smaller id; rows of the query's own id are not candidates.

    Every distinct (id, vector) is a query, so an id with several vectors has several answers; equal
    rows are answered once. Repeated rows of the index count each. No query, or an empty index, gives
    no rows.
    """
    kind = dict(graphs.dtypes)["v"]
    asked = _vectors(queries, vec_id, vector).select("vec_id", F.col("v").cast(kind).alias("v")).dropDuplicates(["vec_id", "v"])
    blocks = max(1, -(-asked.count() // QUERY_ROWS))
    last = graphs.agg(F.max("shard")).first()[0]
    if last is None:
        return asked.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    one = asked.select(
        F.size("v").alias("dim"), F.explode(F.sequence(F.lit(0), F.lit(last))).alias("shard"), block.alias("block"),
        F.lit(-1).alias("node"), F.array(F.col("vec_id"), F.xxhash64("v")).alias("ids"), "v", F.array().cast("array<int>").alias("edges"),
    )
    other = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select(*one.columns)
    rows = one.unionByName(other).repartition((last + 1) * blocks, "dim", "shard", "block").sortWithinPartitions("dim", "shard", "block", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in units(batches, 3):
            node = unit["node"].to_numpy()
            n_queries = int((node < 0).sum())
            if not n_queries or n_queries == len(node):
                continue
            x = unit["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(node), -1)
            q, x = x[:n_queries], x[n_queries:]
            edges = np.full((len(x), DEGREE), -1, np.int64)
            for i, e in enumerate(unit["edges"].to_pylist()[n_queries:]):
                edges[i, : len(e)] = e
            ids = unit["ids"].to_pylist()
            g = Graph(x, edges)
            out: list[tuple[int, int, int, float]] = []
            for at in range(0, n_queries, BATCH):
                found, _ = g.search(q[at : at + BATCH], min(max(SEARCH_BEAM, 2 * k), len(x)))
                for j, row in enumerate(found):
                    own, key = ids[at + j]
                    row = row[row >= 0]
                    exact = np.sqrt(((x[row].astype(float) - q[at + j].astype(float)) ** 2).sum(1))
                    near = sorted((s, i) for s, r in zip(exact.tolist(), row.tolist(), strict=True) for i in ids[n_queries + r][: k + 1] if i != own)[:k]
                    out += [(own, key, i, s) for s, i in near]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*out, strict=True)], ["query_id", "key", "vec_id", "score"])

    found = rows.mapInArrow(run, "query_id long, key long, vec_id long, score double")
    best = Window.partitionBy("query_id", "key").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def recall(spark_df: DataFrame, found: DataFrame, queries: DataFrame, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding") -> float:
    """The share of the exact `k` nearest that `found` holds, for a query set small enough to hold
    on the driver; all vectors are compared with it, in blocks."""
    asked = _vectors(queries, vec_id, vector).toPandas()
    q_ids, q = asked["vec_id"].to_numpy(), np.array(asked["v"].to_list(), float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1).astype(float)
            for i, v in zip(q_ids, q, strict=True):
                d = np.sqrt(((x - v) ** 2).sum(1))
                near = sorted((s, c) for s, c in zip(d.tolist(), ids.tolist(), strict=True) if c != i)[:k]
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(near), pa.int64()), pa.array([c for _, c in near], pa.int64()), pa.array([s for s, _ in near], pa.float64())], ["query_id", "vec_id", "score"])

    exact = _vectors(spark_df, vec_id, vector).mapInArrow(run, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    exact = exact.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    hits = exact.join(found.select("query_id", "vec_id").distinct(), ["query_id", "vec_id"], "left_semi").count()
    return hits / max(1, exact.count())
