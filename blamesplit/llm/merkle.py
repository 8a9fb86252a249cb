"""A Merkle manifest of a dataset, its nodes labelled by nested intervals.

Each row is a leaf. The leaves of a group, in the order of their keys, are the ranks 0..n-1 of a
binary tree, and the groups' roots are in turn the leaves of one tree above. A node covers an interval
of ranks [lo, hi) and carries it as its label, so all relations follow from labels: a node's ancestors
are the nodes whose intervals contain its own, and its sibling is what remains of the parent's
interval when its own is taken away.

The containment joins are bucketed by level. A band is `BAND` levels; the nodes of a band that lie in
one interval of 2^BAND of its lowest nodes are a bucket, joined by equality and searched by interval
inside. Bands are built upwards, each on the top nodes of the one before, and searched downwards: what
lies above a bucket reaches it as one row, so proofs are never spread over leaves x levels rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blamesplit.llm.jaccard import units
from blamesplit.llm.staging import written

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
BAND = 10
#: Kinds of the rows that meet in a bucket, in the order they are read.
ABOVE, NODE, MEMBER = 0, 1, 2
#: Marks of a proof's steps: the sibling stands left, right, or there is none.
LEFT, RIGHT, ALONE = "<", ">", "."


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(columns: list[Column]) -> Column:
    """SHA-256 of the values, each `-` if null, else its UTF-8 byte count, a colon, and itself."""
    said = [c.cast("string") for c in columns]
    told = [F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in said]
    return F.sha2(F.concat(*told).cast("binary"), 256)


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """`rows` (tree, digest, ...) with `rank` in the tree, from 0 in `order`, and `total`, the tree's rows.

    One range shuffle; equal rows are told apart by where they were read, so a hot key spreads too.
    """
    keys = ["tree", *order, "__row"]
    sorted_rows = rows.withColumn("__row", F.monotonically_increasing_id())
    sorted_rows = sorted_rows.repartitionByRange(*(F.col(k).asc_nulls_first() for k in keys))
    sorted_rows = sorted_rows.sortWithinPartitions(*(F.col(k).asc_nulls_first() for k in keys)).drop("__row")
    placed = written(sorted_rows.withColumn("__at", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__at", 33)))
    counts = placed.groupBy("tree", "__part").agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
    whole = Window.partitionBy("tree")
    before = F.sum("__n").over(whole.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    # a row per tree and partition, written so that its size decides how it is joined
    starts = written(counts.select("tree", "__part", (F.coalesce(before, F.lit(0)) - F.col("__first")).alias("__plus"), F.sum("__n").over(whole).alias("total")))
    found = placed.join(starts, ["tree", "__part"])
    return found.withColumn("rank", F.col("__at") + F.col("__plus")).drop("__at", "__part", "__plus")


def height(total: int) -> int:
    """Levels above the leaves."""
    return max(total - 1, 0).bit_length()


NODES = "tree string, total long, level int, lo long, hi long, digest string"


def grown(members: DataFrame, band: int, width: int = BAND) -> DataFrame:
    """The nodes above `members` (tree, total, lo, hi, digest), which are all nodes of level
    band * width, up to level (band + 1) * width or the trees' tops."""
    bottom = band * width
    bucket = F.expr(f"lo >> {bottom + width}")
    rows = members.select("tree", bucket.alias("bucket"), "total", "lo", "hi", "digest")
    rows = rows.repartition("tree", "bucket").sortWithinPartitions("tree", "bucket", "lo")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in units(batches, 2):
            tree, total = unit["tree"][0].as_py(), unit["total"][0].as_py()
            lo, hi, now = unit["lo"].to_pylist(), unit["hi"].to_pylist(), unit["digest"].to_pylist()
            out: list[tuple] = []
            for level in range(bottom + 1, min(bottom + width, height(total)) + 1):
                now = [digest("".join(now[k : k + 2])) for k in range(0, len(now), 2)]
                lo, hi = lo[::2], [*hi[1::2], *hi[-1:]][: len(now)]
                out += [(tree, total, level, a, b, d) for a, b, d in zip(lo, hi, now, strict=True)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _NODE_TYPES, strict=True)], _NODE_NAMES)

    return rows.mapInArrow(run, NODES)


_NODE_NAMES = ["tree", "total", "level", "lo", "hi", "digest"]
_NODE_TYPES = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string()]


def as_nodes(members: DataFrame) -> DataFrame:
    return members.select("tree", "total", F.lit(0).alias("level"), F.col("rank").alias("lo"), (F.col("rank") + 1).alias("hi"), "digest")


def forest(members: DataFrame, width: int = BAND) -> list[DataFrame]:
    """The nodes above ranked leaves, a written table for each band."""
    most = members.agg(F.max("total")).first()[0] or 0
    bands, bottom = [], as_nodes(members)
    for band in range(max(1, -(-height(most) // width))):
        bands.append(written(grown(bottom, band, width)))
        bottom = bands[-1].where(F.col("level") == (band + 1) * width)
    return bands


def tops(members: DataFrame, bands: list[DataFrame]) -> DataFrame:
    """(tree, total, digest): each tree's root, a lone leaf itself; total is its leaves."""
    alone = members.where("total = 1").select("tree", "total", "digest")
    whole = [b.where("level = length(bin(total - 1)) and total > 1").select("tree", "total", "digest") for b in bands]
    return reduce(DataFrame.unionByName, whole, alone)


ROW = {
    "tree": "string", "bucket": "long", "kind": "int", "level": "int", "lo": "long", "hi": "long", "digest": "string",
    "path": "string", "subroot": "string", "root": "string", "doc_id": "long", "found": "string",
}


def _shaped(df: DataFrame, **given: Column) -> DataFrame:
    """Rows as they meet in a bucket: columns by name, `given` ones computed, others null."""
    return df.select(*(given.get(c, F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in ROW.items()))


def _paths(unit: pa.Table) -> tuple[dict, list[dict], list[list[str]]]:
    """The row above a bucket, the bucket's members, and each member's steps up to the root."""
    rows = unit.to_pylist()
    above = next(r for r in rows if r["kind"] == ABOVE)
    members = [r for r in rows if r["kind"] == MEMBER]
    levels: dict[int, list[dict]] = {}
    for r in rows:
        if r["kind"] != ABOVE:
            levels.setdefault(r["level"], []).append(r)
    order = sorted(levels)
    (top,) = levels[order[-1]]
    known = [above["path"].split() if above["path"] else []]
    upper_lo, upper_hi = np.array([top["lo"]]), np.array([top["hi"]])
    for level in reversed(order[:-1]):
        lo, hi = (np.array([r[c] for r in levels[level]]) for c in ("lo", "hi"))
        parent = np.searchsorted(upper_lo, lo, "right") - 1
        outer_lo, outer_hi = upper_lo[parent], upper_hi[parent]
        if not ((outer_lo <= lo) & (hi <= outer_hi)).all():
            raise ValueError("the labels of the manifest are not nested")
        # the interval of the parent without the node's own: before it, after it, or nothing
        rest_lo, rest_hi = np.where(outer_lo < lo, outer_lo, hi), np.where(outer_lo < lo, lo, outer_hi)
        sibling = np.minimum(np.searchsorted(lo, rest_lo), len(lo) - 1)
        some = rest_lo < rest_hi
        if not ((lo[sibling] == rest_lo) & (hi[sibling] == rest_hi))[some].all():
            raise ValueError("a sibling is missing from the manifest")
        marks = np.where(~some, ALONE, np.where(rest_lo < lo, LEFT, RIGHT)).tolist()
        said = [m if m == ALONE else m + levels[level][s]["digest"] for m, s in zip(marks, sibling.tolist(), strict=True)]
        known = [[step, *known[p]] for step, p in zip(said, parent.tolist(), strict=True)]
        upper_lo, upper_hi = lo, hi
    return above, members, known


def bucketed(members: DataFrame, nodes: DataFrame, above: DataFrame, band: int, width: int) -> DataFrame:
    """What lies above each bucket, the band's nodes in it, and its members, side by side."""
    bucket = F.expr(f"lo >> {(band + 1) * width}")
    rows = [
        _shaped(above, kind=F.lit(ABOVE)),
        _shaped(nodes, kind=F.lit(NODE), bucket=bucket),
        _shaped(members, kind=F.lit(MEMBER), bucket=bucket),
    ]
    return reduce(DataFrame.unionByName, rows).repartition("tree", "bucket").sortWithinPartitions("tree", "bucket", "kind", "level", "lo")


def folded(start: str, steps: list[str]) -> str:
    """The root that a leaf's digest and its proof lead to."""
    for s in steps:
        start = digest(start if s == ALONE else s[1:] + start if s[0] == LEFT else start + s[1:])
    return start


PROOFS = "tree string, lo long, doc_id long, digest string, found string, path string, subroot string, root string"


def proofs(members: DataFrame, bands: list[DataFrame], above: DataFrame, width: int = BAND) -> DataFrame:
    """Rows (tree, lo, doc_id, digest, found, path, subroot, root): each leaf's steps up to the root.

    `members` are ranked leaves, `above` (tree, total, path, subroot, root) what lies above each tree.
    """
    leaves = _leaf_rows(members)
    band_of = F.greatest(F.lit(0), F.ceil(F.when(F.col("total") > 1, F.length(F.bin(F.col("total") - 1))).otherwise(0) / width) - 1)
    entering = above.withColumn("bucket", F.lit(0)).withColumn("band", band_of)
    down: DataFrame | None = None
    for band in reversed(range(len(bands))):
        # a tree that ends at the band's lowest level has nothing in the band
        lowest = leaves if band == 0 else bands[band - 1].where((F.col("level") == band * width) & (F.col("hi") - F.col("lo") < F.col("total")))
        start = entering.where(F.col("band") == band).select("tree", "bucket", "path", "subroot", "root")
        tails = start if down is None else start.unionByName(down.select("tree", F.expr(f"lo >> {(band + 1) * width}").alias("bucket"), "path", "subroot", "root"))
        down = bucketed(lowest, bands[band], tails, band, width).mapInArrow(_proved, PROOFS)
        if band:
            down = written(down)
    return down


def _leaf_rows(members: DataFrame) -> DataFrame:
    return members.withColumn("level", F.lit(0)).withColumn("lo", F.col("rank")).withColumn("hi", F.col("rank") + 1)


def _proved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for unit in units(batches, 2):
        above, members, known = _paths(unit)
        n = len(members)
        columns = [[m[c] for m in members] for c in ("tree", "lo", "doc_id", "digest", "found")]
        columns += [[" ".join(steps) for steps in known], [above["subroot"]] * n, [above["root"]] * n]
        types = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 5]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], PROOFS.replace(" string", "").replace(" long", "").split(", "))


class Manifest:
    """Ranked leaves and labelled nodes of a dataset, as tables in the session's shared folder.

    `leaves`: tree, total, rank, digest, doc_id, found; `bands`: nodes (tree, total, level, lo, hi,
    digest) of each group's tree; `upper` and `upper_bands`: the same of the tree over the groups'
    roots. `tree` is '' for a null group, else '=' and its name. The leaves of a group ascend by id,
    null first, then by digest.

    `found` names columns as they are found now, for rows that may have changed since: the leaf of
    these values is kept beside the true one. Null values, repeated rows and empty texts are leaves
    like any other; an empty table has no nodes and no root; other columns are not read.
    """

    def __init__(self, df: DataFrame, columns: tuple[str, ...] = COLUMNS, key: str = "doc_id", group: str = "lang", found: dict[str, Column] | None = None, width: int = BAND):
        self.width = width
        now = [(found or {}).get(c, F.col(c)) for c in columns]
        changed = reduce(Column.__or__, (~n.eqNullSafe(F.col(c)) for c, n in zip(columns, now, strict=True) if c in (found or {})), F.lit(False))
        name = F.col(group).cast("string")
        rows = df.select(
            F.coalesce(F.concat(F.lit("="), name), F.lit("")).alias("tree"),
            F.col(key).cast("long").alias("doc_id"),
            leaf([F.col(c) for c in columns]).alias("digest"),
            F.when(changed, leaf(now)).alias("found"),
        )
        self.leaves = written(ranked(written(rows), ["doc_id", "digest"]))  # texts are read once
        self.bands = forest(self.leaves, width)
        subroots = tops(self.leaves, self.bands).select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest", F.col("total").alias("size"))
        self.upper = written(ranked(subroots, ["name"]))
        self.upper_bands = forest(self.upper, width)

    def proofs(self) -> DataFrame:
        """One row per leaf: (tree, lo, doc_id, digest, found, path, subroot, root). `path` holds the
        steps from the leaf to the root, separated by spaces: `<` or `>` and a left or right sibling's
        digest, or `.` for a node without sibling."""
        roots = tops(self.upper, self.upper_bands).select("tree", "total", F.lit("").alias("path"), F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"))
        named = self.upper.withColumn("doc_id", F.col("rank")).withColumn("found", F.lit(None).cast("string"))
        reached = proofs(named, self.upper_bands, roots, self.width)
        reached = reached.join(self.upper.select(F.col("rank").alias("lo"), "name", "size"), "lo")
        above = written(reached.select(F.col("name").alias("tree"), F.col("size").alias("total"), "path", F.col("digest").alias("subroot"), "root"))
        return proofs(self.leaves, self.bands, above, self.width)

    def verified(self) -> DataFrame:
        """One row per leaf: (doc_id, leaf, subroot, root, proof_sha256, folded_root, verified).

        `folded_root` is worked out from the leaf as found and the siblings of the manifest;
        `verified` says whether it is the root. `proof_sha256` is of the siblings' digests."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                paths = [p.split() for p in batch.column(5).to_pylist()]
                now = [f or d for d, f in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)]
                hashes = [digest("".join(s[1:] for s in p)) for p in paths]
                ends = [folded(d, p) for d, p in zip(now, paths, strict=True)]
                same = [e == r for e, r in zip(ends, batch.column(7).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(2), batch.column(3), batch.column(6), batch.column(7), pa.array(hashes, pa.string()), pa.array(ends, pa.string()), pa.array(same, pa.bool_())],
                    ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"],
                )

        return self.proofs().mapInArrow(run, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def _told_sql(n_chars: str) -> str:
    parts = []
    for c in COLUMNS:
        value = f"CAST({n_chars if c == 'n_chars' else c} AS VARCHAR)"
        parts.append(f"coalesce(octet_length(encode({value})) || ':' || {value}, '-')")
    return " || ".join(parts)


def _tree_sql(name: str, source: str) -> str:
    """Nodes (tree, level, i, n, d) of `source` (tree, i, n, d): all levels, leaves included."""
    return f"""{name}(tree, level, i, n, d) AS (SELECT tree, 0, i, n, d FROM {source}
    UNION ALL SELECT tree, level + 1, i // 2, (n + 1) // 2, sha256(string_agg(d, '' ORDER BY i))
    FROM {name} WHERE n > 1 GROUP BY tree, level, n, i // 2)"""


def _walk_sql(name: str, start: str, tree: str) -> str:
    """Walks (id, tree, level, i, n, d, proof) of `start` up `tree`, by the sibling of each level."""
    return f"""{name}(id, tree, level, i, n, d, proof) AS (SELECT id, tree, 0, i, n, d, proof FROM {start}
    UNION ALL SELECT w.id, w.tree, w.level + 1, w.i // 2, (w.n + 1) // 2,
      sha256(CASE WHEN w.i % 2 = 1 THEN s.d || w.d ELSE w.d || coalesce(s.d, '') END), w.proof || coalesce(s.d, '')
    FROM {name} w LEFT JOIN {tree} s ON s.tree = w.tree AND s.level = w.level AND s.i = xor(w.i, 1) WHERE w.n > 1)"""


#: The registered query in SQL; CRC-32 of the few digits of an id is worked out from its table.
ORACLE = f"""WITH RECURSIVE tab AS MATERIALIZED (SELECT list_transform(range(256), lambda n: list_reduce(
    list_prepend(n, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
    lambda c, z: CASE WHEN c & 1 = 1 THEN xor(CAST(3988292384 AS BIGINT), c >> 1) ELSE c >> 1 END)) AS tab),
  marked AS (SELECT d.*, xor(CAST(4294967295 AS BIGINT), list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
      list_transform(regexp_extract_all(hex(encode(CAST(doc_id AS VARCHAR))), '..'), lambda x: CAST('0x' || x AS BIGINT))),
      lambda c, x: xor(tab[(xor(c, x) & 255) + 1], c >> 8))) % 7 = 0 AS hit FROM documents d, tab),
  told AS (SELECT doc_id, coalesce('=' || lang, '') AS tree, sha256({_told_sql("n_chars")}) AS d,
    CASE WHEN hit THEN sha256({_told_sql("(n_chars + 1)")}) ELSE sha256({_told_sql("n_chars")}) END AS f FROM marked),
  leaves AS MATERIALIZED (SELECT *, row_number() OVER () AS id, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, d) - 1 AS i,
    count(*) OVER (PARTITION BY tree) AS n FROM told),
  {_tree_sql("low", "leaves")},
  subroots AS MATERIALIZED (SELECT tree AS name, d, '' AS tree, row_number() OVER (ORDER BY encode(tree)) - 1 AS i, count(*) OVER () AS n FROM low WHERE n = 1),
  {_tree_sql("high", "subroots")},
  begun AS (SELECT id, tree, i, n, f AS d, '' AS proof FROM leaves),
  {_walk_sql("up", "begun", "low")},
  middle AS (SELECT u.id, '' AS tree, s.i, s.n, u.d, u.proof FROM up u JOIN subroots s ON s.name = u.tree WHERE u.n = 1),
  {_walk_sql("over", "middle", "high")},
  root AS (SELECT d FROM high WHERE n = 1)
  SELECT l.doc_id, l.d AS leaf, s.d AS subroot, r.d AS root, sha256(o.proof) AS proof_sha256, o.d AS folded_root, o.d = r.d AS verified
  FROM leaves l JOIN over o ON o.id = l.id AND o.n = 1 JOIN subroots s ON s.name = l.tree, root r"""
