"""N-gram Jaccard join with Bayesian candidate pruning.

Documents are sets of five-word shingles. Equal texts are one class from the start, so only one
representative of each goes on. Representatives that share a band of MinHash values are compared,
eight values at a time: with a uniform prior, the chance that a pair's similarity reaches the
threshold, given the matches so far, is a binomial tail, and a pair is dropped when that chance
falls below `TOLERANCE`. What survives ties representatives into families. In each family all pairs
are compared again in the same way, and those that survive are verified on their whole shingle sets.

Pairs are never rows. A bucket or family is cut into blocks, each pair of blocks is one bounded unit
of work, and what leaves it is a row per document: its number of links, and the edge that holds it
in its class.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blamesplit.llm.components import connected
from blamesplit.llm.staging import written
from blamesplit.llm.texts import flat, pieces, released, words

N = 5
THRESHOLD = 0.8
HASHES, STEP = 96, 8
#: At the threshold a pair shares no band with chance 1e-5, and less above it.
BANDS, ROWS = 16, 3
TOLERANCE = 1e-6
#: Documents in a block of a bucket, and of a family; shingles in a block of a family.
BUCKET_BLOCK, FAMILY_BLOCK, FAMILY_SHINGLES = 1024, 256, 200_000
#: Bits of the filter that keeps texts without a family out of the second pass. Its size is fixed.
FILTER_BITS = 1 << 24
BITMAP = 32_768


def multipliers() -> np.ndarray:
    return np.random.default_rng(20_240_501).integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def shingles(data: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all texts' shingles in a row, repeats included, and where each text's begin.

    A text of one to four words has one shingle, all of it; one without words has none.
    """
    found, text_of, _ = words(data, places)
    n = len(places) - 1
    counts = np.bincount(text_of, minlength=n)
    coded = found.dictionary_encode()
    distinct = np.fromiter(map(xxhash.xxh3_64_intdigest, coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    w = distinct[coded.indices.to_numpy()]
    w = np.append(w, np.zeros(N, np.uint64))
    h = np.zeros(len(w) - N, np.uint64)
    for k in range(N):
        h = mixed(h + w[k : k + len(h)])
    each = np.where(counts >= N, counts - N + 1, np.minimum(counts, 1))
    firsts = np.cumsum(counts) - counts
    out = h[np.repeat(firsts - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))]
    starts = np.append(0, np.cumsum(each))
    for i in np.flatnonzero((counts > 0) & (counts < N)):  # not to run on into the next text
        some = np.zeros(1, np.uint64)
        for k in range(int(counts[i])):
            some = mixed(some + w[firsts[i] + k])
        out[starts[i]] = mixed(some + np.uint64(counts[i]))[0]
    return out, starts


def signatures(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """MinHash values, a row per text; texts without shingles have a row of zeros."""
    n = len(starts) - 1
    out = np.zeros((n, HASHES), np.uint32)
    some = np.flatnonzero(np.diff(starts))
    if len(some):
        at = starts[some]
        for j, a in enumerate(multipliers()):
            out[some, j] = np.minimum.reduceat(((h * a) >> np.uint64(32)).astype(np.uint32), at)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band, a row per text."""
    out = np.empty((len(sig), BANDS), np.uint64)
    for b in range(BANDS):
        key = np.full(len(sig), b + 1, np.uint64)
        for r in range(ROWS):
            key = mixed(key + sig[:, b * ROWS + r])
        out[:, b] = key
    return out


@cache
def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> tuple[int, ...]:
    """After STEP, 2 STEP, ... values: the fewest matches that keep a pair.

    With a uniform prior and m of n matches, P(similarity >= t) = P(Binomial(n + 1, t) <= m).
    """
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        tail, m = 0.0, -1
        while tail < tolerance:
            m += 1
            tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return tuple(out)


def survivors(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Rows of `many` that stay candidates of signature `one` through all comparisons."""
    alive = np.arange(len(many))
    matches = np.zeros(len(many), np.int64)
    for k, least in enumerate(least_matches()):
        at = slice(k * STEP, (k + 1) * STEP)
        matches += (many[alive, at] == one[at]).sum(1)
        keep = matches >= least
        alive, matches = alive[keep], matches[keep]
        if not len(alive):
            break
    return alive


class Forest:
    """Union-find over the rows of one unit of work."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        self.up[max(a, b)] = min(a, b)


def units(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of rows that agree in the first `keys` columns, from batches sorted by these."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        new = np.zeros(batch.num_rows, bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        first = tuple(c[0] for c in columns)
        if held and first != last:
            yield pa.Table.from_batches(held)
            held = []
        last = tuple(c[-1] for c in columns)
        cuts = np.flatnonzero(new).tolist()
        at = 0
        for cut in cuts:
            yield pa.Table.from_batches([*held, batch.slice(at, cut - at)])
            held, at = [], cut
        held.append(batch.slice(at))
    if held:
        yield pa.Table.from_batches(held)
    released()


def pairs(unit_block: np.ndarray, sig: np.ndarray, crossing: bool) -> Iterator[tuple[int, np.ndarray]]:
    """For each row, the later rows that survive; of two blocks, only rows of the other one."""
    for i in range(len(sig) - 1):
        rest = np.arange(i + 1, len(sig))
        if crossing:
            rest = rest[unit_block[rest] != unit_block[i]]
        if len(rest):
            found = survivors(sig[i], sig[rest])
            if len(found):
                yield i, rest[found]


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, HASHES)


def in_blocks(df: DataFrame, group: str, blocks: Column) -> DataFrame:
    """Rows of each group dealt over its pairs of blocks: (group, low, high, block, ...), sorted."""
    df = df.withColumn("blocks", blocks.cast("int"))
    df = df.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    df = df.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    df = df.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
    rest = [c for c in df.columns if c not in (group, "low", "high", "block", "other", "blocks")]
    df = df.select(group, "low", "high", "block", *rest)
    return df.repartition(group, "low", "high").sortWithinPartitions(group, "low", "high")


def candidate_edges(reps: DataFrame) -> DataFrame:
    """(a, b): forests of the pairs in each bucket that survive the comparison of MinHash values."""
    banded = reps.where("n_shingles > 0").select("id", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    crowded = written(banded.join(shared, "band"))
    some = crowded.select("id").distinct()
    sig = reps.join(some, "id", "left_semi").select("id", "sig")
    rows = in_blocks(crowded.join(sig, "id"), "band", F.ceil(F.col("n") / BUCKET_BLOCK))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a: list[int] = []
        b: list[int] = []
        for unit in units(batches, 3):
            if unit.num_rows > 1:
                ids, block = unit["id"].to_numpy(), unit["block"].to_numpy()
                crossing = unit["low"][0] != unit["high"][0]
                forest = Forest(len(ids))
                for i, others in pairs(block, matrix(unit["sig"]), crossing):
                    for j in others.tolist():
                        forest.join(i, j)
                for i in range(len(ids)):
                    if (r := forest.root(i)) != i:
                        a.append(ids[i])
                        b.append(ids[r])
            if len(a) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def verified(family: DataFrame) -> DataFrame:
    """(id, root, links) from rows (root, id, copies, sig, shingles): per unit of work, the documents
    that link to each, copies counted, and the least document it is tied to."""
    sizes = family.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("shingles") / 8).alias("words"))
    blocks = F.greatest(F.ceil(F.col("n") / FAMILY_BLOCK), F.ceil(F.col("words") / FAMILY_SHINGLES))
    rows = family.join(sizes, "root").withColumn("count", F.least(blocks, F.col("n")))
    rows = in_blocks(rows.drop("n", "words"), "root", F.col("count"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in units(batches, 3):
            if unit.num_rows < 2:
                continue
            ids, block, copies = unit["id"].to_numpy(), unit["block"].to_numpy(), unit["copies"].to_numpy()
            sets = [np.frombuffer(s, np.uint64) for s in unit["shingles"].to_pylist()]
            crossing = unit["low"][0] != unit["high"][0]
            forest, links = Forest(len(ids)), np.zeros(len(ids), np.int64)
            for i, others in pairs(block, matrix(unit["sig"]), crossing):
                for j in others.tolist():
                    if similar(sets[i], sets[j]):
                        forest.join(i, j)
                        links[i] += copies[j]
                        links[j] += copies[i]
            some = np.flatnonzero(links)
            roots = np.array([ids[forest.root(int(i))] for i in some], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(roots), pa.array(links[some])], ["id", "root", "links"])

    return rows.mapInArrow(run, "id long, root long, links long")


def similar(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> bool:
    """Whether two sorted sets reach the threshold, in whole numbers: 5 * shared >= 4 * all."""
    if min(len(a), len(b)) < threshold * max(len(a), len(b)) - 1e-9:
        return False
    if len(a) > len(b):
        a, b = b, a
    shared = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return shared >= threshold * (len(a) + len(b) - shared) - 1e-9


def sketched(docs: DataFrame) -> DataFrame:
    """(doc_id, key, n_shingles, sig, bands) of rows (doc_id, key, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 2):
            h, starts = shingles(*flat(batch.column(2)))
            sig = signatures(h, starts)
            keys = band_keys(sig).view(np.int64)
            offsets = pa.array(np.arange(0, keys.size + 1, BANDS, dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.diff(starts)), pa.array([r.tobytes() for r in sig], pa.binary()), pa.ListArray.from_arrays(offsets, pa.array(keys.reshape(-1)))],
                ["doc_id", "key", "n_shingles", "sig", "bands"],
            )

    return docs.mapInArrow(run, "doc_id long, key string, n_shingles long, sig binary, bands array<long>")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """(id, shingles): sorted distinct hashes of rows (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):
            h, starts = shingles(*flat(batch.column(1)))
            sets = [np.unique(h[a:b]).tobytes() for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["id", "shingles"])

    return docs.mapInArrow(run, "id long, shingles binary")


def only_keys(docs: DataFrame, needed: DataFrame) -> DataFrame:
    """Rows of `docs` whose key may be among those of `needed`, by a bitmap of fixed size."""

    def spread(df: DataFrame) -> DataFrame:
        return df.withColumn("__bit", F.pmod(F.xxhash64("key"), F.lit(FILTER_BITS)))

    part = F.floor(F.col("__bit") / BITMAP).cast("int").alias("__part")
    maps = spread(needed).groupBy(part).agg(F.expr(f"bitmap_construct_agg(__bit % {BITMAP})").alias("__map"))
    byte = F.conv(F.hex(F.expr(f"substring(__map, int(__bit % {BITMAP} div 8) + 1, 1)")), 16, 10).cast("int")
    set_ = F.expr("shiftright(__byte, int(__bit % 8)) & 1") == 1
    held = spread(docs).withColumn("__part", part).join(F.broadcast(maps), "__part")  # at most 2 MB
    return held.withColumn("__byte", byte).where(set_).drop("__bit", "__part", "__map", "__byte")


def classes(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, reps): (doc_id, key) of every document, and for every distinct text (key, doc_id,
    copies, class_id, keeper, links): its least id, its class, the text of the class that has its
    least id (of several, and of texts without ids, the least key), and the documents with other
    texts that reach the threshold with it."""
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumn("key", F.md5("text"))
    rows = written(sketched(docs.select("doc_id", "key", "text")))
    reps = rows.groupBy("key").agg(
        F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"), F.first("bands").alias("bands")
    )
    reps = written(reps.withColumn("id", F.monotonically_increasing_id()))

    family = written(connected(candidate_edges(reps)))
    needed = written(reps.join(family, "id").select("id", "root", "key", "doc_id", "copies", "sig"))
    # one row of each text: the one with the least id, and one of those if it is repeated
    texts = only_keys(docs, needed.select("key"))
    texts = texts.join(needed.select("key", F.col("doc_id").alias("__least"), "id"), "key").where(F.col("doc_id").eqNullSafe(F.col("__least")))
    sets = shingle_sets(texts.select("id", "text")).dropDuplicates(["id"])
    links = written(verified(needed.select("root", "id", "copies", "sig").join(sets, "id")))

    tie = connected(links.select(F.col("id").alias("a"), F.col("root").alias("b")))
    counted = links.groupBy("id").agg(F.sum("links").alias("links"))
    tied_reps = reps.select("id", "key", "doc_id", "copies").join(counted, "id", "left").join(tie, "id", "left")
    tied_reps = tied_reps.withColumn("root", F.coalesce("root", "id"))
    # a struct of (no id, id, key): null ids come last, and keys settle ties
    least = tied_reps.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("least"))
    least = least.select("root", F.col("least.doc_id").alias("class_id"), F.col("least.key").alias("keeper"))
    reps = tied_reps.join(least, "root").select("key", "doc_id", "copies", "class_id", "keeper", F.coalesce("links", F.lit(0)).alias("links"))
    return rows.select("doc_id", "key"), reps


def jaccard_join(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: (doc_id, class_id, n_links, n_copies).

    `n_links` counts the other documents of similarity 0.8 or more, equal texts included; `n_copies`
    those of equal text, itself included; `class_id` is the least id that links lead to. Texts without
    words are alike only if equal; a null text counts as empty. A null id takes part as a document
    without a name. Repeated rows are documents of their own; an empty table gives an empty one.
    Other columns of `df` are not read.
    """
    rows, reps = classes(df, doc_id, text)
    found = rows.join(reps.drop("doc_id"), "key")
    return found.select("doc_id", "class_id", (F.col("links") + F.col("copies") - 1).alias("n_links"), F.col("copies").alias("n_copies"))


def deduplicated(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of `df` for each class, with all its columns: the one of the least id, where one has an id.

    A null text counts as empty; all texts without words that are equal are one class; repeated rows
    are one; an empty table stays empty. The columns travel in one struct, so they may have any name.
    """
    _, reps = classes(df, doc_id, text)
    best = reps.where("key = keeper").select("key", F.col("doc_id").alias("id"))
    boxed = df.select(F.struct("*").alias("row"))
    keyed = boxed.select("row", F.md5(F.coalesce(F.col(f"row.{text}").cast("string"), F.lit(""))).alias("key"), F.col(f"row.{doc_id}").cast("long").alias("id"))
    chosen = keyed.join(best, (keyed["key"] == best["key"]) & keyed["id"].eqNullSafe(best["id"]), "left_semi")
    return chosen.dropDuplicates(["key", "id"]).select("row.*")


ORACLE = """
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
t AS (SELECT text, any_value(w) AS w, min(doc_id) AS rep, count(*) AS copies FROM d GROUP BY text),
s AS (SELECT DISTINCT rep, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS g
  FROM (SELECT rep, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM t WHERE len(w) > 0)),
c AS (SELECT rep, count(*) AS n FROM s GROUP BY rep),
p AS (SELECT a.rep AS a, b.rep AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.rep <> b.rep GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN c x ON x.rep = a JOIN c y ON y.rep = b WHERE 5 * k >= 4 * (x.n + y.n - k)),
r(a, b) AS (SELECT rep, rep FROM t UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
m AS (SELECT a, min(b) AS class_id FROM r GROUP BY a),
l AS (SELECT a, CAST(sum(copies) AS BIGINT) AS n FROM e JOIN t ON t.rep = e.b GROUP BY a)
SELECT d.doc_id, m.class_id, t.copies - 1 + coalesce(l.n, 0) AS n_links, t.copies AS n_copies
FROM d JOIN t ON d.text = t.text JOIN m ON m.a = t.rep LEFT JOIN l ON l.a = t.rep
"""
