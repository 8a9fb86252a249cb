"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint has 64 bits, one for each place where more than half of a text's shingle hashes have a
one. For radius r each bit place gets a non-zero vector of r + 1 bits; the mask of a vector v keeps the
places whose vector has an odd product with v. However r places differ, some v is orthogonal to the
vectors of all of them, so its mask hides every difference: two fingerprints within the radius
agree under at least one of the 2^(r+1) - 1 masks, with certainty. Each mask is a table of buckets.

Only distinct fingerprints enter the tables. A bucket of many is cut again by the same construction
over the places its mask hides, which leaves about a quarter of the places free and so bounds what any
bucket can hold. In each bucket the distances are compared, and a forest of links leaves it, never its
pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blamesplit.llm.components import connected
from blamesplit.llm.staging import written
from blamesplit.llm.texts import flat, gather, pieces, released, words

N, SEED, BITS, RADIUS = 3, 42, 64, 3
#: Distinct fingerprints of a bucket beyond which it is cut again.
CROWD = 512
#: Shingles whose bits are added up in lanes of one byte each.
LANE = 255


def shingle_hashes(data: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of all texts' shingles, repeats included, and where each text's begin, with the end.

    A-Z count as a-z. A text of one or two words has one shingle, all of it; one without words none.
    """
    upper = (data >= 65) & (data <= 90)
    found, text_of, _ = words(np.where(upper, data + 32, data).astype(np.uint8), places)
    n = len(places) - 1
    counts = np.bincount(text_of, minlength=n)
    bounds = np.frombuffer(found.buffers()[1], np.int64)[: len(found) + 1]
    letters = np.frombuffer(found.buffers()[2], np.uint8)
    spaced = np.insert(letters, bounds[1:], 32).tobytes()  # each word and a space
    begins, ends = bounds[:-1] + np.arange(len(found)), bounds[1:] + np.arange(len(found))
    each = np.where(counts >= N, counts - N + 1, np.minimum(counts, 1))
    firsts = gather(np.cumsum(counts) - counts, each)
    lasts = firsts + np.repeat(np.minimum(counts, N), each) - 1
    digest = xxhash.xxh64_intdigest
    spans = zip(begins[firsts].tolist(), ends[lasts].tolist(), strict=True)
    hashes = np.fromiter((digest(spaced[a:b], SEED) for a, b in spans), np.uint64, len(firsts))
    return hashes, np.append(0, np.cumsum(each))


def _lanes() -> np.ndarray:
    """For each byte, its eight bits as the eight bytes of a number."""
    bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
    return np.ascontiguousarray(bits).view(np.uint64).reshape(-1)


def fingerprints(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Per text, the bits set in more than half of its hashes; zero for a text without any."""
    each = np.diff(starts)
    out = np.zeros(len(each), np.uint64)
    some = np.flatnonzero(each)
    if not len(some):
        return out
    parts = -(-each[some] // LANE)
    first_part = np.cumsum(parts) - parts
    begins = np.repeat(starts[some] - first_part * LANE, parts) + np.arange(int(parts.sum())) * LANE
    counts = np.empty((len(some), BITS), np.int64)
    table = _lanes()
    for k in range(BITS // 8):
        lanes = table[((hashes >> np.uint64(8 * k)) & np.uint64(255)).astype(np.uint8)]
        sums = np.add.reduceat(lanes, begins).view(np.uint8).reshape(-1, 8)
        counts[:, 8 * k : 8 * k + 8] = np.add.reduceat(sums.astype(np.int64), first_part, axis=0)
    ones = 2 * counts > each[some, None]
    out[some] = np.packbits(ones, axis=1, bitorder="little").view(np.uint64).reshape(-1)
    return out


def fingerprinted(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint of each whole text as a signed number. A null text has none of
    the words, hence 0."""
    narrow = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):
            fp = fingerprints(*shingle_hashes(*flat(batch.column(1))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return narrow.mapInArrow(run, "doc_id long, fp long")


def covering(places: list[int], radius: int) -> list[int]:
    """Masks over bit places: any `radius` of the places are all hidden by at least one mask."""
    vectors = (1 << (radius + 1)) - 1
    of = {p: k % vectors + 1 for k, p in enumerate(places)}
    return [sum(1 << p for p in places if (of[p] & v).bit_count() % 2) for v in range(1, vectors + 1)]


def masks(radius: int) -> list[tuple[int, list[int]]]:
    """Each table's mask, and the masks that cut its crowded buckets over the places it hides."""
    whole = covering(list(range(BITS)), radius)
    return [(m, [m | k for k in covering([p for p in range(BITS) if not m >> p & 1], radius)]) for m in whole]


def _signed(x: int) -> Column:
    return F.lit(x - (1 << 64) if x >> 63 else x).cast("long")


def bucketed(distinct: DataFrame, radius: int, crowd: int) -> DataFrame:
    """(mask_no, sub_no, key, fp): each fingerprint in its bucket of every table, crowded ones cut."""
    tables = masks(radius)
    entries = F.array(*(F.struct(F.lit(k).alias("mask_no"), F.col("fp").bitwiseAND(_signed(m)).alias("key")) for k, (m, _) in enumerate(tables)))
    rows = distinct.select("fp", F.explode(entries).alias("e")).select("fp", "e.mask_no", "e.key")
    crowded = rows.groupBy("mask_no", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > crowd)
    rows = rows.join(crowded.drop("n").withColumn("crowded", F.lit(True)), ["mask_no", "key"], "left")
    finer = F.array(*(F.array(*map(_signed, subs)) for _, subs in tables))[F.col("mask_no")]
    cut = F.transform(finer, lambda m, k: F.struct((k + 1).alias("sub_no"), F.col("fp").bitwiseAND(m).alias("key")))
    whole = F.array(F.struct(F.lit(0).alias("sub_no"), F.col("key").alias("key")))
    return rows.select("mask_no", "fp", F.explode(F.when(F.col("crowded"), cut).otherwise(whole)).alias("e")).select("mask_no", "e.sub_no", "e.key", "fp")


def forest(fp: np.ndarray, radius: int) -> tuple[list[int], list[int]]:
    """Links that tie together what chains of distances up to `radius` tie: each fingerprint is
    reached once, and only those not reached yet are compared."""
    a: list[int] = []
    b: list[int] = []
    rest = fp
    while len(rest) > 1:
        todo, rest = [rest[0]], rest[1:]
        while todo and len(rest):
            x = todo.pop()
            near = np.bitwise_count(rest ^ x) <= radius
            if near.any():
                found = rest[near]
                rest = rest[~near]
                todo.extend(found)
                a.extend(found.tolist())
                b.extend([int(x)] * len(found))
    return a, b


def links(buckets: DataFrame, radius: int) -> DataFrame:
    """(a, b): a forest of the fingerprints within the radius, for each bucket."""
    keys = ["mask_no", "sub_no", "key"]
    rows = buckets.select(*keys, "fp").repartition(*keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 4
        for batch in batches:
            columns = [np.concatenate([h, batch.column(k).to_numpy().astype(np.int64)]) for k, h in enumerate(held)]
            n = len(columns[0])
            if not n:
                continue
            new = np.append(True, np.logical_or.reduce([c[1:] != c[:-1] for c in columns[:3]])[: n - 1])
            starts = np.flatnonzero(new)
            held = [c[starts[-1] :] for c in columns]  # the last bucket may go on
            yield _linked(columns[3][: starts[-1]], starts, radius)
        yield _linked(held[3], np.array([0, len(held[3])]), radius)
        released()

    return rows.mapInArrow(run, "a long, b long")


def _linked(fp: np.ndarray, starts: np.ndarray, radius: int) -> pa.RecordBatch:
    """Links of the buckets that lie between each of `starts` and the next."""
    values, sizes = fp.view(np.uint64), np.diff(starts)
    two = starts[:-1][sizes == 2]
    two = two[np.bitwise_count(values[two] ^ values[two + 1]) <= radius] if len(two) else two
    a, b = [values[two]], [values[two + 1]]
    for k in np.flatnonzero(sizes > 2).tolist():
        x, y = forest(values[starts[k] : starts[k + 1]], radius)
        a.append(np.array(x, np.uint64))
        b.append(np.array(y, np.uint64))
    ends = (pa.array(np.concatenate(side).astype(np.uint64).view(np.int64)) for side in (a, b))
    return pa.RecordBatch.from_arrays(list(ends), ["a", "b"])


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS, crowd: int = CROWD) -> DataFrame:
    """One row per document: (doc_id, fp, component_id).

    Fingerprints link at `radius` or fewer differing bits; `component_id` is the smallest id that
    links lead to, itself included. Null, empty and wordless texts have fingerprint 0, which links
    like any other. A null id takes part as a document without a name: a component of such has a
    null id. Repeated rows stay; an empty table gives an empty one. Other columns are not read.
    """
    rows = written(fingerprinted(df, doc_id, text))
    distinct = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = connected(links(bucketed(distinct, radius, crowd), radius))
    tied = written(distinct.join(roots, F.col("fp") == F.col("id"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    least = tied.groupBy("root").agg(F.min("least").alias("component_id"))
    found = tied.join(least, "root").select("fp", "component_id")
    return rows.join(found, "fp").select("doc_id", "fp", "component_id")
