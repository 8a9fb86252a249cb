"""Fingerprints bit by bit, masks against all differences, components against brute force."""

import itertools
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from blamesplit.llm import simhash
from blamesplit.llm.registry import QUERIES

DATA = "/root/testdata/sf0.001"


def plain_fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def components(rows):
    """(doc_id, fingerprint, least id) by comparing all pairs."""
    fp = [(d, plain_fingerprint(t)) for d, t in rows]
    left, out = set(range(len(fp))), []
    while left:
        todo, group = [left.pop()], []
        while todo:
            i = todo.pop()
            group.append(i)
            near = {j for j in left if (fp[i][1] ^ fp[j][1]).bit_count() <= 3}
            left -= near
            todo.extend(near)
        ids = [fp[i][0] for i in group if fp[i][0] is not None]
        out += [(fp[i][0], fp[i][1], min(ids, default=None)) for i in group]
    return sorted(out, key=str)


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = simhash.near_duplicates(df, **options).collect()
    return sorted(((r.doc_id, r.fp % (1 << 64), r.component_id) for r in found), key=str)


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_masks_cover_all_differences(radius):
    """Every set of places up to the radius is hidden by a mask, and again inside each table."""
    rng = random.Random(1)
    for m, subs in simhash.masks(radius):
        assert all(s & m == m for s in subs)
        assert max(64 - s.bit_count() for s in subs) <= (17 if radius == 3 else 32)
    whole = [m for m, _ in simhash.masks(radius)]
    for places in itertools.combinations(range(64), radius):
        differing = sum(1 << p for p in places)
        assert any(not m & differing for m in whole)
    for m, subs in simhash.masks(radius):
        hidden = [p for p in range(64) if not m >> p & 1]
        for _ in range(2000):
            differing = sum(1 << p for p in rng.sample(hidden, radius))
            assert any(not s & differing for s in subs)


def test_fingerprints_bit_by_bit(spark):
    rng = random.Random(3)
    texts = ["", " \n", "One", "one TWO", "a b c", "É é ß", "x " * 2000, "日本語 b　c d", None]
    texts += [" ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(900))) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.fp % (1 << 64) for r in simhash.fingerprinted(df).collect()}
    assert got == {i: plain_fingerprint(t) for i, t in enumerate(texts)}


def near_copies(seed, families, copies):
    rng = random.Random(seed)
    rows, vocabulary = [], [f"w{k}" for k in range(500)]
    for f in range(families):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(1, 300))]
        for _ in range(copies):
            text = list(base)
            for _ in range(rng.randrange(3)):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            rows.append((len(rows) * 7 % 1009, " ".join(text)))
    return rows


def test_components_equal_brute_force(spark):
    rows = near_copies(4, 25, 8) + [(3000, None), (3001, ""), (2999, "   "), (None, "a b c"), (None, "a b c d"), (17, "x"), (17, "x")]
    want = components(rows)
    assert run(spark, rows) == want
    assert run(spark, rows, crowd=2) == want  # every shared bucket is cut again
    assert len({c for _, _, c in want}) < len({f for _, f, _ in want})


def test_crowded_buckets_lose_no_link():
    """Chains of fingerprints in one bucket: all are tied, with one link fewer than members."""
    rng = np.random.default_rng(2)
    base = np.uint64(0x0123456789ABCDEF)
    flips = rng.integers(0, 64, 400)
    chain = [base]
    for f in flips.tolist():
        chain.append(chain[-1] ^ np.uint64(1 << f))
    fp = np.unique(np.array(chain, np.uint64))
    a, b = simhash.forest(rng.permutation(fp), 3)
    assert len(a) == len(fp) - 1 and set(a) | set(b) == set(fp.tolist())
    assert all((x ^ y).bit_count() <= 3 for x, y in zip(a, b, strict=True))


def test_distances_on_both_sides_of_the_radius(spark):
    """Planted fingerprints at distance 3 link, at distance 4 they do not."""
    rng = random.Random(8)
    rows, linked = [], []
    for k in range(40):
        x = rng.getrandbits(64)
        for d in (3, 4):
            y = x
            for p in rng.sample(range(64), d):
                y ^= 1 << p
            rows += [x, y]
            linked.append((x, y, d == 3))
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in set(rows)]
    found = simhash.links(simhash.bucketed(spark.createDataFrame(signed, "fp long"), 3, 512), 3)
    pairs = {frozenset((r.a % (1 << 64), r.b % (1 << 64))) for r in found.collect()}
    assert pairs == {frozenset((x, y)) for x, y, yes in linked if yes}


def test_empty_table_and_clashing_columns(spark):
    assert run(spark, []) == []
    df = spark.createDataFrame([(4, "a b", 1, "k"), (2, "A b", 2, "l")], "doc_id long, text string, fp long, root string")
    assert sorted((r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect()) == [(2, 2), (4, 2)]


def test_query_on_the_given_table(spark):
    docs = [tuple(d) for d in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    found = QUERIES["op13_covering_simhash"](spark, DATA).collect()
    assert sorted(((r.doc_id, int(r.fingerprint, 16), r.component_id) for r in found), key=str) == components(docs)
    assert all(len(r.fingerprint) == 16 for r in found)
