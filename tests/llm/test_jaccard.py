"""The join against all pairs in plain Python, its SQL, and components."""

import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import duckdb
import pytest

from blamesplit.llm import jaccard
from blamesplit.llm.components import connected

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, key string, id long, links string"


def brute(rows):
    by = defaultdict(list)
    for i, t, *_ in rows:
        by[t or ""].append(i)
    sets = {}
    for t in by:
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        sets[t] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    up = {t: t for t in by}

    def root(t):
        while up[t] != t:
            t = up[t]
        return t

    links = Counter()
    for a, b in combinations(by, 2):
        x, y = sets[a], sets[b]
        if x and y and 5 * len(x & y) >= 4 * len(x | y):
            links[a] += len(by[b])
            links[b] += len(by[a])
            up[root(a)] = root(b)
    least = {}
    for t, ids in by.items():
        known = [i for i in ids if i is not None]
        if known:
            least[root(t)] = min(least.get(root(t), 1 << 60), *known)
    return sorted((str(i), str(least.get(root(t))), links[t] + len(ids) - 1, len(ids)) for t, ids in by.items() for i in ids)


def corpus():
    rng = random.Random(4)
    texts = []
    for _ in range(60):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(8, 300))]
        texts.append(base)
        for _ in range(rng.randrange(6)):
            other = list(base)
            for _ in range(rng.randrange(1, 4)):
                other[rng.randrange(len(other))] = f"x{rng.randrange(9)}"
            texts.append(other)
    family = [f"f{k}" for k in range(200)]
    for _ in range(150):
        other = list(family)
        for _ in range(3):
            other[rng.randrange(200)] = f"y{rng.randrange(99)}"
        texts.append(other)
    rows = [(k, " ".join(w), "k", 5, "l") for k, w in enumerate(texts)]
    rows += [(1000 + k, rows[3][1], "", 0, "") for k in range(40)] + [(2000, None, None, None, None), (2001, "", "", 0, ""), (2002, " \n", "", 0, "")]
    rows += [(None, rows[5][1], "", 0, ""), (None, "only here and nowhere else at all", "", 0, ""), (2003, "a b", "", 0, ""), (2004, "a b", "", 0, ""), (2005, "a  b", "", 0, ""), (2006, "z " * 60_000, "", 0, "")]
    rows += [(7, rows[7][1], "", 0, "")] * 3
    return rows


@pytest.mark.parametrize("small_blocks", [False, True])
def test_equals_all_pairs(spark, monkeypatch, small_blocks):
    if small_blocks:
        monkeypatch.setattr(jaccard, "BUCKET_BLOCK", 16)
        monkeypatch.setattr(jaccard, "FAMILY_BLOCK", 8)
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    got = sorted((str(r.doc_id), str(r.class_id), r.n_links, r.n_copies) for r in jaccard.jaccard_join(df).collect())
    assert got == brute(rows)
    if not small_blocks:
        left = jaccard.deduplicated(df)
        assert left.columns == df.columns
        assert left.count() == len({c for _, c, *_ in brute(rows)})


def test_one_near_copy_stays_without_or_with_equal_ids(spark):
    def near(name, n):
        return [" ".join(f"{name}{k}" for k in range(100)) + f" end{j}" for j in range(n)]

    rows = [(None, t) for t in near("a", 4)] + [(7, t) for t in near("b", 3)] + [(None, near("c", 3)[0]), (9, near("c", 3)[1]), (8, near("c", 3)[2])] + [(None, "alone")]
    rows += [(None, near("a", 1)[0]), (7, near("b", 1)[0])]
    df = spark.createDataFrame([(i, t, "k", 0, "l") for i, t in rows], SCHEMA).repartition(4)
    got = jaccard.deduplicated(df).collect()
    assert sorted((r.text[:1] if r.text != "alone" else "z", str(r.doc_id)) for r in got) == [("a", "None"), ("b", "7"), ("c", "8"), ("z", "None")]


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert jaccard.jaccard_join(df).collect() == [] and jaccard.deduplicated(df).collect() == []


def test_sql(spark):
    got = jaccard.jaccard_join(spark.read.parquet(f"{DATA}/documents.parquet")).collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    assert sorted(map(tuple, got)) == sorted(con.execute(jaccard.ORACLE).fetchall())


def test_pruning_keeps_what_may_reach_the_threshold():
    least = jaccard.least_matches()
    assert least == tuple(sorted(least)) and 0 <= least[0] <= 3 and 55 <= least[-1] <= 66


def test_components(spark):
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(100, 180)] + [(rng.randrange(1000, 1300), rng.randrange(1000, 1300)) for _ in range(200)] + [(5, 5), (7, 8)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    got = {r.id: r.root for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in list(up)}
