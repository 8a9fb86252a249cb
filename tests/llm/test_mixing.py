"""Mixing against a sorted brute force, the SQL, and edge cases."""

import hashlib
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from blamesplit.llm import mixing

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, source string, h long, key string, target string"


def brute(rows):
    docs = []
    for i, t, s, *_ in rows:
        size = len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        h = int(hashlib.md5(f"{'' if i is None else i}|{t or ''}".encode()).hexdigest()[:15], 16)
        docs.append((i, s, size, h))
    sizes = defaultdict(int)
    for _, s, size, _ in docs:
        sizes[s] += size
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weights = {s: (5.0, 2.0, 1.0)[k % 3] for k, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        level = (total - sum(3 * sizes[s] for s in capped)) / (sum(weights[s] for s in free) or 1)
        over = {s for s in free if level * weights[s] > 3 * sizes[s]}
        if not over:
            break
        capped |= over
    targets = {s: 3.0 * sizes[s] if s in capped else level * weights[s] for s in names}
    out = []
    for s in names:
        full = int(targets[s] // sizes[s]) if sizes[s] else 0
        rest, upto = targets[s] - full * sizes[s], 0
        groups = defaultdict(list)
        for d in docs:
            if d[1] == s:
                groups[d[3]].append(d)
        for h in sorted(groups):
            words = sum(d[2] for d in groups[h])
            upto += words
            extra = upto - words / 2 <= rest
            out += [(d[0], s, d[2], sizes[s], targets[s], d[2] * (full + extra)) for d in groups[h]]
    return out


def same(found, want):
    key = lambda r: (str(r[0]), str(r[1]), r[2], r[5])
    found, want = sorted(found, key=key), sorted(want, key=key)
    assert len(found) == len(want)
    for f, w in zip(found, want, strict=True):
        assert f[:4] == w[:4] and f[5] == w[5] and f[4] == pytest.approx(w[4])


def test_equals_brute_force(spark):
    rows = [(i, "w " * (i % 37) + "é x\x0b", f"src{i % 7}" if i % 3 else "hot", 1, "k", "t") for i in range(3000)]
    rows += [(None, None, None, None, None, None)] * 3 + [(5, "", None, 0, "", ""), (6, "a b", "", 0, "", ""), (7, "long " * 50_000, "big", 0, "", "")]
    rows += [(8, "same row", "src1", 0, "", "")] * 20
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA))
    same([(r.doc_id, r.source, r.size, r.source_size, r.target, r.taken) for r in got.collect()], brute(rows))


@pytest.mark.parametrize("few", [0, 10_000])
def test_rows_repeat_as_the_mix_says(spark, monkeypatch, few):
    monkeypatch.setattr(mixing, "FEW_SOURCES", few)
    rows = [(i, "w " * (i % 11), f"src{i % 4}" if i % 5 else None, i, "k", "t") for i in range(400)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = {r.doc_id: r.repeats for r in mixing.mix(df).collect()}
    got = mixing.mixed(df)
    assert got.columns == df.columns
    assert Counter(r.doc_id for r in got.collect()) == Counter({i: n for i, n in want.items() if n})


def test_empty_and_wordless(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).collect() == []
    found = mixing.mix(spark.createDataFrame([(1, " ", "a", 0, "", ""), (2, None, "b", 0, "", "")], SCHEMA)).collect()
    assert [(r.size, r.target, r.taken) for r in found] == [(0, 0.0, 0)] * 2


def test_sql(spark):
    df = spark.read.parquet(f"{DATA}/documents.parquet")
    got = mixing.mix(df).select("doc_id", "size", "source_size", "target", "taken").collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    assert sorted(map(tuple, got)) == sorted(con.execute(mixing.ORACLE).fetchall())
