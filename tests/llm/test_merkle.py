"""The manifest against trees built by lists."""

import binascii
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from blamesplit.llm import merkle
from blamesplit.llm.registry import QUERIES

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(row, plus=0):
    doc_id, text, lang, source, n_chars = row
    values = [doc_id, source, lang, n_chars if n_chars is None else n_chars + plus, text]
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(leaves):
    """All levels."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        now = levels[-1]
        levels.append([sha("".join(now[k : k + 2])) for k in range(0, len(now), 2)])
    return levels


def siblings(levels, i):
    """(digest or None, whether it stands left) for each level below the top."""
    out = []
    for level in levels[:-1]:
        j = i ^ 1
        out.append((level[j] if j < len(level) else None, j < i))
        i //= 2
    return out


def expected(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    ordered = {g: sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r))) for g in names}
    trees = {g: tree([plain_leaf(r) for r in ordered[g]]) for g in names}
    top = tree([trees[g][-1][0] for g in names])
    out = []
    for at, g in enumerate(names):
        for i, r in enumerate(ordered[g]):
            hit = r[0] is not None and binascii.crc32(str(r[0]).encode()) % 7 == 0
            d = plain_leaf(r, 1 if hit else 0)
            path = siblings(trees[g], i) + siblings(top, at)
            for s, left in path:
                d = sha((s or "") + d if left else d + (s or ""))
            out.append((r[0], plain_leaf(r), trees[g][-1][0], top[-1][0], sha("".join(s or "" for s, _ in path)), d, d == top[-1][0]))
    return sorted(out, key=str)


def manifest(df, **options):
    hit = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    return merkle.Manifest(df, found={"n_chars": F.when(hit, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}, **options)


def run(spark, rows, **options):
    return sorted(map(tuple, manifest(spark.createDataFrame(rows, SCHEMA), **options).verified().collect()), key=str)


def documents(seed, n, langs):
    rng = random.Random(seed)
    rows = [(rng.randrange(5 * n), f"text {k} é", rng.choice(langs), rng.choice(["a", "b", None]), rng.randrange(900)) for k in range(n)]
    return rows


@pytest.mark.parametrize("width", [2, 10])
@pytest.mark.parametrize("n", [1, 2, 3, 37])
def test_sizes_and_bands(spark, n, width):
    rows = documents(n, n, ["en", "de", None, "ü", "z"])
    assert run(spark, rows, width=width) == expected(rows)


def test_nulls_ties_and_repeated_rows(spark):
    rows = [(None, None, None, None, None)] * 3 + [(1, "", "", "", 0), (1, "", "", "", 0), (1, "x" * 200_000, "", "s", 5), (7, "a", "en", "s", None), (8, None, "en", None, 1)]
    assert run(spark, rows, width=1) == expected(rows)
    rows = [(5, "same", "en", "s", 4)] * 70
    assert run(spark, rows, width=2) == expected(rows)


def test_labels_are_nested_intervals(spark):
    rows = documents(3, 40, ["en"])
    made = manifest(spark.createDataFrame(rows, SCHEMA), width=3)
    want = tree(sorted(plain_leaf(r) for r in rows))
    found = [r for b in made.bands for r in b.collect()]
    assert len(found) == sum(map(len, want[1:]))
    assert all(r.lo == (r.lo >> r.level) << r.level and r.hi == min(r.lo + (1 << r.level), 40) for r in found)
    ordered = tree([plain_leaf(r) for r in sorted(rows, key=lambda r: (r[0], plain_leaf(r)))])
    assert all(ordered[r.level][r.lo >> r.level] == r.digest for r in found)


def test_a_missing_node_is_an_error(spark):
    made = manifest(spark.createDataFrame(documents(3, 40, ["en"]), SCHEMA), width=3)
    made.bands[0] = made.bands[0].where("not (level = 1 and lo = 4)")
    with pytest.raises(Exception, match="manifest"):
        made.verified().collect()


def test_changed_rows_do_not_verify(spark):
    rows = documents(11, 60, ["en", "fr"])
    found = manifest(spark.createDataFrame(rows, SCHEMA)).verified().collect()
    for r in found:
        assert r.verified == (binascii.crc32(str(r.doc_id).encode()) % 7 != 0)


def test_empty_table_and_clashing_columns(spark):
    assert run(spark, []) == []
    df = spark.createDataFrame([(1, "a", "en", "s", 1, 5, "t")], SCHEMA + ", rank long, tree string")
    assert len(manifest(df).verified().collect()) == 1


def test_query_on_the_given_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    got = QUERIES["op12_interval_manifest"](spark, DATA).select(*names)
    assert sorted(map(tuple, got.collect()), key=str) == expected([tuple(d) for d in docs.collect()])


def test_sql_agrees(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    names = "doc_id, leaf, subroot, root, proof_sha256, folded_root, verified"
    got = con.execute(f"SELECT {names} FROM ({merkle.ORACLE})").fetchall()
    want = QUERIES["op12_interval_manifest"](spark, DATA).select(*names.split(", ")).collect()
    assert sorted(got, key=str) == sorted(map(tuple, want), key=str)
