"""Patterns against plain regular expressions, and the field on planted cases."""

import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from blamesplit.llm import private

SCHEMA = "doc_id long, text string, spans string, kind string"
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
PARTS = st.sampled_from(["a.b", "@", ".", "x-1", "+1", " ", "(123)", "4539", "578763621486", "10.0.0.1", "256", "-", "\n", "é", "٣", "+49", "00012", "555-1234", "me@a.com"])


def digits(s):
    return "".join(c for c in s if c in "0123456789")


def plain(text):
    out = [(1, m.start(), m.end()) for m in EMAIL.finditer(text)]
    out += [(2, m.start(), m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = digits(m.group())
        total = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d)))
        if 13 <= len(d) <= 19 and total % 10 == 0:
            out.append((3, m.start(), m.end()))
    out += [(4, m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m.group())) <= 15]
    return out


@settings(max_examples=1500, deadline=None)
@given(st.lists(PARTS, max_size=14).map("".join))
def test_patterns(text):
    assert private.base_spans(text) == plain(text)


def found(spark, rows, field=None):
    df = spark.createDataFrame([(i, t, "s", "k") for i, t in rows], SCHEMA)
    field = field or private.trained(df)
    return {r.doc_id: [(s.kind, s.start, s.end, s.base) for s in r.spans] for r in private.find_private(df, field).collect()}, field


def corpus():
    rows = []
    for i in range(200):
        rows.append((i, f"call +1 ({200 + i}) 555-{1000 + 7 * i} or mail u{i}@mail.example.com from 10.0.{i}.7 now"))
        rows.append((1000 + i, f"version {i % 7}.{i % 3} of {1990 + i % 30} with 4539578763621486 paid"))
    return rows


def test_field_completes_what_patterns_miss(spark):
    beside = "write x@y.example.com to +1 (319) 555-3296 4524132264652876 today"
    again = "dial +1 (415) 555-2671 or later 415-555-2671 please, and 4.0 of 2019"
    rows = corpus() + [(5000, beside), (5001, again), (5002, "token a9b8c7d6e5f4 in 2004, page 12, 3.0")]
    got, _ = found(spark, rows)
    said = lambda i, t: [(k, t[a:b], base) for k, a, b, base in got[i]]
    assert ("card", "4524132264652876", False) in said(5000, beside)
    assert ("phone", "+1 (319) 555-3296", False) in said(5000, beside)
    assert ("phone", "415-555-2671", False) in said(5001, again)
    assert got[5002] == []
    assert all(got[i] == [(private.LABELS[y], a, b, True) for y, a, b in private.base_spans(t)] for i, t in corpus())


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "no data"), (None, "a@b.co"), (3, "1" * 50_000), (4, "9 " * 30_000), (5, "@" * 5000), (6, "+1" * 5000)]
    rows += [(7, "x 10.1.2.3 y")] * 3
    df = spark.createDataFrame([(i, t, "s", "k") for i, t in rows], SCHEMA)
    field = private.trained(df)
    got = private.find_private(df, field).collect()
    assert len(got) == len(rows) and all(r.spans is not None for r in got)
    assert sum(r.doc_id == 7 and [s.kind for s in r.spans] == ["ip"] for r in got) == 3
    clean = private.redacted(df, field)
    assert clean.columns == df.columns
    assert {r.text for r in clean.collect() if r.doc_id == 7} == {"x <IP> y"}


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    field = private.trained(df)
    assert private.find_private(df, field).collect() == [] and private.redacted(df, field).collect() == []


def test_propagation_is_exact_on_a_tree():
    g = private.Graph([0, 0, 0], [0] * 3, [0] * 3, ["x", "y", "z"], [0, 0, 0], [(0, 1), (0, 2)], [False, True])
    rng = np.random.default_rng(1)
    own = {s: rng.normal(size=5) for s in "xyz"}
    field = private.Field(own, np.zeros(5), rng.normal(size=(5, 5)), rng.normal(size=(5, 5)))
    p = np.exp(own["x"])[:, None, None] * np.exp(own["y"])[None, :, None] * np.exp(own["z"])[None, None, :]
    p = p * np.exp(field.chain)[:, :, None] * np.exp(field.skip)[:, None, :]
    p /= p.sum()
    got = field.beliefs(g)
    assert np.allclose(got[0], p.sum((1, 2)), atol=5e-3) and np.allclose(got[1], p.sum((0, 2)), atol=5e-3)


def test_long_runs_take_linear_time():
    """A megabyte without white space: letters, and characters of other scripts, beside one digit."""
    import time

    for run in ("a" * 1_000_000, "\u65e5" * 1_000_000, "a@" * 300_000, "9." * 300_000):
        text = f"{run} mail x@example.org 7"
        start = time.perf_counter()
        spans = private.base_spans(text)
        private.graph_of([text], [spans])
        assert time.perf_counter() - start < 10
        assert (1, len(text) - len("x@example.org 7"), len(text) - 2) in spans


def test_shapes_past_the_dictionary_count_alike(spark):
    """However few shapes the tasks hold, the others reach their texts by a join: same spans, same field."""
    beside = "write x@y.example.com to +1 (319) 555-3296 4524132264652876 today"
    again = "dial +1 (415) 555-2671 or later 415-555-2671 please, and 4.0 of 2019"
    rows = corpus() + [(5000, beside), (5001, again), (5001, again), (None, beside), (5002, None), (5003, "")]
    rows += [(6000 + i, f"tel:+1{'-' * (i % 5)}{i:03}-555-20{i:02} by z{i}@h.example.org:{i} or 10.1.2.{i}/24") for i in range(60)]
    df = spark.createDataFrame([(i, t, "s", "k") for i, t in rows], SCHEMA)
    spans = lambda field: sorted(map(str, private.find_private(df, field).collect()))
    cleaned = lambda field: sorted(map(str, private.redacted(df, field).collect()))
    whole = private.trained(df)
    assert whole.rest is None and len(whole.shapes) > 5
    for most in (0, 3, len(whole.shapes) - 1):
        field = private.trained(df, most_shapes=most)
        assert len(field.shapes) == most and field.rest.count() == len(whole.shapes) - most
        assert np.array_equal(field.base, whole.base)
        assert spans(field) == spans(whole) and cleaned(field) == cleaned(whole)
    assert private.trained(df, most_shapes=len(whole.shapes)).rest is None
