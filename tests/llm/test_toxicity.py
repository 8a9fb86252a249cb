"""Fuzzy matching against plain edit distance, quotation, and held-out accuracy."""

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from blamesplit.llm import toxicity
from blamesplit.llm.texts import flat

SCHEMA = "doc_id long, text string, score double, abuse string"
TERMS = ["idiot", "worthless", "scum", "disgusting", "pathetic", "path", "worthier"]
MATCHER = toxicity.Matcher(TERMS)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(new[j] + 1, row[j + 1] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=2000, deadline=None)
@given(st.sampled_from(TERMS), st.lists(st.tuples(st.integers(0, 12), st.sampled_from(["", "x", "t"]), st.booleans()), max_size=3))
def test_nearest_term(term, edits):
    for at, letter, drop in edits:
        at = min(at, len(term))
        term = term[:at] + letter + term[at + drop :]
    want = min(((d, k) for k, t in enumerate(TERMS) if (d := distance(term, t)) <= toxicity.allowed(t)), default=None)
    assert MATCHER.find(term) == want


def features(*texts):
    return toxicity.Lexicon(TERMS).features(*flat(pa.array(texts, pa.string())))


def test_context():
    x = features("you idiot and scum", 'he said "you idiot" to us', "w0rthles person, 1d1ot!", "nothing here", "i.d.i.o.t", None, "« idiot »")
    assert np.allclose(np.expm1(x[:, :3]), [[2, 0, 0], [0, 0, 1], [1, 1, 0], [0, 0, 0], [1, 0, 0], [0, 0, 0], [0, 0, 1]])
    assert x[0, 3] == 2 and not x[1, 3] and not x[3].any() and not x[5].any()


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    own = labels.where("crc32(string(doc_id)) % 4 != 2")
    model = toxicity.trained(docs, own)
    rest = toxicity.scored(docs, model).join(labels.where("crc32(string(doc_id)) % 4 = 2"), "doc_id").collect()
    assert any(t.endswith("*") for t in model.lexicon.terms)
    hit = [r.score >= 0.3 for r in rest if r.toxic]
    wrong = [r.score >= 0.3 for r in rest if not r.toxic]
    assert sum(hit) / len(hit) > 0.84 and sum(wrong) / len(wrong) < 0.02


def test_odd_rows(spark):
    rows = [(1, "idiot " * 20_000, 0.5, "x"), (2, None, None, None), (None, "", 0.1, ""), (3, "fine", 0.2, ""), (3, "fine", 0.2, ""), (4, "x" * 200_000, 0.0, "")]
    df = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(1, 1, "t"), (2, 0, "t"), (3, None, "t"), (None, 1, "t")], "doc_id long, toxic int, text string")
    model = toxicity.trained(df, labels)
    got = toxicity.scored(df, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    none = toxicity.trained(df, labels.where("toxic > 5"))
    assert {r.score for r in toxicity.scored(df, none).collect()} == {0.5}
    assert toxicity.scored(df.where("doc_id = 99"), model).collect() == []


def test_runs_without_ascii_white_space():
    names = [f"name{chr(97 + k)}{chr(97 + j)}" for k in range(4) for j in range(4)]
    for joint in (",", "-", "/", "_", "\u00a0", "\u3000", "\u2009", "，", "、", "; ".strip() + "\u00a0"):
        x = features(joint.join(["idiot", *names, "scum", *names, "w0rthles"]))
        assert np.allclose(np.expm1(x[0, :3]), [2, 1, 0]), joint
    plain = " ".join(["you", "idiot", *names, "and", "scum"])
    assert np.allclose(*features(plain, plain.replace(" ", "\u00a0")))
    said = ",".join([*names, '"idiot"', *names, "“scum”", *names, "don't", "1d1ot", "$cum"])
    assert np.allclose(np.expm1(features(said)[0, :3]), [2, 0, 2])
    assert not features("x" * 200_000, "_" * 200_000, '"' * 200_000, "“'" * 100_000, "\u00a0" * 90).any()


def test_short_terms_and_swaps():
    for word in ("idoit", "idot", "idioot", "idiat", "scmu", "scun", "scu", "scumm", "wortlhess"):
        assert np.allclose(np.expm1(features(f"you {word}")[0, :3]), [0, 1, 0]), word
    assert not features("odiot xcum cum sc sckm2 sxxm idixxt csum").any()
    lexicon = toxicity.Lexicon(TERMS, frozenset(("scam",)))
    assert not lexicon.features(*flat(pa.array(["a scam"]))).any() and lexicon.features(*flat(pa.array(["a scim"]))).any()


def test_planted_misspellings(spark):
    words = "river table cloud stone green paper light music".split()
    rows = [(k, f"{words[k % 8]} {words[k % 7]} " + ("you idiot scum" if k % 4 == 0 else "a scam on the sand" if k % 4 == 1 else "in the hall")) for k in range(400)]
    model = toxicity.trained(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(400)], "doc_id long, toxic int"))
    assert {"idiot", "scum"} <= set(model.lexicon.terms) and model.lexicon.own == {"scam"}
    said = ["you idoit scmu", "a scam on the sand", "in the hall"]
    got = {r.doc_id: r for r in toxicity.scored(spark.createDataFrame([*enumerate(said)], "doc_id long, text string"), model).collect()}
    assert got[0].misspelled > 0 and got[0].score > got[1].score == got[2].score
