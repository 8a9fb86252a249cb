"""Each stage of the pipeline against plain Python, on its own input."""

import hashlib
from collections import Counter

import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from blamesplit.llm import bytenet, jaccard, mixing, private
from blamesplit.llm.staging import written
from blamesplit.llm.texts import flat
from tests.llm import test_jaccard, test_mixing

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    odd = spark.createDataFrame([(-1, None, None, None, None), (-2, "", "en", None, 0), (None, "a text without a name", "en", "src1", 21)], docs.schema)
    docs = docs.unionByName(odd)
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(written(stage(spark, out[-1], DATA)))
    return out


def test_columns(steps):
    for df in steps[1:-1]:
        assert df.columns == steps[0].columns
    assert steps[-1].columns[0] == "doc_id"


def test_quality(spark, steps):
    net = bytenet.trained(steps[0], spark.read.parquet(f"{DATA}/labels.parquet"))
    want = Counter()
    for r in steps[0].collect():
        p, _ = bytenet.probabilities(net, *flat(pa.array([r.text], pa.string())))
        if p[0] >= 0.3:
            want[r.doc_id] += 1
    assert Counter(r.doc_id for r in steps[1].collect()) == want


def test_near_duplicates(steps):
    rows = [(r.doc_id, r.text) for r in steps[1].collect()]
    want = {c for _, c, *_ in test_jaccard.brute(rows)}
    assert sorted(str(r.doc_id) for r in steps[2].collect()) == sorted(want)


def test_private(steps):
    field = private.trained(steps[2])
    got = {r.doc_id: r for r in steps[3].collect()}
    assert len(got) == steps[2].count()
    for r in steps[2].collect():
        spans = private.base_spans(r.text or "")
        g = private.graph_of([r.text or ""], [spans])
        spans = spans + private.added([r.text or ""], g, field.beliefs(g), [spans])[0]
        want = r.text if r.text is None else private.replaced(r.text, spans)
        assert got[r.doc_id].text == want and got[r.doc_id].n_chars == (None if want is None else len(want))


def test_mix(steps):
    want = Counter()
    for i, _, size, _, _, taken in test_mixing.brute([(r.doc_id, r.text, r.source) for r in steps[3].collect()]):
        if size:
            want[i] += taken // size
    got = Counter(r.doc_id for r in steps[4].collect() if (r.text or "").strip())
    assert got == +want


def test_tokens(steps):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r.doc_id: r.text or "" for r in steps[4].collect()}
    rows = steps[5].collect()
    assert len(rows) == steps[4].count()
    for r in rows:
        assert r.ids == library.encode(texts[r.doc_id], add_special_tokens=False).ids and r.n_tokens == len(r.ids)
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_run_is_the_stages_in_turn(spark, steps):
    got = corpus_pipeline.run(spark, DATA)
    assert got.columns == steps[-1].columns and got.count() > 0


CLASHING = "__key string, __id string, __size int, __h int, __salt int, __time int, __cut int, __repeats int, __look string, look string, `row` string, key string, id long"


def test_columns_may_have_any_name(spark):
    """Columns named like internal ones come through every stage that keeps columns."""
    rows = [(k, f"the {k} small text with words number {k} and more of them", "en", "ab"[k % 2], 9, *["v", "w", 1, 2, 3, 4, 5, 6, "z", "y", "x", "q", k]) for k in range(20)]
    docs = spark.createDataFrame([*rows, rows[3], rows[3]], "doc_id long, text string, lang string, source string, n_chars long, " + CLASHING)
    only = jaccard.deduplicated(docs)
    assert only.columns == docs.columns and sorted(map(tuple, only.collect())) == sorted(set(rows))
    clean = private.redacted(docs, private.trained(docs))
    assert clean.columns == docs.columns and clean.count() == 22
    taken = mixing.mixed(docs)
    assert taken.columns == docs.columns and {r[7:] for r in map(tuple, taken.collect())} <= {r[7:] for r in rows}


def test_empty_tables_and_repeated_rows(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert jaccard.deduplicated(docs.limit(0)).count() == 0
    assert mixing.mixed(docs.limit(0)).count() == 0
    assert private.redacted(docs.limit(0), private.trained(docs)).count() == 0
    some = docs.where("doc_id < 10")
    twice = some.unionByName(some)
    assert jaccard.deduplicated(twice).count() == jaccard.deduplicated(some).count()
