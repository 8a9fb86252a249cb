"""Fertility measures against a plain count, and edge cases."""

import math
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tokenizers

from blamesplit.llm import fertility

PATH = public_tokenizers.path("piece_bpe_32k.model")
MODEL = sentencepiece.SentencePieceProcessor(model_file=PATH)
SCHEMA = "doc_id long, text string, lang string, n_words int, latin string"


BYTES = public_tokenizers.path("byte_bpe_50k.json")
BYTE_MODEL = tokenizers.Tokenizer.from_file(BYTES)
BYTE_MODEL.encode_special_tokens = True


def entropy(ids):
    """The mean relative entropy of windows of 128 ids; the last one reaches back."""
    firsts = [min(i, max(len(ids) - 128, 0)) for i in range(0, len(ids), 128)]
    relative = []
    for a in firsts:
        part = ids[a : a + 128]
        h = -sum(c / len(part) * math.log2(c / len(part)) for c in Counter(part).values())
        relative.append(h / math.log2(len(part)) if len(part) > 1 else 0.0)
    return sum(relative) / max(1, len(relative))


def plain_bytes(text):
    """The byte-level measures: a token that is no whole character decodes to U+FFFD."""
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    ids = [i for x in w for i in BYTE_MODEL.encode(" " + x, add_special_tokens=False).ids]
    split = sum("\ufffd" in BYTE_MODEL.decode([i], skip_special_tokens=False) for i in set(ids) for _ in range(ids.count(i)))
    n = max(1, len(ids))
    return [len(ids), sum(map(len, w)) / n, split / n, entropy(ids)]


def plain(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    three = Counter(zip(w, w[1:], w[2:]))
    repeated = {i + k for i in range(len(w) - 2) if three[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    ids = [i for x in w for i in MODEL.encode(x)]
    firsts = list(dict.fromkeys([min(i, max(len(ids) - 128, 0)) for i in range(0, len(ids), 128)]))
    if len(ids) % 128 == 0:
        firsts = list(range(0, len(ids), 128))
    relative = []
    for a in firsts:
        part = ids[a : a + 128]
        h = -sum(c / len(part) * math.log2(c / len(part)) for c in Counter(part).values())
        relative.append(h / math.log2(len(part)) if len(part) > 1 else 0.0)
    n = max(1, len(ids))
    return [
        len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(repeated), len(ids),
        sum(map(len, w)) / n, sum(MODEL.is_byte(i) for i in ids) / n, sum(relative) / max(1, len(relative)),
    ]


def test_equals_plain_count(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang").collect()
    rows = [(r.doc_id, r.text, r.lang, 0, "x") for r in docs]
    odd = [None, "", " \n\t", "a", "a a a a", "日本語 テキスト ⟨⟩ ① 🙂 x", "x" * 70_000, "the cat sat " * 20_000, "b\x1cc d\xa0e\x85f", "l\nl\n \n \nm", "% a | b"]
    rows += [(None if k % 2 else -k, t, None, None, None) for k, t in enumerate(odd)] * 2
    got = fertility.judged(spark.createDataFrame(rows, SCHEMA).repartition(5), PATH).collect()
    names = "n_words word_chars n_symbols n_dup_lines n_repeat_words n_tokens chars_per_token byte_share token_entropy".split()
    found = sorted(((str(r.doc_id), *(r[c] for c in names)) for r in got), key=lambda x: (x[0], x[1:]))
    want = sorted(((str(i), *plain(t)) for i, t, *_ in rows), key=lambda x: (x[0], tuple(x[1:])))
    assert len(found) == len(want)
    for f, w in zip(found, want, strict=True):
        assert f[0] == w[0] and list(f[1:]) == pytest.approx(list(w[1:])), (f, w)
    for r in got:
        failed = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
        assert r.base_failed == failed and not (failed and r.kept)


def test_good_documents_stay_and_junk_goes(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = fertility.judged(docs, PATH).join(labels, "doc_id").where("not base_failed").collect()
    good = [r.kept for r in got if r.quality == 1]
    bad = [r.kept for r in got if r.quality == 0]
    assert sum(good) / len(good) > 0.99 and sum(bad) / len(bad) < 0.1


def test_byte_level_measures_equal_plain_count(spark):
    odd = [None, "", " \n", "a", "日本語 テキスト ⟨⟩ 🙂 x", "naïve élan über", "the cat sat " * 500, "<|endoftext|> a", "b\x1cc d\xa0e"]
    df = spark.createDataFrame([(i, t, "en", 0, "") for i, t in enumerate(odd)] * 2, SCHEMA)
    got = fertility.fertility(df, PATH, BYTES).collect()
    assert len(got) == 2 * len(odd)
    for r in got:
        found = [r.byte_level_n_tokens, r.byte_level_chars_per_token, r.byte_level_byte_share, r.byte_level_token_entropy]
        assert found == pytest.approx(plain_bytes(odd[r.doc_id])), odd[r.doc_id]


def test_two_vocabularies_and_their_fitted_bands(spark):
    """Held to both vocabularies, good documents stay; the constants lie outside the fitted quantiles."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    both = fertility.judged(docs, PATH, byte_path=BYTES).join(labels.select("doc_id", "quality"), "doc_id").where("not base_failed").cache()
    good = [r.kept for r in both.where("quality = 1").collect()]
    bad = [r.kept for r in both.where("quality = 0").collect()]
    assert sum(good) / len(good) > 0.99 and sum(bad) / len(bad) < 0.1
    for bands, prefix in ((fertility.BANDS, ""), (fertility.BYTE_BANDS, fertility.BYTE_LEVEL)):
        for r in fertility.fitted_bands(both.where("quality = 1"), tail=0.01, prefix=prefix).collect():
            b = bands[r.lang]
            assert b.least_chars <= r.chars_per_token[0] and r.chars_per_token[1] <= b.most_chars
            assert r.byte_share[1] <= b.most_bytes and b.least_entropy <= r.token_entropy[0]
    both.unpersist()


def test_empty_table_and_bands(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert fertility.judged(empty, PATH).collect() == []
    assert fertility.judged(empty, PATH, byte_path=BYTES).collect() == []
    assert fertility.fitted_bands(fertility.fertility(empty, PATH)).collect() == []
    some = spark.createDataFrame([(1, "a few words here", "en", 0, ""), (2, None, None, 0, "")], SCHEMA)
    assert {r.lang: r.n for r in fertility.fitted_bands(fertility.fertility(some, PATH)).collect()} == {"en": 1, None: 1}


def test_repeated_words_whatever_the_vocabulary():
    """Windows are numbered directly, or by the pairs that occur where numbers would not fit."""
    rng = np.random.default_rng(2)
    for n_words, n_texts, scale in ((0, 3, 1), (2, 3, 1), (40, 2, 1), (900, 7, 1), (900, 7, 2_000_000), (5000, 40, 1)):
        which = rng.integers(0, 12, n_words).astype(np.int32) * scale
        text_of = np.sort(rng.integers(0, n_texts, n_words))
        want = np.zeros(n_texts, np.int64)
        for t in range(n_texts):
            words = which[text_of == t].tolist()
            windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
            inside = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
            want[t] = len(inside)
        assert fertility.repeated_words(which, text_of, n_texts).tolist() == want.tolist()


def test_words_are_looked_up_once_and_forgotten_in_time(monkeypatch):
    monkeypatch.setattr(fertility, "REMEMBERED", 3)
    asked = []

    class Lengths(fertility.Remembering):
        def encoded(self, some):
            asked.append(some)
            return [[len(w)] for w in some]

    vocab = Lengths()
    assert vocab([b"a", b"bb"]) == [[1], [2]]
    assert vocab([b"bb", b"ccc", b"dddd"]) == [[2], [3], [4]]  # too many: the old ones are forgotten, not asked anew
    assert vocab([]) == [] and vocab([b"ccc"]) == [[3]]
    assert asked == [["a", "bb"], ["ccc", "dddd"]] and len(vocab.known) <= 3
