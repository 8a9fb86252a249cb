"""The alignment against both libraries on whole texts, and counting by plain dictionaries."""

import hashlib
import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from blamesplit.llm import alignment
from blamesplit.llm.registry import QUERIES, tokenizer_file

DATA = "/root/testdata/sf0.001"
A, B = tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model")
ODD = [
    "", " ", "   ", "a", " a", "a ", "a  b", "\n", "a\n\n b\t\tc ", "Don't we'll they've IT'S", "▁", "a ▁b", "x▁ y",
    "日本語 テスト です。", "👩‍👩‍👧 ok", "　 a   b c", "<|endoftext|> and <s> </s> <0x41> <unk>", "a\x00b \x1f c\x85 d", "é é ﬁ ½",
    "0123 456,789.00 $%&", "=" * 3000, "ab" * 4000, " " * 500 + "x", "word " * 200, "ñandú über Straße garçon", "\u0085 x", "\r\n \r\n x",
]


def whole_tokens(text):
    """Ids and bytes of both libraries for a whole text; none if bytes differ."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    global _TOOLS
    try:
        tok, model, names = _TOOLS
    except NameError:
        with open(A, encoding="utf-8") as f:
            described = json.load(f)
        tok = Tokenizer.from_str(json.dumps(described | {"truncation": None, "padding": None}))
        tok.encode_special_tokens = True
        model = SentencePieceProcessor(model_file=B)
        symbols = alignment.byte_symbols()
        names = {i: bytes(symbols[c] for c in t) for t, i in described["model"]["vocab"].items() if all(c in symbols for c in t)}
        _TOOLS = tok, model, names
    if not text:
        return [], []
    a = [(i, names[i]) for i in tok.encode(" " + text, add_special_tokens=False).ids]
    b = []
    for i in model.encode(text):
        p = model.id_to_piece(i)
        b.append((i, bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode()))
    want = (" " + text).encode()
    if b"".join(x for _, x in a) != want or b"".join(x for _, x in b) != want:
        return [], []
    return a, b


def grouped(a, b):
    """Groups as pairs of id lists, by walking along both."""
    out, i, j = [], 0, 0
    while i < len(a):
        left, right = [a[i][0]], [b[j][0]]
        at_a, at_b = len(a[i][1]), len(b[j][1])
        i, j = i + 1, j + 1
        while at_a != at_b:
            if at_a < at_b:
                left.append(a[i][0])
                at_a += len(a[i][1])
                i += 1
            else:
                right.append(b[j][0])
                at_b += len(b[j][1])
                j += 1
        out.append((left, right))
    return out


def expected(rows):
    docs, count = [], Counter()
    for doc_id, text in rows:
        a, b = whole_tokens(text or "")
        groups = grouped(a, b)
        links = Counter()
        for left, right in groups:
            for x, nx in Counter(left).items():
                for y, ny in Counter(right).items():
                    links[x, y] += nx * ny
        count.update(links.keys())
        docs.append((doc_id, a, b, groups, links))
    best = {}
    for (x, _), n in count.items():
        best[x] = max(best.get(x, 0), n)
    out = []
    for doc_id, a, b, groups, links in docs:
        told = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append(
            (
                doc_id, len(a), len(b), len(groups), sum(links.values()),
                sum(n for p, n in links.items() if count[p] == best[p[0]]), sum(n * count[p] for p, n in links.items()),
                hashlib.sha256(told.encode()).hexdigest() if a else "",
            )
        )
    return sorted(out, key=str)


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(map(tuple, alignment.aligned(df, A, B, **options).collect()), key=str)


def test_odd_texts(spark):
    rows = [*enumerate(ODD), (100, None), (None, "a b c"), (5, "a b c"), (5, "a b c")]
    assert run(spark, rows) == expected(rows)


def test_small_blocks_give_the_same(spark):
    rng = random.Random(5)
    letters = "aaeeiot nrs lm\n .,é日 "
    rows = [(i, "".join(rng.choice(letters) for _ in range(rng.randrange(400)))) for i in range(60)]
    want = expected(rows)
    assert run(spark, rows, block_bytes=500) == want
    assert run(spark, rows) == want


def test_wide_groups(spark, monkeypatch):
    rows = list(enumerate(["=" * 999, "ab" * 700 + " x", "日" * 300, "aaaa bbb"]))
    tools = alignment.pair(A, B)
    texts = [(" " + t).encode() for _, t in rows]
    plain = tools.aligned(texts)
    monkeypatch.setattr(alignment, "WIDE_GROUP", 1)
    wide = tools.aligned(texts)
    for x, y in zip(plain, wide, strict=True):
        assert x.tolist() == y.tolist()


def test_query_on_the_given_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    want = expected([tuple(d) for d in docs])
    got = QUERIES["op11_identity_alignment"](spark, DATA)
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.select(*names).collect()), key=str) == want


def test_empty_table_and_clashing_columns(spark):
    assert run(spark, []) == []
    df = spark.createDataFrame([(1, "a b", 7, "x")], "doc_id long, text string, block long, codes string")
    assert [tuple(r)[:2] for r in alignment.aligned(df, A, B).collect()] == [(1, 2)]


def test_identity_map_prefers_written_pieces():
    tools = alignment.pair(A, B)
    for i, j in enumerate(tools.same.tolist()):
        if j >= 0:
            a = tools.a.data[tools.a.places[i] : tools.a.places[i + 1]].tobytes()
            assert a == tools.b.data[tools.b.places[j] : tools.b.places[j + 1]].tobytes()
            if tools.model_b.is_byte(j):  # no piece is written so
                assert len(a) == 1 and (a[0] >= 0x80 or tools.model_b.piece_to_id(a.decode()) == 0)


def test_files_without_ranks_use_the_library(tmp_path):
    with open(A, encoding="utf-8") as f:
        described = json.load(f)
    described["pre_tokenizer"]["use_regex"] = False
    path = tmp_path / "other.json"
    path.write_text(json.dumps(described))
    encode, tokens = alignment.byte_level(str(path))
    assert b"".join(tokens[i] for i in encode(["some words here"])[0]) == b"some words here"


@pytest.mark.parametrize("values", [[], [0], [1, 2, 3], [2**40, 5]])
def test_packed(values):
    import numpy as np

    assert alignment.unpacked(alignment.packed(np.array(values, np.int64))).tolist() == values
