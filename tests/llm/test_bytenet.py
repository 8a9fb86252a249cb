"""The network's gradients and scores against plain loops, and held-out accuracy."""

import numpy as np
import pyarrow as pa
import pytest

from blamesplit.llm import bytenet
from blamesplit.llm.texts import flat

SCHEMA = "doc_id long, text string, score double, n_chunks string"


def plain_score(net, text):
    data = (text or "").encode()
    firsts = [0]
    while firsts[-1] + bytenet.CHUNK < len(data):
        firsts.append(min(firsts[-1] + bytenet.CHUNK - bytenet.OVERLAP, len(data) - bytenet.CHUNK))
    odds = []
    for a in firsts:
        part = list(data[a : a + bytenet.CHUNK])
        padded = part + [256] * (bytenet.CHUNK - len(part))
        e = net.embedding[padded]
        answers = [e[i : i + bytenet.WIDTH].reshape(-1) @ net.filters for i in range(0, bytenet.CHUNK - bytenet.WIDTH + 1, bytenet.STRIDE)]
        top = np.maximum(np.max(answers, 0) + net.offset, 0)
        z = np.append(top, np.log2(len(part) + 1) / 9 - 0.5)
        odds.append(np.maximum(z @ net.hidden + net.hidden_offset, 0) @ net.last + net.last_offset[0])
    return 1 / (1 + np.exp(-np.mean(odds)))


def test_scores_equal_plain_loops():
    net = bytenet.Network.fresh(3, 0.2)
    texts = [None, "", "a", "é" * 300, "word " * 97, "x" * 512, "y" * 513, "abc def " * 400]
    p, counts = bytenet.probabilities(net, *flat(pa.array(texts, pa.string())))
    assert p == pytest.approx([plain_score(net, t) for t in texts], rel=1e-4)
    assert counts.tolist()[:4] == [1, 1, 1, 2] and counts[5] == 1 and counts[6] == 2


def test_gradients_equal_differences():
    net = bytenet.Network.fresh(1, 0.1)
    for p in net.parameters():
        p += np.random.default_rng(2).normal(size=p.shape).astype(np.float32) * 0.01
    net.embedding[256] = 0
    data, places = flat(pa.array(["some text here " * 30, "other words, " * 20]))
    x = bytenet.cut(data, *bytenet.chunks(data, places)[:2])
    y = np.array([1, 0], np.float32)

    def loss():
        z = net.odds(x).astype(float)
        return float(np.mean(np.logaddexp(0, z) - y * z))

    for p, g in zip(net.parameters(), net.gradients(x, y), strict=True):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        keep, h = p[at], 2e-3
        p[at] = keep + h
        up = loss()
        p[at] = keep - h
        slope = (up - loss()) / (2 * h)
        p[at] = keep
        assert slope == pytest.approx(float(g[at]), rel=0.1, abs=1e-4)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    net = bytenet.trained(docs, labels.where("crc32(string(doc_id)) % 5 != 0"))
    rest = bytenet.scored(docs, net).join(labels.where("crc32(string(doc_id)) % 5 = 0"), "doc_id").collect()
    good = [r.score >= 0.3 for r in rest if r.quality]
    bad = [r.score >= 0.3 for r in rest if not r.quality]
    assert sum(good) / len(good) > 0.98 and sum(bad) / len(bad) < 0.15


def test_odd_rows(spark):
    rows = [(1, "idiot " * 20_000, 0.5, "x"), (2, None, None, None), (None, "", 0.1, ""), (3, "fine", 0.2, ""), (3, "fine", 0.2, ""), (4, "x" * 300_000, 0.0, "")]
    df = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(1, 1, "t"), (2, 0, "t"), (3, None, "t"), (None, 1, "t")], "doc_id long, quality int, text string")
    net = bytenet.trained(df, labels)
    got = bytenet.scored(df, net).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert bytenet.kept(df, net, 0.0).columns == df.columns and bytenet.kept(df, net, 0.0).count() == len(rows)
    assert bytenet.kept(df, net, 1.1).count() == 0
    none = bytenet.trained(df, labels.where("quality > 5"))
    assert {r.score for r in bytenet.scored(df, none).collect()} == {0.5}
    assert bytenet.scored(df.where("doc_id = 99"), net).collect() == []
