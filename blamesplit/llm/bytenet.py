"""Quality by a small convolutional network over bytes, written in numpy.

A text is cut into overlapping chunks of `CHUNK` bytes that cover all of it (the last one reaches
back, so that it is full). Each byte has a learned embedding; learned filters of `WIDTH` bytes are
evaluated at every `STRIDE`-th byte of the chunk, that is at each one, and each filter's largest answer in the chunk goes on to a hidden layer, with the
chunk's length, and to the chunk's log odds. Text of little variety excites few filters, odd bytes
excite filters of their own. The document's log odds are the mean of its chunks'.

The network is trained by Adam on chunks of a bounded sample of labelled documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import as_strided
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blamesplit.llm.texts import flat, gather, pieces

CHUNK, OVERLAP = 512, 32
WIDTH, STRIDE = 8, 1
EMBEDDING, FILTERS, HIDDEN = 4, 24, 16
#: Labelled documents that the network is trained on, about, and chunks taken from each, spread evenly.
LABELLED, CHUNKS_EACH = 8_000, 4
EPOCHS, BATCH, RATE, DECAY = 8, 128, 4e-3, 1e-4
AT_ONCE = 256
PLACES = (CHUNK - WIDTH) // STRIDE + 1


def chunks(data: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte and length of all chunks, and the text each belongs to. Empty texts have one, empty."""
    sizes = np.diff(places)
    step = CHUNK - OVERLAP
    counts = np.maximum(1, -(-(sizes - OVERLAP) // step))
    of = np.repeat(np.arange(len(sizes)), counts)
    number = gather(np.zeros(len(sizes), np.int64), counts)
    back = np.maximum(sizes[of] - CHUNK, 0)
    return places[of] + np.minimum(number * step, back), np.minimum(sizes[of], CHUNK), of


def cut(data: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Chunks as rows of CHUNK byte values; 256 stands after the end."""
    out = np.full((len(first), CHUNK), 256, np.int16)
    inside = np.arange(CHUNK) < length[:, None]
    out[inside] = data[gather(first, length)]
    return out


@dataclass
class Network:
    embedding: np.ndarray  # 257 x EMBEDDING; the last row stays 0
    filters: np.ndarray  # WIDTH * EMBEDDING x FILTERS
    offset: np.ndarray
    hidden: np.ndarray  # FILTERS + 1 x HIDDEN
    hidden_offset: np.ndarray
    last: np.ndarray
    last_offset: np.ndarray

    @staticmethod
    def fresh(seed: int, base: float) -> Network:
        rng = np.random.default_rng(seed)

        def normal(*shape: int) -> np.ndarray:
            return (rng.normal(size=shape) / np.sqrt(shape[0])).astype(np.float32)

        emb = rng.normal(size=(257, EMBEDDING)).astype(np.float32)
        emb[256] = 0
        zeros = lambda n: np.zeros(n, np.float32)
        return Network(emb, normal(WIDTH * EMBEDDING, FILTERS), zeros(FILTERS), normal(FILTERS + 1, HIDDEN), zeros(HIDDEN), normal(HIDDEN, 1)[:, 0], np.array([base], np.float32))

    def parameters(self) -> list[np.ndarray]:
        return [self.embedding, self.filters, self.offset, self.hidden, self.hidden_offset, self.last, self.last_offset]

    def windows(self, x: np.ndarray) -> np.ndarray:
        """All windows' embeddings: chunks x PLACES x (WIDTH * EMBEDDING)."""
        e = np.ascontiguousarray(self.embedding[x])
        a, _, c = e.strides
        return as_strided(e, (len(x), PLACES, WIDTH * EMBEDDING), (a, STRIDE * EMBEDDING * c, c)).copy()

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each filter's largest answer in each chunk (0 at least), where it is, and the windows."""
        w = self.windows(x)
        answers = (w.reshape(-1, WIDTH * EMBEDDING) @ self.filters).reshape(len(x), PLACES, FILTERS)
        at = answers.argmax(1)
        top = np.take_along_axis(answers, at[:, None], 1)[:, 0] + self.offset
        return np.maximum(top, 0), at, w

    def odds(self, x: np.ndarray) -> np.ndarray:
        """Log odds of chunks."""
        out = np.empty(len(x), np.float32)
        for k in range(0, len(x), AT_ONCE):
            part = x[k : k + AT_ONCE]
            w = self.windows(part).reshape(-1, WIDTH * EMBEDDING)
            top = (w @ self.filters).reshape(len(part), PLACES, FILTERS).max(1) + self.offset
            z = np.column_stack([np.maximum(top, 0), lengths(part)])
            out[k : k + AT_ONCE] = np.maximum(z @ self.hidden + self.hidden_offset, 0) @ self.last + self.last_offset[0]
        return out

    def gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        top, at, w = self.pooled(x)
        z = np.column_stack([top, lengths(x)]).astype(np.float32)
        h = z @ self.hidden + self.hidden_offset
        r = np.maximum(h, 0)
        d = (1 / (1 + np.exp(-(r @ self.last + self.last_offset[0]))) - y).astype(np.float32) / len(x)
        dh = d[:, None] * self.last * (h > 0)
        dtop = (dh @ self.hidden.T)[:, :FILTERS] * (top > 0)
        picked = np.take_along_axis(w, at[:, :, None], 1)  # chunks x FILTERS x (WIDTH * EMBEDDING)
        demb = np.zeros_like(self.embedding)
        into = dtop[:, :, None] * self.filters.T
        bytes_at = x[np.arange(len(x))[:, None, None], at[:, :, None] * STRIDE + np.arange(WIDTH)]
        np.add.at(demb, bytes_at.reshape(-1), into.reshape(-1, EMBEDDING))
        demb[256] = 0
        return [demb, np.einsum("nf,nfk->kf", dtop, picked), dtop.sum(0), z.T @ dh, dh.sum(0), d @ r, d.sum(keepdims=True)]


def lengths(x: np.ndarray) -> np.ndarray:
    return (np.log2((x != 256).sum(1) + 1) / 9 - 0.5).astype(np.float32)


def fit(x: np.ndarray, y: np.ndarray, seed: int = 5) -> Network:
    """A network trained on chunks `x` with labels `y` (0 or 1)."""
    share = (y.sum() + 1) / (len(y) + 2)
    net = Network.fresh(seed, float(np.log(share / (1 - share))))
    if not 0 < y.sum() < len(y):
        net.last[:] = 0  # one kind of label only: the base rate
        return net
    rng = np.random.default_rng(seed + 1)
    params = net.parameters()
    first, second, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    steps = EPOCHS * -(-len(x) // BATCH)
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for k in range(0, len(x), BATCH):
            some = order[k : k + BATCH]
            t += 1
            rate = RATE * (1 - t / (steps + 1))
            for p, g, m, v in zip(params, net.gradients(x[some], y[some]), first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * ((m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8) + DECAY * p)
    return net


def trained(df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", most: int = LABELLED, each: int = CHUNKS_EACH) -> Network:
    """A network fitted to about `most` of the labelled documents at most, chosen by a hash of their id.

    At most `each` chunks of a document reach the driver, spread over its whole length. Without
    labels, or with one kind only, all scores equal the base rate.
    """
    known = labels.select(F.col(doc_id).cast("long").alias("id"), F.col(label).cast("int").alias("label")).where("label is not null and id is not null")
    n = known.count()
    if n > most:
        known = known.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(1_000_000 * most / n))
    known = known.groupBy("id").agg(F.max("label").alias("label"))
    docs = df.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    sample = docs.join(F.broadcast(known), "id").select("id", "text", "label")  # about `most` rows of two integers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):
            data, places = flat(batch.column(1))
            first, length, of = chunks(data, places)
            counts = np.bincount(of, minlength=batch.num_rows)
            rank = gather(np.zeros(len(counts), np.int64), counts)
            take = np.flatnonzero((rank * each) // counts[of] != ((rank - 1) * each) // counts[of])
            rows = [data[a : a + b].tobytes() for a, b in zip(first[take].tolist(), length[take].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of[take])), pa.array(rows, pa.binary()), batch.column(2).take(pa.array(of[take]))], ["id", "chunk", "label"])

    found = sample.mapInArrow(run, "id long, chunk binary, label int").toArrow()
    order = sorted(range(found.num_rows), key=list(zip(found["id"].to_pylist(), found["chunk"].to_pylist(), strict=True)).__getitem__)
    rows = found["chunk"].to_pylist()
    rows = [rows[i] for i in order]
    y = found["label"].to_numpy()[order].astype(np.float32) if rows else np.zeros(0, np.float32)
    length = np.array([len(r) for r in rows], np.int64)
    data = np.frombuffer(b"".join(rows), np.uint8)
    return fit(cut(data, np.cumsum(length) - length, length), y)


def scored(df: DataFrame, net: Network, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score, n_chunks): the probability of label 1 for each whole text.

    A null or empty text is one empty chunk. Repeated rows are scored each; an empty table gives an
    empty one. Other columns of `df` are not read.
    """
    narrow = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):
            p, counts = probabilities(net, *flat(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array(counts)], ["doc_id", "score", "n_chunks"])

    return narrow.mapInArrow(run, "doc_id long, score double, n_chunks long")


def probabilities(net: Network, data: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first, length, of = chunks(data, places)
    odds = np.concatenate([net.odds(cut(data, first[k : k + AT_ONCE], length[k : k + AT_ONCE])) for k in range(0, len(first), AT_ONCE)])
    counts = np.bincount(of, minlength=len(places) - 1)
    mean = np.bincount(of, weights=odds, minlength=len(places) - 1) / counts
    return 1 / (1 + np.exp(-mean)), counts


def kept(df: DataFrame, net: Network, least: float = 0.3, text: str = "text") -> DataFrame:
    """The rows of `df`, with all columns, whose score is `least` or more."""
    place, schema = df.columns.index(text), df.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, place):
            p, _ = probabilities(net, *flat(batch.column(place)))
            yield batch.filter(pa.array(p >= least))

    return df.mapInArrow(run, schema)
