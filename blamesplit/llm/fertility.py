"""Quality rules by tokeniser fertility.

Public vocabularies were learned on ordinary text. What is not ordinary shows in how it splits:
fewer characters per token, more bytes of split characters where no piece fits, or too little variety
of tokens. Two kinds of vocabulary measure this, SentencePiece pieces and byte-level merges, each with
bands of its own; a document is kept if it lies in both.
Words are tokenised one by one (the vocabularies split at white space anyway); each distinct word of
a piece of the input is tokenised once. Entropy depends on length, so it is measured in windows of
`WINDOW` tokens that cover the whole text, divided by its maximum, and averaged.

Rejection bands are given per language; other languages, and null, take the band of the script that
most letters have.
"""

from __future__ import annotations

import os
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blamesplit.llm.texts import flat, gather, per_text, pieces, words

WINDOW = 128
REMEMBERED = 300_000
SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class Band:
    """Bounds, ends included. Entropy is relative to the most that a window can have."""

    least_chars: float
    most_chars: float
    most_bytes: float
    least_entropy: float
    most_entropy: float = 1.0


#: For piece_bpe_32k.model. Languages: the 0.1 % quantiles of documents labelled good, widened.
BANDS: Mapping[str, Band] = {
    "en": Band(1.6, 6.5, 0.2, 0.797),
    "de": Band(1.6, 6.5, 0.2, 0.795),
    "fr": Band(1.5, 6.5, 0.2, 0.783),
    "es": Band(1.5, 6.5, 0.2, 0.783),
    "latin": Band(1.2, 8.0, 0.3, 0.74),
    "other": Band(0.2, 4.0, 0.9, 0.6),
}

#: For byte_bpe_50k.json, set in the same way; it splits other languages than English more finely.
BYTE_BANDS: Mapping[str, Band] = {
    "en": Band(1.6, 6.5, 0.2, 0.795),
    "de": Band(1.5, 6.5, 0.2, 0.785),
    "fr": Band(1.4, 6.5, 0.25, 0.775),
    "es": Band(1.4, 6.5, 0.25, 0.76),
    "latin": Band(1.0, 8.0, 0.4, 0.7),
    "other": Band(0.2, 4.0, 1.0, 0.5),
}

BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, latin boolean"
#: The measures of one vocabulary; those of a byte-level one are named `byte_level_...`.
MEASURES = ("n_tokens long", "chars_per_token double", "byte_share double", "token_entropy double")
BYTE_LEVEL = "byte_level_"


class Remembering:
    """Token ids of single words, remembered. `is_byte` marks tokens that hold part of a character."""

    size: int
    is_byte: np.ndarray

    def __init__(self) -> None:
        self.known: dict[bytes, list[int]] = {}

    def encoded(self, some: list[str]) -> list[list[int]]:
        raise NotImplementedError

    def __call__(self, distinct: list[bytes]) -> list[list[int]]:
        found = list(map(self.known.get, distinct))
        missing = [i for i, ids in enumerate(found) if ids is None]
        if missing:
            new = [distinct[i] for i in missing]
            if len(self.known) + len(new) > REMEMBERED:
                self.known.clear()
            coded = self.encoded([w.decode() for w in new])
            self.known.update(zip(new, coded, strict=True))
            for i, ids in zip(missing, coded, strict=True):
                found[i] = ids
        return found


class Pieces(Remembering):
    """A SentencePiece model, which falls back to bytes."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        super().__init__()
        self.model = SentencePieceProcessor(model_file=path)
        self.size = self.model.get_piece_size()
        self.is_byte = np.array([self.model.is_byte(i) for i in range(self.size)])

    def encoded(self, some: list[str]) -> list[list[int]]:
        return self.model.encode(some, num_threads=1)


class ByteLevel(Remembering):
    """Byte-level merges. A word is encoded behind a space, strings of special tokens as plain text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        self.model.encode_special_tokens = True
        self.size = self.model.get_vocab_size()
        alone = self.model.decode_batch([[i] for i in range(self.size)], skip_special_tokens=False)
        self.is_byte = np.array(["\ufffd" in t for t in alone])

    def encoded(self, some: list[str]) -> list[list[int]]:
        return [e.ids for e in self.model.encode_batch_fast([" " + w for w in some], add_special_tokens=False)]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Remembering:
    return ByteLevel(path) if path.endswith(".json") else Pieces(path)


def repeated_words(which: np.ndarray, text_of: np.ndarray, n_texts: int) -> np.ndarray:
    """Words of each text that lie in a 3-word window found twice or more in that text."""
    if len(which) < 3:
        return np.zeros(n_texts, np.int64)
    n = int(which.max()) + 1
    first, second = which[:-1].astype(np.int64), which[1:]
    # numbers of word pairs: their own if a window's key fits 63 bits, else those of the pairs that occur
    pairs, n_pairs = first * n + second, n * n
    if n_texts * n**3 >= 1 << 63:
        pairs = np.unique(pairs, return_inverse=True)[1]
        n_pairs = int(pairs.max()) + 1
    at = np.flatnonzero(text_of[2:] == text_of[:-2])
    keys = (text_of[at].astype(np.int64) * n_pairs + pairs[at]) * n + which[at + 2]
    ordered = np.sort(keys)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return np.zeros(n_texts, np.int64)
    again = at[twice[np.minimum(np.searchsorted(twice, keys), len(twice) - 1)] == keys]
    marked = np.zeros(len(which), bool)
    for k in range(3):
        marked[again + k] = True
    return np.bincount(text_of[marked], minlength=n_texts)


def window_entropy(tokens: np.ndarray, starts: np.ndarray, n_ids: int) -> np.ndarray:
    """Mean relative entropy of each text's windows; 0 for a text of fewer than two tokens."""
    counts = np.diff(starts)
    windows = -(-counts // WINDOW)
    of = np.repeat(np.arange(len(counts)), windows)
    number = gather(np.zeros(len(counts), np.int64), windows)
    # the last window of a text reaches back, so that all are full
    first = starts[of] + np.minimum(number * WINDOW, np.maximum(counts[of] - WINDOW, 0))
    length = np.minimum(counts[of], WINDOW)
    keys = np.repeat(np.arange(len(of), dtype=np.int64), length) * n_ids + tokens[gather(first, length)]
    keys.sort()
    run = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    c = np.diff(np.append(run, len(keys)))
    spent = np.bincount(keys[run] // n_ids, weights=c * np.log2(c), minlength=len(of)) if len(of) else np.zeros(0)
    most = np.log2(np.maximum(length, 2))
    relative = np.where(length > 1, (np.log2(np.maximum(length, 1)) - spent / np.maximum(length, 1)) / most, 0.0)
    return np.bincount(of, weights=relative, minlength=len(counts)) / np.maximum(windows, 1)


def dup_lines(data: np.ndarray, places: np.ndarray) -> list[int]:
    """Lines with a word that equal an earlier line of the same text."""
    whole, out = data.tobytes(), []
    for a, b in zip(places[:-1].tolist(), places[1:].tolist(), strict=True):
        lines = [x for x in whole[a:b].split(b"\n") if x.strip(b" \t\r\x0b\x0c")]
        out.append(len(lines) - len(set(lines)))
    return out


def measures(vocab: Remembering, distinct: list[bytes], which: np.ndarray, text_of: np.ndarray, chars: np.ndarray) -> list[np.ndarray]:
    """The `MEASURES` of each text, from its words (`which` of the distinct ones, in which text)."""
    n = len(chars)
    ids = vocab(distinct)
    lengths = np.fromiter(map(len, ids), np.int64, len(ids))
    flat_ids = np.fromiter(chain.from_iterable(ids), np.int32, int(lengths.sum()))
    each = lengths[which]
    tokens = flat_ids[gather((np.cumsum(lengths) - lengths)[which], each)] if len(which) else flat_ids
    n_tokens = np.bincount(text_of, weights=each, minlength=n).astype(np.int64) if len(which) else np.zeros(n, np.int64)
    starts = np.append(0, np.cumsum(n_tokens))
    some = np.maximum(n_tokens, 1)
    split = np.bincount(np.repeat(np.arange(n), n_tokens), weights=vocab.is_byte[tokens], minlength=n)
    return [n_tokens, chars / some, split / some, window_entropy(tokens, starts, vocab.size)]


def measured(batch: pa.RecordBatch, paths: Mapping[str, str]) -> dict[str, pa.Array]:
    data, places = flat(batch.column(1))
    n = batch.num_rows
    found, text_of, _ = words(data, places)
    coded = found.dictionary_encode()
    which, distinct = coded.indices.to_numpy(), coded.dictionary.to_pylist()
    space = ((data >= 9) & (data <= 13)) | (data == 32)
    chars = per_text(~space & ((data & 0xC0) != 0x80), places)
    wide = per_text(data >= 0xC9, places)  # first bytes of characters from U+0240 on
    out = {
        "n_words": pa.array(np.bincount(text_of, minlength=n)),
        "word_chars": pa.array(chars),
        "n_symbols": pa.array(per_text(np.isin(data, np.frombuffer(SYMBOLS, np.uint8)), places)),
        "n_dup_lines": pa.array(dup_lines(data, places), pa.int64()),
        "n_repeat_words": pa.array(repeated_words(which, text_of, n)),
        "latin": pa.array(2 * wide <= chars),
    }
    for prefix, path in paths.items():
        for name, values in zip(MEASURES, measures(vocabulary(path), distinct, which, text_of, chars), strict=True):
            out[prefix + name.split()[0]] = pa.array(values)
    return out


def fertility(df: DataFrame, path: str, byte_path: str | None = None, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(doc_id, lang) and the measures of each whole text under the SentencePiece model at `path` and,
    if it is given, the byte-level vocabulary at `byte_path` (named `byte_level_...`).

    Words are `[^\\x20\\x09-\\x0D]+`. A null or wordless text has zeros. Repeated rows are measured
    each; an empty table gives an empty one. Other columns of `df` are not read.
    """
    paths = {"": path} | ({BYTE_LEVEL: byte_path} if byte_path else {})
    narrow = df.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "lang": batch.column(2)} | measured(batch, paths))

    return narrow.mapInArrow(run, ", ".join(["doc_id long, lang string", BASE, *(p + m for p in paths for m in MEASURES)]))


def in_band(bands: Mapping[str, Band], prefix: str = "") -> Column:
    """Whether a document's measures under one vocabulary lie in the band of its language or script."""

    def inside(b: Band) -> Column:
        return (
            F.col(prefix + "chars_per_token").between(b.least_chars, b.most_chars)
            & (F.col(prefix + "byte_share") <= b.most_bytes)
            & F.col(prefix + "token_entropy").between(b.least_entropy, b.most_entropy)
        )

    verdict = F.when(F.col("latin"), inside(bands["latin"])).otherwise(inside(bands["other"]))
    for name, band in bands.items():
        if name not in ("latin", "other"):
            verdict = F.when(F.col("lang").eqNullSafe(name), inside(band)).otherwise(verdict)
    return verdict


def judged(
    df: DataFrame, path: str, bands: Mapping[str, Band] = BANDS, byte_path: str | None = None, byte_bands: Mapping[str, Band] = BYTE_BANDS, **columns: str
) -> DataFrame:
    """`fertility` with `base_failed` (under 50 words, or over half of them in repeated windows) and
    `kept`: not base_failed, and all measures in their band, under each vocabulary that is given."""
    found = fertility(df, path, byte_path, **columns)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    inside = in_band(bands) & in_band(byte_bands, BYTE_LEVEL) if byte_path else in_band(bands)
    return found.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & inside)


def fitted_bands(found: DataFrame, tail: float = 0.001, accuracy: int = 10_000, prefix: str = "") -> DataFrame:
    """Per language, one vocabulary's quantiles at both tails over all rows of `fertility`: the data to
    set `Band`s from. One aggregation; sketches of size `accuracy` meet, never rows."""
    probs = F.array(F.lit(tail), F.lit(1 - tail))
    names = ("chars_per_token", "byte_share", "token_entropy")
    return found.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), *(F.percentile_approx(prefix + c, probs, accuracy).alias(c) for c in names))
