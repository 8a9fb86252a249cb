"""Byte-level BPE by forced-boundary splitting, and its inverse.

A token of the vocabulary is a byte string. A pair of bytes that stands next to each other in no
token can never be merged over, so a text may be cut between two such bytes, the fragments encoded
on their own, and their ids put one after another. Of these certain cuts, those are left out where
the pre-tokeniser looks across: after white space (it looks ahead in runs of it) and beside an
apostrophe (contractions). The strings of special tokens are never cut. Fragments repeat, so each
distinct one in a piece of the input is encoded once.

Decoding looks up each id's bytes.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blamesplit.llm.texts import flat, pieces

#: Distinct fragments that a task remembers.
REMEMBERED = 150_000
ASCII_SPACE = b"\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f "
#: White space beyond ASCII, in UTF-8.
WIDE_SPACE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies.

    Printable Latin-1 characters stand for themselves, the others follow from code point 256 on.
    """
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Codec:
    """A byte-level BPE vocabulary file of the tokenizers library, applied by certain cuts."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            described = json.load(f)
        self.tokenizer = Tokenizer.from_str(json.dumps(described | {"truncation": None, "padding": None}))
        symbols = byte_symbols()
        added = {t["id"]: t["content"].encode() for t in described["added_tokens"]}
        tokens = {i: bytes(symbols[c] for c in t) for t, i in described["model"]["vocab"].items()}
        self.special = re.compile(b"|".join(re.escape(t) for t in sorted(added.values(), key=len, reverse=True)) or b"(?!)")
        tokens |= added
        self.bytes_of = [tokens.get(i, b"") for i in range(max(tokens) + 1)]
        self.cut_after = self._certain_cuts()
        self.known: dict[bytes, tuple[int, ...]] = {}

    def _certain_cuts(self) -> np.ndarray:
        """For each pair of bytes (first * 256 + second), whether a text is cut between them."""
        cut = np.ones((256, 256), bool)
        for token in self.bytes_of:
            if len(token) > 1:
                t = np.frombuffer(token, np.uint8)
                cut[t[:-1], t[1:]] = False
        cut[:, 0x80:0xC0] = False  # inside a character
        cut[list(ASCII_SPACE)] = False
        cut[ord("'")] = False
        letters = [b for b in range(128) if chr(b).isalnum()]
        before_apostrophe = cut[letters, ord("'")]
        cut[:, ord("'")] = False
        cut[letters, ord("'")] = before_apostrophe
        for a, b in ("re", "ve", "ll"):
            cut[ord(a), ord(b)] = False
        return cut.reshape(-1)

    def cuts(self, data: np.ndarray) -> np.ndarray:
        """Where fragments begin, besides 0, in a text of UTF-8 bytes."""
        if len(data) < 2:
            return np.zeros(0, np.int64)
        here = self.cut_after[data[:-1].astype(np.uint16) << 8 | data[1:]]
        whole = data.tobytes()
        for m in WIDE_SPACE.finditer(whole):
            here[m.end() - 1 : m.end()] = False
        for m in self.special.finditer(whole):
            here[max(0, m.start() - 1) : m.end() - 1] = False
            if m.start():
                here[m.start() - 1] = True
            here[m.end() - 1 : m.end()] = True
        return np.flatnonzero(here) + 1

    def encode(self, data: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of many texts in a row, and where each text's ids begin, with the end.

        `data` holds the texts' bytes, `places` where each begins, with the end.
        """
        begins = self._begins(data, places)
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(places), np.int64)
        bounds = np.append(begins, len(data)).astype(np.int32)
        fragments = pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))])
        coded = fragments.dictionary_encode()
        which, distinct = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        ids = self._look_up(distinct)
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        flat_ids = np.fromiter(chain.from_iterable(ids), np.int32, int(counts.sum()))
        firsts = np.cumsum(counts) - counts
        each = counts[which]
        upto = np.cumsum(each)
        take = np.repeat(firsts[which] - (upto - each), each) + np.arange(int(upto[-1]))
        starts = np.append(0, upto)[np.searchsorted(begins, places)]
        starts[places == len(data)] = upto[-1]
        return flat_ids[take], starts

    def _begins(self, data: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Begins of fragments; texts are cut off from each other first, as they stand alone."""
        firsts = np.unique(places[:-1][places[:-1] < len(data)])
        cuts = self.cuts(data)
        return np.union1d(firsts, cuts)

    def _look_up(self, fragments: list[bytes]) -> list[tuple[int, ...]]:
        known = self.known
        new = [f for f in fragments if f not in known]
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            new = fragments
        for at in range(0, len(new), 20_000):
            some = new[at : at + 20_000]
            coded = self.tokenizer.encode_batch([f.decode() for f in some], add_special_tokens=False)
            known.update((f, tuple(e.ids)) for f, e in zip(some, coded, strict=True))
        return [known[f] for f in fragments]

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that are not UTF-8 become U+FFFD. Ids outside the vocabulary are an error."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode(df: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids): the BPE ids of each whole text under the vocabulary file at `path`.

    A null or empty text has no ids. Rows stay as they are, repeated or without id; an empty table
    gives an empty one. Other columns of `df` are not read.
    """
    return _apply(df, path, doc_id, text, decoded=False)


def encode_and_decode(df: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids, decoded): as `encode`, with the text that the ids decode to."""
    return _apply(df, path, doc_id, text, decoded=True)


def _apply(df: DataFrame, path: str, doc_id: str, text: str, decoded: bool) -> DataFrame:
    narrow = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path)
        for batch in pieces(batches, 1):
            ids, starts = coder.encode(*flat(batch.column(1)))
            out = {"doc_id": batch.column(0), "ids": pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(ids))}
            if decoded:
                every = ids.tolist()
                out["decoded"] = pa.array(map(coder.decode, map(every.__getitem__, map(slice, starts[:-1].tolist(), starts[1:].tolist(), repeat(None)))), pa.string())
            yield pa.RecordBatch.from_pydict(out)

    return narrow.mapInArrow(run, "doc_id long, ids array<int>" + ", decoded string" * decoded)
