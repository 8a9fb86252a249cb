"""Helpers for Arrow functions over texts."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1_000_000


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in a row, and each text's first byte with the end; nulls are empty."""
    column = column.fill_null("").cast(pa.large_string())
    places = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[places[0] : places[-1]], places - places[0]


def pieces(batches: Iterator[pa.RecordBatch], column: int, size: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `size` bytes of text (one row at least), to bound memory."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, places = flat(batch.column(column))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(places, places[at] + size, "right")) - 1)
            end = min(end, batch.num_rows)
            yield batch.slice(at, end - at)
            at = end
    released()


def released() -> None:
    """Hands freed memory back to the system: workers outlive their tasks, and several share a machine."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def words(data: np.ndarray, places: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words `[^\\x20\\x09-\\x0D]+` of all texts, the text each belongs to, and each word's first byte."""
    inside = ~(((data >= 9) & (data <= 13)) | (data == 32))
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = places[:-1][places[:-1] < len(data)]
    first[edges] = inside[edges]
    starts = np.flatnonzero(first)
    kept = data[inside]
    bounds = np.append(np.cumsum(inside)[starts] - 1, len(kept)) if len(starts) else np.zeros(1, np.int64)
    found = pa.Array.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(kept))]
    )
    return found, np.searchsorted(places, starts, "right") - 1, starts


def per_text(flags: np.ndarray, places: np.ndarray) -> np.ndarray:
    """How many flagged bytes each text has."""
    upto = np.append(0, np.cumsum(flags, dtype=np.int64))
    return upto[places[1:]] - upto[places[:-1]]


def gather(firsts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices of runs that begin at `firsts` and are `counts` long, one run after another."""
    upto = np.cumsum(counts)
    return np.repeat(firsts - (upto - counts), counts) + np.arange(int(upto[-1]) if len(upto) else 0)
