"""Cross-tokenizer alignment with an identity map as the fast path.

A text is encoded by a byte-level BPE vocabulary (A) and by a SentencePiece model (B). Byte offsets
where tokens of both end cut it into groups, and the tokens of a group are linked to each other.

Both vocabularies split before a space that follows another character, so texts are cut there and
each distinct fragment of a block of texts is encoded and aligned once. `Pair.same` maps each id of A
to the id of B with the same bytes: links of such ids, nearly all of them one-to-one groups, are
counted in vectors as long as A's vocabulary. Only the other links become rows of a shuffle: a row per
block and id pair, with the number of the block's documents that hold it, so a pair found everywhere
has as many rows as there are blocks, not documents. The corpus-wide counts come back to each
block's distinct pairs, give each fragment its sums, and these give each document its own.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blamesplit.llm.bpe import WIDE_SPACE, byte_symbols
from blamesplit.llm.staging import written
from blamesplit.llm.texts import flat, gather, pieces, released

#: The pattern by which byte-level vocabularies split texts before any merge.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SPACE = "▁"
#: Text of a block; a longer text is a block of its own.
BLOCK_BYTES = 2_000_000
#: Links of a group beyond which it is counted by distinct ids.
WIDE_GROUP = 4096


class Vocabulary(NamedTuple):
    """Each id's bytes, one after another, where they begin (with the end), and the ids as text."""

    data: np.ndarray
    places: np.ndarray
    decimals: pa.Array

    @classmethod
    def of(cls, tokens: list[bytes]) -> Vocabulary:
        places = np.append(0, np.cumsum([len(t) for t in tokens]))
        return cls(np.frombuffer(b"".join(tokens), np.uint8), places, pa.array(map(str, range(len(tokens))), pa.large_string()))

    def lengths(self, ids: np.ndarray) -> np.ndarray:
        return self.places[ids + 1] - self.places[ids]

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return self.data[gather(self.places[ids], self.lengths(ids))]


class Links(NamedTuple):
    """What the distinct fragments of a block hold; all arrays but `good` run over tokens or links."""

    good: np.ndarray  # per fragment: both vocabularies give back its bytes
    numbers: np.ndarray  # per fragment: tokens of A, of B, groups, links
    groups: pa.Array  # per fragment: its groups as text
    same_of: np.ndarray  # identity links: fragment, id of A, how often
    same_id: np.ndarray
    same_times: np.ndarray
    other_of: np.ndarray  # other links: fragment, pair code, how often
    other_code: np.ndarray
    other_times: np.ndarray


class Pair:
    """Vocabulary A (a byte-level BPE file of the tokenizers library) and B (a SentencePiece model)."""

    def __init__(self, path_a: str, path_b: str):
        from sentencepiece import SentencePieceProcessor

        self.encode_a, tokens_a = byte_level(path_a)
        self.model_b = SentencePieceProcessor(model_file=path_b)
        b = self.model_b
        names = [b.id_to_piece(i) for i in range(b.get_piece_size())]
        tokens_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(names)]
        self.a, self.b = Vocabulary.of(tokens_a), Vocabulary.of(tokens_b)
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in names):
            raise ValueError("pieces that go on after a space can't be cut there")
        # of ids with the same bytes the written piece, then the least
        plain = [i for i in range(len(names)) if not (b.is_byte(i) or b.is_control(i) or b.is_unknown(i))]
        by_bytes = {tokens_b[i]: i for i in reversed([*plain, *(i for i in range(len(names)) if b.is_byte(i))])}
        self.same = np.array([by_bytes.get(t, -1) for t in tokens_a], np.int64)
        self.size_a, self.size_b = len(tokens_a), len(names)
        self.space_b = b.piece_to_id(SPACE)

    def encode_b(self, fragments: list[str]) -> list[list[int]]:
        """Ids of fragments, each a space and what follows; the model puts the space there itself."""
        found = self.model_b.encode([f[1:] for f in fragments], num_threads=1)
        return [ids if len(f) > 1 else [self.space_b] for f, ids in zip(fragments, found, strict=True)]

    def aligned(self, fragments: list[bytes]) -> Links:
        n = len(fragments)
        said = [f.decode("utf-8", "replace") for f in fragments]
        (a, of_a), (b, of_b) = (_flat_ids(ids) for ids in (self.encode_a(said), self.encode_b(said)))
        sizes = np.fromiter(map(len, fragments), np.int64, n)
        good = np.ones(n, bool)
        for vocab, ids, of in ((self.a, a, of_a), (self.b, b, of_b)):
            good &= np.bincount(of, weights=vocab.lengths(ids), minlength=n) == sizes
        whole = np.frombuffer(b"".join(fragments), np.uint8)
        byte_of = np.repeat(np.arange(n), sizes)
        for vocab, ids, of in ((self.a, a, of_a), (self.b, b, of_b)):
            # only fragments of the right length take part, so the bytes stand one under another
            differ = vocab.joined(ids[good[of]]) != whole[good[byte_of]]
            good[np.unique(byte_of[good[byte_of]][differ])] = False
        a, of_a, b, of_b = a[good[of_a]], of_a[good[of_a]], b[good[of_b]], of_b[good[of_b]]
        ends_a, ends_b = np.cumsum(self.a.lengths(a)), np.cumsum(self.b.lengths(b))
        cut_a, cut_b = _found(ends_a, ends_b), _found(ends_b, ends_a)
        last_a, last_b = np.flatnonzero(cut_a), np.flatnonzero(cut_b)
        first_a, first_b = np.append(0, last_a + 1)[:-1], np.append(0, last_b + 1)[:-1]
        n_a, n_b = last_a + 1 - first_a, last_b + 1 - first_b
        group_of = of_a[last_a]
        numbers = np.stack([np.bincount(group_of, weights=w, minlength=n).astype(np.int64) for w in (n_a, n_b, np.ones(len(n_a)), n_a * n_b)])
        groups = self._told(a, b, first_a, first_b, group_of, n)

        # the fast path: one token each, and the identity map says which
        one = (n_a == 1) & (n_b == 1)
        fast = one.copy()
        fast[one] = self.same[a[first_a[one]]] == b[first_b[one]]
        same = [(group_of[fast], a[first_a[fast]], np.ones(int(fast.sum()), np.int64))]
        other = []
        for of, left, right, times in (self._small(a, b, first_a, first_b, n_a, n_b, group_of, ~fast), self._wide(a, b, first_a, first_b, n_a, n_b, group_of)):
            alike = self.same[left] == right
            same.append((of[alike], left[alike], times[alike]))
            other.append((of[~alike], left[~alike] * self.size_b + right[~alike], times[~alike]))
        return Links(good, numbers, groups, *_summed(same, self.size_a), *_summed(other, self.size_a * self.size_b))

    def _small(self, a, b, first_a, first_b, n_a, n_b, group_of, left_over):
        """All token pairs of the groups of ordinary size: (fragment, id of A, id of B, how often)."""
        at = np.flatnonzero(left_over & (n_a * n_b <= WIDE_GROUP))
        links = n_a[at] * n_b[at]
        within = gather(np.zeros(len(at), np.int64), links)
        width = np.repeat(n_b[at], links)
        left = a[np.repeat(first_a[at], links) + within // np.maximum(width, 1)]
        right = b[np.repeat(first_b[at], links) + within % np.maximum(width, 1)]
        return np.repeat(group_of[at], links), left, right, np.ones(len(left), np.int64)

    def _wide(self, a, b, first_a, first_b, n_a, n_b, group_of):
        """The same of wide groups: long runs hold few distinct ids, so these meet, with their counts."""
        out = [(np.zeros(0, np.int64),) * 4]
        for g in np.flatnonzero(n_a * n_b > WIDE_GROUP).tolist():
            left, times_left = np.unique(a[first_a[g] : first_a[g] + n_a[g]], return_counts=True)
            right, times_right = np.unique(b[first_b[g] : first_b[g] + n_b[g]], return_counts=True)
            pairs = np.repeat(left, len(right)), np.tile(right, len(left)), np.outer(times_left, times_right).reshape(-1)
            out.append((np.full(len(pairs[0]), group_of[g]), *pairs))
        return tuple(map(np.concatenate, zip(*out, strict=True)))

    def _told(self, a, b, first_a, first_b, group_of, n) -> pa.Array:
        """Each fragment's groups as `a1,a2|b1;a3|b2`."""

        def lists(vocab: Vocabulary, ids: np.ndarray, firsts: np.ndarray) -> pa.Array:
            return _joined(vocab.decimals.take(pa.array(ids)), np.append(firsts, len(ids)), ",")

        each = pc.binary_join_element_wise(lists(self.a, a, first_a), lists(self.b, b, first_b), pa.scalar("|", pa.large_string()))
        return _joined(each, np.append(0, np.cumsum(np.bincount(group_of, minlength=n))), ";")


def byte_level(path: str):
    """(encode, tokens) of a vocabulary file: ids of many texts, special strings as plain text, and each id's bytes.

    Where a merge's number is its token's rank, as in files made from rank tables, the ranks decide
    the same merges in less time; otherwise the tokenizers library encodes.
    """
    with open(path, encoding="utf-8") as f:
        described = json.load(f)
    symbols = byte_symbols()
    vocab = {bytes(symbols[c] for c in t): i for t, i in described["model"]["vocab"].items() if all(c in symbols for c in t)}
    special = {t["content"].encode(): t["id"] for t in described["added_tokens"]}
    tokens = [b""] * (max(*vocab.values(), *special.values(), 0) + 1)
    for t, i in [*vocab.items(), *special.items()]:
        tokens[i] = t
    merges = [m if isinstance(m, list) else m.split(" ") for m in described["model"]["merges"]]
    made = [vocab.get(bytes(symbols[c] for c in x + y), -1) for x, y in merges]
    split = described["pre_tokenizer"] or {}
    usual = split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space") and not described["normalizer"]
    if usual and made == sorted(set(made)) and len(made) + 256 == len(vocab.keys() - special.keys()):
        import tiktoken

        ranks = {t: i for t, i in vocab.items() if t not in special}
        encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        return (lambda texts: list(map(encoding.encode_ordinary, texts))), tokens
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(json.dumps(described | {"truncation": None, "padding": None}))
    tokenizer.encode_special_tokens = True
    return (lambda texts: [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]), tokens


def _joined(strings: pa.Array, bounds: np.ndarray, separator: str) -> pa.Array:
    """Runs of strings, from each bound to the next, joined."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), strings), pa.scalar(separator, pa.large_string()))


def _flat_ids(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    counts = np.fromiter(map(len, ids), np.int64, len(ids))
    return np.fromiter(chain.from_iterable(ids), np.int64, int(counts.sum())), np.repeat(np.arange(len(ids)), counts)


def _found(x: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Which of the ascending `x` stand in the ascending `among`."""
    if not len(among):
        return np.zeros(len(x), bool)
    return among[np.minimum(np.searchsorted(among, x), len(among) - 1)] == x


def _summed(parts: list[tuple[np.ndarray, ...]], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal (owner, value) of all parts put together, their counts added, in ascending order."""
    of, value, times = map(np.concatenate, zip(*parts, strict=True))
    order = np.lexsort((value, of))
    of, value, times = of[order], value[order], times[order]
    new = np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | (value[1:] != value[:-1]))[: len(of)])
    return of[new], value[new], np.add.reduceat(times, new) if len(new) else times


@lru_cache(maxsize=1)
def pair(path_a: str, path_b: str) -> Pair:
    return Pair(path_a, path_b)


def fragments(data: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, begins, text of each): all texts with a space put before, cut before each space that
    follows something other than white space. Empty texts have none."""
    n, sizes = len(places) - 1, np.diff(places)
    some = sizes > 0
    at = places[:-1][some]
    whole = np.insert(data, at, 32)
    firsts = at + np.arange(len(at))
    after_space = (whole >= 9) & (whole <= 13) | (whole >= 28) & (whole <= 32)
    cut = (whole == 32) & ~np.append(True, after_space[:-1])
    for m in WIDE_SPACE.finditer(whole.tobytes()):
        if m.end() < len(cut):
            cut[m.end()] = False
    cut[firsts] = True
    begins = np.flatnonzero(cut)
    return whole, begins, np.flatnonzero(some)[np.searchsorted(firsts, begins, "right") - 1] if n else begins


def packed(x: np.ndarray) -> bytes:
    """A compressed array: equal places of its numbers' bytes stand together."""
    x = x.astype(np.uint32 if not len(x) or x.max() < 1 << 32 else np.uint64)
    turned = np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes()
    head = np.array([x.itemsize, len(x)], np.int64).tobytes()
    return head + (pa.compress(turned, "zstd", asbytes=True) if len(x) else b"")


def unpacked(data: bytes) -> np.ndarray:
    size, n = np.frombuffer(data[:16], np.int64).tolist()
    if not n:
        return np.zeros(0, np.int64)
    turned = np.frombuffer(pa.decompress(data[16:], size * n, "zstd", asbytes=True), np.uint8)
    out = np.ascontiguousarray(turned.reshape(size, n).T).reshape(-1)
    return out.view(np.uint32 if size == 4 else np.uint64).astype(np.int64)


BLOCKS = (
    "block long, ids array<long>, numbers array<binary>, digests array<string>, seen array<binary>,"
    " same array<binary>, other array<binary>, codes array<long>, holders array<int>, vector binary"
)


def _block(batch: pa.RecordBatch, tools: Pair) -> dict:
    """One block's documents, its fragments' links, and how many documents hold each link."""
    n = batch.num_rows
    whole, begins, of = fragments(*flat(batch.column(1)))
    bounds = np.append(begins, len(whole)).astype(np.int64)
    found = pa.Array.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(whole))])
    coded = found.dictionary_encode()
    which = coded.indices.to_numpy().astype(np.int64)
    links = tools.aligned(coded.dictionary.to_pylist())
    bad = np.zeros(n, bool)
    bad[of[~links.good[which]]] = True
    which, of = which[~bad[of]], of[~bad[of]]
    numbers = [np.bincount(of, weights=k[which], minlength=n).astype(np.int64) for k in links.numbers]
    counts = np.bincount(of, minlength=n)
    said = _joined(links.groups.take(pa.array(which)), np.append(0, np.cumsum(counts)), ";")
    digests = [hashlib.sha256(s.as_buffer()).hexdigest() if k else "" for s, k in zip(said, counts.tolist(), strict=True)]

    # each document's distinct fragments, and from them the documents that hold each link
    n_fragments = max(len(links.good), 1)
    keys, times = np.unique(of * n_fragments + which, return_counts=True)
    text, fragment = keys // n_fragments, keys % n_fragments
    same_at, other_at = (np.searchsorted(o, np.arange(n_fragments + 1)) for o in (links.same_of, links.other_of))

    def held(at: np.ndarray, value: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        each = np.diff(at)[fragment]
        pairs = np.unique(np.repeat(text, each) * width + value[gather(at[fragment], each)])
        return np.unique(pairs % width, return_counts=True)

    same_ids, same_docs = held(same_at, links.same_id, tools.size_a)
    vector = np.zeros(tools.size_a, np.int64)
    vector[same_ids] = same_docs
    codes, place = np.unique(links.other_code, return_inverse=True)
    places, holders = held(other_at, place, max(len(codes), 1))
    codes = codes[places]
    local = np.zeros(int(places.max()) + 1 if len(places) else 1, np.int64)
    local[places] = np.arange(len(places))
    used = np.isin(links.other_of, fragment)  # links of documents without tokens are left out
    at = np.searchsorted(text, np.arange(n + 1))
    return {
        "ids": batch.column(0).to_pylist(),
        "numbers": [packed(k) for k in numbers],
        "digests": digests,
        "seen": [packed(np.diff(at)), packed(fragment), packed(times)],
        "same": [packed(links.same_of), packed(links.same_id), packed(links.same_times)],
        "other": [packed(links.other_of[used]), packed(local[place[used]]), packed(links.other_times[used])],
        "codes": codes,
        "holders": holders,
        "vector": packed(vector),
    }


def _sums(block: dict, totals: np.ndarray, tools: Pair, same_counts: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n_best, count_sum) of a block's documents; `totals` are the corpus-wide counts of its codes."""
    per_text, fragment, times = map(unpacked, block["seen"])
    same_of, same_id, same_times = map(unpacked, block["same"])
    other_of, local, other_times = map(unpacked, block["other"])
    n_fragments = 1 + max((int(x.max()) for x in (fragment, same_of, other_of) if len(x)), default=0)
    codes = np.asarray(block["codes"], np.int64)
    count_same, count_other = same_counts[same_id], totals[local] if len(local) else local
    best_same = count_same == best[same_id]
    best_other = count_other == best[codes[local] // tools.size_b] if len(local) else np.zeros(0, bool)

    def total(same: np.ndarray, other: np.ndarray) -> np.ndarray:
        """Per fragment, then per document, in whole numbers."""
        out = np.zeros(n_fragments, np.int64)
        np.add.at(out, same_of, same * same_times)
        np.add.at(out, other_of, other * other_times)
        upto = np.append(0, np.cumsum(out[fragment] * times))
        ends = np.cumsum(per_text)
        return upto[ends] - upto[ends - per_text]

    return total(best_same, best_other), total(count_same, count_other)


def aligned(df: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256).

    `path_a` is a byte-level BPE file of the tokenizers library, `path_b` a SentencePiece model; A
    encodes a space and the text, B the text, special strings as plain text. A null or empty text,
    and one that either vocabulary does not give back byte by byte, has no tokens: zeros and ''.
    A null id is a document without a name; repeated rows are documents of their own and count each;
    an empty table gives an empty one. Other columns of `df` are not read.
    """
    blocks = written(coded(df, path_a, path_b, doc_id, text, block_bytes))
    return counted(blocks, path_a, path_b)


def coded(df: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per block of documents, with their alignment and the block's distinct links."""
    narrow = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools, task = pair(path_a, path_b), TaskContext.get().partitionId()
        for k, batch in enumerate(pieces(batches, 1, block_bytes)):
            row = {"block": (task << 32) + k} | _block(batch, tools)
            yield pa.RecordBatch.from_pylist([row], schema=_SCHEMA)
            released()

    return narrow.mapInArrow(run, BLOCKS)


_SCHEMA = pa.schema(
    [
        ("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("numbers", pa.list_(pa.binary())), ("digests", pa.list_(pa.string())),
        ("seen", pa.list_(pa.binary())), ("same", pa.list_(pa.binary())), ("other", pa.list_(pa.binary())),
        ("codes", pa.list_(pa.int64())), ("holders", pa.list_(pa.int32())), ("vector", pa.binary()),
    ]
)


def identity_counts(blocks: DataFrame, size: int) -> np.ndarray:
    """Documents that hold each id of A linked to its like, as one vector: added up in each task,
    then by id, so that what reaches the driver is as long as the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(size, np.int64)
        for batch in batches:
            for v in batch.column(0).to_pylist():
                sums += unpacked(v)
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(sums[some])], ["a", "n"])

    found = blocks.select("vector").mapInArrow(run, "a long, n long").groupBy("a").agg(F.sum("n").alias("n"))
    return _vector(found, size)


def _vector(df: DataFrame, size: int) -> np.ndarray:
    """A vector from rows (id, number), at most one for each id of a vocabulary."""
    rows = df.collect()
    out = np.zeros(size, np.int64)
    out[[r[0] for r in rows]] = [r[1] for r in rows]
    return out


def counted(blocks: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """The result of `aligned` from a written table of `coded` blocks."""
    tools = pair(path_a, path_b)
    each = blocks.select("block", F.explode(F.arrays_zip("codes", "holders")).alias("e")).select("block", "e.codes", "e.holders")
    pairs = written(each.groupBy("codes").agg(F.sum("holders").alias("total")))
    same_counts = identity_counts(blocks, tools.size_a)
    highest = pairs.groupBy(F.expr(f"codes div {tools.size_b}").alias("a")).agg(F.max("total"))
    best = np.maximum(same_counts, _vector(highest, tools.size_a))
    back = each.select(F.col("block").alias("of"), "codes").join(pairs, "codes")

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        block = right.to_pylist()[0]
        order = np.argsort(left["codes"].to_numpy())
        n_best, count_sum = _sums(block, left["total"].to_numpy()[order], pair(path_a, path_b), same_counts, best)
        numbers = list(map(unpacked, block["numbers"]))
        return pa.table(
            {
                "doc_id": pa.array(block["ids"], pa.int64()), "n_a": numbers[0], "n_b": numbers[1], "n_groups": numbers[2], "n_links": numbers[3],
                "n_best": n_best, "count_sum": count_sum, "groups_sha256": pa.array(block["digests"], pa.string()),
            }
        )

    whole = blocks.drop("holders", "vector").groupBy("block")
    out = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return back.groupBy("of").cogroup(whole).applyInArrow(run, out)
