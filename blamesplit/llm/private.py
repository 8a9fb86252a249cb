"""Personal data: pattern matches, and a skip-chain conditional random field that completes them.

Patterns miss what stands in unlucky company: two numbers side by side read as one that is too long,
or a number that is repeated in another notation. The field has one variable for each token with a
digit or an `@`, with the labels none, email, ip, card and phone. Its factors:

* each token's shape (runs of letters and digits, Luhn and range checks);
* chain links between tokens that follow each other with nothing but white space between;
* skip links from a token to the one before it, anywhere in the document, that is equal, has the same
  digits in another notation, or is as long and differs in few places. Each token has one such link
  for each kind of likeness, so links grow with the document, not with the square of a group.

Tokens of pattern matches are observed. Loopy belief propagation carries labels along the links, so
that like tokens come to agree; all documents of a piece of the input run as one graph.

Weights are trained piecewise on the corpus itself, with the pattern matches as labels: one pass
counts shapes with labels and label pairs along links, and the factors are smoothed log ratios.
Spark adds up these counts over all documents.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blamesplit.llm.staging import written
from blamesplit.llm.texts import pieces

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
NONE = 0
ROUNDS = 12
DAMPING = 0.5
SMOOTHING = 0.5
#: Shapes with a label that every task holds, the most frequent ones; texts with others get theirs by a join.
MOST_SHAPES = 10_000
#: Bounds of the log factor of agreement along skip links; few likenesses in the corpus leave the lower one.
AGREEMENT = (6.5, 8.0)
#: Belief that an added span needs.
BELIEF = 0.6

# The patterns of the task, written so that every search is linear.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
WORD = re.compile(r"\S+")
DATA = re.compile(r"[0-9@]")
NOT_DIGIT = re.compile(r"[^0-9]")
RUNS = re.compile(r"[0-9]+|[^\W\d_]+|.", re.S)

Span = tuple[int, int, int]  # kind as in LABELS, start, end


def luhn(digits: str) -> bool:
    even, odd = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, even)) + sum(sum(divmod(2 * int(c), 10)) for c in odd)) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local part, @ and dotted domain, found from each @ outwards."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            free = m.end()
            at = text.find("@", free)
        else:
            at = text.find("@", at + 1)


def base_spans(text: str) -> list[Span]:
    """The pattern matches, by kind and then by place."""
    found = [(1, a, b) for a, b in emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split(".")):
            found.append((2, m.start(), m.end()))
    for m in CARD.finditer(text):
        digits = NOT_DIGIT.sub("", m.group()) if m.end() - m.start() < 40 else ""
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append((3, m.start(), m.end()))
    for m in PHONE.finditer(text):
        if 9 <= len(NOT_DIGIT.sub("", m.group())) <= 15:
            found.append((4, m.start(), m.end()))
    return found


def shape(token: str) -> str:
    """What a token looks like: runs of digits by length, runs of letters as one `a`, and checks."""
    if len(token) > 64:
        return "long"
    if "@" in token:
        m = DOMAIN.fullmatch(token, token.rindex("@") + 1)
        return f"@{token.count('@') == 1 and m is not None and all(c in LOCAL for c in token[: token.index('@')])}"
    runs = RUNS.findall(token)
    if len(runs) > 11:
        return "mixed"
    digits = NOT_DIGIT.sub("", token)
    checks = ""
    if 13 <= len(digits) <= 19:
        checks = f" luhn {luhn(digits)}"
    elif token.count(".") == 3:
        checks = f" parts {all(p.isdigit() and len(p) < 4 and int(p) < 256 for p in token.split('.'))}"
    dotted = token.count(".") == 3
    return "".join(("9" if dotted else f"9{len(r)}") if r[0].isdigit() else "a" if r[0].isalpha() else r for r in runs) + checks


@dataclass
class Graph:
    """Tokens of many documents and the links between them."""

    text_of: list[int]
    starts: list[int]
    ends: list[int]
    shapes: list[str]
    seen: list[int]  # label of the pattern match that covers the token, or NONE
    links: list[tuple[int, int]]
    is_skip: list[bool]


def graph_of(texts: list[str], spans: list[list[Span]]) -> Graph:
    g = Graph([], [], [], [], [], [], [])
    for k, (text, found) in enumerate(zip(texts, spans, strict=True)):
        by_start = sorted(found, key=lambda s: s[1])
        at, last_end, last = 0, -2, -1
        before: dict[tuple, tuple[int, str]] = {}
        for m in filter(lambda w: DATA.search(w.group()), WORD.finditer(text)):
            word = m.group()
            core = word.strip(".,;:!?\"'<>[]{}=")
            if not core:
                continue
            start = m.start() + word.index(core)
            end, here = start + len(core), len(g.starts)
            while at < len(by_start) and by_start[at][2] <= start:
                at += 1
            label = by_start[at][0] if at < len(by_start) and by_start[at][1] < end else NONE
            g.text_of.append(k)
            g.starts.append(start)
            g.ends.append(end)
            g.shapes.append(shape(core))
            g.seen.append(label)
            if last >= 0 and text[last_end : m.start()].isspace():
                g.links.append((last, here))
                g.is_skip.append(False)
            last, last_end = here, m.end()
            for key in likenesses(core):
                other = before.get(key)
                if other is not None and (key[0] != "half" or alike(other[1], core)):
                    g.links.append((other[0], here))
                    g.is_skip.append(True)
                before[key] = (here, core)
    return g


def likenesses(token: str) -> list[tuple]:
    """Keys under which a token meets the one before it that is like it. Short tokens have none."""
    if not 6 <= len(token) <= 64:
        return []
    keys: list[tuple] = [("same", token.lower())]
    digits = NOT_DIGIT.sub("", token)
    if len(digits) >= 7:
        keys.append(("digits", digits[-7:]))  # a number with and without its prefixes
    if len(token) >= 10:
        half = len(token) // 2
        keys += [("half", 0, len(token), token[:half]), ("half", 1, len(token), token[half:])]
    return keys


def alike(a: str, b: str) -> bool:
    return sum(x != y for x, y in zip(a, b, strict=True)) <= 2


def counted(g: Graph) -> Counter:
    """Of a graph: ("shape", shape, label, ""), ("chain" or "skip", label, label, "")."""
    out: Counter = Counter(("shape", s, LABELS[y]) for s, y in zip(g.shapes, g.seen, strict=True))
    for (i, j), skip in zip(g.links, g.is_skip, strict=True):
        out["skip" if skip else "chain", LABELS[g.seen[i]], LABELS[g.seen[j]]] += 1
    return out


@dataclass(frozen=True)
class Field:
    """Log factors: of shapes (others have `unseen`), and of pairs along chain and skip links.

    `rest` holds the shapes that are too many for a dictionary, if there are any: (shape, counts by
    label). Their factors come from the label shares `base`.
    """

    shapes: dict[str, np.ndarray]
    unseen: np.ndarray
    chain: np.ndarray
    skip: np.ndarray
    base: np.ndarray | None = None
    rest: DataFrame | None = None

    def beliefs(self, g: Graph, rare: Mapping[str, np.ndarray] | None = None) -> np.ndarray:
        """Each token's label probabilities after loopy belief propagation; `rare` are shapes of `rest`."""
        n = len(g.shapes)
        known = {**self.shapes, **rare} if rare else self.shapes
        own = np.array([known.get(s, self.unseen) for s in g.shapes]).reshape(n, len(LABELS))
        seen = np.array(g.seen, np.int64)
        held = np.flatnonzero(seen != NONE)
        own[held] = -30.0
        own[held, seen[held]] = 0.0
        if g.links:
            links, skip = np.array(g.links), np.array(g.is_skip)
            source, target = np.append(links[:, 0], links[:, 1]), np.append(links[:, 1], links[:, 0])
            back = np.append(np.arange(len(links)) + len(links), np.arange(len(links)))
            factor = np.where(skip[:, None, None], self.skip, self.chain)
            factor = np.concatenate([factor, factor.transpose(0, 2, 1)])
            said = np.zeros((len(source), len(LABELS)))
            for _ in range(ROUNDS):
                total = own.copy()
                np.add.at(total, target, said)
                out = total[source] - said[back]
                new = np.logaddexp.reduce(out[:, :, None] + factor, axis=1)
                new -= new.max(1, keepdims=True)
                said = DAMPING * said + (1 - DAMPING) * new
            np.add.at(own, target, said)
        own -= own.max(1, keepdims=True)
        p = np.exp(own)
        return p / p.sum(1, keepdims=True)


def shape_factor(counts: np.ndarray, base: np.ndarray) -> np.ndarray:
    return np.maximum(np.log((counts + SMOOTHING * base) / (counts.sum() + SMOOTHING)), -8.0)


def fitted(counts: Counter | dict, others: np.ndarray | float = 0.0) -> Field:
    """Factors from counts: log P(label | shape), and log P(a, b) / (P(a) P(b)) along links. `others`
    are the label counts of shapes that are not among `counts`.

    Along skip links only agreement counts, alike for all kinds of data; a link never argues for
    `none`, as a token can be data although a like one was missed.
    """
    k = len(LABELS)
    prior = np.full(k, SMOOTHING) + others
    shapes: dict[str, np.ndarray] = {}
    pairs = {"chain": np.full((k, k), SMOOTHING), "skip": np.full((k, k), SMOOTHING)}
    for (what, a, b), n in counts.items():
        if what == "shape":
            shapes.setdefault(a, np.zeros(k))[LABELS.index(b)] += n
            prior[LABELS.index(b)] += n
        else:
            pairs[what][LABELS.index(a), LABELS.index(b)] += n
    base = prior / prior.sum()
    unseen = np.log(np.append(0.98, np.full(k - 1, 0.02 / (k - 1))))
    logs = {s: shape_factor(c, base) for s, c in shapes.items()}
    c = pairs["chain"]
    chain = np.log(c / c.sum()) - np.log(c.sum(1) / c.sum())[:, None] - np.log(c.sum(0) / c.sum())[None, :]
    chain = np.clip(chain, -2.0, 2.0)
    s = pairs["skip"][1:, 1:]
    agree = np.clip(np.log(np.trace(s) / (k - 1)) - np.log((s.sum() - np.trace(s)) / ((k - 1) * (k - 2))), *AGREEMENT)
    skip = np.zeros((k, k))
    skip[1:, 1:] = np.where(np.eye(k - 1, dtype=bool), agree, -agree)
    return Field(logs, unseen, chain, skip, base)


def added(texts: list[str], g: Graph, beliefs: np.ndarray, spans: list[list[Span]]) -> list[list[Span]]:
    """Spans that the field adds to each text: believed runs of tokens of one label that hold enough
    digits for it and overlap no pattern match."""
    out: list[list[Span]] = [[] for _ in texts]
    label = beliefs.argmax(1)
    sure = beliefs.max(1) >= BELIEF
    chained = {b for (a, b), skip in zip(g.links, g.is_skip, strict=True) if not skip}
    n, i = len(label), 0
    while i < n:
        j = i + 1
        y = int(label[i])
        if y in (NONE,) or not sure[i] or g.seen[i] != NONE:
            i = j
            continue
        if y == 4 or (y == 3 and len(NOT_DIGIT.sub("", texts[g.text_of[i]][g.starts[i] : g.ends[i]])) < 13):
            while j < n and j in chained and label[j] == y and sure[j] and g.seen[j] == NONE:
                j += 1
        k, start, end = g.text_of[i], g.starts[i], g.ends[j - 1]
        if valid(y, texts[k][start:end]) and not any(a < end and start < b for _, a, b in spans[k]):
            out[k].append((y, start, end))
        i = j
    return out


def valid(label: int, said: str) -> bool:
    digits = len(NOT_DIGIT.sub("", said))
    if label == 1:
        return "@" in said
    if label == 2:
        return said.count(".") == 3
    return 13 <= digits <= 19 if label == 3 else 7 <= digits <= 15


def _narrow(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Texts without a digit or @ hold nothing to find and stay behind."""
    said = F.col(text).cast("string")
    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.when(said.rlike("[0-9@]"), said).alias("text"))


def trained(df: DataFrame, doc_id: str = "doc_id", text: str = "text", most_shapes: int = MOST_SHAPES) -> Field:
    """The field fitted to all documents of `df`. Only counts reach the driver: of label pairs, and
    of the `most_shapes` most frequent shapes that a pattern match has. Further shapes stay a table,
    `Field.rest`, and count alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 0):
            texts = [t or "" for t in batch.column(0).to_pylist()]
            out = counted(graph_of(texts, [base_spans(t) for t in texts]))
            rows = [(*key, n) for key, n in out.items()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*rows, strict=True)] if rows else [pa.array([], t) for t in (pa.string(),) * 3 + (pa.int64(),)], ["what", "a", "b", "n"])

    some = _narrow(df, doc_id, text).where("text is not null").select("text")
    counts = some.mapInArrow(run, "what string, a string, b string, n long").groupBy("what", "a", "b").agg(F.sum("n").alias("n"))
    wide = counts.groupBy("what", "a").agg(F.map_from_entries(F.collect_list(F.struct("b", "n"))).alias("by"), F.sum(F.when(F.col("b") != "none", F.col("n")).otherwise(0)).alias("data"))
    wide = written(wide.where("what != 'shape' or data > 0"))
    links = wide.where("what != 'shape'").collect()
    shapes = wide.where("what = 'shape'")
    top = shapes.orderBy(F.col("data").desc(), "a").limit(most_shapes + 1).collect()
    found = {(r.what, r.a, b): n for r in links + top[:most_shapes] for b, n in r.by.items()}
    if len(top) <= most_shapes:
        return fitted(found)
    # in the order of `top`, the rest begins with its last row
    behind = (F.col("data") < top[-1].data) | ((F.col("data") == top[-1].data) & (F.col("a") >= top[-1].a))
    by_label = F.array(*[F.coalesce(F.col("by")[y], F.lit(0)).cast("double") for y in LABELS])
    rest = shapes.where(behind).select(F.col("a").alias("shape"), by_label.alias("counts"))
    others = rest.agg(*[F.sum(F.col("counts")[k]) for k in range(len(LABELS))]).first()
    return replace(fitted(found, np.array(others)), rest=rest)


RARE = "array<struct<shape:string,counts:array<double>>>"


def _with_rare(df: DataFrame, said: Column, field: Field, key: str, rare: str) -> DataFrame:
    """`df` with the column `rare`: the shapes of `field.rest` in the text `said`, null if there are none.

    Texts are matched by digest. A text's shapes are at most its tokens, so no group is large.
    """
    if field.rest is None:
        return df.withColumn(rare, F.lit(None).cast(RARE))
    held = frozenset(field.shapes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):
            texts = batch.column(1).to_pylist()
            g = graph_of(texts, [[]] * len(texts))
            pairs = sorted({(k, s) for k, s in zip(g.text_of, g.shapes, strict=True) if s not in held})
            keys = batch.column(0).take(pa.array([k for k, _ in pairs], pa.int64()))
            yield pa.RecordBatch.from_arrays([keys, pa.array([s for _, s in pairs], pa.string())], [key, "shape"])

    digest = F.sha2(said, 256)
    texts = df.where(said.rlike("[0-9@]")).select(digest.alias(key), said.alias("text"))
    shapes = texts.mapInArrow(run, f"{key} string, shape string").distinct().join(field.rest, "shape")
    found = shapes.groupBy(key).agg(F.collect_list(F.struct("shape", "counts")).cast(RARE).alias(rare))
    return df.withColumn(key, digest).join(found, key, "left").drop(key)


def _factors(rare: pa.Array, base: np.ndarray | None) -> dict[str, np.ndarray]:
    """The factors of the shapes that `_with_rare` found in some texts."""
    return {x["shape"]: shape_factor(np.array(x["counts"]), base) for some in rare.drop_null().to_pylist() for x in some}


def find_private(df: DataFrame, field: Field, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, spans): array of (kind, start, end, base) in code points, by kind and start.

    `base` marks pattern matches; the others were added by the field. A text that is null, empty or
    without digit and @ has no spans; repeated rows get the same spans each; an empty table gives an
    empty one. Other columns of `df` are not read.
    """
    schema = "doc_id long, spans array<struct<kind:string,start:long,end:long,base:boolean>>"
    rows = _with_rare(_narrow(df, doc_id, text), F.col("text"), field, "key", "rare")
    field = replace(field, rest=None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):
            said = batch.column(1).to_pylist()
            which = [i for i, t in enumerate(said) if t]
            texts = [said[i] for i in which]
            spans = [base_spans(t) for t in texts]
            g = graph_of(texts, spans)
            more = added(texts, g, field.beliefs(g, _factors(batch.column(2), field.base)), spans)
            out: list[list[dict]] = [[] for _ in said]
            for i, a, b in zip(which, spans, more, strict=True):
                every = sorted([(*s, True) for s in a] + [(*s, False) for s in b])
                out[i] = [{"kind": LABELS[y], "start": p, "end": q, "base": base} for y, p, q, base in every]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], ["doc_id", "spans"])

    return rows.mapInArrow(run, schema)


def redacted(df: DataFrame, field: Field, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`df` with each found span of `text` replaced by `<KIND>`; all columns stay as they are.

    Where spans overlap, the one that starts first counts, and the longer one of two. A null or
    empty text stays as it is; repeated rows stay; an empty table stays empty; other columns may have
    any name and are not looked at.
    """
    names = df.columns
    place = names.index(text)
    said = F.col(text).cast("string")
    look, key, rare = (c + "_" * max(map(len, names)) for c in ("look", "key", "rare"))  # longer than any name of the rows
    marked = df.withColumn(look, F.coalesce(said.rlike("[0-9@]"), F.lit(False)))
    marked = _with_rare(marked, said, field, key, rare)  # the columns of `df`, then these two
    field = replace(field, rest=None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, place):
            whole = batch.column(place).to_pylist()
            which = [i for i, look in enumerate(batch.column(len(names)).to_pylist()) if look]
            texts = [whole[i] for i in which]
            spans = [base_spans(t) for t in texts]
            g = graph_of(texts, spans)
            more = added(texts, g, field.beliefs(g, _factors(batch.column(len(names) + 1), field.base)), spans)
            for i, a, b in zip(which, spans, more, strict=True):
                whole[i] = replaced(whole[i], a + b)
            columns = [pa.array(whole, pa.string()) if k == place else batch.column(k) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, names)

    return marked.mapInArrow(run, df.withColumn(text, said).schema)


def replaced(text: str, spans: list[Span]) -> str:
    out, at = [], 0
    for y, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{LABELS[y].upper()}>"]
            at = b
    return "".join([*out, text[at:]])
