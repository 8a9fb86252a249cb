"""Toxicity by a learned lexicon, matched with spelling errors, and the context of each match.

* **Lexicon**: words that labelled toxic documents have far more often than others, by a likelihood
  ratio test that allows for the number of words tested. Counted by Spark over labelled documents.
* **Matching**: the lexicon is a trie, and its product with the terms' Levenshtein automata is made
  deterministic lazily: a state is a set of (trie node, edits spent), and each step that any word
  takes is remembered. Words far from every term die after a few letters, and each distinct word is
  matched once per task. Terms of four and five letters may be misspelled by one edit after the
  first letter, and all longer than three by a swap of neighbours, unless other documents use the
  variant as a word of its own.
* **Context**: a match inside quotation marks within a window of words counts as quoted, not as
  abuse; matches that stand close together strengthen each other.
* **Score**: a logistic regression over these counts, fitted to labelled documents.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blamesplit.llm.staging import written
from blamesplit.llm.texts import flat, gather, pieces, words

#: Labelled documents that a model is fitted to, about; chosen by a hash of their id.
LABELLED = 20_000
#: Terms that a lexicon holds at most, the most telling ones.
MOST_TERMS = 5_000
#: Share of a term's labelled documents that are toxic.
LEAST_SHARE = 0.7
#: Letters of a stem, and the share of its labelled documents that are toxic.
STEMS, STEM_SHARE = (4, 5, 6, 7, 8), 0.95
#: Letters from which a term may be misspelled by one edit, and by two.
ONE_EDIT, TWO_EDITS = 6, 10
#: Letters from which a term may be misspelled by one edit after its first letter, and any longer
#: one by a swap of neighbours; labelled documents, not toxic, that make a variant a word of its own.
SHORT_EDIT, OWN_WORD = 4, 2
WINDOW = 8
#: Characters of a word or term; longer runs without white space are parted into words.
LONGEST_WORD = 64
REMEMBERED = 300_000
STATES = 100_000
QUOTES = "\"'“”„«»‹›‘’`"
OPENS = "“„«‹‘"
CLOSES = "”»›’"
LOOKALIKE = str.maketrans("013457@$", "oieastas")
PART = re.compile(r"[^\W_]+")
#: A word of a long run: quotation marks that open, letters, what follows up to the next word.
IN_RUN = re.compile(rf"(?:[{OPENS}]{{1,4}}|(?<![^\W_])[\"'`’]{{1,4}})?(?:[^\W_]|[@$])+(?:['’][^\W_]+)*(?:[^\w{OPENS}@$\"'`’]|_|[\"'`’](?![^\W_])|(?<=[^\W_])[\"`])*")
SPACES = [c.encode() for c in "\u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"]
FEATURES = ("abuse", "misspelled", "quoted", "cluster", "density")


def allowed(term: str) -> int:
    return 0 if len(term) < ONE_EDIT else 1 if len(term) < TWO_EDITS else 2


def cuts(word: str) -> list[str]:
    """The word with each letter after the first left out."""
    return [word[:k] + word[k + 1 :] for k in range(1, len(word))]


def blanks(word: str) -> list[str]:
    """The word with each letter after the first replaced by a blank."""
    return [f"{word[:k]} {word[k + 1 :]}" for k in range(1, len(word))]


def swaps(word: str) -> list[str]:
    """The word with each two neighbours after the first letter swapped."""
    return [word[:k] + word[k + 1] + word[k] + word[k + 2 :] for k in range(1, len(word) - 1)]


class Variants:
    """Whether a word is one edit, its first letter kept, from a term too short for the automata, or
    one swap of neighbours from any term."""

    def __init__(self, terms: Sequence[str]):
        self.exact = {t for t in terms if not t.endswith("*")}
        short = {t for t in self.exact if SHORT_EDIT <= len(t) < ONE_EDIT}
        self.short = short
        self.swapped = {w for t in self.exact if len(t) >= SHORT_EDIT for w in swaps(t)}
        self.less = {w for t in short for w in cuts(t)}
        self.blank = {w for t in short for w in blanks(t)}

    def __contains__(self, word: str) -> bool:
        if len(word) < SHORT_EDIT - 1 or word in self.exact:
            return False
        if word in self.swapped or word in self.less:
            return True
        if not SHORT_EDIT <= len(word) <= ONE_EDIT:
            return False
        return any(w in self.blank for w in blanks(word)) or any(w in self.short for w in cuts(word))


class Matcher:
    """Finds the lexicon term nearest to a word within the term's allowed edits."""

    def __init__(self, terms: Sequence[str]):
        self.terms = [t for t in terms if not t.endswith("*")]
        self.stems = {t[:-1] for t in terms if t.endswith("*")}
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[int] = [-1]
        self.budget: list[int] = [0]
        for k, term in enumerate(self.terms):
            node, most = 0, allowed(term)
            self.budget[0] = max(self.budget[0], most)
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append(-1)
                    self.budget.append(0)
                node = self.children[node][c]
                self.budget[node] = max(self.budget[node], most)
            self.ends[node] = k
        self._forget()

    def _forget(self) -> None:
        self.number: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.steps: list[dict[str, int]] = []
        self.hits: list[tuple[int, int] | None] = []
        self.start = self._state({0: 0})

    def _state(self, spent: dict[int, int]) -> int:
        """The number of the state with these nodes, each at its least edits, and all nodes that
        leaving out letters of a term reaches from them. -1: nothing can match."""
        todo = list(spent)
        while todo:
            node = todo.pop()
            for child in self.children[node].values():
                e = spent[node] + 1
                if e <= self.budget[child] and e < spent.get(child, 99):
                    spent[child] = e
                    todo.append(child)
        if not spent:
            return -1
        key = frozenset(spent.items())
        if key not in self.number:
            self.number[key] = len(self.sets)
            self.sets.append(key)
            self.steps.append({})
            found = [(e, self.ends[n]) for n, e in spent.items() if self.ends[n] >= 0 and e <= allowed(self.terms[self.ends[n]])]
            self.hits.append(min(found) if found else None)
        return self.number[key]

    def _step(self, state: int, letter: str) -> int:
        spent: dict[int, int] = {}

        def reach(node: int, e: int) -> None:
            if e <= self.budget[node] and e < spent.get(node, 99):
                spent[node] = e

        for node, e in self.sets[state]:
            reach(node, e + 1)
            for c, child in self.children[node].items():
                reach(child, e + (c != letter))
        return self._state(spent)

    def goes_on(self, word: str) -> bool:
        """Whether a stem of the lexicon begins the word and more letters follow."""
        return any(word[:k] in self.stems for k in STEMS if len(word) > k)

    def find(self, word: str) -> tuple[int, int] | None:
        """(edits, term number) of the nearest term, ties to the smaller number; None without one."""
        if len(self.sets) > STATES:
            self._forget()
        state = self.start
        for c in word:
            after = self.steps[state].get(c)
            if after is None:
                after = self.steps[state][c] = self._step(state, c)
            if after < 0:
                return None
            state = after
        return self.hits[state]


def spaced(data: np.ndarray) -> np.ndarray:
    """UTF-8 bytes with ASCII spaces for the white space beyond ASCII, at the same places."""
    if not len(data) or data.max() < 0xC2:
        return data
    out = data.copy()
    for said in SPACES:
        at = np.flatnonzero(data[: len(data) - len(said) + 1] == said[0])
        for k in range(1, len(said)):
            at = at[data[at + k] == said[k]]
        for k in range(len(said)):
            out[at + k] = 32
    return out


def parted(found: pa.Array, text_of: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The words and their texts, with runs of more than `LONGEST_WORD` characters parted."""
    bounds = np.frombuffer(found.buffers()[1], np.int64)[: len(found) + 1] if len(found) else np.zeros(1, np.int64)
    counts, more = np.ones(len(found), np.int64), []
    first = np.arange(len(found))
    for i in np.flatnonzero(np.diff(bounds) > LONGEST_WORD).tolist():
        run = found[i].as_py().decode()
        parts = IN_RUN.findall(run) if len(run) > LONGEST_WORD else []
        if len(parts) > 1:
            first[i], counts[i] = len(found) + len(more), len(parts)
            more += [x.encode() for x in parts]
    if not more:
        return found, text_of
    return pa.concat_arrays([found, pa.array(more, pa.large_binary())]).take(pa.array(gather(first, counts))), np.repeat(text_of, counts)


@dataclass
class Lexicon:
    """Terms and, per task, what is known of distinct words: 0 none, 1 a term, 2 a misspelled one."""

    terms: list[str]
    #: Variants of terms that are words of their own.
    own: frozenset[str] = frozenset()
    known: dict[bytes, int] = field(default_factory=dict, repr=False)
    matcher: Matcher | None = field(default=None, repr=False)
    variants: Variants | None = field(default=None, repr=False)

    def __getstate__(self) -> dict:
        return {"terms": self.terms, "own": self.own, "known": {}, "matcher": None, "variants": None}

    def codes(self, distinct: list[bytes]) -> np.ndarray:
        """Per word: match in the low two bits, +4 if it opens a quotation, +8 if it closes one."""
        if self.matcher is None:
            self.matcher, self.variants = Matcher(self.terms), Variants(self.terms)
        if len(self.known) > REMEMBERED:
            self.known.clear()
        out = np.zeros(len(distinct), np.uint8)
        for k, w in enumerate(distinct):
            code = self.known.get(w)
            if code is None:
                code = self.known[w] = self._code(w.decode())
            out[k] = code
        return out

    def _code(self, word: str) -> int:
        best = 3
        low = word.lower()
        parts = PART.findall(low)
        tries = parts if len(parts) < 2 else [*parts, "".join(parts)]
        if not low.isalpha():
            plain = low.strip(".,;:!?" + QUOTES).translate(LOOKALIKE)
            tries = [*tries, "".join(PART.findall(plain))] if tries != [plain] else tries
        for part in tries:
            found = self.matcher.find(part)
            if found is not None or self.matcher.goes_on(part):
                best = min(best, 2 if found is not None and found[0] else 1)
            elif part not in self.own and part in self.variants:
                best = min(best, 2)
        bare = word.rstrip(".,;:!?")
        opens = word[0] in QUOTES and word[0] not in CLOSES
        closes = len(bare) > 0 and bare[-1] in QUOTES and bare[-1] not in OPENS and not (len(bare) == 1 and opens)
        return best % 3 + 4 * opens + 8 * closes

    def features(self, data: np.ndarray, places: np.ndarray) -> np.ndarray:
        """One row of `FEATURES` per text; zeros without a match."""
        n = len(places) - 1
        out = np.zeros((n, len(FEATURES)))
        found, text_of, _ = words(spaced(data), places)
        found, text_of = parted(found, text_of)
        if not len(found) or not self.terms:
            return out
        coded = found.dictionary_encode()
        code = self.codes(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        hits = np.flatnonzero(code & 3)
        counts = np.bincount(text_of, minlength=n)
        firsts = np.cumsum(counts) - counts
        by_text: dict[int, list[tuple[int, float]]] = defaultdict(list)
        for i in hits.tolist():
            t = int(text_of[i])
            low, high = max(int(firsts[t]), i - WINDOW), min(int(firsts[t] + counts[t]), i + WINDOW + 1)
            if quoted(code[low:high], i - low):
                out[t, 2] += 1
            else:
                exact = code[i] & 3 == 1
                out[t, 0 if exact else 1] += 1
                by_text[t].append((i, 1.0 if exact else 0.5))
        for t, marks in by_text.items():
            at, mass = np.array([m[0] for m in marks]), np.cumsum([m[1] for m in marks])
            upto = np.searchsorted(at, at + 2 * WINDOW, "right") - 1
            out[t, 3] = min(5.0, float((mass[upto] - mass + [m[1] for m in marks]).max()))
            out[t, 4] = 10 * mass[-1] / (10 + counts[t])
        out[:, :3] = np.log1p(out[:, :3])
        return out


def quoted(window: np.ndarray, at: int) -> bool:
    """Whether a quotation opens before or at the word and closes at or after it, in its window."""
    opens, closes = window & 4 != 0, window & 8 != 0
    before = np.flatnonzero(opens[: at + 1])
    if not len(before) or closes[before[-1] : at].any():
        return False
    after = np.flatnonzero(closes[at:])
    return bool(len(after)) and not opens[at + 1 : at + 1 + after[0]].any()


@dataclass
class Model:
    lexicon: Lexicon
    weights: list[float]  # of FEATURES, then the constant


def _labelled(df: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, most: int) -> DataFrame:
    """(text, label) of about `most` labelled documents at most, chosen by a hash of their id."""
    known = labels.select(F.col(doc_id).cast("long").alias("id"), F.col(label).cast("int").alias("label")).where("label is not null and id is not null")
    n = known.count()
    if n > most:
        known = known.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(1_000_000 * most / n))
    known = known.groupBy("id").agg(F.max("label").alias("label"))
    docs = df.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    return docs.join(F.broadcast(known), "id").select("text", "label")  # about `most` rows of two integers


def learned_terms(sample: DataFrame, most_terms: int = MOST_TERMS) -> list[str]:
    """The terms of `learned_lexicon`."""
    return learned_lexicon(sample, most_terms).terms


def learned_lexicon(sample: DataFrame, most_terms: int = MOST_TERMS) -> Lexicon:
    """The lexicon: words of three letters or more that tell toxic from other documents, and first
    letters, written `abc*`, that do so for all words that go on after them; and the words near to
    terms that other documents use."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 0):
            toxic, other = Counter(), Counter()
            for said, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen = {w for w in PART.findall((said or "").lower()) if len(w) >= 3}
                (toxic if y else other).update({w for w in seen if len(w) <= LONGEST_WORD} | {f"{w[:k]}*" for w in seen for k in STEMS if len(w) > k})
            every = [*(toxic | other)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(every, pa.string()), pa.array([toxic[w] for w in every], pa.int64()), pa.array([other[w] for w in every], pa.int64())],
                ["word", "toxic", "other"],
            )

    total = sample.groupBy().agg(F.sum("label").alias("toxic"), F.count(F.lit(1)).alias("n")).first()
    if not total.toxic or total.toxic == total.n:
        return Lexicon([])
    counts = sample.mapInArrow(run, "word string, toxic long, other long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    p = total.toxic / total.n
    n = F.col("toxic") + F.col("other")

    def part(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, 2 * seen * F.log(seen / expected)).otherwise(0.0)

    ratio = part(F.col("toxic"), n * p) + part(F.col("other"), n * (1 - p))
    tested = F.sum(F.when(n > 1, 1).otherwise(0))
    counts = written(counts.where((F.col("toxic") > 1) | (n > 1)).withColumn("ratio", ratio))
    lines = counts.agg(tested.alias("tested")).first().tested or 1
    least = 2 * float(np.log(lines)) + 6
    share = F.when(F.col("word").endswith("*"), STEM_SHARE).otherwise(LEAST_SHARE)
    telling = counts.where((F.col("ratio") >= least) & (F.col("toxic") >= share * n))
    terms = [r.word for r in telling.orderBy(F.col("ratio").desc(), "word").limit(most_terms).collect()]
    variants = Variants(terms)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([w for w in batch.column(0).to_pylist() if w in variants], pa.string())], ["word"])

    others = counts.where((F.col("other") >= OWN_WORD) & (F.col("toxic") < LEAST_SHARE * n) & ~F.col("word").endswith("*"))
    return Lexicon(terms, frozenset(r.word for r in others.select("word").mapInArrow(near, "word string").collect()))


def fitted_weights(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> list[float]:
    """Logistic regression with a ridge, by Newton steps with halving."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    ridge = np.append(np.full(x.shape[1] - 1, penalty), 1e-3)

    def loss(v: np.ndarray) -> float:
        z = x @ v
        return float(np.logaddexp(0, z).sum() - y @ z + 0.5 * (ridge * v * v).sum())

    now = loss(w)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), grad)
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > now:
            size /= 2
        w = w - size * step
        now, last = loss(w), now
        if last - now < 1e-9 * (1 + abs(now)):
            break
    return w.tolist()


def trained(df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", most: int = LABELLED) -> Model:
    """A model fitted to the rows of `labels`, joined with `df` by id; `most` bounds the sample.

    Without labels, or with only one kind, the lexicon is empty and all scores equal the base rate.
    """
    sample = _labelled(df, labels, doc_id, text, label, most)
    lexicon = learned_lexicon(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 0):
            x = lexicon.features(*flat(batch.column(0)))
            yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in x.T), batch.column(1)], [*FEATURES, "label"])

    rows = sample.mapInArrow(run, ", ".join(f"{c} double" for c in FEATURES) + ", label int").toPandas().to_numpy(float)
    if not len(rows):
        return Model(lexicon, [0.0] * (len(FEATURES) + 1))
    rows = rows[np.lexsort(rows.T)]  # sums do not hang on the order of tasks
    return Model(lexicon, fitted_weights(rows[:, :-1], rows[:, -1]))


def scored(df: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score, and the `FEATURES` of the whole text), one row per document.

    A null, empty or wordless text has zero features and the score of a text without matches.
    Repeated rows are scored each; an empty table gives an empty one. Other columns are not read.
    """
    narrow = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    lexicon = model.lexicon

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):
            x = lexicon.features(*flat(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in x.T)], ["doc_id", *FEATURES])

    found = narrow.mapInArrow(run, "doc_id long, " + ", ".join(f"{c} double" for c in FEATURES))
    z = F.lit(model.weights[-1])
    for name, w in zip(FEATURES, model.weights, strict=False):
        z = z + F.col(name) * F.lit(w)
    return found.select("doc_id", (1 / (1 + F.exp(-z))).alias("score"), *FEATURES)
