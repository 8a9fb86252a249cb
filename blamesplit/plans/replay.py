"""Hybrid replay: run a pipeline for many worlds at once, and compare the runs."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping
from contextlib import contextmanager
from functools import reduce
from itertools import product

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, functions as F

from blamesplit.functions.local import local_table
from blamesplit.functions.prints import fingerprint, world_fingerprints, world_fingerprints_of_parts
from blamesplit.plans.pipeline import Pipeline
from blamesplit.functions.stage import stage
from blamesplit.plans.worlds import MAX_WORLDS, W, State, WorldFrame, one_of, settled, world_const


class Replay:
    """Lazy replay of `worlds` (default: every state of every sensitive operator).

    `cache` keeps the output of operators that are read more than once: "shared" those with
    several consumers, and totals; "wide" also those that join or aggregate, but the sink. The latter is
    for runs that look at every operator. What is made row by row of tables and of kept or given
    outputs costs no shuffle and holds more rows, one for each world: it is made again where it is read.

    `merge` joins worlds that hold the same table: "nodes" as soon as they do, "sink" before they are
    scored. Where all that an operator depends on reaches the sink through it alone, its output is
    kept, worlds of equal content are found by fingerprint, and one of each goes on. Later operators
    and scorers then only see worlds that differ; `alias` tells which world stands for each one that
    was asked for, and `spread` gives a utility back to all of them. Merging at nodes saves work
    where operators are dear, and costs a job for each. Only fingerprints, one per world, reach the
    driver.

    `measure` gives, for a frame, a column of few values to group by and aggregates. The sink is then
    not kept when its worlds merge: one pass takes its fingerprints and these numbers, which go on
    with the frame as `measured`. For scorers that need no more of a sink than that.

    `given` are outputs that were computed before, by operator.
    """

    def __init__(
        self, pipeline: Pipeline, worlds: Iterable[int] | None = None, cache: str = "", merge: str = "",
        given: Mapping[str, WorldFrame] | None = None,
        measure: Callable[[WorldFrame], tuple[Column, list[Column]]] | None = None,
    ):
        self.pipeline = pipeline
        self.required = frozenset(pipeline.all_worlds() if worlds is None else worlds)
        self.alias = {w: w for w in self.required}
        self.cache = cache
        self.merge = merge
        self.measure = measure
        self.given = dict(given or {})
        self._frames: dict[str, WorldFrame] = {}
        self._cached: list[DataFrame] = []

    def state(self, name: str) -> State:
        return State(self.pipeline.operators[name], self.pipeline.fields.get(name), self.required)

    def node(self, name: str) -> WorldFrame:
        """The output of one operator in all required worlds."""
        if name not in self._frames:
            op = self.pipeline.operators[name]
            frame = self._taken(name) if name in self.given else self._run(name, op)
            if len(frame.worlds) > 1 and self._merges(name):
                frame = self._merged(frame, self.measure if name == self.pipeline.sink else None)
            elif self._keeps(name):
                self._keep(frame)
                if op.totals:
                    frame.df.count()
            self._frames[name] = frame
        return self._frames[name]

    def _run(self, name: str, op) -> WorldFrame:
        inputs = {p: self.node(p) for p in op.parents}
        for frame in inputs.values():
            frame.required = self.required  # a merge further on may have left fewer worlds
        return op.body(inputs, self.state(name)).expand(self.pipeline.lineage_fields(name))

    def _taken(self, name: str) -> WorldFrame:
        known = self.given[name]
        frame = WorldFrame(known.df, self.required, known.fields, known.absent)
        return frame if set(known.worlds) <= set(frame.worlds) else frame._like(frame.df.where(one_of(frame.worlds)))

    def _keep(self, frame: WorldFrame) -> None:
        frame.df = frame.df.persist(StorageLevel.MEMORY_AND_DISK)
        self._cached.append(frame.df)

    def _keeps(self, name: str) -> bool:
        readers, op = self._consumers(name), self.pipeline.operators[name]
        if not self.cache or not readers or name in self.given:
            return False
        return op.totals or readers > 1 and not self._row_by_row(name) or self.cache == "wide" and op.wide

    def _row_by_row(self, name: str) -> bool:
        """Whether an output is made of tables, or of what is kept or given, without a join or aggregation."""
        if name in self.given:
            return True
        op = self.pipeline.operators[name]
        return not op.wide and all(self._row_by_row(p) or self._keeps(p) for p in op.parents)

    def _merges(self, name: str) -> bool:
        """Whether worlds merge here: what feeds this operator must reach the sink through it alone."""
        if not self.merge or self.merge == "sink" and name != self.pipeline.sink:
            return False
        lineage = self.pipeline.lineage(name)
        return all(set(op.parents).isdisjoint(lineage - {name}) for n, op in self.pipeline.operators.items() if n not in lineage)

    def _merged(self, frame: WorldFrame, measure: Callable | None) -> WorldFrame:
        if measure is None:
            self._keep(frame)
            prints = world_fingerprints(frame)
        else:
            by, aggregates = measure(frame)
            frame.measured = settled(frame, fingerprint(frame.df, [W, by], frame.columns, *aggregates))
            prints = world_fingerprints_of_parts(frame, frame.measured)
        first: dict[str, int] = {}
        stands_for = {}
        for r in prints.orderBy(W).collect():
            stands_for[r[W]] = first.setdefault(r.fingerprint, r[W])
        if len(first) == len(stands_for):
            return frame
        self.alias = {w: a & ~frame.fields | stands_for[a & frame.fields] for w, a in self.alias.items()}
        self.required = frozenset(self.alias.values())
        left = one_of(first.values())
        measured = None if frame.measured is None else frame.measured.where(left)
        return WorldFrame(frame.df.where(left), self.required, frame.fields, frame.absent, measured)

    def sink(self) -> WorldFrame:
        return self.node(self.pipeline.sink)

    def spread(self, utility: DataFrame) -> DataFrame:
        """A utility (w, u) of the worlds that were left, for every world that was asked for."""
        rows = local_table(utility.sparkSession, f"{W} long, __alias long", sorted(self.alias.items()))
        return rows.join(utility.withColumnRenamed(W, "__alias"), "__alias").select(W, *[c for c in utility.columns if c != W])

    def release(self) -> None:
        for df in self._cached:
            df.unpersist()
        self._cached.clear()

    def _consumers(self, name: str) -> int:
        return sum(name in op.parents for op in self.pipeline.operators.values())


@contextmanager
def wide_sources(pipeline: Pipeline) -> Iterator[dict[str, WorldFrame]]:
    """The first operators of a pipeline that join or aggregate, for the replays of one report.

    These are sources, and others that are made row by row of one source, in all variants of what
    feeds them: what several sources feed has a variant for each mix of theirs. Pass them on as `given`: the game, the drift and the frontier then read each of these
    outputs, which is computed once, by whichever needs it first. All must be evaluated inside the block.
    """
    wide = {n for n, op in pipeline.operators.items() if op.wide}
    sources = set(pipeline.sources)
    names = [n for n in pipeline.order if n in wide and not wide & pipeline.lineage(n) - {n} and len(sources & pipeline.lineage(n)) == 1]
    moved = set()
    for n in names:
        mine = [m for m in pipeline.order if m in pipeline.lineage(n) and m in pipeline.fields]
        variants = [range(len(pipeline.operators[m].variants) + 1) for m in mine]
        moved |= {sum(pipeline.fields[m].world(k) for m, k in zip(mine, ks, strict=True)) for ks in product(*variants)}
    run = Replay(pipeline, {0, *moved}, cache="wide")
    try:
        yield {n: run.node(n) for n in names}
    finally:
        run.release()


# -- more worlds than one plan holds -------------------------------------------------------


def batches(pipeline: Pipeline, worlds: Iterable[int], most: int = MAX_WORLDS) -> tuple[int, list[list[int]]]:
    """(split, batches): lists of at most `most` worlds that differ from each other in the fields `split`.

    Fields are split from the sink upwards, so that as many operators as possible come out the same
    in every batch. Every world carries its own tag, so any number of batches is one result.
    """
    worlds, split = sorted(set(worlds)), 0
    for name in reversed(pipeline.order):
        if len(worlds) <= most:
            return 0, [worlds]
        if name in pipeline.fields:
            split |= pipeline.fields[name].mask
            groups: dict[int, list[int]] = {}
            for w in worlds:
                groups.setdefault(w & split, []).append(w)
            if max(map(len, groups.values())) <= most:
                break
    out: list[list[int]] = [[]]
    for key in sorted(groups):
        if len(out[-1]) + len(groups[key]) > most:
            out.append([])
        out[-1] += groups[key]
    return split, out


def replay_batches(pipeline: Pipeline, worlds: Iterable[int], most: int = MAX_WORLDS, **options) -> Iterable[Replay]:
    """Replays that together cover any number of worlds.

    What the batches have in common is computed once: operators that no split field feeds are read
    from checkpoints wherever an operator of a batch reads them.
    """
    split, lists = batches(pipeline, worlds, most)
    given = {}
    if split:
        common = {n for n in pipeline.operators if not pipeline.lineage_fields(n) & split}
        read = {p for n, op in pipeline.operators.items() if n not in common for p in op.parents if p in common}
        every = {w & ~split for part in lists for w in part}
        for name in sorted(read):
            local = sorted({w & pipeline.lineage_fields(name) for w in every})
            parts = [Replay(pipeline, local[k : k + most]).node(name) for k in range(0, len(local), most)]
            df = stage(reduce(DataFrame.unionByName, [p.df for p in parts]))
            given[name] = WorldFrame(df, frozenset(local), parts[0].fields, parts[0].absent)
    for part in lists:
        yield Replay(pipeline, part, given=given, **options)


def utility_of(pipeline: Pipeline, worlds: Iterable[int], score: Callable[[WorldFrame], DataFrame], most: int = MAX_WORLDS, **options) -> DataFrame:
    """(w, u) of any number of worlds; `score` gets the sink of at most `most` of them at a time."""
    parts = []
    for run in replay_batches(pipeline, worlds, most, **options):
        parts.append(run.spread(score(run.sink())))
        run.release()
    return reduce(DataFrame.unionByName, parts)


def isolated(body: Callable) -> Callable:
    """Adapt a plain `(inputs, params) -> DataFrame` operator that knows nothing about worlds.

    It runs once per distinct local world, so prefer world-aware steps where a frame is large.
    """

    def run(inputs, state: State) -> WorldFrame:
        fields = state.field.mask if state.field else 0
        for frame in inputs.values():
            fields |= frame.fields
        parts = []
        for local in sorted({m & fields for m in state.required}):
            choice = state.field.choice(local) if state.field else 0
            tables = {n: f.world(local) for n, f in inputs.items()}
            parts.append(body(tables, state.op.params(choice)).withColumn(W, world_const(local)))
        df = parts[0]
        for part in parts[1:]:
            df = df.unionByName(part)
        return WorldFrame(df, state.required, fields)

    return run


# -- content fingerprints ------------------------------------------------------------------


def active_frontier(
    pipeline: Pipeline, scenarios: Mapping[str, Mapping[str, int]] | None = None,
    given: Mapping[str, WorldFrame] | None = None,
) -> DataFrame:
    """(scenario, op, changed): does flipping only this operator change its own output?

    `scenarios` maps each name to the variants its operators take (default: one, with the first
    variants). Inputs stay at reference, so each operator is replayed in the worlds that flip it and
    no other; what they all read comes from `given`. A diagnostic: it can miss an operator that
    reacts to incident inputs only, so the game never prunes by it.
    """
    if scenarios is None:
        scenarios = {"": {n: 1 for n in pipeline.fields}}
    flips = {(s, n): pipeline.world([n], c) for s, c in scenarios.items() for n in pipeline.fields}
    spark, parts = None, []
    for name in sorted(pipeline.fields):
        frame = Replay(pipeline, {0, *(w for (_, n), w in flips.items() if n == name)}, given=given).node(name)
        spark = frame.df.sparkSession
        prints = world_fingerprints(frame)
        parts.append(prints.select(F.lit(name).alias("op"), W, "fingerprint"))
    prints = parts[0]
    for part in parts[1:]:
        prints = prints.unionByName(part)
    lineage = {n: pipeline.lineage_fields(n) for n in pipeline.fields}
    rows = [(s, n, w & lineage[n]) for (s, n), w in sorted(flips.items())]
    asked = local_table(spark, f"scenario string, op string, {W} long", rows)
    base = prints.where(F.col(W) == 0).select("op", F.col("fingerprint").alias("base"))
    return asked.join(prints, ["op", W]).join(base, "op").select(
        "scenario", "op", (F.col("fingerprint") != F.col("base")).alias("changed")
    )


def sink_sharing(frame: WorldFrame, n_players: int, masks: DataFrame) -> DataFrame:
    """Distinct sink tables over the coalition lattice: (first_mask, coalitions, n_rows).

    `masks` maps every coalition mask to its world: (mask, w).
    """
    prints = world_fingerprints(frame)
    return (
        masks.join(prints, W)
        .groupBy("fingerprint", "n_rows")
        .agg(F.min("mask").alias("first_mask"), F.count("*").alias("coalitions"))
        .select("first_mask", "coalitions", "n_rows")
    )


# -- profiles and drift --------------------------------------------------------------------


def profile(frame: WorldFrame, numeric: list[str]) -> DataFrame:
    """(w, column, n_rows, mean, sd): one pass over the table for all numeric columns."""
    aggregates = [F.count("*").alias("n_rows")]
    for c in numeric:
        aggregates += [F.avg(c).alias(f"{c}__mean"), F.stddev_samp(c).alias(f"{c}__sd")]
    wide = frame.df.groupBy(W).agg(*aggregates)
    cells = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(c).alias("column"),
                    F.col(f"{c}__mean").cast("double").alias("mean"),
                    F.col(f"{c}__sd").cast("double").alias("sd"),
                )
                for c in numeric
            ]
        )
    )
    return wide.select(W, "n_rows", cells.alias("p")).select(W, "p.column", "n_rows", "p.mean", "p.sd")
