"""Utilities: reduce the sink table of every world to one number, (w, u).

The probe table is the same for all worlds, and every learner here is deterministic, so two
worlds differ only by their data.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window, functions as F

from blamesplit.functions.columns import align
from blamesplit.functions.local import MAX_LOCAL_ROWS, local_table
from blamesplit.functions.newton import fit_worlds
from blamesplit.functions.ordered import BEFORE, in_slices, present
from blamesplit.functions.prints import world_fingerprints
from blamesplit.functions.ranks import world_slices
from blamesplit.plans.worlds import W, WorldFrame, settled

LABEL = "label"
MIN_ROWS = 50
NO_SKILL = 0.5
NUMBERS = {"tinyint", "smallint", "int", "bigint", "float", "double"}


def listed_worlds(frame: WorldFrame) -> DataFrame:
    """Every world of the frame, also those whose table came out empty."""
    return local_table(frame.df.sparkSession, f"{W} long", [(w,) for w in frame.worlds])


# -- ranking quality -----------------------------------------------------------------------


MOST_SLICES = 64
SKETCHED = 0.05  # share of the rows that edges of slices are taken from


def roc_auc(
    scored: DataFrame, by: list[str], score: str, label: str, groups: int = 1, sketched: DataFrame | None = None
) -> DataFrame:
    """ROC AUC per group, ties counted half: (*by, auc), null where a class is missing.

    Rows without a score (null or NaN) or without a 0/1 label cannot be ranked and do not count.

    Equal scores are counted together first. Each group's order is then cut into slices, more where
    there are few `groups`, and a score is only ranked inside its slice; of the others it needs their
    totals. Edges of slices are quantiles of some rows (`sketched`, default: a sample of `scored`), so
    they decide where the work goes, never the result.
    """
    y = F.col(label).cast("long")
    counts = present(scored, score) & y.isin(0, 1)
    named = reduce(Column.__and__, [F.col(c).isNotNull() for c in by], F.lit(True))
    partitions = int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wanted = max(1, min(MOST_SLICES, 4 * partitions // max(groups, 1)))
    some = scored.sample(SKETCHED, seed=1) if sketched is None else sketched
    edges = edges_of(some.where(named & counts), by, score, wanted)
    tied = scored.where(named).groupBy(*by, F.when(counts, F.col(score)).alias("s")).agg(
        F.sum(F.when(counts, y).otherwise(0)).alias("pos"),
        F.sum(F.when(counts, 1 - y).otherwise(0)).alias("neg"),
    )
    if edges is None:
        sliced = in_slices(tied, by, "s")
    else:
        part = sum((F.when(F.col("s") > F.col(f"__edge_{k}"), 1).otherwise(0) for k in range(wanted)), F.lit(0))
        tied = tied.join(F.broadcast(edges), by, "left") if by else tied.crossJoin(F.broadcast(edges))
        sliced = tied.select(*by, "s", "pos", "neg", part.alias("part"))
    keys = [*by, "part"]
    dealt = sliced.repartition(partitions, *keys)
    inside = Window.partitionBy(*keys).orderBy("s").rowsBetween(*BEFORE)
    ranked = dealt.withColumn("below", F.coalesce(F.sum("neg").over(inside), F.lit(0)))
    twice = lambda below: F.sum(F.col("pos").cast("double") * below)
    slices = ranked.groupBy(*keys).agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), twice(2 * F.col("below") + F.col("neg")).alias("wins")
    )
    return auc_of_slices(slices, by)


def auc_of_slices(slices: DataFrame, by: list[str]) -> DataFrame:
    """(*by, auc) from (*by, part, pos, neg, wins): slices of an order, `wins` twice the pairs won inside."""
    across = Window.partitionBy(*by).orderBy("part").rowsBetween(*BEFORE)
    below = slices.withColumn("below", F.coalesce(F.sum("neg").over(across), F.lit(0)))
    pairs = 2.0 * F.sum("pos") * F.sum("neg").cast("double")
    twice = lambda below: F.sum(F.col("pos").cast("double") * below)
    return below.groupBy(*by).agg(((F.sum("wins") + twice(2 * F.col("below"))) / F.nullif(pairs, F.lit(0.0))).alias("auc"))


def edges_of(some: DataFrame, by: list[str], score: str, wanted: int) -> DataFrame | None:
    """(*by, __edge_0, ...): quantiles of some scores, a row per group; none where no quantile is defined."""
    if dict(some.dtypes)[score] not in NUMBERS:
        return None
    probs = F.array(*[F.lit((k + 1) / (wanted + 1)) for k in range(wanted)])
    found = some.groupBy(*by).agg(F.percentile_approx(score, probs, 1000).alias("q"))
    sketch = found.select(*by, *[F.col("q")[k].alias(f"__edge_{k}") for k in range(wanted)])
    if len(rows := sketch.limit(MAX_LOCAL_ROWS + 1).collect()) > MAX_LOCAL_ROWS:
        return None  # too many groups for a broadcast
    return local_table(some.sparkSession, sketch.schema, [tuple(r) for r in rows])


# -- guards --------------------------------------------------------------------------------


def class_counts(sink: WorldFrame, label: str = LABEL) -> DataFrame:
    """(w, y, n): rows per world and class; y is null where there is no label column."""
    y = F.col(label).cast("int") if label in sink.columns else F.lit(None).cast("int")
    return sink.df.groupBy(W, y.alias("y")).agg(F.count("*").alias("n"))


def guards(sink: WorldFrame, counts: DataFrame | None = None, label: str = LABEL) -> DataFrame:
    """(w, n_rows, n_classes, trainable) for every world, empty ones included."""
    counts = class_counts(sink, label) if counts is None else counts
    sums = counts.groupBy(W).agg(F.sum("n").alias("n_rows"), F.count("y").alias("n_classes"))
    features = [(w, bool(features_in(sink, w, label))) for w in sink.worlds]
    listed = local_table(sink.df.sparkSession, f"{W} long, has_features boolean", features)
    n_rows, n_classes = (F.coalesce(F.col(c), F.lit(0)) for c in ("n_rows", "n_classes"))
    return listed.join(sums, W, "left").select(
        W,
        n_rows.alias("n_rows"),
        n_classes.alias("n_classes"),
        ((n_rows >= MIN_ROWS) & (n_classes >= 2) & F.col("has_features")).alias("trainable"),
    )


def features_in(sink: WorldFrame, world: int, label: str = LABEL) -> list[str]:
    return [c for c in sink.columns_in(world) if c != label]


# -- aggregate metric ----------------------------------------------------------------------


def metric_utility(sink: WorldFrame, metric: Column) -> DataFrame:
    """Any aggregate of the sink as utility; a world without rows scores 0."""
    found = settled(sink, sink.df.groupBy(W).agg(metric.cast("double").alias("u")))
    return listed_worlds(sink).join(found, W, "left").select(
        W, F.coalesce("u", F.lit(0.0)).alias("u")
    )


# -- closed-form scorer --------------------------------------------------------------------


def class_statistics(sink: WorldFrame, features: list[str], label: str = LABEL) -> DataFrame:
    """Count, mean and population variance of every feature per (world, class): one pass."""
    by, aggregates = class_measure(features, label)
    return sink.df.groupBy(W, by).agg(*aggregates)


def class_measure(features: list[str], label: str = LABEL) -> tuple[Column, list[Column]]:
    """What `class_statistics` groups by besides the world, and its aggregates.

    The mean is written as sum over count, as it is computed: the count is then held once for both.
    Code is generated for an aggregation of up to 100 columns in all, those it holds included.
    """
    aggregates = [F.count("*").alias("n")]
    for c in features:
        x = F.col(c).cast("double")
        mean = F.sum(x) / F.nullif(F.count(x), F.lit(0))
        aggregates += [F.count(x).alias(f"n_{c}"), mean.alias(f"m_{c}"), F.var_pop(x).alias(f"v_{c}")]
    return F.col(label).cast("int").alias("y"), aggregates


def sink_measure(sink: WorldFrame) -> tuple[Column, list[Column]]:
    """The statistics a discriminant trains on, for a replay to take while it prints its sink."""
    return class_measure([c for c in sink.columns if c != LABEL])


@dataclass(frozen=True)
class Moments:
    """Rows of one class in one world; values, means and population variances of its columns."""

    n: int
    count: dict[str, int]
    mean: dict[str, float | None]
    var: dict[str, float | None]


def moments(stats: DataFrame, features: list[str]) -> dict[int, dict[int, Moments]]:
    found: dict[int, dict[int, Moments]] = {}
    for r in stats.collect():
        found.setdefault(r[W], {})[r.y] = Moments(
            r.n,
            {c: r[f"n_{c}"] for c in features},
            {c: r[f"m_{c}"] for c in features},
            {c: r[f"v_{c}"] for c in features},
        )
    return found


def trainable(classes: dict[int, Moments], features: list[str]) -> bool:
    """The guards of `guards` for one world; a label other than 0 and 1 is an error."""
    labelled = [y for y in classes if y is not None]
    if set(labelled) - {0, 1}:
        raise ValueError(f"labels must be 0 or 1, not {sorted(set(labelled) - {0, 1})}")
    return bool(features) and len(labelled) >= 2 and sum(m.n for m in classes.values()) >= MIN_ROWS


def discriminant_weights(classes: dict[int, Moments], features: list[str]) -> dict[str, float]:
    """Mean difference over pooled variance per feature; 0 where that is undefined.

    A column counts with the values it has; one without values in a class has no weight.
    """
    a, b = classes[0], classes[1]
    weights = {}
    for c in features:
        na, nb = a.count[c], b.count[c]
        pooled = (na * a.var[c] + nb * b.var[c]) / (na + nb) if na and nb else 0.0
        weights[c] = (b.mean[c] - a.mean[c]) / pooled if pooled > 1e-12 else 0.0
    return weights


def linear_auc(
    sink: WorldFrame,
    weights: dict[int, dict[str, float]],
    probe: DataFrame,
    label: str = LABEL,
    digits: int | None = None,
) -> DataFrame:
    """Rank the frozen probe by a linear score per world: (w, u = AUC); no weights means 0.5.

    `digits` rounds scores to so many decimals, where another engine must find the same ties.

    A column the world's sink does not have has no weight, whatever the probe holds there.
    """
    features = [c for c in sink.columns if c != label]
    spark = sink.df.sparkSession
    first: dict[tuple, int] = {}  # worlds with equal weights are scored once
    stands_for = {}
    for w, k in sorted(weights.items()):
        vector = tuple(float(k.get(c, 0.0)) for c in features)
        stands_for[w] = first.setdefault(vector, w)
    # dealt anew: each row is scored in many worlds, so a small probe is much work for few tasks
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = F.col(label).cast("long").isin(0, 1)
    probe = align(probe, features + [label]).where(counts).repartition(tasks).persist()
    aucs: dict[int, float | None] = {}
    try:
        if features and first:
            slices = world_slices(probe, features, label, [(w, vector) for vector, w in first.items()], digits, probe.count())
            aucs = {r[W]: r.auc for r in settled(sink, auc_of_slices(slices, [W])).collect()}
    finally:
        probe.unpersist()
    found = [(w, aucs.get(stands_for.get(w))) for w in sink.worlds]
    return local_table(
        spark, f"{W} long, u double", [(w, NO_SKILL if u is None else float(u)) for w, u in found]
    )


def discriminant_utility(
    sink: WorldFrame, probe: DataFrame, label: str = LABEL, digits: int | None = None
) -> DataFrame:
    """Train a diagonal linear discriminant in every world, score the probe: (w, u = AUC).

    One aggregation over the sink trains all worlds and one ranking of the probe scores them. It
    stands in for the logistic regression where a result should be reproducible in plain SQL. A sink
    that its replay has measured (`sink_measure`) is not read again.
    """
    features = [c for c in sink.columns if c != label]
    measured = sink.measured if label == LABEL else None
    stats = moments(class_statistics(sink, features, label) if measured is None else measured, features)
    weights = {}
    for w, classes in stats.items():
        mine = features_in(sink, w, label)
        if trainable(classes, mine):
            weights[w] = discriminant_weights(classes, mine)
    return linear_auc(sink, weights, probe, label, digits)


# -- logistic regression -------------------------------------------------------------------


def logistic_weights(sink: WorldFrame, label: str = LABEL) -> dict[int, dict[str, float]]:
    """w -> {feature: weight} of L2-regularised logistic regressions (unit penalty, free intercept).

    All worlds are fitted together: every Newton step is one grouped aggregation over the tagged
    sink, whatever the number of worlds, and only the small per-world sums leave the executors.
    Worlds whose sinks have equal content are fitted once. Untrainable worlds are left out; rows
    without a label do not train, and a missing value counts as its column's mean.
    """
    features = [c for c in sink.columns if c != label]
    stats = moments(class_statistics(sink, features, label), features)
    scaling = {}
    for w, classes in stats.items():
        mine = features_in(sink, w, label)
        if trainable(classes, mine):
            scaling[w] = {c: mean_and_sd(classes, c) for c in mine}
    if not scaling:
        return {}
    prints = {r[W]: r.fingerprint for r in world_fingerprints(sink).collect()}
    first: dict[str, int] = {}
    stands_for = {w: first.setdefault(prints[w], w) for w in sorted(scaling)}
    fitted = sorted(set(stands_for.values()))
    columns = [F.coalesce(F.col(c).cast("double"), mean_of(c, scaling, fitted)).alias(c) for c in features]
    rows = sink.df.where(F.col(W).isin(fitted) & F.col(label).isNotNull()).select(
        W, F.col(label).cast("double").alias(label), *columns
    )
    found = fit_worlds(rows, {w: scaling[w] for w in fitted}, features, label)
    return {w: found[v] for w, v in stands_for.items()}


def mean_of(column: str, scaling: dict, worlds: list[int]) -> Column:
    """The column's mean in the row's world; 0 where the world does not have it."""
    cases = " ".join(f"WHEN {w}L THEN {scaling[w].get(column, (0.0, 1.0))[0]!r}D" for w in worlds)
    return F.expr(f"CASE {W} {cases} ELSE 0D END")


def logistic_utility(
    sink: WorldFrame, probe: DataFrame, label: str = LABEL, digits: int | None = None
) -> DataFrame:
    """(w, u): train a logistic regression in every world, score the probe: u = AUC."""
    return linear_auc(sink, logistic_weights(sink, label), probe, label, digits)


def mean_and_sd(classes: dict[int, Moments], column: str) -> tuple[float, float]:
    """Mean and population sd of a column's values in all classes; sd 0 counts as 1."""
    some = [(m.count[column], m.mean[column], m.var[column]) for m in classes.values() if m.count[column]]
    n = sum(k for k, _, _ in some)
    if not n:
        return 0.0, 1.0
    mean = sum(k * m for k, m, _ in some) / n
    var = sum(k * (v + (m - mean) ** 2) for k, m, v in some) / n
    return mean, var**0.5 if var > 0 else 1.0


def standardize(train: DataFrame, others: Iterable[DataFrame], features: list[str]) -> list[DataFrame]:
    """Scale `features` of all tables by mean and population sd of `train` (sd 0 counts as 1)."""
    stats = train.agg(
        *[F.avg(F.col(c).cast("double")).alias(f"m_{c}") for c in features],
        *[F.stddev_pop(F.col(c).cast("double")).alias(f"s_{c}") for c in features],
    ).first()

    def scale(c: str) -> Column:
        mean, sd = stats[f"m_{c}"], stats[f"s_{c}"]
        return ((F.col(c).cast("double") - F.lit(mean)) / F.lit(sd or 1.0)).alias(c)

    return [
        df.select(*[scale(c) if c in features else F.col(c) for c in df.columns])
        for df in (train, *others)
    ]


def single_logistic_auc(train: DataFrame, probe: DataFrame, label: str = LABEL) -> float:
    """The same utility for one plain table, with MLlib: fit on `train`, score the probe."""
    features = [c for c in train.columns if c != label]
    scaled, scaled_probe = standardize(train, [align(probe, features + [label])], features)
    assembler = VectorAssembler(inputCols=features, outputCol="__x")
    learner = LogisticRegression(
        featuresCol="__x",
        labelCol=label,
        regParam=1.0 / train.count(),
        elasticNetParam=0.0,
        standardization=False,
        maxIter=2000,
        tol=1e-9,
    )
    model = learner.fit(assembler.transform(scaled))
    judge = BinaryClassificationEvaluator(
        rawPredictionCol="rawPrediction", labelCol=label, metricName="areaUnderROC", numBins=0
    )
    return judge.evaluate(model.transform(assembler.transform(scaled_probe)))


@dataclass(frozen=True)
class Fold:
    """A user's utility in three steps, so that no task ever holds a world.

    `partial` reduces some rows of one world (an Arrow table without the world tag) to a state,
    `merge` puts two states of a world together, in any order and grouping, and `finish` turns the
    last one into the utility. States are bytes of the user's own making.
    """

    partial: Callable[[pa.Table], bytes]
    merge: Callable[[bytes, bytes], bytes]
    finish: Callable[[bytes], float]


def python_utility(sink: WorldFrame, fold: Fold) -> DataFrame:
    """(w, u) by a user's Python: worlds may have any number of rows, an empty one scores 0.5.

    Each task reduces its batches to one state per world; the states of a world, one per task at
    most, meet in a stream that holds one of them at a time.
    """
    states = sink.df.mapInArrow(_reduced(fold), f"{W} long, state binary")
    dealt = states.repartition(W).sortWithinPartitions(W)
    found = dealt.mapInArrow(_finished(fold), f"{W} long, u double")
    return listed_worlds(sink).join(found, W, "left").select(W, F.coalesce("u", F.lit(NO_SKILL)).alias("u"))


def _reduced(fold: Fold):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[int, bytes] = {}
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for w in pc.unique(table[W]).to_pylist():
                state = fold.partial(table.filter(pc.equal(table[W], w)).drop_columns(W))
                states[w] = fold.merge(states[w], state) if w in states else state
        yield pa.RecordBatch.from_arrays([pa.array(states.keys(), pa.int64()), pa.array(states.values(), pa.binary())], [W, "state"])

    return run


def _finished(fold: Fold):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, b""
        for batch in batches:
            done = []
            for w, more in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if w == now:
                    state = fold.merge(state, more)
                    continue
                if now is not None:
                    done.append((now, fold.finish(state)))
                now, state = w, more
            yield _utilities(done)
        yield _utilities([(now, fold.finish(state))] if now is not None else [])

    return run


def _utilities(rows: list[tuple[int, float]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([w for w, _ in rows], pa.int64()), pa.array([float(u) for _, u in rows], pa.float64())], [W, "u"])
