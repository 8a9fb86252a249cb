"""Reports over games, attributions and their scores."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from blamesplit.functions.columns import numeric_columns
from blamesplit.functions.local import local_table
from blamesplit.operators import game as g
from blamesplit.operators import lineage, scoring
from blamesplit.plans.pipeline import Pipeline
from blamesplit.plans.replay import Replay, active_frontier, profile, wide_sources, world_fingerprints
from blamesplit.plans.worlds import W, WorldFrame

# Fixed limits of the reports.
MEASURABLE = 0.002  # smallest |v(V)| an incident is read at
DRIFT_FLOOR = 0.002
HARM = -0.002  # a fault or incident counts as harmful from here down
METHODS = ["shapley", "anchored", "loo", "drift", "stagewise"]
TINY_DRIFT = 1e-9
SIGN_EPS = 1e-9
RATIO_BINS = [(0.0, 0.25, "r < 0.25"), (0.25, 0.5, "0.25 - 0.5"), (0.5, 1.0, "0.5 - 1"), (1.0, 2.0, "1 - 2"), (2.0, None, "r > 2")]
COARSE_BINS = [(0.0, 0.5, "r < 0.5"), (0.5, 1.0, "0.5 - 1"), (1.0, 2.0, "1 - 2"), (2.0, None, "r > 2")]


@dataclass(frozen=True)
class Incident:
    """One scenario: which variant each faulted operator takes, and who is to blame."""

    name: str
    choice: Mapping[str, int] = field(default_factory=dict)
    culprits: tuple[str, ...] = ()
    group: str = ""


@dataclass
class Study:
    """A pipeline with its incidents, and the tables every report reads."""

    spark: SparkSession
    pipeline: Pipeline
    incidents: list[Incident]
    tables: object = None

    def choice(self, incident: Incident) -> dict[str, int]:
        """Variant of every sensitive operator: sources always move, others only if faulted."""
        sources = {s: 1 for s in self.pipeline.sources if s in self.pipeline.fields}
        rest = {n: 0 for n in self.pipeline.fields if n not in sources}
        return {**rest, **sources, **incident.choice}

    @property
    def scenarios(self) -> dict[str, tuple[Pipeline, dict[str, int]]]:
        return {i.name: (self.pipeline, self.choice(i)) for i in self.incidents}

    def worlds(self) -> list[int]:
        """Worlds of all incidents together; incidents share the healthy and drift-only runs."""
        return sorted({w for _, c in self.scenarios.values() for w in self.pipeline.all_worlds(c)})

    def replay(self, **options) -> Replay:
        return Replay(self.pipeline, self.worlds(), **options)

    def players(self) -> DataFrame:
        return g.players_table(self.spark, self.scenarios)

    def coalitions(self) -> DataFrame:
        return g.coalition_worlds(self.spark, self.scenarios)

    def sampled_coalitions(self, players: DataFrame, count: int, seed: int) -> DataFrame:
        """(scenario, mask, w) of the sampled walks only, for wide DAGs."""
        masks = g.sampled_coalitions(players, count, seed)
        parts = [
            masks.where(F.col("scenario") == name).withColumn(W, pipeline.world_of_mask(F.col("mask"), choice))
            for name, (pipeline, choice) in self.scenarios.items()
        ]
        return staged_rows(reduce(DataFrame.unionByName, parts))

    def walked_coalitions(self, players: DataFrame, count: int, seed: int) -> DataFrame:
        """(scenario, mask, w) that exact and sampled anchored values need, without the lattice."""
        sampled = self.sampled_coalitions(players, count, seed)
        return staged_rows(sampled.unionByName(g.anchored_worlds(self.spark, self.scenarios)).distinct())

    def game(self, utility: DataFrame, coalitions: DataFrame | None = None) -> DataFrame:
        return g.game_table(self.coalitions() if coalitions is None else coalitions, utility)

    def culprits(self) -> DataFrame:
        rows = [(i.name, op) for i in self.incidents for op in i.culprits]
        return local_table(self.spark, "scenario string, op string", rows)


def totals(game: DataFrame, players: DataFrame) -> DataFrame:
    """(scenario, delta, v_anchor): v of everything, and of the anchored sources alone."""
    setting = g.anchors(players)
    joined = game.join(setting, "scenario")
    at = lambda m: F.max(F.when(F.col("mask") == F.col(m), F.col("v")))
    return joined.groupBy("scenario").agg(at("full").alias("delta"), at("held").alias("v_anchor"))


def single_effects(game: DataFrame, players: DataFrame, culprits: DataFrame) -> DataFrame:
    """(scenario, fault_alone, drift_alone).

    Drift is taken per source: jointly, sources that push in opposite directions would cancel.
    """
    singles = (
        players.join(game.withColumnRenamed("mask", "bit"), ["scenario", "bit"], "left")
        .withColumn("v", F.coalesce("v", F.lit(0.0)))
        .join(culprits.distinct().withColumn("guilty", F.lit(True)), ["scenario", "op"], "left")
    )
    return singles.groupBy("scenario").agg(
        F.max(F.when(F.col("guilty"), F.col("v"))).alias("fault_alone"),
        F.max(F.when(F.col("anchored"), F.abs("v"))).alias("drift_alone"),
    )


def efficiency_gap(attribution: DataFrame, game: DataFrame, players: DataFrame) -> DataFrame:
    """(scenario, method, total_phi, to_explain, gap): what an attribution fails to explain."""
    explain = F.when(
        F.col("method").startswith("anchored"), F.col("delta") - F.col("v_anchor")
    ).otherwise(F.col("delta"))
    sums = attribution.groupBy("scenario", "method").agg(F.sum("phi").alias("total_phi"))
    return sums.join(totals(game, players), "scenario").select(
        "scenario", "method", "total_phi", explain.alias("to_explain"),
        F.abs(F.col("total_phi") - explain).alias("gap"),
    )


def max_difference(attribution: DataFrame, a: str, b: str) -> DataFrame:
    """(scenario, max_err): largest disagreement of two methods."""
    pick = lambda m: attribution.where(F.col("method") == m).select(
        "scenario", "op", F.col("phi").alias(f"phi_{'a' if m == a else 'b'}")
    )
    return pick(a).join(pick(b), ["scenario", "op"]).groupBy("scenario").agg(
        F.max(F.abs(F.col("phi_a") - F.col("phi_b"))).alias("max_err")
    )


def boundary_check(game: DataFrame, players: DataFrame) -> DataFrame:
    """(scenario, identity, max_gap): nobody anchored = Shapley; all but i anchored = leave-one-out.

    Each side takes its own route: Shapley from signed subset sums, leave-one-out from two masks.
    """
    empty = g.anchored_shapley(game, g.no_anchor(players), "anchored_empty")
    shapley = subset_shapley(game, players)
    first = compare(empty, shapley, "anchor none = shapley")
    loo = g.leave_one_out(game, players)
    last = (
        players.alias("p")
        .join(players.withColumnRenamed("op", "free").select("scenario", "free"), "scenario")
        .select(
            F.concat_ws("/", "scenario", "free").alias("scenario"), "op", "bit",
            (F.col("op") != F.col("free")).alias("anchored"), "sensitive",
        )
    )
    names = players.select(
        "scenario", F.col("op").alias("free"), F.concat_ws("/", "scenario", "op").alias("key")
    )
    keyed = game.join(names, "scenario").select(F.col("key").alias("scenario"), "mask", "u", "v")
    lone = g.anchored_shapley(keyed, last, "anchored_rest")
    back = lone.join(names.withColumnRenamed("scenario", "s"), F.col("scenario") == F.col("key"))
    back = back.where("op = free").select(F.col("s").alias("scenario"), "method", "op", "phi")
    second = compare(back, loo, "anchor all others = leave-one-out")
    return first.unionByName(second)


def subset_shapley(game: DataFrame, players: DataFrame) -> DataFrame:
    """Shapley value from signed subset sums: each coalition adds to members, takes from others."""
    setting = g.anchors(g.no_anchor(players)).select("scenario", "n_free")
    pairs = game.join(g.core_players(players), "scenario").join(setting, "scenario")
    inside = (F.col("mask").bitwiseAND(F.col("bit")) != 0).cast("int")
    sized = pairs.withColumn("n_free", F.col("n_free").cast("int")).withColumn("inside", inside)
    sized = sized.withColumn("size", F.bit_count("mask") - F.col("inside"))
    weighed = sized.join(g.shapley_weights(game.sparkSession), ["n_free", "size"])
    phi = weighed.groupBy("scenario", "op").agg(
        F.sum((2 * F.col("inside") - 1) * F.col("weight") * F.col("v")).alias("phi")
    )
    return g.with_null_players(phi, players, "shapley")


def compare(a: DataFrame, b: DataFrame, identity: str) -> DataFrame:
    both = a.select("scenario", "op", F.col("phi").alias("pa")).join(
        b.select("scenario", "op", F.col("phi").alias("pb")), ["scenario", "op"]
    )
    return both.groupBy("scenario").agg(F.max(F.abs(F.col("pa") - F.col("pb"))).alias("max_gap")).select(
        "scenario", F.lit(identity).alias("identity"), "max_gap"
    )


def attributions(
    game: DataFrame,
    players: DataFrame,
    orders: DataFrame | None = None,
    drift: DataFrame | None = None,
    methods: Iterable[str] = ("shapley", "anchored", "loo", "stagewise"),
    samples: int = 60,
    seed: int = 1,
) -> DataFrame:
    """All requested methods in one table. `orders` has (scenario, method, pos, op, bit).

    The table has one row per scenario, method and operator: it is run once and kept.
    """
    made = {
        "shapley": lambda: g.exact_shapley(game, players),
        "anchored": lambda: g.anchored_shapley(game, players),
        "loo": lambda: g.leave_one_out(game, players),
        "shapley_mc": lambda: g.sampled_shapley(game, g.no_anchor(players), samples, seed),
        "anchored_mc": lambda: g.sampled_shapley(game, players, samples, seed, "anchored_mc"),
    }
    parts = [made[m]() for m in methods if m in made]
    if orders is not None:
        parts.append(
            g.stagewise(game, players, orders, ["method"]).select("scenario", "method", "op", "phi")
        )
    if drift is not None:
        parts.append(drift)
    return staged_rows(reduce(DataFrame.unionByName, parts))


def model_fits(sink: WorldFrame) -> int:
    """Trainings a game needs: worlds with equal sinks share one."""
    return world_fingerprints(sink).agg(F.count_distinct("fingerprint")).first()[0]


def costs(study: Study, alias: Mapping[int, int]) -> DataFrame:
    """(scenario, n_operators, lattice, model_fits): the size of each scenario's game, and the worlds
    that were scored for it once equal sinks were merged (`Replay.alias`)."""
    n = len(study.pipeline.names)
    rows = [
        (name, n, 1 << n, len({alias[w] for w in pipeline.all_worlds(choice)}))
        for name, (pipeline, choice) in study.scenarios.items()
    ]
    return local_table(study.spark, "scenario string, n_operators long, lattice long, model_fits long", rows)


def frontier_size(study: Study, given: Mapping[str, WorldFrame] | None = None) -> DataFrame:
    """(scenario, frontier): operators that change their own output when only they are flipped."""
    changed = active_frontier(study.pipeline, {i.name: study.choice(i) for i in study.incidents}, given)
    return changed.groupBy("scenario").agg(F.count(F.when(F.col("changed"), 1)).alias("frontier"))


def incident_report(study: Study, game: DataFrame, fits: int, frontier: DataFrame) -> DataFrame:
    """The incident card: ranked anchored blame with culprit and anchor marks, the sums, the cost."""
    players, culprits = study.players(), study.culprits()
    phi = staged_rows(g.anchored_shapley(game, players))
    ranked = scoring.blame_ranking(phi)
    gap = efficiency_gap(phi, game, players).select("scenario", "total_phi", "to_explain", "gap")
    lattice = local_table(
        study.spark, "scenario string, n_operators long, lattice long",
        [(i.name, len(study.pipeline.names), 1 << len(study.pipeline.names)) for i in study.incidents],
    )
    marks = players.select("scenario", "op", "anchored")
    guilty = culprits.distinct().withColumn("is_culprit", F.lit(True))
    return (
        ranked.join(marks, ["scenario", "op"])
        .join(guilty, ["scenario", "op"], "left")
        .join(totals(game, players), "scenario")
        .join(gap, "scenario")
        .join(lattice, "scenario")
        .join(frontier, "scenario")
        .select(
            "scenario", "rank", "op", "phi",
            F.coalesce("is_culprit", F.lit(False)).alias("is_culprit"),
            "anchored", "delta", "v_anchor", "total_phi", "to_explain", "gap",
            "n_operators", "lattice", F.lit(fits).cast("long").alias("model_fits"), "frontier",
        )
    )


def staged_rows(df: DataFrame) -> DataFrame:
    """A report of a few rows, run once and kept, for the summaries built on it."""
    return local_table(df.sparkSession, df.schema, [tuple(r) for r in df.collect()])


# -- drift of every node -------------------------------------------------------------------


def node_drift(study: Study, incidents: list[Incident], given: Mapping[str, WorldFrame] | None = None) -> DataFrame:
    """Drift attribution: how far each operator's own output moved between the two full runs.

    Score = mean over shared numeric columns of |mean shift| / sd at reference (0 or missing sd
    counts as 1) + relative change of the row count + 1 if the column set changed. An operator
    without shared numeric columns has only the schema term. More drift is more blame, so
    phi = -score.
    """
    pipeline, spark = study.pipeline, study.spark
    ends = {i.name: pipeline.world(pipeline.names, study.choice(i)) for i in incidents}
    run = Replay(pipeline, {0, *ends.values()}, cache="wide", given=given)
    profiles, pairs, flags = [], [], []
    for op in pipeline.names:
        frame = run.node(op)
        numeric = numeric_columns(frame.df, [W])
        if numeric:
            profiles.append(profile(frame, numeric).select(F.lit(op).alias("op"), "*"))
        for scenario, world in ends.items():
            local = world & frame.fields
            before, after = frame.columns_in(0), frame.columns_in(local)
            shared = [c for c in numeric if c in before and c in after]
            pairs += [(scenario, op, c, local) for c in shared]
            flags.append((scenario, op, set(before) != set(after), bool(shared)))
    cells = staged_rows(reduce(DataFrame.unionByName, profiles))
    run.release()
    before = cells.where(F.col(W) == 0).select(
        "op", "column", F.col("n_rows").alias("n0"), F.col("mean").alias("m0"), "sd"
    )
    after = cells.select(
        "op", "column", W, F.col("n_rows").alias("n1"), F.col("mean").alias("m1")
    )
    sd = F.when(F.coalesce("sd", F.lit(0.0)) == 0, 1.0).otherwise(F.col("sd"))
    n0, n1 = F.coalesce("n0", F.lit(0)), F.coalesce("n1", F.lit(0))
    wanted = local_table(spark, f"scenario string, op string, column string, {W} long", pairs)
    moved = (
        wanted.join(before, ["op", "column"], "left")
        .join(after, ["op", "column", W], "left")
        .groupBy("scenario", "op")
        .agg(
            F.coalesce(F.avg(F.abs(F.col("m0") - F.col("m1")) / sd), F.lit(0.0)).alias("shift"),
            F.max(F.abs(n0 - n1) / F.greatest(n0, F.lit(1))).alias("rows"),
        )
    )
    listed = local_table(
        spark, "scenario string, op string, schema_changed boolean, measured boolean", flags
    )
    score = F.when(
        F.col("measured"), F.coalesce("shift", F.lit(0.0)) + F.coalesce("rows", F.lit(0.0))
    ).otherwise(0.0) + F.col("schema_changed").cast("double")
    return listed.join(moved, ["scenario", "op"], "left").select(
        "scenario", F.lit("drift").alias("method"), "op", (-score).alias("phi")
    )


# -- scenario summaries --------------------------------------------------------------------


def groups(study: Study) -> DataFrame:
    """(scenario, grp): harmful, benign, and compound for harmful scenarios of several faults."""
    rows = [(i.name, i.group) for i in study.incidents]
    rows += [(i.name, "compound") for i in study.incidents if i.group == "harmful" and "+" in i.name]
    return local_table(study.spark, "scenario string, grp string", rows)


def gate_summary(study: Study, attribution: DataFrame) -> DataFrame:
    """(grp, method, n_scenarios, p_at_1, mrr, mass) for harmful, compound and benign scenarios.

    Benign faults do no harm: their scores say where the little blame goes, `benign_summary` how
    little it is.
    """
    judged = scoring.scores(attribution, study.culprits())
    return (
        judged.join(groups(study), "scenario")
        .groupBy("grp", "method")
        .agg(
            F.count("*").alias("n_scenarios"),
            *[F.avg(c).alias(c) for c in ("p_at_1", "mrr", "mass")],
        )
    )


def benign_summary(study: Study, game: DataFrame, players: DataFrame) -> DataFrame:
    """(scenario, delta, max_abs_phi): benign faults should get next to no blame."""
    phi = g.exact_shapley(game, players)
    largest = phi.groupBy("scenario").agg(F.max(F.abs("phi")).alias("max_abs_phi"))
    return (
        groups(study).where("grp = 'benign'")
        .join(totals(game, players), "scenario")
        .join(largest, "scenario")
        .select("scenario", "delta", "max_abs_phi")
    )


# -- severity ladders ----------------------------------------------------------------------


def ladder(study: Study, game: DataFrame, players: DataFrame, attribution: DataFrame, cost: DataFrame) -> DataFrame:
    """One row per fault and severity: damage, fault-to-drift ratio, gaps, cost, score per method."""
    culprits = study.culprits()
    methods = [m for m in METHODS]
    judged = scoring.scores(attribution, culprits)
    pick = lambda m, c: F.max(F.when(F.col("method") == m, F.col(c)))
    wide = judged.groupBy("scenario").agg(
        *[pick(m, c).alias(f"{m}_{c}") for m in methods for c in ("p_at_1", "mrr")]
    )
    gaps = efficiency_gap(attribution, game, players).groupBy("scenario").agg(
        pick("anchored", "gap").alias("anchored_eff_gap"), pick("loo", "gap").alias("loo_eff_gap")
    )
    names = local_table(
        study.spark, "scenario string, fault_type string, severity string, culprit string",
        [(i.name, *i.name.split("/", 1), i.culprits[0]) for i in study.incidents],
    )
    ratio = F.abs("fault_alone") / F.greatest("drift_alone", F.lit(TINY_DRIFT))
    return (
        names.join(totals(game, players), "scenario")
        .join(single_effects(game, players, culprits), "scenario")
        .join(gaps, "scenario")
        .join(wide, "scenario")
        .join(cost, "scenario")
        .select(
            "fault_type", "severity", "culprit", "delta", "fault_alone", "drift_alone",
            ratio.alias("ratio"), "anchored_eff_gap", "loo_eff_gap",
            *[c for c in cost.columns if c != "scenario"],
            (F.abs("delta") >= MEASURABLE).alias("measurable"),
            *[f"{m}_{c}" for m in methods for c in ("p_at_1", "mrr")],
        )
    )


def ratio_bins(rows: DataFrame, bins) -> DataFrame:
    """(ratio_bin, n, one p@1 column per method) over measurable rows, and all of them together."""
    live = rows.where("measurable")
    label = F.lit(None).cast("string")
    for low, high, name in reversed(bins):
        inside = F.col("ratio") >= low
        if high is not None:
            inside = inside & (F.col("ratio") < high)
        label = F.when(inside, name).otherwise(label)
    means = [F.avg(f"{m}_p_at_1").alias(m) for m in METHODS]
    binned = live.groupBy(label.alias("ratio_bin")).agg(F.count("*").alias("n"), *means)
    overall = live.groupBy(F.lit("OVERALL").alias("ratio_bin")).agg(F.count("*").alias("n"), *means)
    return binned.unionByName(overall)


def excluded(rows: DataFrame) -> DataFrame:
    """(fault_type, severity): incidents too small to be read."""
    return rows.where(~F.col("measurable")).select("fault_type", "severity")


def method_agreement(rows: DataFrame) -> DataFrame:
    """Do anchored blame and leave-one-out name the same culprit, and do they add up?"""
    same = F.col("anchored_p_at_1") == F.col("loo_p_at_1")
    return rows.agg(
        F.count(F.when(F.col("measurable") & same, 1)).alias("agree"),
        F.count(F.when(F.col("measurable"), 1)).alias("live"),
        F.max("anchored_eff_gap").alias("anchored_gap_max"),
        F.max("loo_eff_gap").alias("loo_gap_max"),
        F.avg("loo_eff_gap").alias("loo_gap_mean"),
    )


def case_validity(rows: DataFrame) -> DataFrame:
    """Add degraded, harmful, valid, reason: only a fault that does harm has a culprit to find."""
    degraded, harmful = F.col("delta") <= HARM, F.col("fault_alone") <= HARM
    reason = (
        F.when(~harmful, "fault does no harm").when(~degraded, "no net degradation").otherwise("valid")
    )
    return rows.withColumns(
        {"degraded": degraded, "harmful": harmful, "valid": degraded & harmful, "reason": reason}
    )


def validity_summary(rows: DataFrame) -> DataFrame:
    """(method, n, p_at_1, mrr) over the valid cases of a ladder."""
    cells = F.explode(
        F.array(
            *[
                F.struct(F.lit(m).alias("method"), F.col(f"{m}_p_at_1").alias("p"), F.col(f"{m}_mrr").alias("r"))
                for m in METHODS
            ]
        )
    )
    judged = case_validity(rows).where("valid").select(cells.alias("c")).select("c.*")
    return judged.groupBy("method").agg(
        F.count("*").alias("n"), F.avg("p").alias("p_at_1"), F.avg("r").alias("mrr")
    )


def drift_floor(study: Study, game: DataFrame, players: DataFrame) -> DataFrame:
    """(max_drift, negligible): with no drift to hold fixed, anchoring cannot make a difference."""
    effects = single_effects(game, players, study.culprits())
    return effects.agg(F.max("drift_alone").alias("max_drift")).withColumn(
        "negligible", F.col("max_drift") < DRIFT_FLOOR
    )


# -- order dependence ----------------------------------------------------------------------


def order_dependence(study: Study, blame: DataFrame, orders: int, game: DataFrame, players: DataFrame) -> DataFrame:
    """How far stagewise blame of each operator swings over all topological orders.

    `blame` is `step_blame` of the study's downset steps and `orders` their number. An operator's
    blame in an order depends only on the set before it, so the extremes over the steps are those
    over the orders, however many there are.
    """
    anchored = g.anchored_shapley(game, players).select("scenario", "op", F.col("phi").alias("anchored"))
    guilty = study.culprits().distinct().withColumn("is_culprit", F.lit(True))
    low, high = F.col("stagewise_min"), F.col("stagewise_max")
    return (
        blame.groupBy("scenario", "op")
        .agg(F.min("phi").alias("stagewise_min"), F.max("phi").alias("stagewise_max"))
        .join(anchored, ["scenario", "op"])
        .join(players.select("scenario", "op", F.col("anchored").alias("is_source")), ["scenario", "op"])
        .join(guilty, ["scenario", "op"], "left")
        .select(
            "scenario", "op", F.coalesce("is_culprit", F.lit(False)).alias("is_culprit"),
            "is_source", F.lit(orders).cast("long").alias("n_orders"), "stagewise_min", "stagewise_max",
            (high - low).alias("spread"),
            ((low < -SIGN_EPS) & (high > SIGN_EPS)).alias("sign_flips"), "anchored",
        )
    )


def order_top_blamed(study: Study, blame: DataFrame) -> DataFrame:
    """(scenario, op, n_orders, is_culprit): in how many orders a stagewise walk blames whom first.

    Steps are ranked by blame, ties by name, as in a ranking of one order. The orders all of whose
    steps rank k or later are counted along the downsets, for every k at once; those that lack a step
    of rank k among them are the ones counted for k + 1, so the differences belong to k alone.
    """
    rank = F.dense_rank().over(Window.partitionBy("scenario").orderBy(F.round("phi", 9), "op"))
    ranked = lineage.kept(blame.withColumn("key", rank).select("scenario", "done", "op", "bit", "key"))
    keys = lineage.kept(ranked.select("scenario", "key", "op").distinct())
    now = keys.select("scenario", F.col("key").alias("least"), F.lit(0).cast("long").alias("done"), F.lit(1).cast(lineage.COUNT).alias("orders"))
    for _ in study.pipeline.names:
        taken = now.join(ranked, ["scenario", "done"]).where(F.col("key") >= F.col("least"))
        reached = taken.groupBy("scenario", "least", F.col("done").bitwiseOR(F.col("bit")).alias("done"))
        now = lineage.kept(reached.agg(F.sum("orders").cast(lineage.COUNT).alias("orders")))
    from_here = now.select("scenario", F.col("least").alias("key"), "orders")
    counted = keys.join(from_here, ["scenario", "key"], "left").withColumn("orders", F.coalesce("orders", F.lit(0)))
    later = F.coalesce(F.lead("orders").over(Window.partitionBy("scenario").orderBy("key")), F.lit(0))
    first = counted.withColumn("first", F.col("orders") - later).groupBy("scenario", "op").agg(F.sum("first").cast("long").alias("n_orders"))
    guilty = study.culprits().distinct().withColumn("is_culprit", F.lit(True))
    return (
        first.where("n_orders > 0")
        .join(guilty, ["scenario", "op"], "left")
        .select("scenario", "op", "n_orders", F.coalesce("is_culprit", F.lit(False)).alias("is_culprit"))
    )


# -- scaling -------------------------------------------------------------------------------


def scale_row(
    study: Study, m: int, utility: Callable[[WorldFrame], DataFrame], samples: int, seed: int, measure: Callable | None = None
) -> DataFrame:
    """Cost and result of one DAG width: lattice against distinct sinks, frontier, top blame.

    Only the worlds that exact and sampled anchored values read are replayed. Game and frontier read
    the same sources, and equal sinks are scored once. `measure` is what the utility needs of a sink
    (see `Replay`), if that is all it reads.
    """
    incident, players = study.incidents[0], study.players()
    coalitions = study.walked_coalitions(players, samples, seed)
    worlds = sorted({r[W] for r in coalitions.collect()})
    with wide_sources(study.pipeline) as given:
        run = Replay(study.pipeline, worlds, merge="sink", given=given, measure=measure)
        sink = run.sink()
        game = staged_rows(study.game(run.spread(utility(sink)), coalitions))
        frontier = active_frontier(study.pipeline, given=given).where("changed").count()
        run.release()
    exact = g.anchored_shapley(game, players)
    sampled = g.sampled_shapley(game, players, samples, seed, "anchored_mc")
    error = max_difference(exact.unionByName(sampled), "anchored", "anchored_mc")
    top = scoring.blame_ranking(sampled).where("rank = 1").select("scenario", F.col("op").alias("top_blame"))
    n = len(study.pipeline.names)
    facts = local_table(
        study.spark,
        "scenario string, m long, n long, lattice long, model_fits long, frontier long, culprit string",
        [(incident.name, m, n, 1 << n, len(set(run.alias.values())), frontier, incident.culprits[0])],
    )
    measurable = F.abs("delta") >= MEASURABLE
    return (
        facts.join(error, "scenario")
        .join(totals(game, players), "scenario")
        .join(top, "scenario")
        .select(
            "m", "n", "lattice", "model_fits",
            (F.col("lattice") / F.col("model_fits")).alias("reduction"),
            "frontier", F.col("max_err").alias("mc_max_err"), "delta",
            measurable.alias("measurable"), "top_blame", "culprit",
            (measurable & (F.col("top_blame") == F.col("culprit"))).alias("correct"),
        )
    )
