"""The cooperative game over coalition masks, and the attribution methods.

Tables (a `scenario` column keys all of them, so many incidents are attributed in one plan):

  players(scenario, op, bit, anchored, sensitive)
  game(scenario, mask, u, v)          masks range over the *sensitive* players
  attribution(scenario, method, op, phi)

An insensitive operator runs the same function on the same inputs in both states. It is a null
player: its value is exactly 0 and leaving it out changes nobody else's. So the game holds 2^k
masks for k sensitive operators, whatever the size of the DAG, and null players get their zero
at the end.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from math import comb

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from blamesplit.functions.local import MAX_LOCAL_ROWS, local_table
from blamesplit.plans.pipeline import Pipeline
from blamesplit.plans.worlds import W

# Fixed values of the permutation order (a quadratic hash modulo a Mersenne prime).
PRIME = 2147483647
PERM_FACTOR, SLOT_FACTOR, SEED_FACTOR, MIX_FACTOR = 7919, 104729, 1299721, 48271


def long(value: int) -> Column:
    return F.lit(value).cast("long")


def has(mask: Column, bits: Column) -> Column:
    return mask.bitwiseAND(bits) == bits


# -- inputs --------------------------------------------------------------------------------


def players_table(
    spark: SparkSession, scenarios: Mapping[str, tuple[Pipeline, Mapping[str, int]]]
) -> DataFrame:
    """One row per scenario and operator. Sources are the default anchor."""
    rows = []
    for name, (pipeline, choice) in scenarios.items():
        for op in pipeline.names:
            moves = op in pipeline.fields and pipeline.world([op], choice) != 0
            rows.append((name, op, pipeline.bit(op), op in pipeline.sources, moves))
    return local_table(
        spark, "scenario string, op string, bit long, anchored boolean, sensitive boolean", rows
    )


def coalition_worlds(
    spark: SparkSession, scenarios: Mapping[str, tuple[Pipeline, Mapping[str, int]]]
) -> DataFrame:
    """(scenario, mask, w): every coalition of sensitive players and the world it runs in.

    Coalition number k of a scenario puts its moving players in where k has ones. Few are listed as
    a local table; many are made by the executors, so their number is not bounded by the driver.
    """
    steps = {
        name: [(pipeline.bit(op), step) for op in pipeline.fields if (step := pipeline.world([op], choice))]
        for name, (pipeline, choice) in scenarios.items()
    }
    if sum(1 << len(moving) for moving in steps.values()) <= MAX_LOCAL_ROWS:
        rows = []
        for name, moving in steps.items():
            pairs = [(0, 0)]
            for bit, step in moving:
                pairs += [(m | bit, w + step) for m, w in pairs]
            rows += [(name, m, w) for m, w in pairs]
        return local_table(spark, f"scenario string, mask long, {W} long", rows)
    parts = []
    for name, moving in steps.items():
        taken = [F.shiftright("id", k).bitwiseAND(long(1)) for k in range(len(moving))]
        mask, world = (reduce(Column.__add__, (t * long(s[i]) for t, s in zip(taken, moving, strict=True)), long(0)) for i in (0, 1))
        parts.append(spark.range(1 << len(moving)).select(F.lit(name).alias("scenario"), mask.alias("mask"), world.alias(W)))
    return reduce(DataFrame.unionByName, parts)


def anchored_worlds(
    spark: SparkSession, scenarios: Mapping[str, tuple[Pipeline, Mapping[str, int]]]
) -> DataFrame:
    """(scenario, mask, w): the coalitions that anchored values read, and the empty one.

    With the anchored players held, 2^f coalitions are left for f free sensitive players, however
    many sources move: the exact game of a wide DAG with few faults.
    """
    rows = []
    for name, (pipeline, choice) in scenarios.items():
        moving = [n for n in pipeline.fields if pipeline.world([n], choice)]
        held = [n for n in moving if n in pipeline.sources]
        teams = [held]
        for op in moving:
            if op not in held:
                teams += [[*t, op] for t in teams]
        found = {(sum(map(pipeline.bit, t)), pipeline.world(t, choice)) for t in [[], *teams]}
        rows += [(name, m, w) for m, w in sorted(found)]
    return local_table(spark, f"scenario string, mask long, {W} long", rows)


def game_table(coalitions: DataFrame, utility: DataFrame) -> DataFrame:
    """game(scenario, mask, u, v) with v relative to the scenario's empty coalition."""
    valued = coalitions.join(utility, W)
    base = Window.partitionBy("scenario")
    u0 = F.max(F.when(F.col("mask") == 0, F.col("u"))).over(base)
    return valued.select("scenario", "mask", "u", (F.col("u") - u0).alias("v"))


def full_lattice(game: DataFrame, pipeline: Pipeline, scenario: str) -> DataFrame:
    """Values of all 2^n coalitions of one scenario, insensitive operators included."""
    spark = game.sparkSession
    masks = spark.range(pipeline.full_mask + 1).select(
        F.col("id").alias("mask"),
        F.col("id").bitwiseAND(long(pipeline.sensitive_mask)).alias("core"),
    )
    core = game.where(F.col("scenario") == scenario).withColumnRenamed("mask", "core")
    return masks.join(core, "core").select("scenario", "mask", "u", "v")


def core_players(players: DataFrame) -> DataFrame:
    return players.where("sensitive")


def anchors(players: DataFrame) -> DataFrame:
    """(scenario, held, n_free): held = sensitive anchored bits, n_free = sensitive free players."""
    held = F.when(F.col("anchored") & F.col("sensitive"), F.col("bit")).otherwise(0)
    free = F.when(~F.col("anchored") & F.col("sensitive"), 1).otherwise(0)
    return players.groupBy("scenario").agg(
        F.sum(held).alias("held"),
        F.sum(free).alias("n_free"),
        F.sum(F.when(F.col("sensitive"), F.col("bit")).otherwise(0)).alias("full"),
    )


def with_null_players(phi: DataFrame, players: DataFrame, method: str) -> DataFrame:
    """Complete a method's result to all players; those without a value get 0."""
    return players.join(phi, ["scenario", "op"], "left").select(
        "scenario", F.lit(method).alias("method"), "op", F.coalesce("phi", F.lit(0.0)).alias("phi")
    )


# -- exact values --------------------------------------------------------------------------


def shapley_weights(spark: SparkSession, most: int = 63) -> DataFrame:
    """(n_free, size, weight): size! (n - size - 1)! / n! for up to `most` players, from whole numbers."""
    rows = [(n, k, 1 / (n * comb(n - 1, k))) for n in range(1, most + 1) for k in range(n)]
    return local_table(spark, "n_free int, size int, weight double", rows)


def needed(value: Column, coalition: Column) -> Column:
    """`value`, or an error that names the coalition which the game lacks."""
    missing = F.raise_error(F.concat(F.lit("the game has no value for coalition "), coalition.cast("string")))
    return F.when(value.isNotNull(), value).otherwise(missing.cast("double"))


def anchored_shapley(game: DataFrame, players: DataFrame, method: str = "anchored") -> DataFrame:
    """Exact Shapley value with the anchored players held at incident state.

    They get 0; the free players share v(all) - v(anchor) exactly. A scenario with no free player
    has no result rows. A game without the whole lattice over the free players is an error.

    A coalition T of size t counts for its members with weight (t - 1), against the others with
    weight t, so one pass that sums v by size, for all coalitions and for those of each player,
    replaces the join of every coalition with its neighbours: a row per scenario and size leaves it.
    """
    setting = anchors(players)
    free = core_players(players).where(~F.col("anchored")).select("scenario", "op", "bit")
    bits = sorted({r.bit for r in free.select("bit").distinct().collect()})
    size = (F.bit_count(F.col("mask")) - F.bit_count("held")).cast("int")
    reached = game.join(setting, "scenario").where(has(F.col("mask"), F.col("held")))
    by_size = reached.groupBy("scenario", "n_free", size.alias("size")).agg(
        F.count("v").alias("n"),
        F.sum("v").alias("total"),
        *[F.sum(F.when(F.col("mask").bitwiseAND(long(b)) != 0, F.col("v"))).alias(f"with_{b}") for b in bits],
    )
    cells = F.explode(F.array(*[F.struct(long(b).alias("bit"), F.col(f"with_{b}").alias("inside")) for b in bits] or [F.struct(long(0).alias("bit"), F.lit(0.0).alias("inside"))]))
    weights = shapley_weights(game.sparkSession)
    joining = weights.select("n_free", (F.col("size") + 1).alias("size"), F.col("weight").alias("joining"))
    weighed = (
        by_size.select("scenario", F.col("n_free").cast("int").alias("n_free"), "size", "n", "total", cells.alias("c"))
        .select("scenario", "n_free", "size", "n", "total", "c.bit", F.coalesce("c.inside", F.lit(0.0)).alias("inside"))
        .join(joining, ["n_free", "size"], "left")
        .join(weights, ["n_free", "size"], "left")
    )
    gain = F.col("inside") * F.coalesce("joining", F.lit(0.0)) - (F.col("total") - F.col("inside")) * F.coalesce("weight", F.lit(0.0))
    sums = free.join(weighed, ["scenario", "bit"]).groupBy("scenario", "op").agg(
        F.sum(gain).alias("phi"), F.sum("n").alias("n"), F.max("n_free").alias("n_free")
    )
    whole = F.col("n").cast("double") == F.pow(F.lit(2.0), F.col("n_free"))
    short = F.raise_error(F.concat(F.lit("the game lacks coalitions of scenario "), F.col("scenario")))
    phi = free.join(sums, ["scenario", "op"], "left").select(
        "scenario", "op", F.when(whole, F.col("phi")).otherwise(short.cast("double")).alias("phi")
    )
    some_free = players.where(~F.col("anchored")).select("scenario").distinct()
    return with_null_players(phi, players, method).join(some_free, "scenario", "left_semi")


def exact_shapley(game: DataFrame, players: DataFrame, method: str = "shapley") -> DataFrame:
    """Exact Shapley value: the anchored value with nobody anchored."""
    return anchored_shapley(game, players.withColumn("anchored", F.lit(False)), method)


# -- walks ---------------------------------------------------------------------------------


def permutations(players: DataFrame, count: int, seed: int) -> DataFrame:
    """(scenario, perm, pos, op, bit): pseudo-random player orders, the same in every run."""
    slot = F.row_number().over(Window.partitionBy("scenario").orderBy("op")).cast("long")
    drawn = players.withColumn("slot", slot).withColumn(
        "perm", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(count).cast("long")))
    )
    x = (F.col("perm") * PERM_FACTOR + F.col("slot") * SLOT_FACTOR + seed * SEED_FACTOR) % PRIME
    y = (F.col("x") * F.col("x")) % PRIME
    z = (F.col("y") * MIX_FACTOR + F.col("x")) % PRIME
    keyed = drawn.withColumn("x", x).withColumn("y", y).withColumn("z", (z * z) % PRIME)
    order = Window.partitionBy("scenario", "perm").orderBy("z", "op")
    return keyed.select(
        "scenario", "perm", F.row_number().over(order).alias("pos"), "op", "bit"
    )


def walk(game: DataFrame, players: DataFrame, orders: DataFrame, keys: list[str]) -> DataFrame:
    """Marginal contribution of each operator along each order, starting at the anchor.

    `orders` has (scenario, *keys, pos, op, bit); anchored players must not be in it.
    """
    setting = anchors(players).select("scenario", "held", "full")
    spec = Window.partitionBy("scenario", *keys).orderBy("pos")
    running = F.sum("bit").over(spec.rowsBetween(Window.unboundedPreceding, 0))
    masks = orders.join(setting, "scenario").withColumn(
        "mask", (running.bitwiseAND(F.col("full"))).bitwiseOR(F.col("held"))
    )
    start = game.join(setting, (game["scenario"] == setting["scenario"]) & (game["mask"] == setting["held"]))
    start = start.select(game["scenario"], F.col("v").alias("v_start"))
    valued = masks.join(game.select("scenario", "mask", "v"), ["scenario", "mask"], "left")
    valued = valued.withColumn("v", needed(F.col("v"), F.col("mask"))).join(start, "scenario", "left")
    previous = F.coalesce(F.lag("v").over(spec), needed(F.col("v_start"), F.col("held")))
    return valued.select("scenario", *keys, "pos", "op", (F.col("v") - previous).alias("phi"))


def no_anchor(players: DataFrame) -> DataFrame:
    return players.withColumn("anchored", F.lit(False))


def sampled_shapley(
    game: DataFrame, players: DataFrame, count: int = 200, seed: int = 0, method: str = "shapley_mc"
) -> DataFrame:
    """Permutation-sampled value from the anchor upwards (pass `no_anchor(players)` for Shapley)."""
    free = players.where(~F.col("anchored")).select("scenario", "op", "bit")
    steps = walk(game, players, permutations(free, count, seed), ["perm"])
    phi = steps.groupBy("scenario", "op").agg((F.sum("phi") / count).alias("phi"))
    return with_null_players(phi, players, method)


def sampled_coalitions(players: DataFrame, count: int, seed: int) -> DataFrame:
    """(scenario, mask): the coalitions that `sampled_shapley` visits, plus none, anchor and all.

    At most count x players masks per scenario. For many sensitive operators, replay only the
    worlds of these masks instead of the whole lattice.
    """
    free = players.where(~F.col("anchored")).select("scenario", "op", "bit")
    setting = anchors(players).select("scenario", "held", "full")
    spec = Window.partitionBy("scenario", "perm").orderBy("pos")
    running = F.sum("bit").over(spec.rowsBetween(Window.unboundedPreceding, 0))
    visited = (
        permutations(free, count, seed)
        .withColumn("mask", running)
        .join(setting, "scenario")
        .select("scenario", F.expr("(mask & full) | held").alias("mask"))
    )
    ends = setting.select("scenario", F.expr("explode(array(0L, held, full))").alias("mask"))
    return visited.unionByName(ends).distinct()


def leave_one_out(game: DataFrame, players: DataFrame, method: str = "loo") -> DataFrame:
    """v(all) - v(all but i)."""
    full = anchors(players).select("scenario", "full")
    top = game.select("scenario", F.col("mask").alias("full"), F.col("v").alias("v_full"))
    rest = (
        core_players(players)
        .join(full, "scenario")
        .join(top, ["scenario", "full"], "left")
        .withColumn("mask", F.col("full").bitwiseAND(F.bitwise_not("bit")))
        .join(game.select("scenario", "mask", "v"), ["scenario", "mask"], "left")
    )
    loss = needed(F.col("v_full"), F.col("full")) - needed(F.col("v"), F.col("mask"))
    phi = rest.select("scenario", "op", loss.alias("phi"))
    return with_null_players(phi, players, method)


def stagewise(
    game: DataFrame, players: DataFrame, orders: DataFrame, keys: list[str]
) -> DataFrame:
    """Blame along given topological orders: (scenario, *keys, pos, op, phi)."""
    return walk(game, no_anchor(players), orders, keys)


def step_blame(game: DataFrame, players: DataFrame, steps: DataFrame) -> DataFrame:
    """(scenario, done, op, bit, phi) for `steps` (done, op, bit): what an operator adds right after
    the operators in `done`, whichever order they came in."""
    setting = anchors(players).select("scenario", "full")
    placed = players.select("scenario", "op").join(steps.select("done", "op", "bit"), "op").join(setting, "scenario")
    before = game.select("scenario", F.col("mask").alias("low"), F.col("v").alias("v_before"))
    after = game.select("scenario", F.col("mask").alias("high"), F.col("v").alias("v_after"))
    valued = (
        placed.withColumn("low", F.col("done").bitwiseAND(F.col("full")))
        .withColumn("high", F.col("done").bitwiseOR(F.col("bit")).bitwiseAND(F.col("full")))
        .join(before, ["scenario", "low"], "left")
        .join(after, ["scenario", "high"], "left")
    )
    phi = needed(F.col("v_after"), F.col("high")) - needed(F.col("v_before"), F.col("low"))
    return valued.select("scenario", "done", "op", "bit", phi.alias("phi"))
