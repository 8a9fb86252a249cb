"""Registered queries: name -> (spark, folder) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from datetime import date
from functools import reduce
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, functions as F

from blamesplit.functions import columns as fc
from blamesplit.functions import ordered, skew
from blamesplit.functions import utility as ut
from blamesplit.functions.local import local_table
from blamesplit.functions.stage import kept, shared_folder
from blamesplit.operators import game as g
from blamesplit.operators import lattice, lineage, scoring
from blamesplit.plans import catalogue, customer_value, fan_in, replay, reports, trips
from blamesplit.plans.pipeline import Operator, Pipeline
from blamesplit.plans.replay import Replay
from blamesplit.plans.reports import Study
from blamesplit.sources import files
from blamesplit.sources import tables as src
from blamesplit.sources.tables import Tables
from suite import studies

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
UTILITY_DIGITS = 8
SCORE_DIGITS = 6
PHI_DIGITS = 8
SAMPLES, SEED = 60, 1
CENSUS_DAYS = [date(2024, 1, 28), date(2024, 1, 29), date(2024, 1, 30), date(2024, 1, 31), date(2024, 2, 1)]
DAY = date(2024, 1, 8)
SCAN_COLUMNS = ["l_orderkey", "l_partkey", "l_quantity", "l_extendedprice"]
CONTRACTS = {
    "orders": ["o_orderkey", "o_custkey", "o_totalprice", "o_clerk"],
    "customer": ["c_custkey", "c_acctbal", "c_phone"],
}
FILL_CHECK_FAULTS = {
    "filter_active": [{"min_txn": 2}, {"min_txn": 10}],
    "encode_features": [{"drop_columns": ("income",)}],
}
ALIGNED = ["c_acctbal", "c_nationkey", "credit_limit"]


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def rounded(df: DataFrame, *columns: str, digits: int = PHI_DIGITS) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def customer(spark, folder, faults=None):
    return customer_value.build(Tables(spark, folder), faults)


def trip(spark, folder, faults=None):
    return trips.build(Tables(spark, folder), faults)


def faulted(pipeline, op: str) -> DataFrame:
    """Output of one operator with only itself in incident state."""
    world = pipeline.world([op])
    return Replay(pipeline, [world]).node(op).world(world)


# -- sources -------------------------------------------------------------------------------


@query
def scan_parquet_project(spark, folder):
    return src.load(Tables(spark, folder), "lineitem", SCAN_COLUMNS)


@query
def canonical_columns(spark, folder):
    orders = Tables(spark, folder)("orders")
    shouted = orders.toDF(*[c.upper() for c in orders.columns])
    names = ["o_orderkey", "o_custkey", "o_totalprice"]
    return src.canonical_columns(shouted, names).select(*names)


@query
def contract_check(spark, folder):
    tables = Tables(spark, folder)
    checks = [src.contract(tables(t), cols, t) for t, cols in CONTRACTS.items()]
    return checks[0].unionByName(checks[1])


@query
def day_partition(spark, folder):
    day = src.on_day(Tables(spark, folder)("events"), "ts", DAY)
    part = lambda name: getattr(F, name)("ts").cast("long").alias(name)
    return day.select("event_id", "user_id", part("year"), part("month"), part("day"))


@query
def partition_cap(spark, folder):
    capped = src.cap_days(Tables(spark, folder)("events"), "ts", ["ts", "event_id"], 100)
    return capped.select(F.col("day").cast("string").alias("day"), "event_id")


@query
def partition_census(spark, folder):
    events = Tables(spark, folder)("events")
    census = src.partition_census(events, "ts", CENSUS_DAYS)
    return census.select(F.col("day").cast("string").alias("day"), "n_rows", "thin")


def shared_path(spark, name: str) -> str:
    """A new place in the folder that all executors share."""
    return f"{shared_folder(spark)}/{name}-{uuid4().hex}"


@query
def csv_scan(spark, folder):
    """Suppliers written as CSV and read under a declared schema; empty text is missing."""
    firms = Tables(spark, folder)("supplier").select("s_suppkey", "s_name", "s_nationkey", F.round("s_acctbal", 2).alias("s_acctbal"))
    path = shared_path(spark, "suppliers")
    files.write_table(firms, path, "csv")
    return src.read_csv(spark, path, "s_suppkey long, s_name string, s_nationkey long, s_acctbal double")


@query
def table_write(spark, folder):
    """Active customers written as Parquet and read back through the column contract."""
    active = Replay(customer(spark, folder), [0]).node("filter_active").world(0)
    path = shared_path(spark, "active")
    files.write_table(active, path)
    names = ["customer_id", "txn_count", "total_amount"]
    return src.require_columns(src.canonical_columns(spark.read.parquet(path), names), names, "active").select(*names)


@query
def csv_report(spark, folder):
    """Events by type and day as a CSV report, read again with casts; only valid rows count."""
    events = Tables(spark, folder)("events").withColumn("day", F.to_date("ts").cast("string"))
    counted = events.groupBy("event_type", "day").agg(F.count("*").alias("n_rows"))
    path = shared_path(spark, "report")
    files.write_csv_report(counted.withColumn("valid", F.col("n_rows") >= 10), path)
    return files.read_csv_report(spark, path, {"n_rows": "long"}, "valid").select("event_type", "day", "n_rows")


@query
def incident_json(spark, folder):
    """The incident card written as JSON and read again, a row per operator."""
    card = incident_card(spark, folder, ut.discriminant_utility)
    path = shared_path(spark, "incident")
    files.write_incident_json(card, path, ["scenario", "delta", "model_fits"])
    shape = "scenario string, delta double, model_fits long, attribution map<string, double>, culprits array<string>, sources array<string>"
    found = spark.read.schema(shape).json(path)
    blame = found.select("scenario", "delta", "model_fits", "culprits", "sources", F.explode("attribution").alias("op", "phi"))
    return blame.select(
        "scenario", "delta", "model_fits", "op", "phi",
        F.array_contains("culprits", F.col("op")).alias("is_culprit"), F.array_contains("sources", F.col("op")).alias("is_source"),
    )


@query
def user_operator(spark, folder):
    """A user's plain operator, one that knows nothing of worlds, at the end of the customer pipeline."""

    def by_segment(inputs, params):
        people = inputs["filter_active"].where(F.col("txn_count") >= params["least"])
        return people.groupBy("segment").agg(F.count("*").alias("n_people"), F.sum("txn_count").alias("n_orders"))

    base = customer(spark, folder, FILL_CHECK_FAULTS)
    ops = [base.operators[n] for n in base.names if n != base.sink]
    ops.append(Operator("by_segment", ("filter_active",), replay.isolated(by_segment), {"least": 1}, ({"least": 4},)))
    pipeline = Pipeline(ops, "by_segment")
    return Replay(pipeline, pipeline.every_world()).sink().df.select("w", "segment", "n_people", "n_orders")


# -- row-wise steps ------------------------------------------------------------------------


@query
def filter_valid(spark, folder):
    valid = Replay(trip(spark, folder), [0]).node("filter_valid").world(0)
    return valid.select("trip_id", "payment_type", "fare_amount", "trip_distance")


@query
def filter_active(spark, folder):
    active = Replay(customer(spark, folder), [0]).node("filter_active").world(0)
    return active.select("customer_id", "txn_count", "total_amount")


@query
def clean_customers(spark, folder):
    return Replay(customer(spark, folder), [0]).node("clean_customers").world(0)


@query
def derive_time(spark, folder):
    timed = Replay(trip(spark, folder), [0]).node("derive_time").world(0)
    return timed.select("trip_id", "duration", "hour", "dow")


@query
def one_hot_fixed(spark, folder):
    people = Tables(spark, folder)("customer")
    return people.select("c_custkey", *fc.one_hot("c_mktsegment", customer_value.SEGMENTS[:4], "seg"))


@query
def ratio_label(spark, folder):
    lines = Tables(spark, folder)("lineitem")
    label = fc.ratio_above(F.col("l_tax"), F.col("l_discount"), 0.8)
    return lines.select("l_orderkey", "l_partkey", "l_linenumber", label.alias("label"))


@query
def encode_features(spark, folder):
    return Replay(customer(spark, folder), [0]).sink().world(0)


@query
def encode_trips(spark, folder):
    return faulted(trip(spark, folder, {"encode": [{"drop_columns": ("duration", "hour")}]}), "encode")


@query
def encode_wide(spark, folder):
    return Replay(fan_in.build(Tables(spark, folder), 3), [0]).sink().world(0)


@query
def align_schema(spark, folder):
    people = Tables(spark, folder)("customer")
    return fc.align(people, ["c_custkey", *ALIGNED])


@query
def standardize(spark, folder):
    tables = Tables(spark, folder)
    train = tables("supplier").select("s_suppkey", F.col("s_acctbal").alias("balance"), F.col("s_nationkey").alias("nation"))
    other = tables("customer").select("c_custkey", F.col("c_acctbal").alias("balance"), F.col("c_nationkey").alias("nation"))
    scaled = ut.standardize(train, [other], ["balance", "nation"])[1]
    return rounded(scaled, "balance", "nation", digits=6)


# -- joins ---------------------------------------------------------------------------------


@query
def join_features(spark, folder):
    return Replay(customer(spark, folder), [0]).node("join_features").world(0)


@query
def join_pu_zone(spark, folder):
    return Replay(trip(spark, folder), [0]).node("join_pu_zone").world(0).select("trip_id", "pu_zone", "pu_region")


@query
def join_do_zone(spark, folder):
    return Replay(trip(spark, folder), [0]).node("join_do_zone").world(0).select("trip_id", "do_zone", "do_region")


@query
def join_two_roles(spark, folder):
    both = Replay(trip(spark, folder), [0]).node("join_do_zone").world(0)
    return both.groupBy("pu_region", "do_region").agg(
        F.count("*").alias("n_trips"), F.sum("trip_distance").alias("distance")
    )


@query
def join_stats(spark, folder):
    joined = Replay(trip(spark, folder), [0]).node("join_stats").world(0)
    return joined.select("trip_id", "pu_zone", "zone_mean_fare", "zone_trip_count")


HOT_PARTS = 16


def corrupted_trips(spark, folder):
    """Nine tenths of the pickup zones are one unmatched key: the pipeline measures and cuts it."""
    faults = {"join_pu_zone": [{"corrupt_ids": 0.9}]}
    return trips.build(Tables(spark, folder), faults, parts=HOT_PARTS)


@query
def join_hot_zone(spark, folder):
    joined = faulted(corrupted_trips(spark, folder), "join_pu_zone")
    return joined.select("trip_id", "pu_zone", "pu_region")


@query
def join_hot_stats(spark, folder):
    """Per zone of the corrupted trips, through all three measured joins."""
    pipeline = corrupted_trips(spark, folder)
    world = pipeline.world(["join_pu_zone"])
    joined = Replay(pipeline, [world]).node("join_stats").world(world)
    return joined.groupBy("pu_zone", "do_region").agg(
        F.count("*").alias("n_trips"), F.sum("zone_trip_count").alias("zone_trips")
    )


@query
def hot_zones(spark, folder):
    """The keys that the join cuts, with their rows and pieces."""
    rows = faulted(corrupted_trips(spark, folder), "join_pu_zone").select("pu_zone")
    hot = F.broadcast(skew.hot_keys(rows, ["pu_zone"], HOT_PARTS))
    named = rows.withColumn("key_hash", skew.key_hash(["pu_zone"])).join(hot, "key_hash")
    return named.select("pu_zone", F.col("n").alias("n_trips"), F.col("pieces").cast("long").alias("pieces")).distinct()


@query
def join_all_branches(spark, folder):
    return Replay(fan_in.build(Tables(spark, folder), 5), [0]).node("join_all").world(0)


FAN_OUT_FAULTS = {
    "join_features": [
        catalogue.CUSTOMER_FAULTS["join_fanout_uniform"][1],
        catalogue.CUSTOMER_FAULTS["join_fanout_biased"][1],
    ]
}


def single_worlds(pipeline) -> list[int]:
    """Reference, and each variant of each operator on its own."""
    worlds = {0}
    for name, field in pipeline.fields.items():
        if pipeline.operators[name].parents:
            worlds |= {field.world(c + 1) for c in range(len(pipeline.operators[name].variants))}
    return sorted(worlds)


@query
def join_fanout_ratio(spark, folder):
    pipeline = customer(spark, folder, FAN_OUT_FAULTS)
    run = Replay(pipeline, single_worlds(pipeline))
    joined = run.node("join_features")
    left = run.node("clean_customers").expand(joined.fields)
    rows_in = left.df.groupBy("w").agg(F.count("*").alias("rows_in"))
    rows_out = joined.df.groupBy("w").agg(F.count("*").alias("rows_out"))
    ratio = F.round(F.col("rows_out") / F.col("rows_in"), 6)
    return rows_out.join(rows_in, "w").select("w", "rows_in", "rows_out", ratio.alias("ratio"))


# -- aggregates ----------------------------------------------------------------------------


@query
def agg_transactions(spark, folder):
    return Replay(customer(spark, folder), [0]).node("agg_transactions").world(0)


@query
def zone_stats(spark, folder):
    return Replay(trip(spark, folder), [0]).node("zone_stats").world(0)


@query
def quantile_threshold(spark, folder):
    orders = Tables(spark, folder)("orders")
    both = {"median_price": 0.5, "top_quarter": 0.75}
    found = ordered.exact_quantiles(orders, "o_totalprice", both, ["o_orderstatus"])
    return rounded(found, *both, digits=4)


@query
def column_profile(spark, folder):
    sink = Replay(customer(spark, folder), [0]).sink()
    prof = replay.profile(sink, fc.numeric_columns(sink.df, ["w"]))
    return rounded(prof.select(F.col("column").alias("column_name"), "n_rows", "mean", "sd"), "mean", "sd", digits=4)


@query
def utility_guards(spark, folder):
    pipeline = customer(spark, folder, FILL_CHECK_FAULTS)
    return ut.guards(Replay(pipeline, single_worlds(pipeline)).sink())


@query
def positive_rate(spark, folder):
    tables = Tables(spark, folder)
    parts = [
        probe.agg(F.count("*").alias("n_rows"), F.round(F.avg("label"), 6).alias("positive_rate"))
        .select(F.lit(name).alias("probe"), "n_rows", "positive_rate")
        for name, probe in (
            ("customer_value", customer_value.probe(tables)),
            ("trips", trips.probe(tables)),
            ("fan_in", fan_in.probe(tables, 2)),
        )
    ]
    return reduce(DataFrame.unionByName, parts)


@query
def head_fraction(spark, folder):
    events = Tables(spark, folder)("events")
    return ordered.head_fraction(events, "event_id", 0.3, ["event_type"]).select("event_type", "event_id")


@query
def union_append(spark, folder):
    tables = Tables(spark, folder)
    people = tables("customer").select(F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"))
    firms = tables("supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"))
    return people.unionByName(firms)


# -- perturbations -------------------------------------------------------------------------


@query
def row_selector(spark, folder):
    orders = Tables(spark, folder)("orders")
    return orders.where(fc.selected(F.col("o_orderkey"), 0.25, 7)).select("o_orderkey", "o_custkey")


@query
def perturb_unit(spark, folder):
    return faulted(customer(spark, folder, studies.UNIT_FAULT), "agg_transactions")


@query
def perturb_duration_unit(spark, folder):
    op, params = catalogue.TRIP_FAULTS["unit_change"]
    return faulted(trip(spark, folder, {op: [params]}), op).select("trip_id", "duration")


@query
def perturb_predicate(spark, folder):
    op, params = catalogue.CUSTOMER_FAULTS["predicate_flip"]
    return faulted(customer(spark, folder, {op: [params]}), op).select("customer_id", "txn_count")


def one_fault(spark, folder, name):
    op, params = catalogue.CUSTOMER_FAULTS[name]
    return faulted(customer(spark, folder, {op: [params]}), op)


@query
def perturb_null_mcar(spark, folder):
    return one_fault(spark, folder, "null_spike_mcar")


@query
def perturb_null_mnar(spark, folder):
    return one_fault(spark, folder, "null_spike_mnar")


@query
def perturb_fanout_uniform(spark, folder):
    return one_fault(spark, folder, "join_fanout_uniform")


@query
def perturb_fanout_biased(spark, folder):
    return one_fault(spark, folder, "join_fanout_biased")


@query
def perturb_join_key(spark, folder):
    op, params = catalogue.TRIP_FAULTS["broken_join_key"]
    return faulted(trip(spark, folder, {op: [params]}), op).select("trip_id", "pu_zone", "pu_region")


@query
def perturb_schema(spark, folder):
    return one_fault(spark, folder, "schema_drift")


@query
def perturb_noise_mix(spark, folder):
    mixed = faulted(fan_in.build(Tables(spark, folder), 1, 0, studies.CORRUPT), "agg_0")
    return rounded(mixed, "x0", digits=6)


@query
def fault_catalogue(spark, folder):
    """The ladder with the size of the sink each fault leaves behind on its own."""
    study = studies.ladder(spark, Tables(spark, folder))
    worlds = [
        (*i.name.split("/", 1), study.pipeline.world(i.culprits, i.choice)) for i in study.incidents
    ]
    sink = Replay(study.pipeline, single_worlds(study.pipeline)).sink()
    sizes = ut.metric_utility(sink, F.count("*"))
    where = local_table(spark, "fault_type string, severity string, w long", worlds)
    listed = catalogue.catalogue_table(spark, catalogue.CUSTOMER_SWEEPS)
    return (
        listed.join(where, ["fault_type", "severity"])
        .join(sizes, "w")
        .select("fault_type", "severity", "op", "params", F.col("u").cast("long").alias("sink_rows"))
    )


def with_damage(study: Study, listed: DataFrame) -> DataFrame:
    """A catalogue by scenario, with the size of the sink that each scenario leaves on its own."""
    worlds = [(i.name, study.pipeline.world(i.culprits, i.choice)) for i in study.incidents]
    sizes = ut.metric_utility(Replay(study.pipeline, {w for _, w in worlds}).sink(), F.count("*"))
    where = local_table(study.spark, "scenario string, w long", worlds)
    found = listed.join(where, "scenario").join(sizes, "w")
    return found.select(*listed.columns, F.col("u").cast("long").alias("sink_rows"))


@query
def customer_fault_catalogue(spark, folder):
    """Every fault of the customer pipeline."""
    listed = catalogue.scenario_table(spark, catalogue.CUSTOMER_FAULTS, [(n,) for n in catalogue.CUSTOMER_FAULTS])
    return with_damage(studies.customer_faults(spark, Tables(spark, folder)), listed)


@query
def gate_catalogue(spark, folder):
    """The scenarios of the gate, compound ones included."""
    listed = catalogue.scenario_table(spark, catalogue.CUSTOMER_FAULTS, catalogue.GATE_SCENARIOS)
    return with_damage(studies.gate(spark, Tables(spark, folder)), listed)


@query
def trip_fault_catalogue(spark, folder):
    """Every fault of the trip pipeline."""
    listed = catalogue.scenario_table(spark, catalogue.TRIP_FAULTS, [(n,) for n in catalogue.TRIP_FAULTS])
    return with_damage(studies.trip_faults(spark, Tables(spark, folder)), listed.drop("benign"))


@query
def trip_ladder_catalogue(spark, folder):
    """The severity ladder of the trip pipeline."""
    listed = catalogue.catalogue_table(spark, catalogue.TRIP_SWEEPS)
    named = listed.withColumn("scenario", F.concat_ws("/", "fault_type", "severity"))
    return with_damage(studies.trip_ladder(spark, Tables(spark, folder)), named).drop("scenario")


# -- lineage -------------------------------------------------------------------------------


def node_sizes(spark, folder) -> tuple:
    """The customer pipeline's metadata and the rows every operator puts out at reference."""
    pipeline = customer(spark, folder)
    run = Replay(pipeline, [0])
    parts = [
        run.node(n).df.agg(F.count("*").alias("n_rows")).select(F.lit(n).alias("op"), "n_rows")
        for n in pipeline.names
    ]
    return pipeline, pipeline.nodes(spark), pipeline.edges(spark), reduce(DataFrame.unionByName, parts)


@query
def lineage_ancestors(spark, folder):
    pipeline, nodes, edges, sizes = node_sizes(spark, folder)
    return lineage.ancestors(nodes, edges, "join_features", len(pipeline.names)).join(sizes, "op")


@query
def lineage_sources(spark, folder):
    _, nodes, edges, sizes = node_sizes(spark, folder)
    return lineage.sources(nodes, edges).join(sizes, "op")


@query
def lineage_children(spark, folder):
    _, nodes, edges, sizes = node_sizes(spark, folder)
    return lineage.children(edges, "agg_transactions").join(sizes, "op")


@query
def lineage_depth(spark, folder):
    pipeline, nodes, edges, sizes = node_sizes(spark, folder)
    return lineage.depth(nodes, edges, len(pipeline.names)).join(sizes, "op")


# -- replay --------------------------------------------------------------------------------


@query
def hybrid_replay(spark, folder):
    return studies.unit_change(spark, Tables(spark, folder)).replay().sink().df


@query
def table_fingerprint(spark, folder):
    """Which worlds have a sink with the content of the reference sink?"""
    study = studies.incident(spark, Tables(spark, folder))
    prints = replay.world_fingerprints(study.replay().sink())
    reference = prints.where("w = 0").select("fingerprint")
    same = prints.join(reference.withColumn("same", F.lit(True)), "fingerprint", "left")
    return same.select("w", "n_rows", F.coalesce("same", F.lit(False)).alias("same_as_reference"))


def both_ends(study: Study) -> Replay:
    incident = study.pipeline.world(study.pipeline.names, study.choice(study.incidents[0]))
    return Replay(study.pipeline, [0, incident])


@query
def node_profiles(spark, folder):
    study = studies.unit_change(spark, Tables(spark, folder))
    run = both_ends(study)
    parts = []
    for name in study.pipeline.names:
        frame = run.node(name)
        prof = replay.profile(frame, fc.numeric_columns(frame.df, ["w"]))
        parts.append(prof.select(F.lit(name).alias("op"), (F.col("w") > 0).alias("incident"),
                                 F.col("column").alias("column_name"), "n_rows", "mean", "sd"))
    return rounded(reduce(DataFrame.unionByName, parts), "mean", "sd", digits=3)


@query
def active_frontier(spark, folder):
    study = studies.gate(spark, Tables(spark, folder))
    return replay.active_frontier(study.pipeline, {i.name: study.choice(i) for i in study.incidents})


@query
def sink_sharing(spark, folder):
    study = studies.incident(spark, Tables(spark, folder))
    choice = study.choice(study.incidents[0])
    masks = spark.range(study.pipeline.full_mask + 1).withColumnRenamed("id", "mask")
    masks = masks.withColumn("w", study.pipeline.world_of_mask(F.col("mask"), choice))
    return replay.sink_sharing(study.replay().sink(), len(study.pipeline.names), masks)


@query
def many_worlds(spark, folder):
    """8192 worlds, more than one plan holds: batches over shared operators, one utility table."""
    pipeline = customer(spark, folder, studies.MANY_FAULTS)
    cents = F.sum(F.round(F.col("total_amount") * 100).cast("long"))

    def spent(sink):
        return ut.metric_utility(sink, F.coalesce(cents, F.lit(0)))

    return replay.utility_of(pipeline, pipeline.every_world(), spent)


@query
def merged_worlds(spark, folder):
    """Which world stands for which once equal tables are merged, and the utility trained on it."""
    study = studies.incident(spark, Tables(spark, folder))
    run = study.replay(merge="nodes")
    sink = run.sink()
    utility = coarse(ut.discriminant_utility(sink, customer_value.probe(study.tables), digits=SCORE_DIGITS))
    alias = local_table(spark, "w long, stands_for long", sorted(run.alias.items()))
    fitted = run.spread(utility).join(alias, "w").withColumn("model_fits", F.lit(len(sink.worlds)).cast("long"))
    run.release()
    return fitted


# -- utility and game ----------------------------------------------------------------------


def coarse(utility: DataFrame) -> DataFrame:
    """Utilities to eight digits, so that results do not hang on the order of float sums."""
    return utility.select("w", F.round("u", UTILITY_DIGITS).alias("u"))


def scored(study: Study, given=None) -> tuple[DataFrame, DataFrame]:
    """The study's game by the closed-form scorer, and its players."""
    tables = study.tables
    sink = study.replay(given=given).sink()
    utility = coarse(ut.discriminant_utility(sink, customer_value.probe(tables), digits=SCORE_DIGITS))
    return study.game(utility), study.players()


def side_by_side(*jobs):
    """Run independent Spark jobs at the same time."""
    with ThreadPoolExecutor(len(jobs)) as pool:
        return [f.result() for f in [pool.submit(job) for job in jobs]]


def incident_game(spark, folder):
    study = studies.incident(spark, Tables(spark, folder))
    game, players = scored(study)
    return study, game, players


@query
def roc_auc(spark, folder):
    tables = Tables(spark, folder)
    marked = tables("documents").join(tables("labels"), "doc_id")
    return rounded(ut.roc_auc(marked, ["lang"], "n_chars", "quality"), "auc", digits=6)


@query
def roc_auc_missing(spark, folder):
    """AUC where scores and labels are missing: such rows cannot be ranked and do not count."""
    tables = Tables(spark, folder)
    marked = tables("documents").join(tables("labels"), "doc_id", "left")
    some = marked.withColumn("score", F.when(F.col("doc_id") % 7 != 0, F.col("n_chars")))
    return rounded(ut.roc_auc(some, ["source"], "score", "toxic"), "auc", digits=6)


@query
def utility_lda(spark, folder):
    study = studies.incident(spark, Tables(spark, folder))
    return coarse(ut.discriminant_utility(study.replay().sink(), customer_value.probe(study.tables), digits=SCORE_DIGITS))


def logistic(study: Study) -> DataFrame:
    return coarse(ut.logistic_utility(study.replay().sink(), customer_value.probe(study.tables), digits=SCORE_DIGITS))


@query
def utility_lr(spark, folder):
    study = studies.incident(spark, Tables(spark, folder))
    return logistic(study)


PAIR = ["income", "avg_amount"]


@query
def utility_lr_pair(spark, folder):
    """Logistic regressions of two features: their weights, and the AUC on the probe."""
    study = studies.unit_change(spark, Tables(spark, folder))
    sink = study.replay().sink().rows(lambda df: df.select("w", *PAIR, "label"))
    weights = ut.logistic_weights(sink)
    probe = customer_value.probe(study.tables).select(*PAIR, "label")
    scored = coarse(ut.linear_auc(sink, weights, probe, digits=SCORE_DIGITS))
    rows = [(w, *[round(weights.get(w, {}).get(c, 0.0), 9) for c in PAIR]) for w in sink.worlds]
    return scored.join(local_table(spark, "w long, income double, avg_amount double", rows), "w")


@query
def utility_metric(spark, folder):
    study = studies.incident(spark, Tables(spark, folder))
    orders = F.sum("txn_count")
    return ut.metric_utility(study.replay().sink(), F.coalesce(orders, F.lit(0)))


@query
def game_values(spark, folder):
    study, game, _ = incident_game(spark, folder)
    return rounded(g.full_lattice(game, study.pipeline, studies.INCIDENT.name), "u", "v")


def _counts(table) -> bytes:
    """Rows and orders of both classes, as eight-byte numbers."""
    label, orders = (table[c].to_numpy(zero_copy_only=False) for c in ("label", "txn_count"))
    return b"".join(int(x).to_bytes(8, "little") for y in (0, 1) for x in ((label == y).sum(), orders[label == y].sum()))


def _numbers(state: bytes) -> list[int]:
    return [int.from_bytes(state[k : k + 8], "little") for k in range(0, 32, 8)]


def _difference(state: bytes) -> float:
    n0, s0, n1, s1 = _numbers(state)
    return (s1 / n1 if n1 else 0.0) - (s0 / n0 if n0 else 0.0)


@query
def utility_python(spark, folder):
    """A user's own utility in Python, how many more orders the one class has, folded over batches."""
    study = studies.incident(spark, Tables(spark, folder))
    kept = study.replay().sink().rows(lambda df: df.select("w", "txn_count", "label").where("txn_count IS NOT NULL"))
    added = lambda a, b: b"".join((x + y).to_bytes(8, "little") for x, y in zip(_numbers(a), _numbers(b), strict=True))
    return coarse(ut.python_utility(kept, ut.Fold(_counts, added, _difference)))


@query
def probe_table(spark, folder):
    return customer_value.probe(Tables(spark, folder))


# -- attribution ---------------------------------------------------------------------------


@query
def shapley_exact(spark, folder):
    _, game, players = incident_game(spark, folder)
    return rounded(g.exact_shapley(game, players), "phi")


@query
def shapley_many_players(spark, folder):
    """Every source of documents is a player, and a coalition is worth the text lengths it covers."""
    docs = Tables(spark, folder)("documents")
    names = [r.source for r in docs.select("source").where("source IS NOT NULL").distinct().orderBy("source").collect()]
    rows = [("coverage", s, 1 << k, False, True) for k, s in enumerate(names)]
    players = local_table(spark, "scenario string, op string, bit long, anchored boolean, sensitive boolean", rows)
    holds = docs.join(players.select(F.col("op").alias("source"), "bit"), "source")
    items = holds.groupBy("n_chars").agg(F.bit_or("bit").alias("mask"))
    game = lattice.coverage_game(items, len(names), "coverage")
    return rounded(g.exact_shapley(game, players), "phi", digits=6)


@query
def shapley_mc(spark, folder):
    _, game, players = incident_game(spark, folder)
    return rounded(g.sampled_shapley(game, g.no_anchor(players), SAMPLES, SEED), "phi")


@query
def shapley_anchored(spark, folder):
    _, game, players = incident_game(spark, folder)
    return rounded(g.anchored_shapley(game, players), "phi")


@query
def shapley_anchored_mc(spark, folder):
    _, game, players = incident_game(spark, folder)
    return rounded(g.sampled_shapley(game, players, SAMPLES, SEED, "anchored_mc"), "phi")


@query
def leave_one_out(spark, folder):
    _, game, players = incident_game(spark, folder)
    return rounded(g.leave_one_out(game, players), "phi")


def orders_of(study: Study, limit: int | None) -> DataFrame:
    """(order_id, pos, op, bit): the first topological orders of the study's pipeline, or all."""
    pipeline, spark = study.pipeline, study.spark
    return lineage.kept(lineage.topological_orders(pipeline.nodes(spark), pipeline.edges(spark), len(pipeline.names), limit))


def for_all(study: Study, orders: DataFrame) -> DataFrame:
    names = F.array(*[F.lit(i.name) for i in study.incidents])
    return orders.withColumn("scenario", F.explode(names))


@query
def topological_orders(spark, folder):
    """All orders of the pipeline with the blame a walk along each of them gives."""
    study, game, players = incident_game(spark, folder)
    steps = g.stagewise(game, players, for_all(study, orders_of(study, None)), ["order_id"])
    return rounded(steps.select("order_id", "pos", "op", "phi"), "phi")


@query
def stagewise(spark, folder):
    study, game, players = incident_game(spark, folder)
    first = for_all(study, orders_of(study, 1))
    return rounded(g.stagewise(game, players, first, ["order_id"]).select("scenario", "pos", "op", "phi"), "phi")


@query
def node_drift(spark, folder):
    study = studies.incident(spark, Tables(spark, folder))
    return rounded(reports.node_drift(study, [study.incidents[0]]), "phi", digits=6)


# -- scores --------------------------------------------------------------------------------


def judged(spark, folder):
    """Four methods on the incident, and its culprits."""
    study, game, players = incident_game(spark, folder)
    first = for_all(study, orders_of(study, 1)).withColumn("method", F.lit("stagewise"))
    table = reports.attributions(game, players, first, None, ("shapley", "anchored", "loo"))
    return study, game, players, table


@query
def blame_ranking(spark, folder):
    _, _, _, table = judged(spark, folder)
    return rounded(scoring.blame_ranking(table), "phi")


@query
def precision_at_1(spark, folder):
    study, _, _, table = judged(spark, folder)
    return scoring.precision_at_1(table, study.culprits())


@query
def reciprocal_rank(spark, folder):
    study, _, _, table = judged(spark, folder)
    return rounded(scoring.reciprocal_rank(table, study.culprits()), "mrr", digits=6)


@query
def blame_mass(spark, folder):
    study, _, _, table = judged(spark, folder)
    return rounded(scoring.blame_mass(table, study.culprits()), "mass", digits=6)


# -- reports -------------------------------------------------------------------------------


@query
def efficiency_gap(spark, folder):
    _, game, players, table = judged(spark, folder)
    gaps = reports.efficiency_gap(table, game, players)
    return rounded(gaps, "total_phi", "to_explain", "gap")


@query
def mc_error(spark, folder):
    _, game, players = incident_game(spark, folder)
    both = g.exact_shapley(game, players).unionByName(
        g.sampled_shapley(game, g.no_anchor(players), SAMPLES, SEED)
    )
    return rounded(reports.max_difference(both, "shapley", "shapley_mc"), "max_err")


@query
def boundary_check(spark, folder):
    _, game, players = incident_game(spark, folder)
    return rounded(reports.boundary_check(game, players), "max_gap")


@query
def report_gate(spark, folder):
    study = studies.gate(spark, Tables(spark, folder))
    with replay.wide_sources(study.pipeline) as given:
        (game, players), drift = side_by_side(
            lambda: scored(study, given), lambda: reports.node_drift(study, study.incidents, given)
        )
    table = gate_attributions(study, game, players, drift)
    return rounded(reports.gate_summary(study, table), "p_at_1", "mrr", "mass", digits=6)


def gate_attributions(study, game, players, drift):
    all_orders = orders_of(study, None)
    last = all_orders.agg(F.max("order_id").alias("order_id"))
    ends = for_all(
        study,
        all_orders.where("order_id = 1").withColumn("method", F.lit("stagewise_a")).unionByName(
            all_orders.join(last, "order_id").withColumn("method", F.lit("stagewise_b"))
        ),
    )
    return reports.attributions(
        game, players, ends, drift, ("shapley", "shapley_mc", "loo"), SAMPLES, SEED
    )


@query
def report_benign(spark, folder):
    study = studies.gate(spark, Tables(spark, folder))
    game, players = scored(study)
    return rounded(reports.benign_summary(study, game, players), "delta", "max_abs_phi")


def merged_game(study: Study, probe: DataFrame, fit=ut.discriminant_utility, given=None) -> tuple[DataFrame, DataFrame]:
    """The study's game from one replay whose equal sinks are merged, and what each scenario cost."""
    measure = ut.sink_measure if fit is ut.discriminant_utility else None
    run = study.replay(merge="sink", cache="shared", given=given, measure=measure)
    game = study.game(run.spread(coarse(fit(run.sink(), probe, digits=SCORE_DIGITS))))
    run.release()
    return game, reports.costs(study, run.alias)


def ladder_rows(study: Study, probe: DataFrame, frontier: bool = False) -> DataFrame:
    """The ladder of a study; the game and the drift of the nodes are worked out side by side."""
    with replay.wide_sources(study.pipeline) as given:
        jobs = [
            lambda: merged_game(study, probe, given=given),
            lambda: reports.node_drift(study, study.incidents, given),
        ]
        if frontier:
            jobs.append(lambda: reports.staged_rows(reports.frontier_size(study, given)))
        (game, cost), drift, *sizes = side_by_side(*jobs)
    cost = cost.join(sizes[0], "scenario") if sizes else cost
    players = study.players()
    first = for_all(study, orders_of(study, 1)).withColumn("method", F.lit("stagewise"))
    table = reports.attributions(game, players, first, drift, ("shapley", "anchored", "loo"))
    return reports.ladder(study, game, players, table, cost)


def customer_ladder(spark, folder):
    tables = Tables(spark, folder)
    return ladder_rows(studies.ladder(spark, tables), customer_value.probe(tables))


def trip_game(study):
    return merged_game(study, trips.probe(study.tables))[0], study.players()


def trips_ladder(spark, folder, frontier=False):
    tables = Tables(spark, folder)
    with replay.wide_sources(trips.probe_pipeline(tables)) as held:  # its trips are read for the zones and for the joins
        return ladder_rows(studies.trip_ladder(spark, tables), trips.probe(tables, held), frontier)


LADDER_NUMBERS = ["delta", "fault_alone", "drift_alone", "ratio", "anchored_eff_gap", "loo_eff_gap"]


@query
def severity_ladder(spark, folder):
    rows = customer_ladder(spark, folder).drop("n_operators", "lattice")
    scores = [c for c in rows.columns if c.endswith(("_p_at_1", "_mrr"))]
    return rounded(rounded(rows, *LADDER_NUMBERS), *scores, digits=6)


@query
def ratio_bins(spark, folder):
    rows = reports.staged_rows(customer_ladder(spark, folder))
    return rounded(reports.ratio_bins(rows, reports.RATIO_BINS), *reports.METHODS, digits=6)


@query
def coarse_ratio_bins(spark, folder):
    rows = reports.staged_rows(customer_ladder(spark, folder))
    return rounded(reports.ratio_bins(rows, reports.COARSE_BINS), *reports.METHODS, digits=6)


@query
def excluded_cases(spark, folder):
    return reports.excluded(customer_ladder(spark, folder))


@query
def method_agreement(spark, folder):
    rows = reports.staged_rows(customer_ladder(spark, folder))
    return rounded(
        reports.method_agreement(rows), "anchored_gap_max", "loo_gap_max", "loo_gap_mean"
    )


@query
def case_validity(spark, folder):
    rows = trips_ladder(spark, folder, frontier=True)
    picked = reports.case_validity(rows).select(
        "fault_type", "severity", "culprit", "delta", "fault_alone", "degraded", "harmful", "valid", "reason",
        "n_operators", "lattice", "model_fits", "frontier",
    )
    return rounded(picked, "delta", "fault_alone")


@query
def validity_summary(spark, folder):
    rows = reports.staged_rows(trips_ladder(spark, folder))
    return rounded(reports.validity_summary(rows), "p_at_1", "mrr", digits=6)


@query
def drift_floor(spark, folder):
    study = studies.trip_ladder(spark, Tables(spark, folder))
    game, players = trip_game(study)
    return rounded(reports.drift_floor(study, game, players), "max_drift")


def order_blame(spark, folder):
    """The order study's game, and the blame of every step that some order takes."""
    study = studies.orders(spark, Tables(spark, folder))
    pipeline = study.pipeline
    (game, players), steps = side_by_side(
        lambda: scored(study), lambda: lineage.downset_steps(pipeline.nodes(spark), pipeline.edges(spark))
    )
    return study, game, players, steps, g.step_blame(game, players, steps)


@query
def order_dependence(spark, folder):
    study, game, players, steps, blame = order_blame(spark, folder)
    table = reports.order_dependence(study, blame, lineage.count_orders(steps), game, players)
    return rounded(table, "stagewise_min", "stagewise_max", "spread", "anchored")


@query
def order_top_blamed(spark, folder):
    study, _, _, _, blame = order_blame(spark, folder)
    return reports.order_top_blamed(study, blame)


@query
def scale_report(spark, folder):
    tables = Tables(spark, folder)

    weeks = (fan_in.REFERENCE_WEEK, fan_in.INCIDENT_WEEK, fan_in.PROBE_WEEK)

    def one(m: int, sums: DataFrame) -> DataFrame:
        def utility(sink):
            return coarse(ut.discriminant_utility(sink, fan_in.probe(tables, m, sums), digits=SCORE_DIGITS))

        study = studies.width(m, spark, tables, sums)
        return reports.staged_rows(reports.scale_row(study, m, utility, SAMPLES, SEED, ut.sink_measure))

    with kept(fan_in.user_sums(tables, weeks, range(max(studies.SCALE_WIDTHS)))) as sums:
        rows = side_by_side(*[lambda m=m: one(m, sums) for m in studies.SCALE_WIDTHS])
    table = reduce(DataFrame.unionByName, rows)
    return rounded(rounded(table, "mc_max_err", "delta"), "reduction", digits=3)


def incident_card(spark, folder, fit) -> DataFrame:
    """One replay whose equal sinks are merged: what is left is trained and counted."""
    study = studies.incident(spark, Tables(spark, folder))
    with replay.wide_sources(study.pipeline) as given:
        (game, cost), frontier = side_by_side(
            lambda: merged_game(study, customer_value.probe(study.tables), fit, given),
            lambda: reports.staged_rows(reports.frontier_size(study, given)),
        )
    card = reports.incident_report(study, game, cost.first().model_fits, frontier)
    return rounded(card, "phi", "delta", "v_anchor", "total_phi", "to_explain", "gap")


@query
def incident_report(spark, folder):
    return incident_card(spark, folder, ut.discriminant_utility)


@query
def incident_report_lr(spark, folder):
    """The incident card with logistic regressions trained on every distinct sink."""
    return incident_card(spark, folder, ut.logistic_utility)
