"""The tagged replay against one plain run per world, and its edge cases."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from blamesplit.functions import utility as ut
from blamesplit.functions.stage import kept
from blamesplit.operators import game as g
from blamesplit.plans import catalogue, customer_value, fan_in, replay, trips, worlds
from blamesplit.plans.pipeline import Operator, Pipeline
from blamesplit.plans.replay import Replay, isolated
from blamesplit.plans.reports import Incident, Study
from blamesplit.plans.worlds import WorldFrame
from blamesplit.sources.tables import Tables
from suite import queries
from tests.conftest import DATA

FAULTS = {
    "clean_customers": [{"null_rate": 0.5, "null_mode": "mnar"}, {"null_rate": 0.4}],
    "join_features": [{"duplicate_rate": 0.5, "duplicate_bias": "high_spend", "duplicate_factor": 2}],
    "encode_features": [{"drop_columns": ("income", "txn_count")}],
}


def same(a, b):
    a = a.select(*b.columns)
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_each_world_equals_its_own_run(tables):
    pipeline = customer_value.build(tables, FAULTS)
    together = Replay(pipeline).sink()
    worlds = pipeline.all_worlds({"clean_customers": 2}) + pipeline.all_worlds()
    assert len(together.worlds) == 32
    together = Replay(pipeline, worlds).sink()
    for world in (0, max(worlds), pipeline.world(["clean_customers", "load_customers"], {"clean_customers": 2})):
        alone = Replay(pipeline, [world]).sink()
        assert alone.worlds == [world]
        assert same(together.world(world), alone.world(world))


def test_trip_worlds_equal_their_own_runs(tables):
    faults = {op: [params] for op, params in catalogue.TRIP_FAULTS.values()}
    pipeline = trips.build(tables, faults)
    worlds = pipeline.all_worlds()
    wanted = [0, worlds[-1], worlds[11], worlds[37]]
    together = Replay(pipeline, wanted, cache="shared")
    for world in wanted:
        assert same(together.sink().world(world), Replay(pipeline, [world]).sink().world(world))
    together.release()


def test_replays_of_a_report_share_wide_sources(tables):
    cases = [
        (trips.build(tables, {op: [params] for op, params in catalogue.TRIP_FAULTS.values()}), ["load_trips"]),
        (fan_in.build(tables, 2, 1, 0.9), ["load_0", "load_1"]),
    ]
    for pipeline, wide in cases:
        worlds = pipeline.all_worlds()
        wanted = [0, worlds[-1], worlds[len(worlds) // 2]]
        with replay.wide_sources(pipeline) as given:
            assert sorted(given) == wide
            assert all(f.df.storageLevel.useMemory for f in given.values())
            run = Replay(pipeline, wanted, cache="wide", given=given)
            for world in wanted:
                assert same(run.sink().world(world), Replay(pipeline, [world]).sink().world(world))
            kept = {n for n in run._frames if run._frames[n].df.storageLevel.useMemory}
            assert pipeline.sink not in kept
            assert {n for n, op in pipeline.operators.items() if op.wide and n not in wide} <= kept
            flips = lambda rows: sorted((r.op, r.changed) for r in rows.collect())
            assert flips(replay.active_frontier(pipeline, given=given)) == flips(replay.active_frontier(pipeline))
            run.release()
        assert not any(f.df.storageLevel.useMemory for f in given.values())


def test_fan_in_inner_joins_pair_worlds(tables):
    pipeline = fan_in.build(tables, 3, 1, 0.9)
    together = Replay(pipeline).sink()
    assert len(together.worlds) == 16
    counts = {r.w: r["count"] for r in together.df.groupBy("w").count().collect()}
    for world in together.worlds:
        assert counts.get(world, 0) == Replay(pipeline, [world]).sink().df.count()


def test_sampled_walks_need_only_their_own_worlds(spark, tables):
    pipeline = fan_in.build(tables, 3, 0, 0.9)
    study = Study(spark, pipeline, [Incident("s", {"agg_0": 1}, ("agg_0",))], tables)
    players = study.players()
    few = study.sampled_coalitions(players, 2, 1)
    worlds = [r.w for r in few.select("w").distinct().collect()]
    assert len(worlds) < len(pipeline.all_worlds())
    rows = lambda run: ut.metric_utility(run.sink(), F.sum(F.round("x0", 3)))
    part = study.game(rows(Replay(pipeline, worlds)), few)
    whole = study.game(rows(study.replay()))
    found = {r.op: r.phi for r in g.sampled_shapley(part, players, 2, 1).collect()}
    expected = {r.op: r.phi for r in g.sampled_shapley(whole, players, 2, 1).collect()}
    assert found == pytest.approx(expected) and found["agg_0"] != 0


def test_salted_join_equals_plain_join(spark):
    left = WorldFrame(spark.range(60).selectExpr("id % 2 AS w", "id % 3 AS k", "id"), frozenset([0, 1]), 1)
    right = WorldFrame(spark.sql("SELECT explode(array(0L, 1L)) AS w, 1L AS k, 'x' AS v"), frozenset([0, 1]), 1)
    for how in ("inner", "left"):
        salted, plain = left.join(right, ["k"], how, spread=4), left.join(right, ["k"], how)
        assert same(salted.df, plain.df) and salted.df.count() == (60 if how == "left" else 20)


def test_head_fraction_inside_worlds(spark):
    def source(inputs, state):
        return state.partition(spark.range(100).withColumnRenamed("id", "k"), lambda p: F.col("k") < p["n"])

    def cut(inputs, state):
        frame = state.enter(inputs["src"])
        return frame.head_fraction("k", state.values("keep", 1.0), state.field)

    pipeline = Pipeline(
        [
            Operator("src", (), source, {"n": 100}, ({"n": 40},)),
            Operator("cut", ("src",), cut, {"keep": 1.0}, ({"keep": 0.25},)),
        ],
        "cut",
    )
    sink = Replay(pipeline).sink()
    counts = {r.w: r["count"] for r in sink.df.groupBy("w").count().collect()}
    src, cut_bit = pipeline.fields["src"].mask, pipeline.fields["cut"].mask
    assert counts == {0: 100, src: 40, cut_bit: 25, src | cut_bit: 10}


def test_left_join_keeps_rows_that_match_in_one_world_only(spark):
    def left(inputs, state):
        return state.partition(spark.createDataFrame([(1,), (2,)], "k int"), lambda p: F.lit(True))

    def right(inputs, state):
        return state.partition(spark.createDataFrame([(1, "x")], "k int, v string"), lambda p: F.lit(p["on"]))

    pipeline = Pipeline(
        [
            Operator("left", (), left),
            Operator("right", (), right, {"on": True}, ({"on": False},)),
            Operator("join", ("left", "right"), lambda i, s: i["left"].join(i["right"], ["k"], "left")),
        ],
        "join",
    )
    rows = sorted((r.w, r.k, r.v or "") for r in Replay(pipeline).sink().df.collect())
    assert rows == [(0, 1, "x"), (0, 2, ""), (1, 1, ""), (1, 2, "")]


def test_plain_operator_runs_world_by_world(spark, tables):
    def plain(inputs, params):
        return inputs["agg_transactions"].where(F.col("txn_count") >= params["least"])

    base = customer_value.build(tables, {"agg_transactions": [{"amount_scale": 0.5}]})
    ops = [base.operators[n] for n in ("load_transactions", "agg_transactions")]
    ops.append(Operator("busy", ("agg_transactions",), isolated(plain), {"least": 1}, ({"least": 3},)))
    pipeline = Pipeline(ops, "busy")
    frame = Replay(pipeline).sink()
    assert len(frame.worlds) == 8
    agg = Replay(pipeline).node("agg_transactions")
    for world in (0, frame.worlds[-1]):
        least = 3 if world & pipeline.fields["busy"].mask else 1
        assert same(frame.world(world), agg.world(world).where(F.col("txn_count") >= least))


def test_bad_pipelines_are_refused():
    body = lambda inputs, state: None
    with pytest.raises(ValueError, match="sink"):
        Pipeline([Operator("a", (), body)], "b")
    with pytest.raises(ValueError, match="unknown parent"):
        Pipeline([Operator("a", ("x",), body)], "a")
    with pytest.raises(ValueError, match="cycle"):
        Pipeline([Operator("a", ("b",), body), Operator("b", ("a",), body)], "a")


def test_only_operators_with_other_parameters_get_a_field():
    body = lambda inputs, state: None
    ops = [
        Operator("a", (), body, {"x": 1}, ({"x": 2},)),
        Operator("b", ("a",), body, {"x": 1}, ({"x": 1},)),
        Operator("c", ("b",), body, {"x": 1}, ({"x": 2}, {"x": 3})),
    ]
    pipeline = Pipeline(ops, "c")
    assert set(pipeline.fields) == {"a", "c"}
    assert pipeline.world(["a", "b", "c"], {"c": 2}) == 1 | 2 << 1


def test_incomplete_rows_survive_if_the_gap_is_in_a_dropped_column(spark):
    frame = spark.createDataFrame([(0, None, 1.0), (1, None, 1.0), (1, 2.0, None)], "w long, a double, b double")
    tagged = WorldFrame(frame, frozenset([0, 1]), 1, {"a": frozenset([(1, 1)])})
    kept = [(r.w, r.a, r.b) for r in tagged.drop_incomplete().df.collect()]
    assert kept == [(1, None, 1.0)]
    assert tagged.columns_in(1) == ["b"] and tagged.columns_in(0) == ["a", "b"]


def test_fingerprint_counts_duplicates_and_ignores_order(spark):
    def prints(rows):
        df = spark.createDataFrame([(0, *r) for r in rows], "w long, a int, b string")
        return replay.fingerprint(df, ["w"], ["a", "b"]).collect()[0]

    rows = [(1, "x"), (2, "y"), (2, None)]
    assert prints(rows) == prints(rows[::-1])
    assert prints(rows) != prints(rows + rows[:1])
    assert prints(rows + rows[:1] * 2) != prints(rows)
    two = [spark.createDataFrame([(0, *r)], "w long, a double, b double") for r in ((None, 5.0), (5.0, None))]
    first, second = (replay.fingerprint(df, ["w"], ["a", "b"]).collect()[0].hash_sum for df in two)
    assert first != second


def test_empty_worlds_are_still_listed(tables):
    pipeline = customer_value.build(tables, {"filter_active": [{"min_txn": 99}]})
    sink = Replay(pipeline).sink()
    checks = {r.w: r for r in ut.guards(sink).collect()}
    gone = pipeline.fields["filter_active"].mask
    assert set(checks) == set(sink.worlds)
    assert checks[gone].n_rows == 0 and not checks[gone].trainable
    utility = {r.w: r.u for r in ut.discriminant_utility(sink, customer_value.probe(tables)).collect()}
    assert utility[gone] == 0.5 and set(utility) == set(sink.worlds)
    frontier = {r.op: r.changed for r in replay.active_frontier(pipeline).collect()}
    assert frontier == {"filter_active": True, "load_customers": True, "load_transactions": True}


def test_merging_faults_of_one_operator():
    faults = {"one": ("op", {"a": 1}), "two": ("op", {"b": 2})}
    variants, incidents = catalogue.named_incidents(faults, [("one",), ("one", "two")])
    assert variants == {"op": [{"a": 1}, {"a": 1, "b": 2}]}
    assert incidents[1].choice == {"op": 2}


def test_nan_is_missing_from_the_source_on(spark, tables):
    class Spoiled(type(tables)):
        def __call__(self, name):
            df = super().__call__(name)
            if name == "customer":
                nan = F.when(F.col("c_custkey") % 3 == 0, float("nan")).otherwise(F.col("c_acctbal"))
                df = nan_to_null(df.withColumn("c_acctbal", nan))
            return df

    from blamesplit.functions.columns import nan_to_null

    clean = Replay(customer_value.build(Spoiled(spark, tables.folder)), [0]).node("clean_customers").world(0)
    assert clean.where("customer_id % 3 = 0 OR isnan(income)").count() == 0
    loaded = tables("customer")
    assert loaded.schema == spark.read.parquet(f"{tables.folder}/customer.parquet").schema


def rows_of(sink):
    return ut.metric_utility(sink, F.sum(F.col("txn_count") * 7 + F.col("label")))


def test_batches_give_what_one_replay_gives(tables):
    pipeline = customer_value.build(tables, FAULTS)
    worlds = pipeline.every_world()
    split, lists = replay.batches(pipeline, worlds, 16)
    assert split == pipeline.fields["encode_features"].mask | pipeline.fields["join_features"].mask
    assert sorted(w for part in lists for w in part) == worlds and max(map(len, lists)) <= 16
    assert replay.batches(pipeline, worlds[:5], 16) == (0, [worlds[:5]])
    whole = {r.w: r.u for r in rows_of(Replay(pipeline, worlds).sink()).collect()}
    for options in ({}, {"merge": "sink"}):
        parts = replay.utility_of(pipeline, worlds, rows_of, most=16, **options)
        assert {r.w: r.u for r in parts.collect()} == whole
    some = worlds[::5]  # no lattice: batches of different sizes
    assert {r.w: r.u for r in replay.utility_of(pipeline, some, rows_of, most=3).collect()} == {w: whole[w] for w in some}


@pytest.mark.parametrize("merge", ["nodes", "sink"])
def test_merged_worlds_stand_for_equal_tables(tables, merge):
    """A threshold that nobody fails, or everybody, makes worlds equal; each stands for its like."""
    faults = {"filter_active": [{"min_txn": 0}, {"min_txn": 10_000}, {"min_txn": 20_000}], "clean_customers": [{"null_rate": 0.5}]}
    pipeline = customer_value.build(tables, faults)
    worlds = pipeline.every_world()
    plain = Replay(pipeline, worlds).sink()
    run = Replay(pipeline, worlds, merge=merge)
    sink = run.sink()
    assert set(run.alias) == set(worlds) and set(run.alias.values()) == set(sink.worlds)
    assert len(sink.worlds) < len(worlds)
    prints = {r.w: r.fingerprint for r in replay.world_fingerprints(plain).collect()}
    assert len(sink.worlds) == len(set(prints.values()))
    assert all(prints[w] == prints[a] for w, a in run.alias.items())
    assert same(sink.df.drop("w").distinct(), plain.df.drop("w").distinct())
    want = {r.w: r.u for r in rows_of(plain).collect()}
    assert {r.w: r.u for r in run.spread(rows_of(sink)).collect()} == want
    run.release()


def test_merging_stops_where_a_table_is_read_twice(tables):
    """derive_time merges for both its readers; what one of them makes of it must wait for the other."""
    pipeline = trips.build(tables, {op: [params] for op, params in catalogue.TRIP_FAULTS.values()})
    worlds = [0, *pipeline.all_worlds()[-3:], pipeline.all_worlds()[5]]
    run = Replay(pipeline, worlds, merge="nodes")
    assert run._merges("derive_time") and not run._merges("zone_stats") and run._merges("encode")
    sink, plain = run.sink(), Replay(pipeline, worlds).sink()
    for w in worlds:
        assert same(sink.world(run.alias[w]), plain.world(w))
    run.release()


def test_rows_are_repeated_only_for_worlds_that_are_wanted(spark):
    frame = WorldFrame(spark.range(3).selectExpr("id AS k", "explode(array(0L, 1L, 2L)) AS w"), frozenset({0, 1, 2, 4, 6, 8}), 3)
    wide = frame.expand(12)
    assert wide.worlds == [0, 1, 2, 4, 6, 8]
    assert sorted(r.w for r in wide.df.where("k = 1").collect()) == wide.worlds
    assert "IN (" in wide.df._jdf.queryExecution().analyzed().toString()
    assert "Filter" not in wide.df._jdf.queryExecution().analyzed().toString()


def test_quantiles_are_ordered_in_worlds_that_read_them_only(spark, monkeypatch):
    before = WorldFrame(spark.range(101).selectExpr("id AS x", "explode(array(0L, 1L)) AS w"), frozenset(range(8)), 1)
    seen = []
    real = worlds.exact_quantile
    monkeypatch.setattr(worlds, "exact_quantile", lambda df, *a: seen.append(df.count()) or real(df, *a))
    frame = before.expand(6)
    got = frame.with_quantile("x", 0.5, "mid", before, [3, 5, 6])
    mids = {r.w: r.mid for r in got.df.select("w", "mid").distinct().collect()}
    assert mids == {w: 50.0 if w in (3, 5, 6) else None for w in range(8)}
    assert seen == [202]  # and not the 808 rows of all worlds
    whole = frame.with_quantile("x", 0.5, "mid")
    assert {r.mid for r in whole.df.select("mid").distinct().collect()} == {50.0}
    none = frame.with_quantile("x", 0.5, "mid", before, [])
    assert {r.mid for r in none.df.select("mid").distinct().collect()} == {None}


def test_measured_sinks_are_not_kept(tables):
    pipeline = customer_value.build(tables, {**FAULTS, "clean_customers": [{"null_rate": 0.0001}]})  # blanks nobody
    wanted, probe = pipeline.all_worlds(), customer_value.probe(tables)
    kept = Replay(pipeline, wanted, merge="sink")
    passed = Replay(pipeline, wanted, merge="sink", measure=ut.sink_measure)
    want, got = (sorted(map(tuple, r.spread(ut.discriminant_utility(r.sink(), probe, digits=6)).collect())) for r in (kept, passed))
    assert got == want
    assert passed.alias == kept.alias
    assert len(passed.sink().worlds) < len(wanted)
    assert not passed._cached
    kept.release()


def test_the_frontier_replays_an_operator_in_its_own_flips_only(tables, monkeypatch):
    variants, incidents = catalogue.sweep_incidents(catalogue.TRIP_SWEEPS)
    study = Study(tables.spark, trips.build(tables, variants), incidents, tables)
    seen = {}
    real = replay.world_fingerprints
    monkeypatch.setattr(replay, "world_fingerprints", lambda frame: seen.update({tuple(frame.columns): len(frame.worlds)}) or real(frame))
    found = replay.active_frontier(study.pipeline, {i.name: study.choice(i) for i in study.incidents})
    assert max(seen.values()) == 5  # the reference and the levels of one fault
    changed = {(r.scenario, r.op): r.changed for r in found.collect()}
    assert len(changed) == len(incidents) * len(study.pipeline.fields)
    assert all(changed[i.name, "load_trips"] for i in incidents)
    assert {i.culprits[0] for i in incidents if changed[i.name, i.culprits[0]]} == set(variants)


def test_widths_share_one_pass_over_the_events(spark, monkeypatch):
    asked = []

    class Counted(Tables):
        def __call__(self, name):
            asked.append(name)
            return super().__call__(name)

    monkeypatch.setattr(queries, "Tables", Counted)
    monkeypatch.setattr(queries.studies, "SCALE_WIDTHS", [1, 2, 6])
    assert queries.QUERIES["scale_report"](spark, DATA).count() == 3
    assert asked == ["events"]


def test_shared_sums_give_the_rows_of_each_pipeline(spark):
    at = lambda s: datetime.fromisoformat(f"2024-01-{s}")
    rows = [
        (1, "click", at("01"), 1.5), (1, "click", at("07T23:59:59"), None), (1, "error", at("08"), 2.0), (1, "view", at("20"), 7.0),
        (2, "click", at("15"), None), (2, "error", at("03"), 40_000.0), (2, None, at("04"), 1.0), (None, "click", at("02"), 5.0),
        (3, "click", None, 9.0), (3, "click", at("09"), 3.0), (3, "click", at("09"), 3.0), (3, "error", at("16"), 4.0), (4, "purchase", at("30"), 1.0),
    ]
    events = spark.createDataFrame(rows, "user_id long, event_type string, ts timestamp_ntz, value double")
    given = lambda name: events
    weeks = (fan_in.REFERENCE_WEEK, fan_in.INCIDENT_WEEK, fan_in.PROBE_WEEK)
    with kept(fan_in.user_sums(given, weeks, range(fan_in.MOST_BRANCHES))) as sums:
        shared, own = fan_in.build(given, 7, 0, 0.9, sums=sums), fan_in.build(given, 7, 0, 0.9)
        for b in (0, 1, 5):
            ours, theirs = (Replay(p, shared.all_worlds()).node(f"agg_{b}") for p in (shared, own))
            assert same(ours.df, theirs.df) and "InMemoryTableScan" in ours.df._jdf.queryExecution().executedPlan().toString()
        assert same(fan_in.probe(given, 2, sums), fan_in.probe(given, 2))
    clicks = {(r.w, r.entity_id): (r.x0, r.w0, r.label) for r in Replay(own, [0, own.world(["load_0"])]).node("load_0").df.collect()}
    week = own.world(["load_0"])
    assert clicks == {(0, 1): (1.5, 2.0, 0), (week, 2): (None, 1.0, 1)}


def test_what_is_made_row_by_row_is_not_kept(tables):
    variants, _ = catalogue.sweep_incidents(catalogue.TRIP_SWEEPS)
    pipeline = trips.build(tables, variants)
    wanted = [0, *pipeline.all_worlds()[-2:]]
    with replay.wide_sources(pipeline) as given:
        for cache in ("shared", "wide"):
            run = Replay(pipeline, wanted, cache=cache, given=given)
            sink = run.sink()
            held = {n for n in run._frames if n not in given and run._frames[n].df.storageLevel.useMemory}
            assert held == {"zone_stats"}  # and not derive_time, or zones that other plans would find in the cache
            plan = sink.df._jdf.queryExecution().executedPlan().toString()
            assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan  # the size of the zones is known
            for w in wanted:
                assert same(sink.world(w), Replay(pipeline, [w]).sink().world(w))
            run.release()
    plain = Replay(pipeline, wanted, cache="shared")
    plain.sink()
    assert plain._frames["derive_time"].df.storageLevel.useMemory  # nothing before it is kept
    plain.release()


def test_a_salt_of_one_column_spreads_a_hot_key(spark):
    left = WorldFrame(spark.range(100).selectExpr("0L AS w", "id", "0L AS k", "'x' AS unused"), frozenset({0}))
    right = WorldFrame(spark.sql("SELECT 0L AS w, explode(array(0L, 0L, 1L)) AS k, 7 AS v"), frozenset({0}))
    salted, plain = left.join(right, ["k"], "left", 4, salt=["id"]), left.join(right, ["k"], "left")
    assert same(salted.df, plain.df) and salted.df.count() == 200
    assert "unused" not in salted.df.select("v")._jdf.queryExecution().optimizedPlan().toString()


def test_a_report_reads_each_trip_of_the_probe_from_what_is_held(tables):
    with replay.wide_sources(trips.probe_pipeline(tables)) as held:
        given, own = trips.probe(tables, held), trips.probe(tables)
        assert same(given, own) and same(own, given)
        assert "parquet" not in given._jdf.queryExecution().withCachedData().toString().split("InMemoryRelation")[0].lower()


def test_reports_share_the_first_operators_that_aggregate(tables):
    pipeline = customer_value.build(tables, {**FAULTS, "agg_transactions": [{"amount_scale": 0.5}]})
    with replay.wide_sources(pipeline) as given:
        assert sorted(given) == ["agg_transactions", "load_customers"]
        assert len(given["agg_transactions"].worlds) == 4 and len(given["load_customers"].worlds) == 2
        worlds = pipeline.all_worlds()
        run = Replay(pipeline, worlds, given=given)
        for w in (0, worlds[-1], pipeline.world(["agg_transactions"]), pipeline.world(["load_transactions"])):
            assert same(run.sink().world(w), Replay(pipeline, [w]).sink().world(w))
        assert "o_orderdate" not in run.node("agg_transactions").df._jdf.queryExecution().withCachedData().toString().split("InMemoryRelation")[0]
        few = Replay(pipeline, [0], given=given)
        assert few.node("agg_transactions").df.select("w").distinct().count() == 1


def test_what_many_sources_feed_is_not_made_in_all_their_mixes(tables):
    sums = fan_in.user_sums(tables, (fan_in.REFERENCE_WEEK, fan_in.INCIDENT_WEEK), range(10))
    pipeline = fan_in.build(tables, 10, 0, 0.9, sums=sums)
    with replay.wide_sources(pipeline) as given:
        assert not given  # join_all has 2048 worlds, of which a report reads a few
