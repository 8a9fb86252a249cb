"""Plain SQL for every registered query that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from blamesplit.plans import catalogue, customer_value, fan_in, trips
from blamesplit.plans.pipeline import Operator, Pipeline
from blamesplit.plans.reports import COARSE_BINS, RATIO_BINS, Study
from suite import queries as q
from suite import studies
from suite.sql import (
    CUSTOMER, CUSTOMER_FEATURES, TRIP_FEATURES, TRIPS, Chains, fan_bodies, fan_features, hit,
    logistic_ctes, one_hot, utility_ctes, values, with_,
)

ORACLES: dict[str, Callable[[], str]] = {}


def oracle(fn):
    ORACLES[fn.__name__] = fn
    return fn


def oracles() -> dict[str, str]:
    return {name: make() for name, make in ORACLES.items()}


def customer_chains(faults=None, prefix="") -> Chains:
    return Chains(customer_value.build(None, faults), CUSTOMER, prefix)


def trip_chains(faults=None, prefix="") -> Chains:
    return Chains(trips.build(None, faults), TRIPS, prefix)


def of_node(chains: Chains, name: str, world: int, select: str = "*") -> str:
    cte = chains.node(name, world)
    return with_(chains.ctes, f"SELECT {select} FROM {cte}")


def of_fault(chains: Chains, name: str, select: str = "*") -> str:
    return of_node(chains, name, chains.pipeline.world([name]), select)


def r8(x: str) -> str:
    return f"(round({x}, 8) + CAST(0 AS DOUBLE))"


# -- sources -------------------------------------------------------------------------------


@oracle
def scan_parquet_project():
    return f"SELECT {', '.join(q.SCAN_COLUMNS)} FROM lineitem"


@oracle
def csv_scan():
    return "SELECT s_suppkey, s_name, CAST(s_nationkey AS BIGINT) AS s_nationkey, round(s_acctbal, 2) AS s_acctbal FROM supplier"


@oracle
def table_write():
    return of_node(customer_chains(), "filter_active", 0, "customer_id, txn_count, total_amount")


@oracle
def csv_report():
    return """SELECT event_type, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n_rows
    FROM events GROUP BY ALL HAVING count(*) >= 10"""


@oracle
def incident_json():
    return f"""SELECT i.scenario, i.delta, i.model_fits, i.op, i.phi, i.is_culprit, i.anchored AS is_source
    FROM ({incident_card(utility_ctes)}) i"""


@oracle
def user_operator():
    pipeline = customer_value.build(None, q.FILL_CHECK_FAULTS)
    chains, parts = Chains(pipeline, CUSTOMER), []
    kept = {n: pipeline.operators[n] for n in pipeline.names if n != pipeline.sink}
    mine = Pipeline([*kept.values(), Operator("by_segment", ("filter_active",), None, {"least": 1}, ({"least": 4},))], "by_segment")
    for w in mine.every_world():
        choice = {n: f.choice(w) for n, f in mine.fields.items()}
        source = chains.node("filter_active", pipeline.world(choice, choice))
        parts.append(f"""SELECT CAST({w} AS BIGINT) AS w, segment, count(*) AS n_people, CAST(sum(txn_count) AS BIGINT) AS n_orders
          FROM {source} WHERE txn_count >= {(1, 4)[choice['by_segment']]} GROUP BY segment""")
    return with_(chains.ctes, "\nUNION ALL ".join(parts))


@oracle
def canonical_columns():
    return "SELECT o_orderkey, o_custkey, o_totalprice FROM orders"


@oracle
def contract_check():
    have = {"orders": ["o_orderkey", "o_custkey", "o_totalprice"], "customer": ["c_custkey", "c_acctbal"]}
    parts = []
    for table, columns in q.CONTRACTS.items():
        for c in columns:
            ok = c in have[table]
            n = f"(SELECT count({c}) FROM {table})" if ok else "CAST(0 AS BIGINT)"
            parts.append(
                f"SELECT '{table}' AS table_name, '{c}' AS column_name, {ok} AS present, {n} AS filled"
            )
    return "\nUNION ALL ".join(parts)


@oracle
def day_partition():
    parts = ", ".join(f"CAST({p}(ts) AS BIGINT) AS {p}" for p in ("year", "month", "day"))
    return f"SELECT event_id, user_id, {parts} FROM events WHERE CAST(ts AS DATE) = DATE '{q.DAY}'"


@oracle
def partition_cap():
    return """SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_id FROM events
    QUALIFY row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id) <= 100"""


@oracle
def partition_census():
    days = ", ".join(f"(DATE '{d}')" for d in q.CENSUS_DAYS)
    return f"""SELECT CAST(d.day AS VARCHAR) AS day, count(e.event_id) AS n_rows,
      count(e.event_id) < 1000 AS thin
    FROM (VALUES {days}) AS d(day) LEFT JOIN events e ON CAST(e.ts AS DATE) = d.day GROUP BY d.day"""


# -- row-wise steps ------------------------------------------------------------------------


@oracle
def filter_valid():
    return of_node(trip_chains(), "filter_valid", 0, "trip_id, payment_type, fare_amount, trip_distance")


@oracle
def filter_active():
    return of_node(customer_chains(), "filter_active", 0, "customer_id, txn_count, total_amount")


@oracle
def clean_customers():
    return of_node(customer_chains(), "clean_customers", 0)


@oracle
def derive_time():
    return of_node(trip_chains(), "derive_time", 0, "trip_id, duration, hour, dow")


@oracle
def one_hot_fixed():
    cols = one_hot("c_mktsegment", customer_value.SEGMENTS[:4], "seg")
    return f"SELECT c_custkey, {', '.join(cols)} FROM customer"


@oracle
def ratio_label():
    return """SELECT l_orderkey, l_partkey, l_linenumber,
      CAST(coalesce(l_tax / nullif(l_discount, 0) > 0.8::DOUBLE, FALSE) AS INTEGER) AS label FROM lineitem"""


@oracle
def encode_features():
    return of_node(customer_chains(), "encode_features", 0)


@oracle
def encode_trips():
    return of_fault(trip_chains({"encode": [{"drop_columns": ("duration", "hour")}]}), "encode")


@oracle
def encode_wide():
    return of_node(Chains(fan_in.build(None, 3), fan_bodies(3)), "encode", 0)


@oracle
def align_schema():
    return """SELECT CAST(c_custkey AS DOUBLE) AS c_custkey, c_acctbal, CAST(c_nationkey AS DOUBLE) AS c_nationkey,
      CAST(0 AS DOUBLE) AS credit_limit FROM customer"""


@oracle
def standardize():
    def scale(c, s):
        return f"round((c_{c} - avg_{s}) / CASE WHEN sd_{s} = 0 THEN 1 ELSE sd_{s} END, 6)"

    return f"""SELECT c_custkey, {scale('acctbal', 'b')} AS balance, {scale('nationkey', 'n')} AS nation
    FROM customer, (SELECT avg(s_acctbal) AS avg_b, stddev_pop(s_acctbal) AS sd_b,
      avg(CAST(s_nationkey AS DOUBLE)) AS avg_n, stddev_pop(CAST(s_nationkey AS DOUBLE)) AS sd_n FROM supplier)"""


# -- joins and aggregates ------------------------------------------------------------------


@oracle
def join_features():
    return of_node(customer_chains(), "join_features", 0)


@oracle
def join_pu_zone():
    return of_node(trip_chains(), "join_pu_zone", 0, "trip_id, pu_zone, pu_region")


@oracle
def join_do_zone():
    return of_node(trip_chains(), "join_do_zone", 0, "trip_id, do_zone, do_region")


@oracle
def join_two_roles():
    chains = trip_chains()
    cte = chains.node("join_do_zone", 0)
    return with_(chains.ctes, f"""SELECT pu_region, do_region, count(*) AS n_trips,
      sum(trip_distance) AS distance FROM {cte} GROUP BY pu_region, do_region""")


@oracle
def join_stats():
    return of_node(trip_chains(), "join_stats", 0, "trip_id, pu_zone, zone_mean_fare, zone_trip_count")


def corrupted_trips() -> Chains:
    return trip_chains({"join_pu_zone": [{"corrupt_ids": 0.9}]})


@oracle
def join_hot_zone():
    return of_fault(corrupted_trips(), "join_pu_zone", "trip_id, pu_zone, pu_region")


@oracle
def join_hot_stats():
    chains = corrupted_trips()
    cte = chains.node("join_stats", chains.pipeline.world(["join_pu_zone"]))
    return with_(chains.ctes, f"""SELECT pu_zone, do_region, count(*) AS n_trips,
      CAST(sum(zone_trip_count) AS BIGINT) AS zone_trips FROM {cte} GROUP BY pu_zone, do_region""")


@oracle
def hot_zones():
    chains = corrupted_trips()
    cte = chains.node("join_pu_zone", chains.pipeline.world(["join_pu_zone"]))
    return with_(chains.ctes, f"""SELECT pu_zone, count(*) AS n_trips,
      (count(*) * 16 + t.total - 1) // t.total AS pieces
      FROM {cte}, (SELECT count(*) AS total FROM {cte}) t GROUP BY pu_zone, t.total HAVING count(*) * 16 > t.total""")


@oracle
def join_all_branches():
    return of_node(Chains(fan_in.build(None, 5), fan_bodies(5)), "join_all", 0)


@oracle
def join_fanout_ratio():
    chains = customer_chains(q.FAN_OUT_FAULTS)
    parts = []
    for w in q.single_worlds(chains.pipeline):
        a, b = chains.node("clean_customers", w), chains.node("join_features", w)
        parts.append(f"""SELECT CAST({w} AS BIGINT) AS w, (SELECT count(*) FROM {a}) AS rows_in,
          (SELECT count(*) FROM {b}) AS rows_out,
          round((SELECT count(*) FROM {b}) / CAST((SELECT count(*) FROM {a}) AS DOUBLE), 6) AS ratio""")
    return with_(chains.ctes, "\nUNION ALL ".join(parts))


@oracle
def agg_transactions():
    return of_node(customer_chains(), "agg_transactions", 0)


@oracle
def zone_stats():
    return of_node(trip_chains(), "zone_stats", 0)


@oracle
def quantile_threshold():
    return """SELECT o_orderstatus, round(median(o_totalprice), 4) AS median_price,
      round(quantile_cont(o_totalprice, 0.75), 4) AS top_quarter FROM orders GROUP BY o_orderstatus"""


def profile_parts(cte: str, columns: list[str], extra: str, digits: int) -> list[str]:
    return [
        f"""SELECT {extra}'{c}' AS column_name, count(*) AS n_rows,
        round(avg(CAST("{c}" AS DOUBLE)), {digits}) AS mean,
        round(stddev_samp(CAST("{c}" AS DOUBLE)), {digits}) AS sd FROM {cte}"""
        for c in columns
    ]


@oracle
def column_profile():
    chains = customer_chains()
    cte = chains.node("encode_features", 0)
    parts = profile_parts(cte, [*CUSTOMER_FEATURES, "label"], "", 4)
    return with_(chains.ctes, "\nUNION ALL ".join(parts))


@oracle
def utility_guards():
    chains = customer_chains(q.FILL_CHECK_FAULTS)
    worlds = q.single_worlds(chains.pipeline)
    sinks = chains.tagged_sinks(CUSTOMER_FEATURES, worlds)
    known = ", ".join(f"({w}, {bool(chains.columns(CUSTOMER_FEATURES, w))})" for w in worlds)
    return with_([*chains.ctes, ("sinks", sinks)], f"""
    SELECT CAST(k.w AS BIGINT) AS w, count(s.label) AS n_rows, count(DISTINCT s.label) AS n_classes,
      count(s.label) >= 50 AND count(DISTINCT s.label) >= 2 AND any_value(k.f) AS trainable
    FROM (VALUES {known}) AS k(w, f) LEFT JOIN sinks s ON s.w = k.w GROUP BY k.w""")


def probe_chains(kind: str, m: int = 0) -> Chains:
    if kind == "customer_value":
        y = customer_value.PROBE_YEAR
        return Chains(customer_value.build(None, reference=y, incident=y), CUSTOMER, "probe_")
    if kind == "trips":
        h = trips.PROBE_HALF
        return Chains(trips.build(None, reference=h, incident=h), TRIPS, "probe_")
    week = fan_in.PROBE_WEEK
    return Chains(fan_in.build(None, m, reference=week, incident=week), fan_bodies(m), "probe_")


@oracle
def positive_rate():
    ctes, parts = [], []
    for kind in ("customer_value", "trips", "fan_in"):
        chains = probe_chains(kind, 2)
        chains.prefix = f"{kind}_"
        cte = chains.node(chains.pipeline.sink, 0)
        ctes += chains.ctes
        parts.append(f"SELECT '{kind}' AS probe, count(*) AS n_rows, round(avg(label), 6) AS positive_rate FROM {cte}")
    return with_(ctes, "\nUNION ALL ".join(parts))


@oracle
def head_fraction():
    return """SELECT event_type, event_id FROM events
    QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id)
      <= floor(count(*) OVER (PARTITION BY event_type) * 0.3::DOUBLE)"""


@oracle
def union_append():
    return """SELECT c_nationkey AS nation, c_acctbal AS balance FROM customer
    UNION ALL SELECT s_nationkey, s_acctbal FROM supplier"""


# -- perturbations -------------------------------------------------------------------------


@oracle
def row_selector():
    return f"SELECT o_orderkey, o_custkey FROM orders WHERE {hit('o_orderkey', 0.25, 7)}"


@oracle
def perturb_unit():
    return of_fault(customer_chains(studies.UNIT_FAULT), "agg_transactions")


@oracle
def perturb_duration_unit():
    op, params = catalogue.TRIP_FAULTS["unit_change"]
    return of_fault(trip_chains({op: [params]}), op, "trip_id, duration")


@oracle
def perturb_predicate():
    op, params = catalogue.CUSTOMER_FAULTS["predicate_flip"]
    return of_fault(customer_chains({op: [params]}), op, "customer_id, txn_count")


def one_fault(name: str) -> str:
    op, params = catalogue.CUSTOMER_FAULTS[name]
    return of_fault(customer_chains({op: [params]}), op)


ORACLES |= {
    "perturb_null_mcar": lambda: one_fault("null_spike_mcar"),
    "perturb_null_mnar": lambda: one_fault("null_spike_mnar"),
    "perturb_fanout_uniform": lambda: one_fault("join_fanout_uniform"),
    "perturb_fanout_biased": lambda: one_fault("join_fanout_biased"),
    "perturb_schema": lambda: one_fault("schema_drift"),
}


@oracle
def perturb_join_key():
    op, params = catalogue.TRIP_FAULTS["broken_join_key"]
    return of_fault(trip_chains({op: [params]}), op, "trip_id, pu_zone, pu_region")


@oracle
def perturb_noise_mix():
    chains = Chains(fan_in.build(None, 1, 0, studies.CORRUPT), fan_bodies(1))
    return of_fault(chains, "agg_0", "entity_id, round(x0, 6) AS x0, w0, label")


@oracle
def fault_catalogue():
    study = studies.ladder()
    chains = Chains(study.pipeline, CUSTOMER)
    parts = []
    for i in study.incidents:
        kind, level = i.name.split("/", 1)
        params = dict(catalogue.CUSTOMER_SWEEPS[kind][1])[level]
        text = ", ".join(f"{k}={v}" for k, v in sorted(params.items())).replace("'", "''")
        sink = chains.node("encode_features", study.pipeline.world(i.culprits, i.choice))
        parts.append(
            f"SELECT '{kind}' AS fault_type, '{level}' AS severity, '{i.culprits[0]}' AS op, "
            f"'{text}' AS params, (SELECT count(*) FROM {sink}) AS sink_rows"
        )
    return with_(chains.ctes, "\nUNION ALL ".join(parts))


def damage(study: Study, bodies, columns: str, rows: list[tuple]) -> str:
    """Rows that start with a scenario, and the size of the sink this scenario leaves."""
    chains = Chains(study.pipeline, bodies)
    sizes = "\nUNION ALL ".join(
        f"SELECT '{i.name}' AS scenario, (SELECT count(*) FROM {chains.node(chains.pipeline.sink, study.pipeline.world(i.culprits, i.choice))}) AS sink_rows"
        for i in study.incidents
    )
    listed = values("listed", f"scenario, {columns}", rows)
    return with_([*chains.ctes, listed, ("sizes", sizes)], f"SELECT scenario, {columns}, sink_rows FROM listed JOIN sizes USING (scenario)")


def written(params) -> str:
    return ", ".join(f"{k}={params[k]}" for k in sorted(params))


@oracle
def customer_fault_catalogue():
    rows = [(f, f, op, written(p), f in catalogue.BENIGN_FAULTS) for f, (op, p) in catalogue.CUSTOMER_FAULTS.items()]
    return damage(studies.customer_faults(), CUSTOMER, "fault, op, params, benign", rows)


@oracle
def gate_catalogue():
    faults = catalogue.CUSTOMER_FAULTS
    rows = [("+".join(s), f, faults[f][0], written(faults[f][1]), f in catalogue.BENIGN_FAULTS) for s in catalogue.GATE_SCENARIOS for f in s]
    return damage(studies.gate(), CUSTOMER, "fault, op, params, benign", rows)


@oracle
def trip_fault_catalogue():
    rows = [(f, f, op, written(p)) for f, (op, p) in catalogue.TRIP_FAULTS.items()]
    return damage(studies.trip_faults(), TRIPS, "fault, op, params", rows)


@oracle
def trip_ladder_catalogue():
    rows = [(f"{f}/{s}", f, s, op, written(p)) for f, (op, levels) in catalogue.TRIP_SWEEPS.items() for s, p in levels]
    sql = damage(studies.trip_ladder(), TRIPS, "fault_type, severity, op, params", rows)
    return f"SELECT * EXCLUDE (scenario) FROM ({sql})"


# -- lineage -------------------------------------------------------------------------------


def graph(pipeline) -> list[tuple[str, str]]:
    edges = [(p, n) for n in pipeline.names for p in pipeline.operators[n].parents]
    return [
        values("nodes", "op, bit", [(n, pipeline.bit(n)) for n in pipeline.names]),
        values("edges", "parent, child", edges),
    ]


def sized_graph() -> list[tuple[str, str]]:
    chains = customer_chains()
    rows = [
        f"SELECT '{n}' AS op, (SELECT count(*) FROM {chains.node(n, 0)}) AS n_rows"
        for n in chains.pipeline.names
    ]
    return [*chains.ctes, *graph(chains.pipeline), ("sizes", "\nUNION ALL ".join(rows))]


@oracle
def lineage_ancestors():
    up = """SELECT 'join_features' AS op UNION SELECT e.parent FROM up JOIN edges e ON e.child = up.op"""
    return with_([*sized_graph(), ("up", up)], "SELECT op, n_rows FROM up JOIN sizes USING (op)", True)


@oracle
def lineage_sources():
    return with_(sized_graph(), """SELECT op, n_rows FROM nodes JOIN sizes USING (op)
    WHERE op NOT IN (SELECT child FROM edges)""")


@oracle
def lineage_children():
    return with_(sized_graph(), """SELECT child AS op, n_rows FROM edges JOIN sizes ON op = child
    WHERE parent = 'agg_transactions'""")


@oracle
def lineage_depth():
    down = """SELECT op, CAST(0 AS BIGINT) AS depth FROM nodes
    UNION ALL SELECT e.child, d.depth + 1 FROM down d JOIN edges e ON e.parent = d.op"""
    return with_([*sized_graph(), ("down", down)], """SELECT op, max(depth) AS depth, any_value(n_rows) AS n_rows
    FROM down JOIN sizes USING (op) GROUP BY op""", True)


def order_ctes(pipeline) -> list[tuple[str, str]]:
    """orders(order_id, pos, op, bit): every topological order, lexicographic by name."""
    return [
        *graph(pipeline),
        ("needs", """SELECT n.op, n.bit, coalesce(sum(p.bit), 0) AS needs,
          lpad(CAST(row_number() OVER (ORDER BY n.op) AS VARCHAR), 3, '0') AS code
          FROM nodes n LEFT JOIN edges e ON e.child = n.op LEFT JOIN nodes p ON p.op = e.parent
          GROUP BY n.op, n.bit"""),
        ("paths", """SELECT '' AS path, CAST(0 AS BIGINT) AS done, CAST([] AS VARCHAR[]) AS ops
          UNION ALL SELECT path || code, done | bit, list_append(ops, op)
          FROM paths, needs WHERE done & bit = 0 AND done & CAST(needs AS BIGINT) = needs"""),
        ("complete", f"""SELECT row_number() OVER (ORDER BY path) AS order_id, ops FROM paths
          WHERE len(ops) = {len(pipeline.names)}"""),
        ("orders_list", """SELECT order_id, CAST(pos AS BIGINT) AS pos, ops[pos] AS op, bit
          FROM (SELECT order_id, ops, unnest(range(1, len(ops) + 1)) AS pos FROM complete)
          JOIN nodes ON nodes.op = ops[pos]"""),
    ]


# -- replay --------------------------------------------------------------------------------


@oracle
def hybrid_replay():
    study = studies.unit_change()
    chains = Chains(study.pipeline, CUSTOMER)
    sinks = chains.tagged_sinks(CUSTOMER_FEATURES, study.worlds())
    return with_(chains.ctes, sinks)


def sink_prints(chains: Chains, worlds: list[int]) -> list[tuple[str, str]]:
    """prints(w, n_rows, print): content of every world's sink; the column list counts."""
    parts = []
    for w in worlds:
        cols = [*chains.columns(CUSTOMER_FEATURES, w), "label"]
        row = "hash(" + ", ".join(f'"{c}"' for c in cols) + ")"
        sink = chains.node(chains.pipeline.sink, w)
        parts.append(f"""SELECT CAST({w} AS BIGINT) AS w, count(*) AS n_rows, '{",".join(cols)}' || '|' ||
          count(*) || '|' || coalesce(sum(CAST({row} AS HUGEINT)), 0) || '|' || coalesce(bit_xor({row}), 0) AS print FROM {sink}""")
    return [*chains.ctes, ("prints", "\nUNION ALL ".join(parts))]


@oracle
def table_fingerprint():
    study = studies.incident()
    ctes = sink_prints(Chains(study.pipeline, CUSTOMER), study.worlds())
    return with_(ctes, """SELECT w, n_rows, print = (SELECT print FROM prints WHERE w = 0) AS same_as_reference
    FROM prints""")


@oracle
def sink_sharing():
    study = studies.incident()
    p, choice = study.pipeline, study.choice(study.incidents[0])
    masks = []
    for mask in range(p.full_mask + 1):
        masks.append((mask, p.world([n for n in p.names if mask & p.bit(n)], choice)))
    ctes = [*sink_prints(Chains(p, CUSTOMER), study.worlds()), values("masks", "mask, w", masks)]
    return with_(ctes, """SELECT min(mask) AS first_mask, count(*) AS coalitions, n_rows
    FROM masks JOIN prints USING (w) GROUP BY print, n_rows""")


@oracle
def many_worlds():
    """Joined rows per state of the sources and the scale; thresholds and schemas are small tables."""
    pipeline = customer_value.build(None, studies.MANY_FAULTS)
    chains, fields, parts = Chains(pipeline, CUSTOMER), pipeline.fields, []
    below = fields["load_customers"].mask | fields["load_transactions"].mask | fields["agg_transactions"].mask
    for w in sorted({w & below for w in pipeline.every_world()}):
        parts.append(f"SELECT CAST({w} AS BIGINT) AS base, total_amount, txn_count FROM {chains.node('join_features', w)}")
    least = [(fields["filter_active"].world(c), k) for c, k in enumerate(range(1, 33))]
    dropped = [(fields["encode_features"].world(c),) for c in range(8)]
    ctes = [*chains.ctes, ("joined", "\nUNION ALL ".join(parts)), values("least", "f, k", least), values("dropped", "e", dropped),
            ("bases", "SELECT DISTINCT base FROM joined"),
            ("spent", """SELECT base, f, sum(CAST(round(total_amount * 100) AS BIGINT)) AS cents
              FROM joined JOIN least ON txn_count >= k GROUP BY base, f""")]
    return with_(ctes, """SELECT b.base | l.f | d.e AS w, CAST(coalesce(s.cents, 0) AS DOUBLE) AS u
    FROM bases b CROSS JOIN least l CROSS JOIN dropped d LEFT JOIN spent s ON s.base = b.base AND s.f = l.f""")


@oracle
def merged_worlds():
    study = studies.incident()
    cols = ", ".join(f'"{c}"' for c in [*CUSTOMER_FEATURES, "label"])
    ctes = [*study_utility(study),
            ("shapes", f"SELECT w, count(*) AS n, sum(CAST(hash({cols}) AS HUGEINT)) AS h FROM sinks GROUP BY w")]
    return with_(ctes, """SELECT w, u.u, min(w) OVER (PARTITION BY n, h) AS stands_for,
      (SELECT count(DISTINCT (n, h)) FROM shapes) AS model_fits FROM shapes JOIN u USING (w)""")


def numeric_of(name: str) -> list[str]:
    """Numeric columns of the customer pipeline's operators."""
    people = ["customer_id", "income", "tenure_days", "label"]
    spend = ["total_amount", "txn_count", "avg_amount"]
    return {
        "load_customers": people,
        "clean_customers": people,
        "load_transactions": ["customer_id", "amount"],
        "agg_transactions": ["customer_id", *spend],
        "join_features": [*people, *spend],
        "filter_active": [*people, *spend],
        "encode_features": [*CUSTOMER_FEATURES, "label"],
    }[name]


def ends(study: Study, incident) -> tuple[int, int]:
    return 0, study.pipeline.world(study.pipeline.names, study.choice(incident))


@oracle
def node_profiles():
    study = studies.unit_change()
    chains = Chains(study.pipeline, CUSTOMER)
    parts = []
    for n in study.pipeline.names:
        low, high = ends(study, study.incidents[0])
        for w in (low, high):
            cte = chains.node(n, w)
            moved = w & study.pipeline.lineage_fields(n) > 0
            parts += profile_parts(cte, numeric_of(n), f"'{n}' AS op, {moved} AS incident, ", 3)
    return with_(chains.ctes, "\nUNION ALL ".join(parts))


def frontier_ctes(study: Study, bodies, prefix: str = "") -> list[tuple[str, str]]:
    """{prefix}front(scenario, op, changed): the tables of an operator before and after only it flips."""
    pipeline, chains, flips, parts = study.pipeline, Chains(study.pipeline, bodies, prefix), {}, []
    for i in study.incidents:
        choice = study.choice(i)
        for n in pipeline.fields:
            w = pipeline.world([n], choice)
            if not w:
                parts.append(f"SELECT '{i.name}' AS scenario, '{n}' AS op, FALSE AS changed")
                continue
            if (n, w) not in flips:
                a, b = chains.node(n, 0), chains.node(n, w)
                differ = f"""EXISTS ((SELECT * FROM {a}) EXCEPT ALL (SELECT * FROM {b}))
                  OR EXISTS ((SELECT * FROM {b}) EXCEPT ALL (SELECT * FROM {a}))"""
                if pipeline.operators[n].params(choice[n]).get("drop_columns"):
                    differ = "TRUE"  # another column set
                flips[n, w] = (f"{prefix}flip_{len(flips)}", f"SELECT {differ} AS changed")
            parts.append(f"SELECT '{i.name}' AS scenario, '{n}' AS op, changed FROM {flips[n, w][0]}")
    return [*chains.ctes, *flips.values(), (f"{prefix}front", "\nUNION ALL ".join(parts))]


@oracle
def active_frontier():
    return with_(frontier_ctes(studies.gate(), CUSTOMER), "SELECT * FROM front")


# -- utility and game ----------------------------------------------------------------------


def study_utility(study: Study, kind="customer_value", m=0, prefix="", worlds=None, fit=utility_ctes) -> list[tuple[str, str]]:
    """CTEs of a study's utility table {prefix}u(w, u), over all its worlds or the given ones; `fit` is the scorer."""
    bodies, features = {
        "customer_value": (CUSTOMER, CUSTOMER_FEATURES),
        "trips": (TRIPS, TRIP_FEATURES),
        "fan_in": (fan_bodies(m), fan_features(m)) if m else (None, None),
    }[kind]
    probe = probe_chains(kind, m)
    probe.prefix = f"{prefix}probe_"
    cte = probe.node(probe.pipeline.sink, 0)
    chains = Chains(study.pipeline, bodies, prefix)
    return [*probe.ctes, *fit(chains, features, worlds or study.worlds(), cte, prefix)]


def game_ctes(study: Study, kind="customer_value", m=0, prefix="", anchored=False, fit=utility_ctes) -> list[tuple[str, str]]:
    """... plus {prefix}game, {prefix}players, {prefix}setting, {prefix}culprits.

    `anchored` leaves only the empty coalition and those that hold all moving sources.
    """
    coalitions, players, culprits = [], [], []
    for name, (pipeline, choice) in study.scenarios.items():
        moving = [n for n in pipeline.names if pipeline.world([n], choice)]
        for pick in range(1 << len(moving)):
            team = [n for k, n in enumerate(moving) if pick >> k & 1]
            if anchored and team and any(n in pipeline.sources and n not in team for n in moving):
                continue
            coalitions.append((name, sum(map(pipeline.bit, team)), pipeline.world(team, choice)))
        for n in pipeline.names:
            players.append((name, n, pipeline.bit(n), n in pipeline.sources, n in moving))
    for i in study.incidents:
        culprits += [(i.name, op) for op in sorted(set(i.culprits))]
    x = prefix
    return [
        *study_utility(study, kind, m, prefix, sorted({w for _, _, w in coalitions}) if anchored else None, fit),
        values(f"{x}coalitions", "scenario, mask, w", coalitions),
        values(f"{x}players", "scenario, op, bit, anchored, sensitive", players),
        values(f"{x}culprits", "scenario, op", culprits),
        (f"{x}game", f"""SELECT c.scenario, c.mask, u.u, u.u - z.u AS v
          FROM {x}coalitions c JOIN {x}u u ON u.w = c.w
          JOIN {x}coalitions z0 ON z0.scenario = c.scenario AND z0.mask = 0 JOIN {x}u z ON z.w = z0.w"""),
        (f"{x}setting", f"""SELECT scenario,
          CAST(coalesce(sum(bit) FILTER (anchored AND sensitive), 0) AS BIGINT) AS held,
          count(*) FILTER (sensitive AND NOT anchored) AS n_free, count(*) FILTER (sensitive) AS n_all,
          CAST(coalesce(sum(bit) FILTER (sensitive), 0) AS BIGINT) AS full_mask FROM {x}players GROUP BY scenario"""),
        (f"{x}totals", f"""SELECT s.scenario, a.v AS delta, b.v AS v_anchor FROM {x}setting s
          JOIN {x}game a ON a.scenario = s.scenario AND a.mask = s.full_mask
          JOIN {x}game b ON b.scenario = s.scenario AND b.mask = s.held"""),
    ]


def weight(size: str, n: str) -> str:
    return f"(CAST(factorial(CAST({size} AS INTEGER)) AS DOUBLE) * CAST(factorial(CAST({n} - {size} - 1 AS INTEGER)) AS DOUBLE) / CAST(factorial(CAST({n} AS INTEGER)) AS DOUBLE))"


def all_players(phi: str, method: str, x: str = "") -> str:
    return f"""SELECT p.scenario, '{method}' AS method, p.op, coalesce(f.phi, 0) AS phi
    FROM {x}players p LEFT JOIN ({phi}) f ON f.scenario = p.scenario AND f.op = p.op"""


def sql_shapley(x: str = "") -> str:
    phi = f"""SELECT p.scenario, p.op, sum({weight('bit_count(a.mask)', 's.n_all')} * (b.v - a.v)) AS phi
      FROM {x}game a JOIN {x}players p ON p.scenario = a.scenario AND p.sensitive AND a.mask & p.bit = 0
      JOIN {x}setting s ON s.scenario = a.scenario
      JOIN {x}game b ON b.scenario = a.scenario AND b.mask = a.mask | p.bit GROUP BY p.scenario, p.op"""
    return all_players(phi, "shapley", x)


def sql_anchored(x: str = "") -> str:
    size = "(bit_count(a.mask) - bit_count(s.held))"
    phi = f"""SELECT p.scenario, p.op, sum({weight(size, 's.n_free')} * (b.v - a.v)) AS phi
      FROM {x}game a JOIN {x}setting s ON s.scenario = a.scenario AND a.mask & s.held = s.held
      JOIN {x}players p ON p.scenario = a.scenario AND p.sensitive AND NOT p.anchored AND a.mask & p.bit = 0
      JOIN {x}game b ON b.scenario = a.scenario AND b.mask = a.mask | p.bit GROUP BY p.scenario, p.op"""
    return all_players(phi, "anchored", x)


def sql_loo(x: str = "") -> str:
    phi = f"""SELECT p.scenario, p.op, t.v - r.v AS phi FROM {x}players p JOIN {x}setting s USING (scenario)
      JOIN {x}game t ON t.scenario = p.scenario AND t.mask = s.full_mask
      JOIN {x}game r ON r.scenario = p.scenario AND r.mask = xor(s.full_mask, p.bit) WHERE p.sensitive"""
    return all_players(phi, "loo", x)


def perm_ctes(anchored: bool, x: str = "") -> list[tuple[str, str]]:
    """Pseudo-random orders of the (free) players and the running coalition along them."""
    free = "WHERE NOT anchored" if anchored else ""
    start = "s.held" if anchored else "CAST(0 AS BIGINT)"
    tag = f"{x}{'free' if anchored else 'all'}"
    return [
        (f"{tag}_slots", f"SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY op) AS slot FROM {x}players {free}"),
        (f"{tag}_x", f"""SELECT *, (perm * 7919 + slot * 104729 + {q.SEED} * 1299721) % 2147483647 AS x
          FROM {tag}_slots, (SELECT unnest(range(1, {q.SAMPLES} + 1)) AS perm)"""),
        (f"{tag}_z", f"SELECT *, ((x * x) % 2147483647 * 48271 + x) % 2147483647 AS z FROM {tag}_x"),
        (f"{tag}_walk", f"""SELECT k.scenario, k.perm, k.op,
          row_number() OVER o AS pos,
          CAST(sum(k.bit) OVER o AS BIGINT) & s.full_mask | {start} AS mask, {start} AS start_mask
          FROM {tag}_z k JOIN {x}setting s USING (scenario)
          WINDOW o AS (PARTITION BY k.scenario, k.perm ORDER BY (k.z * k.z) % 2147483647, k.op)"""),
        (f"{tag}_steps", f"""SELECT w.scenario, w.op, g.v - coalesce(lag(g.v) OVER
            (PARTITION BY w.scenario, w.perm ORDER BY w.pos), b.v) AS step
          FROM {tag}_walk w JOIN {x}game g ON g.scenario = w.scenario AND g.mask = w.mask
          JOIN {x}game b ON b.scenario = w.scenario AND b.mask = w.start_mask"""),
    ]


def sql_mc(anchored: bool, x: str = "") -> str:
    tag = f"{x}{'free' if anchored else 'all'}"
    phi = f"SELECT scenario, op, sum(step) / {q.SAMPLES} AS phi FROM {tag}_steps GROUP BY scenario, op"
    return all_players(phi, "anchored_mc" if anchored else "shapley_mc", x)


def walk_ctes(pipeline, x: str = "") -> list[tuple[str, str]]:
    """{x}walks(scenario, order_id, pos, op, phi) over all topological orders."""
    return [
        *order_ctes(pipeline),
        (f"{x}masks", f"""SELECT s.scenario, o.order_id, o.pos, o.op,
          CAST(sum(o.bit) OVER (PARTITION BY s.scenario, o.order_id ORDER BY o.pos) AS BIGINT) & s.full_mask AS mask
          FROM orders_list o, {x}setting s"""),
        (f"{x}walks", f"""SELECT m.scenario, m.order_id, m.pos, m.op,
          g.v - coalesce(lag(g.v) OVER (PARTITION BY m.scenario, m.order_id ORDER BY m.pos), 0) AS phi
          FROM {x}masks m JOIN {x}game g ON g.scenario = m.scenario AND g.mask = m.mask"""),
    ]


@oracle
def roc_auc():
    return """WITH d AS (SELECT lang, n_chars AS s, quality AS y FROM documents JOIN labels USING (doc_id)),
    r AS (SELECT *, rank() OVER (PARTITION BY lang ORDER BY s)
        + (count(*) OVER (PARTITION BY lang, s) - 1) / 2.0 AS r FROM d)
    SELECT lang, round((sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0)
      / nullif(CAST(count(*) FILTER (y = 1) AS DOUBLE) * count(*) FILTER (y = 0), 0), 6) AS auc FROM r GROUP BY lang"""


@oracle
def roc_auc_missing():
    return """WITH d AS (SELECT source, n_chars AS s, toxic AS y FROM documents JOIN labels USING (doc_id)
      WHERE doc_id % 7 <> 0 AND n_chars IS NOT NULL AND toxic IN (0, 1)),
    r AS (SELECT *, rank() OVER (PARTITION BY source ORDER BY s)
        + (count(*) OVER (PARTITION BY source, s) - 1) / 2.0 AS r FROM d),
    a AS (SELECT source, round((sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0)
      / nullif(CAST(count(*) FILTER (y = 1) AS DOUBLE) * count(*) FILTER (y = 0), 0), 6) AS auc FROM r GROUP BY source)
    SELECT s.source, a.auc FROM (SELECT DISTINCT source FROM documents) s LEFT JOIN a ON a.source IS NOT DISTINCT FROM s.source"""


@oracle
def utility_lda():
    return with_(study_utility(studies.incident()), "SELECT w, u FROM u")


@oracle
def utility_lr():
    return with_(study_utility(studies.incident(), fit=logistic_ctes), "SELECT w, u FROM u")


@oracle
def utility_lr_pair():
    """Newton steps written out, each 3 x 3 system solved by Cramer's rule."""
    study = studies.unit_change()
    chains = Chains(study.pipeline, CUSTOMER)
    probe = probe_chains("customer_value", 0)
    probe.prefix = "probe_"
    table = probe.node(probe.pipeline.sink, 0)
    sinks = chains.tagged_sinks(CUSTOMER_FEATURES, study.worlds())
    ctes = [
        *chains.ctes, *probe.ctes, ("sinks", sinks),
        ("scale", """SELECT w, avg(income) AS m1, avg(avg_amount) AS m2,
            CASE WHEN var_pop(income) > 0 THEN sqrt(var_pop(income)) ELSE 1 END AS s1,
            CASE WHEN var_pop(avg_amount) > 0 THEN sqrt(var_pop(avg_amount)) ELSE 1 END AS s2,
            count(*) >= 50 AND count(DISTINCT label) >= 2 AS ok FROM sinks GROUP BY w"""),
        ("z", "SELECT w, (income - m1) / s1 AS z1, (avg_amount - m2) / s2 AS z2, CAST(label AS DOUBLE) AS y FROM sinks JOIN scale USING (w) WHERE ok"),
        ("b0", "SELECT DISTINCT w, CAST(0 AS DOUBLE) AS c0, CAST(0 AS DOUBLE) AS c1, CAST(0 AS DOUBLE) AS c2 FROM z"),
    ]
    det = lambda a, b, c: (  # noqa: E731  determinant of three columns of (0, 1, 2) entries
        f"({a[0]} * ({b[1]} * {c[2]} - {c[1]} * {b[2]}) - {b[0]} * ({a[1]} * {c[2]} - {c[1]} * {a[2]})"
        f" + {c[0]} * ({a[1]} * {b[2]} - {b[1]} * {a[2]}))"
    )
    h = [["h00", "h01", "h02"], ["h01", "h11", "h12"], ["h02", "h12", "h22"]]
    g = ["g0", "g1", "g2"]
    for k in range(12):
        ctes += [
            (f"p{k}", f"SELECT z.*, c0, c1, c2, 1 / (1 + exp(-(c0 + c1 * z1 + c2 * z2))) AS p FROM z JOIN b{k} USING (w)"),
            (f"s{k}", f"""SELECT w, c0, c1, c2, sum(p - y) AS g0, sum((p - y) * z1) + c1 AS g1, sum((p - y) * z2) + c2 AS g2,
              sum(p * (1 - p)) AS h00, sum(p * (1 - p) * z1) AS h01, sum(p * (1 - p) * z2) AS h02,
              sum(p * (1 - p) * z1 * z1) + 1 AS h11, sum(p * (1 - p) * z1 * z2) AS h12,
              sum(p * (1 - p) * z2 * z2) + 1 AS h22 FROM p{k} GROUP BY w, c0, c1, c2"""),
            (f"b{k + 1}", f"""SELECT w, c0 - {det(g, h[1], h[2])} / {det(*h)} AS c0,
              c1 - {det(h[0], g, h[2])} / {det(*h)} AS c1, c2 - {det(h[0], h[1], g)} / {det(*h)} AS c2 FROM s{k}"""),
        ]
    ctes += [
        ("k", "SELECT scale.w, coalesce(c1 / s1, 0) AS k1, coalesce(c2 / s2, 0) AS k2, ok FROM scale LEFT JOIN b12 USING (w)"),
        ("scored", f"SELECT w, label AS y, round(k1 * coalesce(income, 0) + k2 * coalesce(avg_amount, 0), 6) AS s FROM {table} CROSS JOIN k"),
        ("r", """SELECT *, rank() OVER (PARTITION BY w ORDER BY s)
            + (count(*) OVER (PARTITION BY w, s) - 1) / 2.0 AS r FROM scored"""),
        ("auc", """SELECT w, (sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0)
            / nullif(CAST(count(*) FILTER (y = 1) AS DOUBLE) * count(*) FILTER (y = 0), 0) AS u FROM r GROUP BY w"""),
    ]
    return with_(ctes, """SELECT k.w, round(k1, 9) AS income, round(k2, 9) AS avg_amount,
      round(CASE WHEN ok THEN coalesce(u, 0.5) ELSE 0.5 END, 8) AS u FROM k LEFT JOIN auc USING (w)""")


@oracle
def utility_metric():
    study = studies.incident()
    chains = Chains(study.pipeline, CUSTOMER)
    sinks = chains.tagged_sinks(CUSTOMER_FEATURES, study.worlds())
    return with_([*chains.ctes, ("sinks", sinks)], """SELECT w, CAST(coalesce(sum(txn_count), 0) AS DOUBLE) AS u
    FROM sinks GROUP BY w""")


@oracle
def game_values():
    study = studies.incident()
    full, core = study.pipeline.full_mask, study.pipeline.sensitive_mask
    return with_(game_ctes(study), f"""SELECT scenario, m AS mask, {r8('u')} AS u, {r8('v')} AS v
    FROM (SELECT unnest(range(0, {full + 1})) AS m) JOIN game ON game.mask = m & {core}""")


@oracle
def utility_python():
    study = studies.incident()
    chains = Chains(study.pipeline, CUSTOMER)
    sinks = chains.tagged_sinks(CUSTOMER_FEATURES, study.worlds())
    worlds = values("worlds", "w", [(w,) for w in study.worlds()])
    return with_([*chains.ctes, ("sinks", sinks), worlds, ("m", """SELECT w, coalesce(sum(txn_count) FILTER (label = 1) / CAST(count(*) FILTER (label = 1) AS DOUBLE), 0)
      - coalesce(sum(txn_count) FILTER (label = 0) / CAST(count(*) FILTER (label = 0) AS DOUBLE), 0) AS u
      FROM sinks WHERE txn_count IS NOT NULL GROUP BY w""")], f"SELECT w, {r8('coalesce(u, 0.5)')} AS u FROM worlds LEFT JOIN m USING (w)")


@oracle
def probe_table():
    chains = probe_chains("customer_value")
    return of_node(chains, "encode_features", 0)


# -- attribution ---------------------------------------------------------------------------


def phi_of(sql: str) -> str:
    return f"SELECT scenario, method, op, {r8('phi')} AS phi FROM ({sql})"


@oracle
def shapley_exact():
    return with_(game_ctes(studies.incident()), phi_of(sql_shapley()))


@oracle
def shapley_many_players():
    """An item that m players hold is worth 1/m to each of them."""
    return """WITH h AS (SELECT DISTINCT source, n_chars FROM documents WHERE source IS NOT NULL),
    m AS (SELECT n_chars, count(*) AS m FROM h GROUP BY n_chars)
    SELECT 'coverage' AS scenario, 'shapley' AS method, h.source AS op, round(sum(1 / CAST(m.m AS DOUBLE)), 6) AS phi
    FROM h JOIN m ON m.n_chars IS NOT DISTINCT FROM h.n_chars GROUP BY h.source"""


@oracle
def shapley_mc():
    return with_([*game_ctes(studies.incident()), *perm_ctes(False)], phi_of(sql_mc(False)))


@oracle
def shapley_anchored():
    return with_(game_ctes(studies.incident()), phi_of(sql_anchored()))


@oracle
def shapley_anchored_mc():
    return with_([*game_ctes(studies.incident()), *perm_ctes(True)], phi_of(sql_mc(True)))


@oracle
def leave_one_out():
    return with_(game_ctes(studies.incident()), phi_of(sql_loo()))


@oracle
def topological_orders():
    study = studies.incident()
    ctes = [*game_ctes(study), *walk_ctes(study.pipeline)]
    return with_(ctes, f"SELECT order_id, pos, op, {r8('phi')} AS phi FROM walks", True)


@oracle
def stagewise():
    study = studies.incident()
    ctes = [*game_ctes(study), *walk_ctes(study.pipeline)]
    return with_(ctes, f"SELECT scenario, pos, op, {r8('phi')} AS phi FROM walks WHERE order_id = 1", True)


def drift_ctes(study: Study, chains: Chains, numeric, x: str = "") -> list[tuple[str, str]]:
    """{x}drift(scenario, op, phi): one comparison of two plain tables per scenario and operator."""
    seen, cells, pairs = set(), [], []
    p = study.pipeline
    for i in study.incidents:
        low, high = ends(study, i)
        for n in p.names:
            a, b = chains.node(n, low), chains.node(n, high)
            field = p.fields.get(n)
            gone = set()
            if field:
                gone = set(p.operators[n].params(field.choice(high)).get("drop_columns", ()))
            for cte, lost in ((a, set()), (b, gone)):
                if cte in seen:
                    continue
                seen.add(cte)
                cols = [c for c in numeric(n) if c not in lost]
                names = ", ".join(f"'{c}'" for c in cols)
                mean = ", ".join(f'avg(CAST("{c}" AS DOUBLE))' for c in cols)
                sd = ", ".join(f'stddev_samp(CAST("{c}" AS DOUBLE))' for c in cols)
                cells.append(f"""SELECT '{cte}' AS t, unnest([{names}]) AS c, count(*) AS n,
                  unnest([{mean}]) AS m, unnest([{sd}]) AS sd FROM {cte}""")
            for c in numeric(n):
                if c not in gone:
                    pairs.append((i.name, n, a, b, c, 1 if gone else 0))
    return [
        *chains.ctes,
        (f"{x}cells", "\nUNION ALL ".join(cells)),
        values(f"{x}pairs", "scenario, op, a, b, c, changed", pairs),
        (f"{x}drift", f"""SELECT p.scenario, 'drift' AS method, p.op, -(coalesce(avg(abs(a.m - b.m) /
            CASE WHEN coalesce(a.sd, 0) = 0 THEN 1 ELSE a.sd END), 0)
            + max(abs(a.n - b.n) / CAST(greatest(a.n, 1) AS DOUBLE)) + max(p.changed)) AS phi
          FROM {x}pairs p JOIN {x}cells a ON a.t = p.a AND a.c = p.c JOIN {x}cells b ON b.t = p.b AND b.c = p.c
          GROUP BY p.scenario, p.op"""),
    ]


def customer_drift(study: Study) -> list[tuple[str, str]]:
    return drift_ctes(study, Chains(study.pipeline, CUSTOMER, "d_"), numeric_of)


def trip_numeric(name: str) -> list[str]:
    base = ["trip_id", "passenger_count", "trip_distance", "pu_zone", "do_zone", "fare_amount", "net_amount"]
    timed = [*base, "duration", "hour", "dow"]
    stats = ["zone_mean_fare", "zone_trip_count"]
    return {
        "load_trips": base,
        "load_zones": ["zone"],
        "filter_valid": base,
        "derive_time": timed,
        "zone_stats": ["pu_zone", *stats],
        "join_pu_zone": timed,
        "join_do_zone": timed,
        "join_stats": [*timed, *stats],
        "encode": [*TRIP_FEATURES, "label"],
    }[name]


@oracle
def node_drift():
    ctes = customer_drift(studies.incident())
    return with_(ctes, "SELECT scenario, method, op, round(phi, 6) AS phi FROM drift")


# -- scores --------------------------------------------------------------------------------


def rank_ctes(table: str) -> list[tuple[str, str]]:
    return [
        ("ranked", f"""SELECT *, row_number() OVER (PARTITION BY scenario, method ORDER BY round(phi, 9), op) AS rank
          FROM ({table})"""),
        ("judged", """SELECT r.scenario, r.method,
          CAST(coalesce(min(r.rank) FILTER (c.op IS NOT NULL) = 1, FALSE) AS DOUBLE) AS p_at_1,
          coalesce(CAST(1 AS DOUBLE) / min(r.rank) FILTER (c.op IS NOT NULL), 0) AS mrr,
          coalesce(sum(round(-r.phi, 9)) FILTER (c.op IS NOT NULL AND round(r.phi, 9) < 0)
            / sum(round(-r.phi, 9)) FILTER (round(r.phi, 9) < 0), 0) AS mass
          FROM ranked r LEFT JOIN culprits c ON c.scenario = r.scenario AND c.op = r.op
          GROUP BY r.scenario, r.method"""),
    ]


FIRST_WALK = "SELECT scenario, 'stagewise' AS method, op, phi FROM walks WHERE order_id = 1"


def four_methods() -> str:
    return f"{sql_shapley()} UNION ALL {sql_anchored()} UNION ALL {sql_loo()} UNION ALL {FIRST_WALK}"


def judged_ctes() -> list[tuple[str, str]]:
    study = studies.incident()
    return [*game_ctes(study), *walk_ctes(study.pipeline), ("attribution", four_methods()), *rank_ctes("SELECT * FROM attribution")]


@oracle
def blame_ranking():
    return with_(judged_ctes(), f"SELECT scenario, method, op, {r8('phi')} AS phi, rank FROM ranked", True)


@oracle
def precision_at_1():
    return with_(judged_ctes(), "SELECT scenario, method, p_at_1 FROM judged", True)


@oracle
def reciprocal_rank():
    return with_(judged_ctes(), "SELECT scenario, method, round(mrr, 6) AS mrr FROM judged", True)


@oracle
def blame_mass():
    return with_(judged_ctes(), "SELECT scenario, method, round(mass, 6) AS mass FROM judged", True)


# -- reports -------------------------------------------------------------------------------


GAPS = ("gaps", """SELECT a.scenario, a.method, sum(a.phi) AS total_phi,
  any_value(CASE WHEN a.method LIKE 'anchored%' THEN t.delta - t.v_anchor ELSE t.delta END) AS to_explain
  FROM attribution a JOIN totals t USING (scenario) GROUP BY a.scenario, a.method""")


@oracle
def efficiency_gap():
    return with_([*judged_ctes(), GAPS], f"""SELECT scenario, method, {r8('total_phi')} AS total_phi,
    {r8('to_explain')} AS to_explain, {r8('abs(total_phi - to_explain)')} AS gap FROM gaps""", True)


@oracle
def mc_error():
    ctes = [*game_ctes(studies.incident()), *perm_ctes(False), ("e", sql_shapley()), ("s", sql_mc(False))]
    return with_(ctes, f"""SELECT e.scenario, {r8('max(abs(e.phi - s.phi))')} AS max_err
    FROM e JOIN s ON s.scenario = e.scenario AND s.op = e.op GROUP BY e.scenario""")


@oracle
def boundary_check():
    inside = weight("(bit_count(g.mask) - 1)", "s.n_all")
    outside = weight("bit_count(g.mask)", "s.n_all")
    ctes = [
        *game_ctes(studies.incident()),
        ("loo", sql_loo()),
        ("shapley", sql_shapley()),
        ("subsets", f"""SELECT p.scenario, p.op, sum(CASE WHEN g.mask & p.bit <> 0 THEN {inside} * g.v
            ELSE -{outside.replace('factorial(CAST(s.n_all - bit_count(g.mask) - 1', 'factorial(CAST(greatest(s.n_all - bit_count(g.mask) - 1, 0)')} * g.v END) AS phi
          FROM players p JOIN game g ON g.scenario = p.scenario JOIN setting s ON s.scenario = p.scenario
          WHERE p.sensitive GROUP BY p.scenario, p.op"""),
        ("lone", """SELECT p.scenario, p.op, sum(b.v - a.v) AS phi FROM players p JOIN setting s USING (scenario)
          JOIN game a ON a.scenario = p.scenario AND a.mask & xor(s.full_mask, p.bit) = xor(s.full_mask, p.bit)
            AND a.mask & p.bit = 0
          JOIN game b ON b.scenario = p.scenario AND b.mask = a.mask | p.bit
          WHERE p.sensitive GROUP BY p.scenario, p.op"""),
    ]
    return with_(ctes, f"""SELECT scenario, 'anchor none = shapley' AS identity,
      {r8('max(abs(a.phi - b.phi))')} AS max_gap FROM shapley a JOIN subsets b USING (scenario, op) GROUP BY scenario
    UNION ALL SELECT scenario, 'anchor all others = leave-one-out', {r8('max(abs(a.phi - b.phi))')}
      FROM loo a JOIN lone b USING (scenario, op) GROUP BY scenario""")


def groups(study: Study) -> tuple[str, str]:
    rows = [(i.name, i.group) for i in study.incidents]
    rows += [(i.name, "compound") for i in study.incidents if i.group == "harmful" and "+" in i.name]
    return values("groups", "scenario, grp", rows)


@oracle
def report_gate():
    study = studies.gate()
    last = "(SELECT max(order_id) FROM walks)"
    table = f"""{sql_shapley()} UNION ALL {sql_mc(False)} UNION ALL {sql_loo()}
      UNION ALL SELECT scenario, 'stagewise_a', op, phi FROM walks WHERE order_id = 1
      UNION ALL SELECT scenario, 'stagewise_b', op, phi FROM walks WHERE order_id = {last}
      UNION ALL SELECT * FROM drift"""
    ctes = [
        *game_ctes(study), *perm_ctes(False), *walk_ctes(study.pipeline), *customer_drift(study),
        *rank_ctes(table), groups(study),
    ]
    return with_(ctes, """SELECT grp, method, count(*) AS n_scenarios, round(avg(p_at_1), 6) AS p_at_1,
    round(avg(mrr), 6) AS mrr, round(avg(mass), 6) AS mass
    FROM judged JOIN groups USING (scenario) GROUP BY grp, method""", True)


@oracle
def report_benign():
    study = studies.gate()
    ctes = [*game_ctes(study), groups(study), ("s", sql_shapley())]
    return with_(ctes, f"""SELECT scenario, {r8('any_value(delta)')} AS delta, {r8('max(abs(phi))')} AS max_abs_phi
    FROM s JOIN totals USING (scenario) JOIN groups USING (scenario) WHERE grp = 'benign' GROUP BY scenario""")


def ladder_ctes(study: Study, kind: str) -> list[tuple[str, str]]:
    """ladder(...): one row per fault and severity."""
    drift = (
        customer_drift(study) if kind == "customer_value"
        else drift_ctes(study, Chains(study.pipeline, TRIPS, "d_"), trip_numeric)
    )
    names = [(i.name, *i.name.split("/", 1), i.culprits[0]) for i in study.incidents]
    features = CUSTOMER_FEATURES if kind == "customer_value" else TRIP_FEATURES
    cols = ", ".join(f'"{c}"' for c in [*features, "label"])
    methods = ", ".join(
        f"max({c}) FILTER (method = '{m}') AS {m}_{c}"
        for m in ("shapley", "anchored", "loo", "drift", "stagewise") for c in ("p_at_1", "mrr")
    )
    return [
        *game_ctes(study, kind), *walk_ctes(study.pipeline), *drift,
        ("attribution", f"{four_methods()} UNION ALL SELECT * FROM drift"),
        *rank_ctes("SELECT * FROM attribution"), GAPS,
        values("names", "scenario, fault_type, severity, culprit", names),
        ("method_scores", f"SELECT scenario, {methods} FROM judged GROUP BY scenario"),
        ("alone", """SELECT p.scenario, max(g.v) FILTER (c.op IS NOT NULL) AS fault_alone,
            max(abs(coalesce(g.v, 0))) FILTER (p.anchored) AS drift_alone
          FROM players p LEFT JOIN game g ON g.scenario = p.scenario AND g.mask = p.bit
          LEFT JOIN culprits c ON c.scenario = p.scenario AND c.op = p.op GROUP BY p.scenario"""),
        ("gap_wide", """SELECT scenario, max(abs(total_phi - to_explain)) FILTER (method = 'anchored') AS anchored_eff_gap,
            max(abs(total_phi - to_explain)) FILTER (method = 'loo') AS loo_eff_gap FROM gaps GROUP BY scenario"""),
        ("shapes", f"SELECT w, count(*) AS n, sum(CAST(hash({cols}) AS HUGEINT)) AS h FROM sinks GROUP BY w"),
        ("cost", """SELECT c.scenario, count(DISTINCT (coalesce(s.n, 0), coalesce(s.h, 0))) AS model_fits
          FROM coalitions c LEFT JOIN shapes s ON s.w = c.w GROUP BY c.scenario"""),
        ("ladder", """SELECT scenario, fault_type, severity, culprit, delta, fault_alone, drift_alone,
            abs(fault_alone) / greatest(drift_alone, 1e-9) AS ratio, anchored_eff_gap, loo_eff_gap, model_fits,
            abs(delta) >= 0.002::DOUBLE AS measurable, method_scores.* EXCLUDE (scenario)
          FROM names JOIN totals USING (scenario) JOIN alone USING (scenario) JOIN cost USING (scenario)
          JOIN gap_wide USING (scenario) JOIN method_scores USING (scenario)"""),
    ]


METHODS = ["shapley", "anchored", "loo", "drift", "stagewise"]


@oracle
def severity_ladder():
    numbers = ", ".join(f"{r8(c)} AS {c}" for c in q.LADDER_NUMBERS)
    scores = ", ".join(f"round({m}_{c}, 6) AS {m}_{c}" for m in METHODS for c in ("p_at_1", "mrr"))
    return with_(ladder_ctes(studies.ladder(), "customer_value"),
                 f"SELECT fault_type, severity, culprit, measurable, model_fits, {numbers}, {scores} FROM ladder", True)


@oracle
def ratio_bins():
    return binned(RATIO_BINS)


@oracle
def coarse_ratio_bins():
    return binned(COARSE_BINS)


@oracle
def excluded_cases():
    return with_(ladder_ctes(studies.ladder(), "customer_value"),
                 "SELECT fault_type, severity FROM ladder WHERE NOT measurable", True)


@oracle
def validity_summary():
    parts = "\nUNION ALL ".join(
        f"""SELECT '{m}' AS method, count(*) AS n, round(avg({m}_p_at_1), 6) AS p_at_1, round(avg({m}_mrr), 6) AS mrr
        FROM ladder WHERE delta <= -0.002::DOUBLE AND fault_alone <= -0.002::DOUBLE HAVING count(*) > 0"""
        for m in METHODS
    )
    return with_(ladder_ctes(studies.trip_ladder(), "trips"), parts, True)


def binned(bins) -> str:
    case = " ".join(
        f"WHEN ratio >= {low} " + (f"AND ratio < {high} " if high is not None else "") + f"THEN '{name}'"
        for low, high, name in bins
    )
    means = ", ".join(f"round(avg({m}_p_at_1), 6) AS {m}" for m in METHODS)
    return with_(ladder_ctes(studies.ladder(), "customer_value"), f"""
    SELECT CASE {case} END AS ratio_bin, count(*) AS n, {means} FROM ladder WHERE measurable GROUP BY 1
    UNION ALL SELECT 'OVERALL', count(*), {means} FROM ladder WHERE measurable""", True)


@oracle
def method_agreement():
    return with_(ladder_ctes(studies.ladder(), "customer_value"), f"""SELECT
    count(*) FILTER (measurable AND anchored_p_at_1 = loo_p_at_1) AS agree, count(*) FILTER (measurable) AS live,
    {r8('max(anchored_eff_gap)')} AS anchored_gap_max, {r8('max(loo_eff_gap)')} AS loo_gap_max,
    {r8('avg(loo_eff_gap)')} AS loo_gap_mean FROM ladder""", True)


@oracle
def case_validity():
    study = studies.trip_ladder()
    n = len(study.pipeline.names)
    return with_([*ladder_ctes(study, "trips"), *frontier_ctes(study, TRIPS, "f_")], f"""SELECT fault_type, severity, culprit,
    {r8('delta')} AS delta, {r8('fault_alone')} AS fault_alone,
    delta <= -0.002::DOUBLE AS degraded, fault_alone <= -0.002::DOUBLE AS harmful,
    delta <= -0.002::DOUBLE AND fault_alone <= -0.002::DOUBLE AS valid,
    CASE WHEN fault_alone > -0.002::DOUBLE THEN 'fault does no harm'
         WHEN delta > -0.002::DOUBLE THEN 'no net degradation' ELSE 'valid' END AS reason,
    CAST({n} AS BIGINT) AS n_operators, CAST({1 << n} AS BIGINT) AS lattice, model_fits,
    (SELECT count(*) FROM f_front f WHERE f.scenario = ladder.scenario AND changed) AS frontier FROM ladder""", True)


@oracle
def drift_floor():
    ctes = game_ctes(studies.trip_ladder(), "trips")
    return with_(ctes, f"""SELECT {r8('max(abs(v))')} AS max_drift, max(abs(v)) < 0.002::DOUBLE AS negligible
    FROM players p JOIN game g ON g.scenario = p.scenario AND g.mask = p.bit WHERE p.anchored""")


@oracle
def order_dependence():
    study = studies.orders()
    ctes = [*game_ctes(study), *walk_ctes(study.pipeline), ("a", sql_anchored())]
    return with_(ctes, f"""SELECT w.scenario, w.op, any_value(c.op IS NOT NULL) AS is_culprit,
    any_value(p.anchored) AS is_source, count(*) AS n_orders, {r8('min(w.phi)')} AS stagewise_min,
    {r8('max(w.phi)')} AS stagewise_max, {r8('max(w.phi) - min(w.phi)')} AS spread,
    min(w.phi) < -1e-9 AND max(w.phi) > 1e-9 AS sign_flips, {r8('any_value(a.phi)')} AS anchored
    FROM walks w JOIN players p ON p.scenario = w.scenario AND p.op = w.op
      JOIN a ON a.scenario = w.scenario AND a.op = w.op
      LEFT JOIN culprits c ON c.scenario = w.scenario AND c.op = w.op GROUP BY w.scenario, w.op""", True)


@oracle
def order_top_blamed():
    study = studies.orders()
    ctes = [
        *game_ctes(study), *walk_ctes(study.pipeline),
        ("winner", """SELECT * FROM walks QUALIFY row_number() OVER
          (PARTITION BY scenario, order_id ORDER BY round(phi, 9), op) = 1"""),
    ]
    return with_(ctes, f"""SELECT w.scenario, w.op, count(*) AS n_orders, any_value(c.op IS NOT NULL) AS is_culprit
    FROM winner w LEFT JOIN culprits c ON c.scenario = w.scenario AND c.op = w.op GROUP BY w.scenario, w.op""", True)


@oracle
def scale_report():
    ctes, parts = [], []
    for m in studies.SCALE_WIDTHS:
        study = studies.width(m)
        x = f"m{m}_"
        p = study.pipeline
        chains = Chains(p, fan_bodies(m), f"{x}f_")
        changed = []
        for n in sorted(p.fields):
            a, b = chains.node(n, 0), chains.node(n, p.world([n]))
            changed.append(f"""SELECT EXISTS ((SELECT * FROM {a}) EXCEPT ALL (SELECT * FROM {b}))
              OR EXISTS ((SELECT * FROM {b}) EXCEPT ALL (SELECT * FROM {a})) AS changed""")
        cols = ", ".join([*fan_features(m), "label"])
        ctes += [
            *game_ctes(study, "fan_in", m, x, anchored=True), *perm_ctes(True, x), *chains.ctes,
            (f"{x}front", "\nUNION ALL ".join(changed)),
            (f"{x}prints", f"SELECT w, count(*) AS n, sum(CAST(hash({cols}) AS HUGEINT)) AS h FROM {x}sinks GROUP BY w"),
            (f"{x}e", sql_anchored(x)), (f"{x}s", sql_mc(True, x)),
        ]
        n = len(p.names)
        parts.append(f"""SELECT CAST({m} AS BIGINT) AS m, CAST({n} AS BIGINT) AS n, CAST({1 << n} AS BIGINT) AS lattice,
          f.fits AS model_fits, round({1 << n} / CAST(f.fits AS DOUBLE), 3) AS reduction,
          (SELECT count(*) FROM {x}front WHERE changed) AS frontier,
          (SELECT {r8('max(abs(e.phi - s.phi))')} FROM {x}e e JOIN {x}s s ON s.op = e.op) AS mc_max_err,
          {r8('t.delta')} AS delta, abs(t.delta) >= 0.002::DOUBLE AS measurable, b.op AS top_blame, 'agg_0' AS culprit,
          abs(t.delta) >= 0.002::DOUBLE AND b.op = 'agg_0' AS correct
          FROM {x}totals t, (SELECT count(DISTINCT (n, h)) AS fits FROM {x}prints) f,
            (SELECT op FROM {x}s ORDER BY round(phi, 9), op LIMIT 1) b""")
    return with_(ctes, "\nUNION ALL ".join(parts))


@oracle
def incident_report():
    return incident_card(utility_ctes)


@oracle
def incident_report_lr():
    return incident_card(logistic_ctes)


def incident_card(fit) -> str:
    study = studies.incident()
    n, pipeline = len(study.pipeline.names), study.pipeline
    chains, changed = Chains(pipeline, CUSTOMER, "front_"), []
    for op in pipeline.fields:
        w = pipeline.world([op], study.choice(study.incidents[0]))
        if w and pipeline.operators[op].params(1).get("drop_columns"):
            changed.append("SELECT TRUE AS changed")
        elif w:
            a, b = chains.node(op, 0), chains.node(op, w)
            changed.append(f"""SELECT EXISTS ((SELECT * FROM {a}) EXCEPT ALL (SELECT * FROM {b}))
              OR EXISTS ((SELECT * FROM {b}) EXCEPT ALL (SELECT * FROM {a})) AS changed""")
    cols = ", ".join(f'"{c}"' for c in [*CUSTOMER_FEATURES, "label"])
    ctes = [
        *game_ctes(study, fit=fit), ("a", sql_anchored()), *chains.ctes, ("front", "\nUNION ALL ".join(changed)),
        ("prints", f"SELECT w, count(*) AS n, sum(CAST(hash({cols}) AS HUGEINT)) AS h FROM sinks GROUP BY w"),
    ]
    return with_(ctes, f"""SELECT a.scenario, row_number() OVER (ORDER BY round(a.phi, 9), a.op) AS rank, a.op,
    {r8('a.phi')} AS phi, c.op IS NOT NULL AS is_culprit, p.anchored, {r8('t.delta')} AS delta,
    {r8('t.v_anchor')} AS v_anchor, {r8('s.total_phi')} AS total_phi, {r8('t.delta - t.v_anchor')} AS to_explain,
    {r8('abs(s.total_phi - (t.delta - t.v_anchor))')} AS gap,
    CAST({n} AS BIGINT) AS n_operators, CAST({1 << n} AS BIGINT) AS lattice,
    (SELECT count(DISTINCT (n, h)) FROM prints) AS model_fits, (SELECT count(*) FROM front WHERE changed) AS frontier
    FROM a JOIN players p ON p.scenario = a.scenario AND p.op = a.op JOIN totals t ON t.scenario = a.scenario
      JOIN (SELECT scenario, sum(phi) AS total_phi FROM a GROUP BY scenario) s ON s.scenario = a.scenario
      LEFT JOIN culprits c ON c.scenario = a.scenario AND c.op = a.op""")
