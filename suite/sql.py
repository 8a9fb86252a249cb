"""Plain SQL for pipelines: every world is its own chain of CTEs with literal parameters.

This is a second formulation of the same questions, not the tagged plan written again: there is
no world column inside the chains, each operator is a textbook query over its parents.
"""

from __future__ import annotations

from collections.abc import Callable

from blamesplit.plans import customer_value as cv
from blamesplit.plans import fan_in, trips
from blamesplit.plans.pipeline import Pipeline


def hit(key: str, rate: float, seed: int) -> str:
    return f"((({key}) * 48271 + {seed} * 69621) % 1000 < {round(rate * 1000)})"


def one_hot(column: str, vocabulary, prefix: str) -> list[str]:
    return [
        f"CAST(coalesce({column} = '{v}', FALSE) AS INTEGER) AS \"{prefix}_{v.replace(' ', '_')}\""
        for v in vocabulary
    ]


# -- customer pipeline ---------------------------------------------------------------------


def sql_load_customers(p, i):
    y = p["year"]
    return f"""SELECT c.c_custkey AS customer_id, c.c_acctbal AS income, c.c_mktsegment AS segment,
      coalesce(date_diff('day', CAST(h.first_order AS DATE), DATE '{y + 1}-01-01'), 0) AS tenure_days,
      CAST(coalesce(h.cents > {int(cv.HIGH_VALUE_SPEND * 100)}, FALSE) AS BIGINT) AS label
    FROM customer c LEFT JOIN (
      SELECT o_custkey, min(o_orderdate) AS first_order,
             sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS cents
      FROM orders GROUP BY o_custkey) h ON h.o_custkey = c.c_custkey"""


def sql_load_transactions(p, i):
    y = p["year"]
    return f"""SELECT o_custkey AS customer_id, o_totalprice AS amount FROM orders
    WHERE o_orderdate >= TIMESTAMP '{y}-01-01' AND o_orderdate < TIMESTAMP '{y + 1}-01-01'"""


def sql_clean_customers(p, i):
    src = i["load_customers"]
    income = "income"
    if p.get("null_rate", 0.0) > 0:
        cond = hit("customer_id", p["null_rate"], cv.NULL_SEED)
        if p.get("null_mode", "mcar") == "mnar":
            cond += f" AND income > (SELECT median(income) FROM {src})"
        income = f"CASE WHEN {cond} THEN NULL ELSE income END"
    return f"""SELECT customer_id, income, segment,
      CASE WHEN tenure_days < 0 THEN 0 WHEN tenure_days > {cv.TENURE_LIMIT} THEN {cv.TENURE_LIMIT}
           ELSE tenure_days END AS tenure_days, label
    FROM (SELECT * REPLACE ({income} AS income) FROM {src}) WHERE income IS NOT NULL"""


def sql_agg_transactions(p, i):
    scale = p.get("amount_scale", 1.0)
    return f"""SELECT customer_id, CAST(units AS DOUBLE) / CAST(10000 AS DOUBLE) AS total_amount, txn_count,
      CAST(units AS DOUBLE) / (txn_count * CAST(10000 AS DOUBLE)) AS avg_amount
    FROM (SELECT customer_id, count(amount) AS txn_count,
                 sum(CAST(round(amount * 10000 * CAST({scale} AS DOUBLE)) AS BIGINT)) AS units
          FROM {i['load_transactions']} GROUP BY customer_id)"""


def sql_join_features(p, i):
    agg = i["agg_transactions"]
    right = f"SELECT * FROM {agg}"
    if p.get("duplicate_rate", 0.0) > 0:
        cond = hit("customer_id", p["duplicate_rate"], cv.DUPLICATE_SEED)
        if p.get("duplicate_bias") == "high_spend":
            cond += f" AND total_amount >= (SELECT quantile_cont(total_amount, 0.75) FROM {agg})"
        extra = f" UNION ALL SELECT * FROM {agg} WHERE {cond}"
        right += extra * p.get("duplicate_factor", 1)
    return f"""SELECT c.customer_id, c.income, c.segment, c.tenure_days, c.label,
      coalesce(a.total_amount, 0) AS total_amount, coalesce(a.txn_count, 0) AS txn_count,
      coalesce(a.avg_amount, 0) AS avg_amount
    FROM {i['clean_customers']} c LEFT JOIN ({right}) a ON a.customer_id = c.customer_id"""


def sql_filter_active(p, i):
    return f"SELECT * FROM {i['join_features']} WHERE txn_count >= {p['min_txn']}"


def sql_encode_features(p, i):
    gone = set(p.get("drop_columns", ()))
    cols = [c for c in cv.FEATURES if c not in gone]
    cols += one_hot("segment", cv.SEGMENTS, "segment") + ["label"]
    return f"SELECT {', '.join(cols)} FROM {i['filter_active']}"


CUSTOMER = {
    "load_customers": sql_load_customers,
    "load_transactions": sql_load_transactions,
    "clean_customers": sql_clean_customers,
    "agg_transactions": sql_agg_transactions,
    "join_features": sql_join_features,
    "filter_active": sql_filter_active,
    "encode_features": sql_encode_features,
}
CUSTOMER_FEATURES = [*cv.FEATURES, *[f"segment_{s}" for s in cv.SEGMENTS]]


# -- trip pipeline -------------------------------------------------------------------------


def sql_load_trips(p, i):
    low, high = p["half"]
    return f"""SELECT l_orderkey * 8 + l_linenumber AS trip_id, o_orderdate AS pickup_at,
      l_shipdate AS dropoff_at, CAST(l_linenumber AS DOUBLE) AS passenger_count,
      l_quantity AS trip_distance, CAST(s_nationkey AS BIGINT) AS pu_zone,
      CAST(c_nationkey AS BIGINT) AS do_zone, l_returnflag AS payment_type,
      l_extendedprice AS fare_amount, l_extendedprice * (1 - l_discount) AS net_amount
    FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
      JOIN supplier ON s_suppkey = l_suppkey
    WHERE l_shipdate >= TIMESTAMP '{low}' AND l_shipdate < TIMESTAMP '{high}'"""


def sql_load_zones(p, i):
    return """SELECT CAST(n_nationkey AS BIGINT) AS zone, r_name AS region
    FROM nation JOIN region ON r_regionkey = n_regionkey"""


def sql_filter_valid(p, i):
    return f"""SELECT * FROM {i['load_trips']} WHERE payment_type <> 'N'
      AND fare_amount > {p['min_fare']} AND trip_distance > 0 AND trip_distance < 100
      AND passenger_count IS NOT NULL"""


def sql_derive_time(p, i):
    return f"""SELECT * FROM (SELECT *,
      CAST(epoch_us(dropoff_at) - epoch_us(pickup_at) AS DOUBLE) / CAST(1000000 AS DOUBLE)
        / CAST({p['duration_unit']} AS DOUBLE) AS duration,
      hour(pickup_at) AS hour, isodow(pickup_at) - 1 AS dow
      FROM {i['filter_valid']}) WHERE duration BETWEEN 0 AND 100000"""


def sql_zone_stats(p, i):
    return f"""SELECT pu_zone, CAST(sum(CAST(round(fare_amount * 100) AS BIGINT)) AS DOUBLE)
        / (count(fare_amount) * CAST(100 AS DOUBLE)) AS zone_mean_fare, count(*) AS zone_trip_count
    FROM {i['derive_time']} WHERE pu_zone IS NOT NULL GROUP BY pu_zone"""


def sql_join_pu_zone(p, i):
    frac = p.get("corrupt_ids", 0.0)
    key = "pu_zone"
    if frac > 0:
        cond = hit("trip_id", frac, trips.CORRUPT_SEED)
        key = f"CASE WHEN {cond} THEN {trips.UNKNOWN_ZONE} ELSE pu_zone END"
    return f"""SELECT t.*, z.region AS pu_region
    FROM (SELECT * REPLACE ({key} AS pu_zone) FROM {i['derive_time']}) t
      LEFT JOIN {i['load_zones']} z ON z.zone = t.pu_zone"""


def sql_join_do_zone(p, i):
    zones = f"SELECT * FROM {i['load_zones']}"
    if p.get("duplicate_zones", 0.0) > 0:
        cond = hit("zone", p["duplicate_zones"], trips.DUPLICATE_SEED)
        zones += f" UNION ALL SELECT * FROM {i['load_zones']} WHERE {cond}"
    return f"""SELECT t.*, z.region AS do_region
    FROM {i['join_pu_zone']} t LEFT JOIN ({zones}) z ON z.zone = t.do_zone"""


def sql_join_stats(p, i):
    return f"""SELECT t.*, coalesce(s.zone_mean_fare, 0) AS zone_mean_fare,
      coalesce(s.zone_trip_count, 0) AS zone_trip_count
    FROM {i['join_do_zone']} t LEFT JOIN {i['zone_stats']} s ON s.pu_zone = t.pu_zone"""


def sql_encode_trips(p, i):
    gone = set(p.get("drop_columns", ()))
    cols = [c for c in trips.MEASURES if c not in gone]
    full = " AND ".join(f"{c} IS NOT NULL" for c in cols)
    cols += one_hot("pu_region", trips.REGIONS, "pu") + one_hot("do_region", trips.REGIONS, "do")
    label = f"CAST(coalesce(net_amount > {trips.NET_LIMIT}, FALSE) AS BIGINT) AS label"
    where = f" WHERE {full}" if full else ""
    return f"SELECT {', '.join(cols)}, {label} FROM {i['join_stats']}{where}"


TRIPS = {
    "load_trips": sql_load_trips,
    "load_zones": sql_load_zones,
    "filter_valid": sql_filter_valid,
    "derive_time": sql_derive_time,
    "zone_stats": sql_zone_stats,
    "join_pu_zone": sql_join_pu_zone,
    "join_do_zone": sql_join_do_zone,
    "join_stats": sql_join_stats,
    "encode": sql_encode_trips,
}
TRIP_FEATURES = [
    *trips.MEASURES,
    *[f"{r}_{v.replace(' ', '_')}" for r in ("pu", "do") for v in trips.REGIONS],
]


# -- fan-in pipeline -----------------------------------------------------------------------


def fan_bodies(m: int) -> dict[str, Callable]:
    def load(b):
        def body(p, i):
            low = p["week"]
            label, join = "", ""
            if b == 0:
                label = ", max(t.label) AS label"
                join = f"""JOIN (SELECT user_id, CAST(sum(CAST(round(value * 100) AS BIGINT)) >
                    {int(fan_in.HEAVY_USER * 100)} AS BIGINT) AS label
                    FROM events GROUP BY user_id) t ON t.user_id = e.user_id"""
            return f"""SELECT e.user_id AS entity_id,
              CAST(sum(CAST(round(e.value * 100) AS BIGINT)) AS DOUBLE) / CAST(100 AS DOUBLE) AS x{b},
              CAST(count(*) AS DOUBLE) AS w{b}{label}
            FROM events e {join}
            WHERE e.event_type = '{fan_in.BRANCHES[b % 5]}' AND ({b >= 5} OR e.ts >= TIMESTAMP '{low}')
              AND e.ts < TIMESTAMP '{low}' + INTERVAL 7 DAY
            GROUP BY e.user_id"""

        return body

    def clean(b):
        return lambda p, i: f"SELECT * FROM {i[f'load_{b}']} WHERE w{b} > {p['floor']}"

    def agg(b):
        def body(p, i):
            c = p["corrupt"]
            x = f"x{b}"
            if c > 0:
                seed = fan_in.NOISE_SEED + b
                noise = f"((entity_id * 48271 + {seed} * 69621) % 2001 - 1000) / CAST(1000 AS DOUBLE)"
                c = f"CAST({c} AS DOUBLE)"
                x = f"(1 - {c}) * x{b} + {c} * ({noise} * {fan_in.NOISE_SIZE})"
            return f"SELECT * REPLACE ({x} AS x{b}) FROM {i[f'clean_{b}']}"

        return body

    bodies = {}
    for b in range(m):
        bodies |= {f"load_{b}": load(b), f"clean_{b}": clean(b), f"agg_{b}": agg(b)}

    def join_all(p, i):
        sql = f"SELECT * FROM {i['agg_0']}"
        return sql + "".join(f" JOIN {i[f'agg_{b}']} USING (entity_id)" for b in range(1, m))

    bodies["join_all"] = join_all
    bodies["filter_rows"] = lambda p, i: f"SELECT * FROM {i['join_all']}"
    cols = fan_features(m)
    bodies["encode"] = lambda p, i: f"SELECT {', '.join(cols)}, label FROM {i['filter_rows']}"
    return bodies


def fan_features(m: int) -> list[str]:
    return [f"{c}{b}" for b in range(m) for c in "xw"]


# -- chains --------------------------------------------------------------------------------


class Chains:
    """CTE chains of chosen (operator, world) outputs; equal prefixes are written once."""

    def __init__(self, pipeline: Pipeline, bodies: dict[str, Callable], prefix: str = ""):
        self.pipeline, self.bodies, self.prefix = pipeline, bodies, prefix
        self.ctes: list[tuple[str, str]] = []
        self._names: dict[tuple, str] = {}

    def node(self, name: str, world: int) -> str:
        op = self.pipeline.operators[name]
        field = self.pipeline.fields.get(name)
        choice = field.choice(world) if field else 0
        parents = {p: self.node(p, world) for p in op.parents}
        key = (name, choice, tuple(parents.values()))
        if key not in self._names:
            cte = f"{self.prefix}{name}_{len(self.ctes)}"
            self._names[key] = cte
            self.ctes.append((cte, self.bodies[name](op.params(choice), parents)))
        return self._names[key]

    def columns(self, features: list[str], world: int) -> list[str]:
        """Sink columns present in a world."""
        op = self.pipeline.operators[self.pipeline.sink]
        field = self.pipeline.fields.get(self.pipeline.sink)
        gone = set(op.params(field.choice(world) if field else 0).get("drop_columns", ()))
        return [c for c in features if c not in gone]

    def tagged_sinks(self, features: list[str], worlds: list[int]) -> str:
        parts = []
        for w in worlds:
            sink = self.node(self.pipeline.sink, w)
            have = set(self.columns(features, w))
            cols = [f'"{c}"' if c in have else f'NULL AS "{c}"' for c in features]
            parts.append(f"SELECT CAST({w} AS BIGINT) AS w, {', '.join(cols)}, label FROM {sink}")
        return "\nUNION ALL ".join(parts)


def with_(ctes: list[tuple[str, str]], final: str, recursive: bool = False) -> str:
    body = ",\n".join(f"{name} AS (\n{sql}\n)" for name, sql in ctes)
    return f"WITH {'RECURSIVE ' if recursive else ''}{body}\n{final}"


def values(name: str, columns: str, rows: list[tuple]) -> tuple[str, str]:
    def cell(v):
        if isinstance(v, bool):
            return "TRUE" if v else "FALSE"
        if isinstance(v, int):
            return f"CAST({v} AS BIGINT)"
        if isinstance(v, float):
            return f"CAST({v!r} AS DOUBLE)"
        return "'" + str(v).replace("'", "''") + "'"

    lines = ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows)
    return name, f"SELECT * FROM (VALUES {lines}) AS t({columns})"


def auc_ctes(x: str, scored: str) -> list[tuple[str, str]]:
    """CTEs from {x}scored to {x}u(w, u): the AUC of every world's scores, 0.5 where it may not train."""
    return [
        (f"{x}scored", scored),
        (f"{x}tied", f"SELECT w, s, sum(label) AS pos, sum(1 - label) AS neg FROM {x}scored GROUP BY w, s"),
        (f"{x}below", f"""SELECT *, coalesce(sum(neg) OVER (PARTITION BY w ORDER BY s
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM {x}tied"""),
        (f"{x}aucs", f"""SELECT w, CAST(sum(pos * (2 * b + neg)) AS DOUBLE)
            / nullif(2 * CAST(sum(pos) AS DOUBLE) * CAST(sum(neg) AS DOUBLE), 0) AS auc FROM {x}below GROUP BY w"""),
        (f"{x}guard", f"SELECT w, count(*) AS n_rows, count(DISTINCT label) AS n_classes FROM {x}sinks GROUP BY w"),
        (f"{x}u", f"""SELECT w, round(CASE WHEN g.n_rows >= 50 AND g.n_classes >= 2 AND f
            THEN coalesce(auc, 0.5) ELSE 0.5 END, 8) AS u
            FROM {x}worlds LEFT JOIN {x}guard g USING (w) LEFT JOIN {x}aucs USING (w)"""),
    ]


def world_ctes(chains: Chains, features: list[str], worlds: list[int], x: str) -> list[tuple[str, str]]:
    """{x}sinks, all worlds' rows, and {x}worlds(w, f), whether a world has features."""
    known = ", ".join(f"({w}, {bool(chains.columns(features, w))})" for w in worlds)
    sinks = chains.tagged_sinks(features, worlds)
    return [*chains.ctes, (f"{x}sinks", sinks), (f"{x}worlds", f"SELECT CAST(w AS BIGINT) AS w, f FROM (VALUES {known}) AS t(w, f)")]


NEWTON_STEPS = 9


def logistic_ctes(
    chains: Chains, features: list[str], worlds: list[int], probe: str, prefix: str = ""
) -> list[tuple[str, str]]:
    """CTEs ending in {prefix}u(w, u): a logistic regression per world, AUC on the probe, 8 digits.

    Newton steps from zero, written out: the sums of each are the upper triangle of a symmetric
    system with one row per weight, eliminated pivot by pivot and solved backwards.
    """
    x, d = prefix, len(features) + 1
    stat = ", ".join(
        f"""avg(CAST("{c}" AS DOUBLE)) AS m{i}, CASE WHEN var_pop(CAST("{c}" AS DOUBLE)) > 0
            THEN sqrt(var_pop(CAST("{c}" AS DOUBLE))) ELSE 1 END AS s{i}""" for i, c in enumerate(features, 1)
    )
    scaled = ", ".join(f'coalesce((CAST("{c}" AS DOUBLE) - m{i}) / s{i}, 0) AS z{i}' for i, c in enumerate(features, 1))
    ctes = [
        *world_ctes(chains, features, worlds, x),
        (f"{x}scale", f"SELECT w, {stat} FROM {x}sinks GROUP BY w"),
        (f"{x}z", f"SELECT w, CAST(label AS DOUBLE) AS y, CAST(1 AS DOUBLE) AS z0, {scaled} FROM {x}sinks JOIN {x}scale USING (w) WHERE label IS NOT NULL"),
        (f"{x}c0", f"SELECT w, {', '.join(f'CAST(0 AS DOUBLE) AS c{i}' for i in range(d))} FROM {x}scale"),
    ]
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    kept = ", ".join(f"c{i}" for i in range(d))
    for k in range(NEWTON_STEPS):
        score = " + ".join(f"c{i} * z{i}" for i in range(d))
        slopes = [f"sum((p - y) * z{i}) + {int(i > 0)} * any_value(c{i}) AS b{i}" for i in range(d)]
        bends = [f"sum(p * (1 - p) * z{i} * z{j}) + {int(i == j and i > 0)} AS a{i}_{j}" for i, j in pairs]
        old = ", ".join(f"any_value(c{i}) AS c{i}" for i in range(d))
        ctes += [
            (f"{x}p{k}", f"SELECT z.*, {kept}, 1 / (1 + exp(-({score}))) AS p FROM {x}z z JOIN {x}c{k} USING (w)"),
            (f"{x}e{k}_0", f"SELECT w, {old}, {', '.join(slopes + bends)} FROM {x}p{k} GROUP BY w"),
        ]
        for r in range(d - 1):  # row r is done; take it out of the rows below
            done = [f"a{i}_{j}" for i, j in pairs if i <= r] + [f"b{i}" for i in range(r + 1)]
            rest = [f"a{i}_{j} - a{r}_{i} / a{r}_{r} * a{r}_{j} AS a{i}_{j}" for i, j in pairs if i > r]
            rest += [f"b{i} - a{r}_{i} / a{r}_{r} * b{r} AS b{i}" for i in range(r + 1, d)]
            ctes.append((f"{x}e{k}_{r + 1}", f"SELECT w, {kept}, {', '.join(done + rest)} FROM {x}e{k}_{r}"))
        source = f"{x}e{k}_{d - 1}"
        for r in reversed(range(d)):
            known = "".join(f" - a{r}_{j} * t{j}" for j in range(r + 1, d))
            ctes.append((f"{x}t{k}_{r}", f"SELECT *, (b{r}{known}) / a{r}_{r} AS t{r} FROM {source}"))
            source = f"{x}t{k}_{r}"
        ctes.append((f"{x}c{k + 1}", f"SELECT w, {', '.join(f'c{i} - t{i} AS c{i}' for i in range(d))} FROM {source}"))
    ranked = " + ".join(f'k{i} * coalesce(CAST(p."{c}" AS DOUBLE), 0)' for i, c in enumerate(features, 1))
    weights = ", ".join(f"coalesce(c{i} / s{i}, 0) AS k{i}" for i in range(1, d))
    ctes.append((f"{x}weights", f"SELECT w, {weights} FROM {x}c{NEWTON_STEPS} JOIN {x}scale USING (w)"))
    return [*ctes, *auc_ctes(x, f"SELECT k.w, p.label, round({ranked}, 6) AS s FROM {probe} p CROSS JOIN {x}weights k")]


def utility_ctes(
    chains: Chains, features: list[str], worlds: list[int], probe: str, prefix: str = ""
) -> list[tuple[str, str]]:
    """CTEs ending in {prefix}u(w, u): discriminant per world, AUC on the probe, 8 digits."""
    q = [f'"{c}"' for c in features]
    x = prefix
    stat = ", ".join(
        f'avg(CAST("{c}" AS DOUBLE)) AS "m_{c}", var_pop(CAST("{c}" AS DOUBLE)) AS "v_{c}"' for c in features
    )
    pick = ", ".join(
        f'max("{s}_{c}") FILTER (y = {y}) AS "{s}{y}_{c}"'
        for c in features for s in "mv" for y in (0, 1)
    )

    def weight(c):
        pooled = f'((n0 * "v0_{c}" + n1 * "v1_{c}") / (n0 + n1))'
        return f'CASE WHEN {pooled} > 1e-12 THEN ("m1_{c}" - "m0_{c}") / {pooled} ELSE 0 END AS "k_{c}"'

    score = " + ".join(f'"k_{c}" * coalesce(CAST(p."{c}" AS DOUBLE), 0)' for c in features)
    return [
        *world_ctes(chains, features, worlds, x),
        (f"{x}stats", f"SELECT w, label AS y, count(*) AS n, {stat} FROM {x}sinks GROUP BY w, label"),
        (f"{x}wide", f"SELECT w, max(n) FILTER (y = 0) AS n0, max(n) FILTER (y = 1) AS n1, {pick} FROM {x}stats GROUP BY w"),
        (f"{x}weights", f"SELECT w, {', '.join(map(weight, features))} FROM {x}wide"),
        *auc_ctes(x, f"SELECT k.w, p.label, round({score}, 6) AS s FROM {probe} p CROSS JOIN {x}weights k"),
    ]
