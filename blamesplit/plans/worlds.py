"""World-tagged frames: one DataFrame holding the rows of many hybrid runs.

Column `w` says which world a row belongs to, restricted to the fields of the operators in the
frame's lineage.  Parameters that differ between worlds become CASE expressions over `w`, so a
faulty and a healthy operator are one plan over one scan.  The set of worlds is known when the
plan is built; every frame holds exactly the projection of that set onto its lineage.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from blamesplit.functions.local import local_table
from blamesplit.functions.ordered import exact_quantile, head_fraction
from blamesplit.functions.skew import dealt
from blamesplit.plans.pipeline import Field, Operator

W = "w"
MAX_WORLDS = 4096  # bounds every per-world broadcast; `replay_batches` splits larger requests
MAX_CASES = 32  # of worlds that go on alike in one expression


def world_const(value: int) -> Column:
    return F.expr(f"{value}L")


def sql_literal(value) -> str:
    """A parameter value as SQL text: one expression string instead of many column objects."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, int):
        return str(value)
    if isinstance(value, float):
        return f"{value!r}D"
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def one_of(worlds: Iterable[int]) -> Column:
    return F.expr(f"{W} IN ({', '.join(f'{w}L' for w in sorted(worlds))})")


class WorldFrame:
    def __init__(
        self,
        df: DataFrame,
        required: frozenset[int],
        fields: int = 0,
        absent: Mapping[str, frozenset[tuple[int, int]]] | None = None,
        measured: DataFrame | None = None,
    ):
        self.df = df
        self.required = required
        self.fields = fields
        self.absent = dict(absent or {})
        self.measured = measured  # a few rows per world that a replay took of exactly these rows

    # -- bookkeeping ---------------------------------------------------------------------

    @property
    def worlds(self) -> list[int]:
        return sorted({m & self.fields for m in self.required})

    @property
    def columns(self) -> list[str]:
        return [c for c in self.df.columns if c != W]

    def _like(self, df: DataFrame, fields: int | None = None, absent=None) -> "WorldFrame":
        return WorldFrame(
            df,
            self.required,
            self.fields if fields is None else fields,
            self.absent if absent is None else absent,
        )

    def rows(self, step: Callable[[DataFrame], DataFrame]) -> "WorldFrame":
        """Apply a row-wise step (filter, projection, new columns); it must keep `w`."""
        return self._like(step(self.df))

    def expand(self, fields: int) -> "WorldFrame":
        """Repeat rows so that `w` also covers `fields` (only worlds that are required)."""
        target = self.fields | fields
        if target == self.fields:
            return self
        extra = target & ~self.fields
        wanted = {m & target for m in self.required}
        steps = sorted({m & extra for m in wanted})
        if steps == [0]:
            return self._like(self.df, target)
        others = [c for c in self.df.columns if c != W]
        if len(steps) == 1:
            df = self.df.withColumn(W, F.expr(f"{W} | {steps[0]}L"))
        else:
            mine: dict[int, set[int]] = {}
            for m in self.required:
                mine.setdefault(m & self.fields, set()).add(m & extra)
            alike: dict[tuple[int, ...], list[int]] = {}  # worlds that go on in the same steps
            for world, some in mine.items():
                alike.setdefault(tuple(sorted(some)), []).append(world)
            listed = lambda some: "array(" + ", ".join(f"{W} | {s}L" for s in some) + ")"
            if len(alike) == 1 or len(alike) > MAX_CASES:
                options = listed(steps)
            else:  # a row is repeated only for worlds that are wanted of its own
                options = " ".join(f"WHEN {W} IN ({', '.join(f'{w}L' for w in ws)}) THEN {listed(some)}" for some, ws in alike.items())
                options = f"CASE {options} END"
            df = self.df.select(F.expr(f"explode({options})").alias(W), *others)
            if len(alike) > MAX_CASES:
                df = df.where(one_of(wanted))
        return self._like(df, target)

    def only_required(self, possible: set[int]) -> "WorldFrame":
        wanted = self.worlds
        if possible <= set(wanted):
            return self
        return self._like(self.df.where(one_of(wanted)))

    # -- world-aware relational steps ----------------------------------------------------

    def group_by(self, keys: Sequence[str], *aggregates: Column) -> "WorldFrame":
        """Group inside each world; rows with a null key are left out."""
        df = self.df
        for key in keys:
            df = df.where(F.col(key).isNotNull())
        return self._like(df.groupBy(W, *keys).agg(*aggregates), absent={})

    def join(
        self,
        other: "WorldFrame",
        on: Sequence[str],
        how: str = "inner",
        spread: int = 1,
        parts: int | None = None,
        salt: Sequence[str] = ("*",),
    ) -> "WorldFrame":
        """Equi-join inside each world.

        Inner joins pair rows that agree on the shared fields. For a left join the left rows are
        first repeated for the right side's fields, because a row may match in one world and not
        in another. Both plan as equi-joins, so size decides the strategy at run time. `spread`
        salts the key: the (small) right side is repeated that often and every hot key of the
        left side is shared by that many tasks, by a hash of the left columns `salt`. With `parts`, hot keys are measured instead, and
        only they are cut, into pieces of about 1 / `parts` of the left rows.
        """
        if how not in ("inner", "left"):
            raise ValueError(f"join type {how!r} is not supported")
        both = self.fields | other.fields
        left = self.expand(other.fields) if how == "left" else self
        shared = left.fields & other.fields
        right = other.df.withColumnRenamed(W, "__w")
        l, r = left.df, right
        if shared:
            l = l.withColumn("__shared", F.expr(f"{W} & {shared}L"))
            r = r.withColumn("__shared", F.expr(f"__w & {shared}L"))
        keys = [*on, *(["__shared"] if shared else [])]
        if parts is not None:
            l, r = dealt(l, r, keys, parts)
            keys.append("__salt")
        elif spread > 1:
            l = l.withColumn("__salt", F.expr(f"pmod(hash({', '.join(salt)}), {spread})"))
            r = r.withColumn("__salt", F.expr(f"explode(sequence(0, {spread - 1}))"))
            keys.append("__salt")
        joined = l.join(r, keys, how).drop("__shared", "__salt")
        if how == "inner" and other.fields & ~self.fields:
            joined = joined.withColumn(W, F.expr(f"{W} | __w"))
        out = WorldFrame(
            joined.drop("__w"), self.required, both, {**self.absent, **other.absent}
        )
        possible = {a | b for a in left.worlds for b in other.worlds if (a & shared) == (b & shared)}
        return out.only_required(possible)

    def union(self, other: "WorldFrame") -> "WorldFrame":
        a, b = self.expand(other.fields), other.expand(self.fields)
        return a._like(a.df.unionByName(b.df), absent={**self.absent, **other.absent})

    def with_quantile(
        self, column: str, q: float, out: str, of: "WorldFrame | None" = None, read: Iterable[int] | None = None
    ) -> "WorldFrame":
        """Attach the exact quantile of a column, taken per world.

        The column is read once and the one number per world is settled here, so whatever reads
        the frame later does not compute it again. `of` is a frame whose rows this one only repeats for
        more worlds: each of its worlds is ordered once. With `read`, other worlds get a null.
        """
        of = self if of is None else of
        read = self.worlds if read is None else [w for w in self.worlds if w in set(read)]
        wanted = {w & of.fields for w in read}
        rows = of.df if wanted == set(of.worlds) else of.df.where(one_of(wanted)) if wanted else of.df.limit(0)
        stat = settled(of, exact_quantile(rows, column, q, [W], out))
        found = {r[W]: r[out] for r in stat.collect()}
        kind = dict(stat.dtypes)[out]
        listed = [(w, found[w & of.fields]) for w in read if w & of.fields in found]
        each = local_table(self.df.sparkSession, f"{W} long, `{out}` {kind}", listed)
        return self._like(self.df.join(self.per_world(each), W, "left"))

    def per_world(self, stats: DataFrame) -> DataFrame:
        """A table with one row per world: its size is bounded by the request, so broadcast it."""
        if len(self.worlds) > MAX_WORLDS:
            raise ValueError(f"more than {MAX_WORLDS} worlds in one replay")
        return F.broadcast(stats)

    def head_fraction(self, key: str, keep: Mapping[int, float], field: Field | None):
        """Keep the leading share of each world's rows (share by variant number)."""
        shares = set(keep.values())
        if shares == {1.0}:
            return self
        parts = []
        for share in sorted(shares):
            df = self.df
            if field is not None and len(shares) > 1:
                hits = [field.world(c) for c, s in keep.items() if s == share]
                df = df.where(F.expr(f"{W} & {field.mask}L IN ({', '.join(f'{h}L' for h in hits)})"))
            parts.append(head_fraction(df, key, share, [W]))
        df = parts[0]
        for part in parts[1:]:
            df = df.unionByName(part)
        return self._like(df)

    # -- schema drift --------------------------------------------------------------------

    def without(self, field: Field | None, dropped: Mapping[int, Iterable[str]]) -> "WorldFrame":
        """Drop columns in some worlds only: the column stays, null where it is absent."""
        absent = {c: set(v) for c, v in self.absent.items()}
        everywhere = set()
        for choice, names in dropped.items():
            for name in names:
                if name not in self.columns:
                    continue
                if field is None:
                    everywhere.add(name)
                else:
                    absent.setdefault(name, set()).add((field.mask, field.world(choice)))
        frame = self._like(
            self.df.drop(*everywhere),
            absent={c: frozenset(v) for c, v in absent.items() if c not in everywhere},
        )
        hidden = [c for c in frame.columns if c in frame.absent]
        if not hidden:
            return frame
        return frame.rows(
            lambda df: df.select(
                *[
                    F.when(~frame.is_absent(c), F.col(c)).alias(c) if c in hidden else F.col(c)
                    for c in df.columns
                ]
            )
        )

    def is_absent(self, column: str) -> Column:
        rules = sorted(self.absent.get(column, ()))
        return F.expr(" OR ".join(f"({W} & {m}L) = {v}L" for m, v in rules) or "FALSE")

    def columns_in(self, world: int) -> list[str]:
        """The columns this frame has in one world."""
        gone = {
            c for c, rules in self.absent.items() if any(world & m == v for m, v in rules)
        }
        return [c for c in self.columns if c not in gone]

    def drop_incomplete(self) -> "WorldFrame":
        """Drop rows with a null in any column that exists in the row's world."""
        full = F.lit(True)
        for c in self.columns:
            here = F.col(c).isNotNull()
            full = full & (here | self.is_absent(c) if c in self.absent else here)
        return self.rows(lambda df: df.where(full))

    def world(self, mask: int) -> DataFrame:
        """One world as a plain table with the schema it has there."""
        local = mask & self.fields
        return self.df.where(F.col(W) == world_const(local)).select(*self.columns_in(local))


def settled(frame: WorldFrame, df: DataFrame) -> DataFrame:
    """Run a query that yields a few rows per world and keep its rows as a small local table.

    The worlds of a request are counted when the plan is built, so the size is known to be small;
    everything computed from the result then plans without the pipeline behind it.
    """
    if len(frame.worlds) > MAX_WORLDS:
        raise ValueError(f"more than {MAX_WORLDS} worlds in one replay")
    return local_table(df.sparkSession, df.schema, [tuple(r) for r in df.collect()])


class State:
    """Parameters of one operator, seen from inside its body."""

    def __init__(self, op: Operator, field: Field | None, required: frozenset[int]):
        self.op = op
        self.field = field
        self.required = required
        worlds = {field.choice(m) for m in required} if field else {0}
        self.choices = sorted(worlds)

    def enter(self, frame: WorldFrame) -> WorldFrame:
        """Let the frame's rows split by this operator's state."""
        return frame.expand(self.field.mask) if self.field else frame

    def values(self, name: str, default=None) -> dict[int, object]:
        """Python value of a parameter by variant number."""
        return {c: self.op.params(c).get(name, default) for c in self.choices}

    def worlds_with(self, frame: WorldFrame, name: str, value) -> list[int]:
        """Worlds of a frame that has entered this state and in which the parameter has a value."""
        hits = {c for c, v in self.values(name).items() if v == value}
        return [w for w in frame.worlds if (self.field.choice(w) if self.field else 0) in hits]

    def any(self, name: str, default=None) -> bool:
        """Whether the parameter leaves its default in some required world."""
        return any(v != default for v in self.values(name, default).values())

    def by_state(self, options: Mapping[int, Column]) -> Column:
        """Pick an expression by the state of the row's world."""
        state = F.expr(f"{W} & {self.field.mask}L") if len(options) > 1 else None
        if state is None:
            return next(iter(options.values()))
        picked = None
        for choice, expr in options.items():
            hit = state == world_const(self.field.world(choice))
            picked = F.when(hit, expr) if picked is None else picked.when(hit, expr)
        return picked

    def value(self, name: str, default=None) -> Column:
        """The parameter as a column: a literal, or a CASE over the world tag."""
        values = self.values(name, default)
        if len(set(values.values())) == 1:
            return F.lit(next(iter(values.values())))
        cases = " ".join(
            f"WHEN {self.field.world(c)}L THEN {sql_literal(v)}" for c, v in values.items()
        )
        return F.expr(f"CASE {W} & {self.field.mask}L {cases} END")

    def partition(self, df: DataFrame, rule: Callable[[Mapping], Column]) -> WorldFrame:
        """Source partition by state: each state reads the rows its own rule accepts.

        One scan serves all states; the union of the rules is pushed to it.
        """
        rules = {c: rule(self.op.params(c)) for c in self.choices}
        if len(rules) == 1:
            fields = self.field.mask if self.field else 0
            kept = df.where(next(iter(rules.values()))).withColumn(W, world_const(0))
            return WorldFrame(kept, self.required).expand(fields)
        either = None
        for r in rules.values():
            either = r if either is None else either | r
        tags = [F.when(r, world_const(self.field.world(c))) for c, r in rules.items()]
        tagged = df.where(either).withColumn(W, F.explode(F.array_compact(F.array(*tags))))
        return WorldFrame(tagged, self.required, self.field.mask)
