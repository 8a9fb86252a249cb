"""Pipeline metadata: operators, their parameter variants, and the world encoding.

A *world* is one assignment of a parameter variant to every operator.  It is stored in a single
BIGINT: each state-sensitive operator owns a small bit field, field value 0 means "reference
parameters" and value i means "incident variant i".  A plain incident has one variant per
operator, so its fields are single bits; a severity ladder gives one operator many variants and
still runs as one plan.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field
from graphlib import CycleError, TopologicalSorter
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from blamesplit.functions.local import local_table

MAX_PLAYERS = 62  # coalition masks live in a signed BIGINT


@dataclass(frozen=True)
class Operator:
    """One node. `body(inputs, state)` builds a plan; it runs nothing.

    `wide` says that the body joins or aggregates, so that its output is worth keeping. `totals`
    says that it aggregates to groups: these are worked out before others read them, so that their
    size decides how they are joined.
    """

    name: str
    parents: tuple[str, ...]
    body: Callable
    reference: Mapping = field(default_factory=dict)
    variants: tuple[Mapping, ...] = ()
    wide: bool = False
    totals: bool = False

    @property
    def sensitive(self) -> bool:
        return any(dict(v) != dict(self.reference) for v in self.variants)

    def params(self, choice: int) -> Mapping:
        return self.reference if choice == 0 else self.variants[choice - 1]


@dataclass(frozen=True)
class Field:
    """Where an operator's variant number sits inside a world id."""

    shift: int
    mask: int

    def world(self, choice: int) -> int:
        return choice << self.shift

    def choice(self, world: int) -> int:
        return (world & self.mask) >> self.shift


class Pipeline:
    """A checked DAG of operators with one sink."""

    def __init__(self, operators: Iterable[Operator], sink: str):
        self.operators = {op.name: op for op in operators}
        if sink not in self.operators:
            raise ValueError(f"sink {sink!r} is not an operator")
        for op in self.operators.values():
            for parent in op.parents:
                if parent not in self.operators:
                    raise ValueError(f"{op.name} references unknown parent {parent!r}")
        try:
            self.order = list(
                TopologicalSorter({n: op.parents for n, op in self.operators.items()}).static_order()
            )
        except CycleError as err:
            raise ValueError(f"pipeline contains a cycle: {err.args[1]}") from err
        if len(self.operators) > MAX_PLAYERS:
            raise ValueError(f"more than {MAX_PLAYERS} operators do not fit a coalition mask")
        self.sink = sink
        self.fields = self._lay_out_fields()

    def _lay_out_fields(self) -> dict[str, Field]:
        fields, shift = {}, 0
        for name in sorted(self.operators):
            op = self.operators[name]
            if op.sensitive:
                width = len(op.variants).bit_length()
                fields[name] = Field(shift, ((1 << width) - 1) << shift)
                shift += width
        if shift > MAX_PLAYERS:
            raise ValueError("too many parameter variants for one world id")
        return fields

    # -- names and bits ------------------------------------------------------------------

    @property
    def names(self) -> list[str]:
        return sorted(self.operators)

    @property
    def sources(self) -> list[str]:
        return sorted(n for n, op in self.operators.items() if not op.parents)

    def bit(self, name: str) -> int:
        return 1 << self.names.index(name)

    @property
    def full_mask(self) -> int:
        return (1 << len(self.operators)) - 1

    @property
    def sensitive_mask(self) -> int:
        return sum(self.bit(n) for n in self.fields)

    def lineage(self, name: str) -> set[str]:
        """Every operator that feeds `name`, itself included."""
        seen, todo = set(), [name]
        while todo:
            node = todo.pop()
            if node not in seen:
                seen.add(node)
                todo.extend(self.operators[node].parents)
        return seen

    def lineage_fields(self, name: str) -> int:
        """Fields of every operator that feeds `name`, itself included."""
        fields = 0
        for node in self.lineage(name):
            fields |= self.fields[node].mask if node in self.fields else 0
        return fields

    # -- worlds --------------------------------------------------------------------------

    def world(self, coalition: Iterable[str], choice: Mapping[str, int] | None = None) -> int:
        """World id of a coalition; `choice` names the variant (default 1) of each operator."""
        choice = choice or {}
        return sum(
            self.fields[n].world(choice.get(n, 1)) for n in set(coalition) if n in self.fields
        )

    def all_worlds(self, choice: Mapping[str, int] | None = None) -> list[int]:
        """The state lattice of one incident: every sensitive operator on or off."""
        steps = [(0, self.world([n], choice)) for n in self.fields]
        return sorted({sum(pick) for pick in product(*steps)})

    def every_world(self) -> list[int]:
        """All variants of all sensitive operators, in all combinations."""
        steps = [[f.world(c) for c in range(len(self.operators[n].variants) + 1)] for n, f in self.fields.items()]
        return sorted({sum(pick) for pick in product(*steps)})

    def world_of_mask(self, mask: Column, choice: Mapping[str, int] | None = None) -> Column:
        """The world a coalition mask runs in (insensitive operators do not matter)."""
        world = F.lit(0).cast("long")
        for name in self.fields:
            step = self.world([name], choice)
            if step:
                hit = mask.bitwiseAND(F.lit(self.bit(name)).cast("long")) != 0
                world = world + F.when(hit, F.lit(step)).otherwise(F.lit(0)).cast("long")
        return world

    # -- metadata tables -----------------------------------------------------------------

    def nodes(self, spark: SparkSession) -> DataFrame:
        rows = [(n, self.bit(n), n in self.fields, n in self.sources) for n in self.names]
        return local_table(
            spark, "op string, bit long, sensitive boolean, is_source boolean", rows
        )

    def edges(self, spark: SparkSession) -> DataFrame:
        rows = [(p, n) for n in self.names for p in self.operators[n].parents]
        return local_table(spark, "parent string, child string", rows)
