"""Query operations compiled to DataFrames.

A query starts with its anchor's rows under their own column names.  Each further table is joined
under a new alias, with only the columns that keys and filters need, renamed so that nothing is
ambiguous when a table occurs twice.

Relations are followed in order.  One that touches the anchor's table starts there; one that
doesn't starts at the table joined last that it touches.  A relation of a class with itself is a
real self-join: the referenced side is the new one.  All joins are inner and keep
duplicates.  Scope predicates are put on the anchor (and with deep scope on every joined table)
while compiling.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import CompileError
from ..model.mapping import Mapping, RelationMap, Step
from ..operators import relational as R
from .operations import Query


@dataclass(frozen=True)
class Scope:
    """Rows that an identity may see.

    ``owned`` maps a table to the column that must equal the identity; ``paths`` maps a table without such a column to the
    foreign keys that lead from it to one that has it.
    """

    identity: object
    owned: dict[str, str]
    deep: bool = False
    paths: dict[str, tuple[Step, ...]] = field(default_factory=dict)

    def column(self, table: str) -> str | None:
        return self.owned.get(table)

    def covers(self, table: str) -> bool:
        return table in self.owned or table in self.paths

    def within(self, df: DataFrame, table: str, tables: Callable[[str], DataFrame]) -> DataFrame:
        """The rows of a table that the identity may see: a filter, or a chain of semi-joins that ends in one."""
        if table in self.owned:
            return R.where_equal(df, {self.owned[table]: self.identity})
        if table not in self.paths:
            return df
        steps = self.paths[table]
        seen = R.where_equal(tables(steps[-1].ref_table), {self.owned[steps[-1].ref_table]: self.identity})
        for step, onward in zip(reversed(steps), [*reversed(steps[:-1]), None], strict=True):
            keys = seen.select(F.col(f"`{step.ref_column}`").alias("_key"))
            near = df if onward is None else tables(step.fk_table)
            seen = near.join(keys, F.col(f"`{step.fk_column}`") == F.col("_key"), "left_semi")
        return seen


@dataclass(frozen=True)
class Trust:
    """What may be relied on in rewrites, since it was checked.

    Non-null and unique columns, as (table, column), and references, as (table, column, other table, its column).
    """

    not_null: frozenset = frozenset()
    unique: frozenset = frozenset()
    foreign: frozenset = frozenset()


@dataclass
class _Node:
    table: str
    alias: str
    frame: DataFrame

    def column(self, name: str) -> str:
        return name if not self.alias else f"{self.alias}.{name}"

    def ref(self, name: str) -> Column:
        return F.col(f"`{self.column(name)}`")


class Compiler:
    """``tables`` gives the DataFrame of a physical table.

    A ``store`` (a transaction) gives a table's rows with given values from the files that may hold them, and aggregates that it knows without a scan.
    """

    def __init__(self, mapping: Mapping, tables: Callable[[str], DataFrame], scope: Scope | None = None, trust: Trust | None = None, store=None):
        self.mapping, self.tables, self.scope, self.trust, self.store = mapping, tables, scope, trust or Trust(), store

    def scoped(self, name: str, always: bool = True, pairs: dict | None = None) -> DataFrame:
        """A table's rows that have the given values, less those outside the scope."""
        pairs, inside = pairs or {}, self.scope is not None and (always or self.scope.deep)
        column = self.scope.column(name) if inside else None
        near = pairs if column is None or column in pairs else pairs | {column: self.scope.identity}
        df = self.store.where(name, near) if self.store and near else self.tables(name)
        df = R.where_equal(df, pairs)
        return self.scope.within(df, name, self.tables) if inside else df

    def whole(self, q: Query) -> DataFrame | None:
        """The aggregate of a whole table, where it is known without reading it."""
        t = self.mapping.table(q.entity)
        if self.store is None or not q.aggregate or q.filters or q.relations or (self.scope and self.scope.covers(t.name)):
            return None
        fn, column = q.aggregate[0], t.physical(q.aggregate[1]) if q.aggregate[1] else None
        value = self.store.known(t.name, fn, column)
        if value is None:
            return None
        kind = "bigint" if fn == "count" else self.store.schema(t.name)[column].dataType
        return self.store.spark.range(1).select(F.lit(value[0]).cast(kind).alias(fn))

    def _touches(self, rel: str, table: str) -> bool:
        relation = self.mapping.relations.get(rel)
        return relation is not None and any(table in s.tables for s in relation.steps)

    def query(self, q: Query) -> DataFrame:
        known = self.whole(q)
        if known is not None:
            return known
        anchor_map = self.mapping.table(q.entity)
        physical = {anchor_map.physical(f): v for f, v in q.filters.items()}
        anchor = _Node(anchor_map.name, "", self.scoped(anchor_map.name, pairs=physical))
        state = _Joined(self, anchor)
        for i, hop in enumerate(q.relations):
            # a later relation that misses the anchor may start at this one's tables, so those joins are kept
            state.keep = any(not self._touches(h.rel, anchor_map.name) for h in q.relations[i + 1 :])
            relation = self.mapping.relations.get(hop.rel)
            if relation is None:
                raise CompileError(f"relation {hop.rel!r} is unknown")
            other = self.mapping.table(hop.entity)
            state.follow(relation, other.name, {other.physical(f): v for f, v in hop.filters.items()})
        out = state.frame
        if q.aggregate:
            fn, field = q.aggregate
            return R.aggregate(out, fn, anchor_map.physical(field) if field else None)
        if q.sort:
            out = R.order(out, anchor_map.physical(q.sort[0]), q.sort[1])
        if q.limit:
            out = out.limit(q.limit)
        columns = [anchor_map.physical(f) for f in q.fields] or anchor.frame.columns
        missing = [c for c in columns if c not in anchor.frame.columns]
        if missing:
            raise CompileError(f"{anchor_map.name} has no column {', '.join(missing)}")
        return out.select(*[F.col(f"`{c}`") for c in columns])


class _Joined:
    """The joined frame so far and its nodes in order."""

    def __init__(self, compiler: Compiler, anchor: _Node):
        self.compiler, self.anchor, self.nodes, self.frame = compiler, anchor, [anchor], anchor.frame
        self.keep, self.count = True, 0

    def follow(self, relation: RelationMap, target: str, filters: dict) -> None:
        touched = {t for s in relation.steps for t in s.tables}
        start = self.anchor if self.anchor.table in touched else next((n for n in reversed(self.nodes) if n.table in touched), None)
        if start is None:
            raise CompileError(f"relation {relation.name} touches neither {self.anchor.table} nor a table joined before it")
        local, steps = [start], list(relation.steps)
        own = lambda t: next((n for n in local if n.table == t), None)
        while steps:
            step = next((s for s in steps if s.fk_table == s.ref_table or own(s.fk_table) or own(s.ref_table)), None)
            if step is None:
                raise CompileError(f"the steps of relation {relation.name} don't connect")
            steps.remove(step)
            same = step.fk_table == step.ref_table
            if not same and own(step.fk_table) and own(step.ref_table):
                continue
            from_key = own(step.fk_table) is not None
            node = own(step.fk_table) if from_key else own(step.ref_table)
            other = step.ref_table if from_key else step.fk_table
            here, there = (step.fk_column, step.ref_column) if from_key else (step.ref_column, step.fk_column)
            wanted = filters if other == target else {}
            last = not steps
            if last and self._needless(step, from_key, same, other, wanted):
                continue
            new = self._node(other, {there, *wanted, *(c for s in steps for c in ((s.fk_column,) if s.fk_table == other else (s.ref_column,) if s.ref_table == other else ()))}, wanted)
            semi = last and from_key and (step.ref_table, step.ref_column) in self.compiler.trust.unique and not self.keep
            self.frame = self.frame.join(new.frame, node.ref(here) == new.ref(there), "left_semi" if semi else "inner")
            if not semi:
                self.nodes.append(new)
                local.append(new)
            if wanted:
                filters = {}
        if filters:
            at = next((n for n in reversed(local) if n.table == target), None)
            if at is None:
                raise CompileError(f"relation {relation.name} doesn't reach {target}")
            df = self.compiler.tables(target)
            for column, value in filters.items():
                self.frame = self.frame.where(R.equals(df, column, value, f"`{at.column(column)}`"))

    def _needless(self, step: Step, from_key: bool, same: bool, other: str, filters: dict) -> bool:
        """A join to exactly one row of the other side, without filters, changes nothing: the key refers to a row, and to one only."""
        trust, scope = self.compiler.trust, self.compiler.scope
        scoped = scope and scope.deep and scope.covers(other)
        key, target = (step.fk_table, step.fk_column), (step.ref_table, step.ref_column)
        return from_key and not same and not filters and not scoped and not self.keep and key in trust.not_null and target in trust.unique and (*key, *target) in trust.foreign

    def _node(self, table: str, columns: set[str], filters: dict) -> _Node:
        """A further table with the columns that later steps or relations may need."""
        df = self.compiler.scoped(table, always=False, pairs=filters)
        keys = {s.fk_column for r in self.compiler.mapping.relations.values() for s in r.steps if s.fk_table == table}
        keys |= {s.ref_column for r in self.compiler.mapping.relations.values() for s in r.steps if s.ref_table == table}
        self.count += 1
        alias = f"a{self.count}"
        keep = [c for c in df.columns if c in keys | columns]
        return _Node(table, alias, df.select(*[F.col(f"`{c}`").alias(f"{alias}.{c}") for c in keep]))
