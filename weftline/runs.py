"""Runs of like operations as one: staged together, looked up together, checked together.

Creates of one entity with the same fields, and links or unlinks by one relation with the same filters, take a number of jobs that doesn't grow
with their number: end points and references are found by joins with the run's values, rows are written once, constraints are checked
once.  What a run does and says is what its operations would do and say one after another; where that isn't so (rows of the run that may refer to
or find each other), there is no run.  If a run fails, the first operation that fails is found by halving, and fails by itself.
"""

from __future__ import annotations

from itertools import groupby

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import CompileError
from .functions import text as say
from .functions.literals import coerce
from .plans.operations import Create, End, Link
from .sources.constraints import check_removed, check_rows

#: Operations from which a run is worth its joins.
LEAST = 8


def _shape(op) -> tuple | None:
    """Equal for operations that may be one run."""
    end = lambda e: (e.entity, *sorted(e.filters))
    if isinstance(op, Create):
        return ("create", op.entity, *sorted(op.data), *((n, end(e)) for n, e in sorted(op.resolve.items())))
    if isinstance(op, Link):
        return (op.op, op.relation, end(op.start), end(op.end))
    return None


def cut(operations: list) -> list[list[int]]:
    """Numbers of the operations, those of a run together."""
    out = []
    for shape, some in groupby(range(len(operations)), lambda i: _shape(operations[i])):
        some = list(some)
        out += [some] if shape is not None and len(some) >= LEAST else [[i] for i in some]
    return out


class _Undone(Exception):
    pass


class Failed(Exception):
    """The operation after ``done`` of a run failed, by the exception's cause."""

    def __init__(self, done: list):
        super().__init__(len(done))
        self.done = done


class Together:
    """``run`` is the batch's state: mapping, transaction, scope, and its operations one by one."""

    def __init__(self, run):
        self.run, self.tx, self.mapping = run, run.tx, run.mapping

    def may(self, op) -> bool:
        if self.tx is None:
            return False
        if isinstance(op, Create):
            t = self.mapping.table(op.entity).name
            rules = self.tx.entry(t)["constraints"] if t in self.tx.state["tables"] else {}
            found = {self.mapping.table(e.entity).name for e in op.resolve.values()}
            return t not in found and not any(other == t for _, other, _ in rules.get("foreign", ())) and not (self.run.scope and t in self.run.scope.paths)
        return True

    def operations(self, some: list) -> list[tuple[str, dict]]:
        """Text and log entry of each; raises what the first that fails raises."""
        try:
            with self.tx.savepoint():
                return self._all(some)
        except Exception:
            good, bad = 0, len(some)
            while bad - good > 1:
                middle = (good + bad) // 2
                good, bad = (middle, bad) if self._would(some[:middle]) else (good, middle)
            out = self._all(some[:good]) if good else []
            for op in some[good:]:
                try:
                    out.append(self.run.operation(op))
                except Exception as e:
                    raise Failed(out) from e
            return out

    def _would(self, some: list) -> bool:
        try:
            with self.tx.savepoint():
                self._all(some)
                raise _Undone
        except _Undone:
            return True
        except Exception:
            return False

    def _all(self, some: list) -> list[tuple[str, dict]]:
        return self._create(some) if isinstance(some[0], Create) else self._link(some)

    def _frame(self, table: str, columns: list[str], rows: list[tuple]) -> DataFrame:
        """Values for columns of a table, with their number in the run as ``_op``; made to fit the columns' types."""
        schema = self.tx.schema(table)
        unknown = [c for c in columns if c not in schema.names]
        if unknown:
            raise CompileError(f"there is no column {unknown[0]}")
        kinds = [schema[c].dataType for c in columns]
        values = [(i, *(coerce(v, k, c) for v, k, c in zip(row, kinds, columns, strict=True))) for i, row in enumerate(rows)]
        return self.run.engine.spark.createDataFrame(values, T.StructType([T.StructField("_op", T.LongType()), *(T.StructField(f"_{c}", k) for c, k in zip(columns, kinds, strict=True))]))

    def _found(self, ends: list[End], column: str, scoped: bool) -> dict[int, tuple[int, object]]:
        """By operation: how many rows fit an end, and the smallest key among them."""
        t = self.mapping.table(ends[0].entity)
        pairs = [{t.physical(f): v for f, v in e.filters.items()} for e in ends]
        columns = sorted(pairs[0])
        asked = self._frame(t.name, columns, [tuple(p[c] for c in columns) for p in pairs])
        table = self.run.table(t.name)
        if scoped and self.run.scope:
            table = self.run.scope.within(table, t.name, self.run.table)
        table = table.select(*{c: F.col(f"`{c}`") for c in [*columns, column]}.values())
        both = table.join(asked, [F.col(f"`{c}`") == F.col(f"`_{c}`") for c in columns])
        return {r["_op"]: (r["n"], r["key"]) for r in both.groupBy("_op").agg(F.count(F.lit(1)).alias("n"), F.min(f"`{column}`").alias("key")).collect()}

    def _now(self):
        return self.run.engine.spark.sql("SELECT cast(current_timestamp() AS timestamp_ntz)").first()[0]

    def _append(self, table: str, rows: list[dict]) -> tuple[DataFrame, list[dict]]:
        schema = self.tx.schema(table)
        values = [{f.name: coerce(r.get(f.name), f.dataType, f.name) for f in schema.fields} for r in rows]
        plain = T.StructType([T.StructField(f.name, f.dataType) for f in schema.fields])
        new = self.tx.append(table, self.run.engine.spark.createDataFrame([tuple(v[f.name] for f in schema.fields) for v in values], plain))
        check_rows(self.tx, table, new)
        return new, values

    def _create(self, some: list[Create]) -> list[tuple[str, dict]]:
        t = self.mapping.table(some[0].entity)
        schema = self.tx.schema(t.name)
        rows = [{t.physical(f): v for f, v in op.data.items()} for op in some]
        for name in some[0].resolve:
            step = self.mapping.relations[name].steps[0]
            if some[0].resolve[name].filters:
                found = self._found([op.resolve[name] for op in some], step.ref_column, False)
                for i, row in enumerate(rows):
                    row[step.fk_column] = found.get(i, (0, None))[1]
            else:
                key = self.run.lookup(some[0].resolve[name], step.ref_column)
                for row in rows:
                    row[step.fk_column] = key
        scope, numbered = self.run.scope_column(t.name), t.primary_key in schema.names and isinstance(schema[t.primary_key].dataType, (T.IntegerType, T.LongType))
        unknown = sorted({c for row in rows for c in row if c not in schema.names})
        if unknown:
            raise CompileError(f"{t.name} has no column {', '.join(unknown)}")
        now = self._now() if "created_at" in schema.names else None
        defaults = self.tx.entry(t.name)["constraints"].get("defaults", {})
        for row in rows:
            if scope:
                row[scope] = self.run.identity
            if numbered and row.get(t.primary_key) is None:
                row[t.primary_key] = self.tx.take_key(t.name)
            if now is not None and row.get("created_at") is None:
                row["created_at"] = now
            for c, v in defaults.items():
                row.setdefault(c, v)
        new, values = self._append(t.name, rows)
        plan = self.run.engine.plan_text(new)
        out = []
        for v in values:
            frame = new.where(F.col(f"`{t.primary_key}`") == v[t.primary_key]) if t.primary_key in v else new
            out.append((say.write_text("create", t.cls, 1, [v]), {"frame": frame, "plan": plan, "result": {"success": True, "rows_affected": 1, "returned_data": [v]}}))
        return out

    def _link(self, some: list[Link]) -> list[tuple[str, dict]]:
        relation, one = self.mapping.relations[some[0].relation], some[0]
        bridge = relation.junction
        steps = [next(s for s in relation.steps if s.ref_table == self.mapping.table(e.entity).name) for e in (one.start, one.end)]
        ends = [self._found([getattr(op, side) for op in some], s.ref_column, True) for side, s in zip(("start", "end"), steps, strict=True)]
        for i, op in enumerate(some):
            for e, found in zip((op.start, op.end), ends, strict=True):
                if found.get(i, (0, None))[0] != 1:
                    raise CompileError(f"{e.entity} {i} doesn't fit one row")  # told again by the operation itself
        columns = [s.fk_column for s in steps]
        pairs = [tuple(found[i][1] for found in ends) for i in range(len(some))]
        asked = self._frame(bridge, columns, sorted(set(pairs), key=str))
        same = [F.col(f"`{c}`") == F.col(f"`_{c}`") for c in columns]
        there = {tuple(r) for r in self.run.table(bridge).join(asked, same, "left_semi").select(*[F.col(f"`{c}`") for c in columns]).distinct().collect()}
        names, out, new, gone = f"{one.start.entity} and {one.end.entity}", [], [], []
        for pair in pairs:
            if one.op == "link":
                if pair in there:
                    out.append((f"{names} are linked by {one.relation} already.", {"result": "already linked"}))
                    continue
                there.add(pair)
                new.append(pair)
                out.append((f"Linked {names} by {one.relation}.", {"result": "linked"}))
            elif pair in there:
                there.discard(pair)
                gone.append(pair)
                out.append((f"Unlinked {names} from {one.relation}.", {"result": "unlinked"}))
            else:
                out.append((f"{names} are not linked by {one.relation}.", {"result": "not linked"}))
        if new:
            schema, key = self.tx.schema(bridge), self.tx.entry(bridge)["primary_key"]
            rows = [dict(zip(columns, pair, strict=True)) for pair in new]
            now = self._now() if "created_at" in schema.names else None
            for row in rows:
                if key in schema.names and key not in row:
                    row[key] = self.tx.take_key(bridge)
                if now is not None:
                    row["created_at"] = now
            self._append(bridge, rows)
        if gone:
            taken = self._frame(bridge, columns, gone)
            self.tx.change(bridge, lambda df: df.join(taken, same, "left_semi"), None)
            check_removed(self.tx, bridge, self.tx.replaced)
        return out
