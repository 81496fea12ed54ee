"""Running batches of operations against a store or a read-only catalog."""

from __future__ import annotations

import copy
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import CompileError, ConstraintViolation, StoreError, WeftlineError
from .functions import text as say
from .functions.actions import Actions
from .functions.literals import coerce
from .model.mapping import Mapping
from .operators import relational as R
from .plans.compile import Compiler, Scope, Trust
from .plans.operations import Call, Create, Delete, End, Link, Query, Update, parse
from .plans.tool import tool_schema
from .plans.validate import validate
from .runs import Failed, Together, cut
from .sources.constraints import check_removed, check_rows
from .sources.store import Store, Transaction


@dataclass
class Result:
    """What a batch gave: text for a caller that reads, frames and rows for one that computes.

    Of a lazy batch ``parts`` makes the text when ``pieces`` asks for it, and rows are handles (``functions.text.Rows``).
    """

    said: str | None
    ok: bool
    log: list[dict] = field(default_factory=list)
    parts: list = field(default_factory=list)

    def pieces(self) -> Iterator[str]:
        """The text, in pieces that a caller may write one by one."""
        if self.said is not None:
            yield self.said
            return
        for i, part in enumerate(self.parts):
            if i:
                yield "\n"
            yield from ([part] if isinstance(part, str) else part())

    @property
    def text(self) -> str:
        return "".join(self.pieces())


@dataclass
class Context:
    """What an action sees and may do: the tables as the batch has left them so far, who asks, and writes that join the batch.

    ``execute`` runs operations in the batch's transaction, under its identity, and gives their log entries; the first that fails raises.
    ``transaction`` is that transaction (None over a read-only catalog), for writes of rows as DataFrames; those need ``check_rows`` to be relied on.
    """

    spark: SparkSession
    table: object
    identity: object = None
    execute: object = None
    transaction: Transaction | None = None

    def savepoint(self):
        """A block whose writes go if it raises, without the batch failing; blocks may be nested."""
        if self.transaction is None:
            raise StoreError("this source is read-only")
        return self.transaction.savepoint()


class Engine:
    """``source`` is a Store, or a catalog with ``table(name)`` that is only read.

    With ``owned`` (table -> column, see mapping.ownership) and an identity, operations see and
    write only that identity's rows of the tables named; with ``paths`` (see mapping.owner_paths) also of tables that lead to these by keys.  Text and results hold all rows, or the first
    ``max_rows`` where a caller sets that, and say how many there are; a frame always holds all.
    """

    def __init__(self, spark: SparkSession, mapping: Mapping, source, actions: Actions | None = None, owned: dict[str, str] | None = None, deep_scope: bool = False, rewrite: bool = True, max_rows: int | None = None, paths: dict | None = None):
        self.spark, self.mapping, self.source = spark, mapping, source
        self.actions, self.owned, self.deep_scope, self.rewrite, self.max_rows = actions or Actions(), owned or {}, deep_scope, rewrite, max_rows
        self.paths = paths or {}

    def tool(self) -> dict:
        return tool_schema(self.mapping, self.actions)

    def scope(self, identity) -> Scope | None:
        return Scope(identity, self.owned, self.deep_scope, self.paths) if identity is not None and self.owned else None

    def trust(self, tx: Transaction | None) -> Trust:
        """What a store's constraints guarantee where all that was written was checked; a catalog guarantees nothing."""
        if not self.rewrite or tx is None:
            return Trust()
        rules = {n: t["constraints"] for n, t in tx.state["tables"].items() if t["verified"] and n not in tx.unchecked}
        pairs = lambda kind: frozenset((n, c) for n, r in rules.items() for c in r.get(kind, ()))
        return Trust(pairs("not_null"), pairs("unique"), frozenset((n, *f) for n, r in rules.items() for f in r.get("foreign", ()) if f[1] not in tx.unheld))

    def compiler(self, tx: Transaction | None, scope: Scope | None) -> Compiler:
        return Compiler(self.mapping, tx.table if tx else self.source.table, scope, self.trust(tx), tx)

    def plan_text(self, frame: DataFrame | None) -> str | None:
        return plan_text(frame)

    def begin(self) -> Transaction | None:
        return self.source.transaction() if isinstance(self.source, Store) else None

    def frame(self, raw: dict, identity=None) -> DataFrame:
        """A query operation as a DataFrame, nothing being run."""
        errors = validate([raw], self.mapping, self.actions)
        if errors:
            raise CompileError("; ".join(errors))
        operation = parse(raw)
        if not isinstance(operation, Query):
            raise CompileError("only a query is a frame")
        return self.compiler(self.begin(), self.scope(identity)).query(operation)

    def frames(self, batch: list[dict], identity=None) -> list[DataFrame]:
        """Every query of a batch as a DataFrame."""
        return [self.frame(raw, identity) for raw in batch]

    def identities(self, entity: str, n: int = 20) -> DataFrame:
        """The first rows of the identity entity by key, to choose from."""
        t = self.mapping.table(entity)
        return self.source.table(t.name).orderBy(t.primary_key).limit(n)

    def execute(self, batch: list[dict], identity=None, lazy: bool = False) -> Result:
        """Run all operations, or none if one fails.  Failures are text, never exceptions.

        With ``lazy`` no result is brought to the driver before it is asked for, whatever its size.
        """
        errors = validate(batch, self.mapping, self.actions)
        if errors:
            return Result(say.invalid_text(errors), False)
        tx = self.begin()
        run = _Run(self, tx, self.scope(identity), identity, lazy)
        texts, log = [], []
        operations = [parse(raw) for raw in copy.deepcopy(batch)]
        together = Together(run)
        for some in cut(operations):
            ops, done, error = [operations[i] for i in some], [], None
            try:
                if len(some) > 1 and together.may(ops[0]):
                    done = together.operations(ops)
                else:
                    for op in ops:
                        done.append(run.operation(op))
            except Exception as e:  # Spark and the JVM raise many kinds; whatever it is, nothing staged may stay
                if tx:
                    tx.rollback()
                done, error = (e.done, e.__cause__) if isinstance(e, Failed) else (done, e)
            except BaseException:  # the caller gave up
                if tx:
                    tx.rollback()
                raise
            for i, (out, entry) in zip(some, done):  # noqa: B905 - fewer where one failed
                raw = batch[i]
                texts.append(out)
                log.append({"op": raw, "is_write": raw["op"] not in ("query", "action"), "plan": entry["plan"] if "plan" in entry else plan_text(entry.get("frame")), **entry})
            if error:
                return Result(say.failed_text(len(texts) + 1, _short(error), len(texts)), False, log)
        if tx:
            try:
                tx.commit()
            except Exception as e:
                tx.rollback()
                return Result(say.failed_text(len(batch), _short(e), len(batch) - 1), False, log)
        return Result(None, True, log, texts) if lazy else Result("\n".join(texts), True, log)


def plan_text(frame: DataFrame | None) -> str | None:
    """What Spark runs for a frame, literals included: what a log of statements and parameters would tell."""
    return frame._jdf.queryExecution().optimizedPlan().toString() if frame is not None else None


def _short(e: Exception) -> str:
    text = f"constraint_violation: {e}" if isinstance(e, ConstraintViolation) else str(e)
    return text.split("\nJVM stacktrace", 1)[0].split("\n\tat ", 1)[0].strip()


class _Run:
    def __init__(self, engine: Engine, tx: Transaction | None, scope: Scope | None, identity, lazy: bool = False):
        self.lazy = lazy
        self.engine, self.tx, self.scope, self.identity, self.mapping = engine, tx, scope, identity, engine.mapping

    def table(self, name: str) -> DataFrame:
        return self.tx.table(name) if self.tx else self.engine.source.table(name)

    def where(self, name: str, pairs: dict) -> DataFrame:
        """Rows of a table of the store that have the given values."""
        return R.where_equal(self.tx.where(name, pairs), pairs)

    def rows(self, df: DataFrame) -> tuple[list[dict], int]:
        """All rows or the first max_rows, and how many there are."""
        most = self.engine.max_rows
        if most is None:
            rows = [r.asDict() for r in df.collect()]
            return rows, len(rows)
        rows = [r.asDict() for r in df.limit(most + 1).collect()]
        return rows[:most], len(rows) if len(rows) <= most else df.count()

    def operation(self, op) -> tuple[str, dict]:
        if isinstance(op, Query):
            df = self.engine.compiler(self.tx, self.scope).query(op)
            if self.lazy:
                rows = say.Rows(df)
                return partial(say.query_pieces, op.entity, rows), {"frame": df, "result": rows}
            rows, total = self.rows(df)
            return say.query_text(op.entity, rows, total), {"frame": df, "result": rows, "total": total}
        if isinstance(op, Call):
            return self.call(op)
        if self.tx is None:
            raise StoreError("this source is read-only")
        if isinstance(op, Create):
            return self.create(op)
        if isinstance(op, (Update, Delete)):
            return self.change(op)
        return self.link(op)

    def call(self, op: Call) -> tuple[str, dict]:
        try:
            out = str(self.engine.actions.get(op.action).run(op.params, Context(self.engine.spark, self.table, self.identity, self.nested, self.tx), self.mapping))
        except Exception as e:  # whatever a domain's code raises is the operation's failure
            raise WeftlineError(f"action {op.action}: {e}") from e
        return out, {"result": out}

    def nested(self, batch: list[dict]) -> list[dict]:
        """Operations of an action, in the same transaction."""
        errors = validate(batch, self.mapping, self.engine.actions)
        if errors:
            raise CompileError("; ".join(errors))
        return [{"op": raw, **self.operation(parse(raw))[1]} for raw in copy.deepcopy(batch)]

    def scope_column(self, table: str) -> str | None:
        return self.scope.column(table) if self.scope else None

    def create(self, op: Create) -> tuple[str, dict]:
        t = self.mapping.table(op.entity)
        schema = self.tx.schema(t.name)
        row = {t.physical(f): v for f, v in op.data.items()}
        for name, end in op.resolve.items():
            step = self.mapping.relations[name].steps[0]
            row[step.fk_column] = self.lookup(end, step.ref_column)
        column = self.scope_column(t.name)
        if column:
            row[column] = self.identity
        unknown = [c for c in row if c not in schema.names]
        if unknown:
            raise CompileError(f"{t.name} has no column {', '.join(unknown)}")
        if t.primary_key in schema.names and row.get(t.primary_key) is None and isinstance(schema[t.primary_key].dataType, (T.IntegerType, T.LongType)):
            row[t.primary_key] = self.tx.take_key(t.name)
        if "created_at" in schema.names and row.get("created_at") is None:
            row["created_at"] = self.engine.spark.sql("SELECT cast(current_timestamp() AS timestamp_ntz)").first()[0]
        defaults = self.tx.entry(t.name)["constraints"].get("defaults", {})
        values = {f.name: coerce(row.get(f.name, defaults.get(f.name)), f.dataType, f.name) for f in schema.fields}
        df = self.engine.spark.createDataFrame([tuple(values[f.name] for f in schema.fields)], T.StructType([T.StructField(f.name, f.dataType) for f in schema.fields]))
        new = self.tx.append(t.name, df)
        check_rows(self.tx, t.name, new)
        if self.scope and t.name in self.scope.paths and not self.scope.within(new, t.name, self.table).limit(1).collect():
            raise CompileError(f"the new {op.entity} would be outside what the identity may write")
        rows, _ = self.rows(new)
        return say.write_text("create", op.entity, 1, rows), {"frame": new, "result": {"success": True, "rows_affected": 1, "returned_data": rows}}

    def lookup(self, end: End, column: str):
        """The key of the row that fits; of several the lowest, of none null."""
        t = self.mapping.table(end.entity)
        found = self.where(t.name, {t.physical(f): v for f, v in end.filters.items()}).select(column).orderBy(column).limit(1).collect()
        return found[0][0] if found else None

    def change(self, op: Update | Delete) -> tuple[str, dict]:
        t = self.mapping.table(op.entity)
        schema = self.tx.schema(t.name)
        pairs = {t.physical(f): v for f, v in op.filters.items()}
        column = self.scope_column(t.name)
        asked = dict(pairs)
        if column:  # a filter on the scope's own column holds as well
            pairs.setdefault(column, self.identity)

        def pick(df: DataFrame) -> DataFrame:
            df = R.where_equal(df, asked)
            return self.scope.within(df, t.name, self.table) if self.scope else df

        values = None
        if isinstance(op, Update):
            values = {}
            for f, v in op.data.items():
                c = t.physical(f)
                if c not in schema.names:
                    raise CompileError(f"{t.name} has no column {c}")
                values[c] = F.lit(coerce(v, schema[c].dataType, c)).cast(schema[c].dataType)
        unknown = [c for c in pairs if c not in schema.names]
        if unknown:
            raise CompileError(f"there is no column {', '.join(unknown)}")
        some = bool(pairs) or bool(self.scope and self.scope.covers(t.name))
        result = self.tx.change(t.name, pick if some else None, values, pairs or None)
        referred = {key for e in self.tx.state["tables"].values() for _, other, key in e["constraints"].get("foreign", ()) if other == t.name}
        if values is not None:
            check_rows(self.tx, t.name, result, set(values))
        if values is None or referred & set(values):
            check_removed(self.tx, t.name, self.tx.replaced)
        else:
            self.tx.unheld.discard(t.name)
        if values and self.scope and t.name in self.scope.paths and self.scope.paths[t.name][0].fk_column in values and self.scope.within(result, t.name, self.table).count() < result.count():
            raise CompileError(f"the {op.entity} would go outside what the identity may write")
        affected = result.count()
        if self.lazy:
            rows = say.Rows(result)
            return partial(say.write_pieces, op.op, op.entity, affected, rows), {"frame": result, "result": {"success": True, "rows_affected": affected, "returned_data": rows}}
        rows, _ = self.rows(result)
        return say.write_text(op.op, op.entity, affected, rows), {"frame": result, "result": {"success": True, "rows_affected": affected, "returned_data": rows}}

    def end(self, end: End, column: str):
        """The key of the one row that fits an endpoint."""
        t = self.mapping.table(end.entity)
        pairs = {t.physical(f): v for f, v in end.filters.items()}
        scope = self.scope_column(t.name)
        if scope:
            pairs[scope] = self.identity
        df = self.where(t.name, pairs)
        found = (self.scope.within(df, t.name, self.table) if self.scope else df).select(column).limit(2).collect()
        if len(found) != 1:
            raise CompileError(f"{'no' if not found else 'more than one'} {end.entity} fits {end.filters}{': ambiguous' if found else ': no match'}")
        return found[0][0]

    def link(self, op: Link) -> tuple[str, dict]:
        relation = self.mapping.relations[op.relation]
        step_of = lambda end: next(s for s in relation.steps if s.ref_table == self.mapping.table(end.entity).name)
        steps = step_of(op.start), step_of(op.end)
        pair = {s.fk_column: self.end(e, s.ref_column) for s, e in zip(steps, (op.start, op.end), strict=True)}
        there = bool(self.where(relation.junction, pair).limit(1).collect())
        names = f"{op.start.entity} and {op.end.entity}"
        if op.op == "link":
            if there:
                return f"{names} are linked by {op.relation} already.", {"result": "already linked"}
            schema = self.tx.schema(relation.junction)
            key = self.tx.entry(relation.junction)["primary_key"]
            row = dict(pair)
            if key in schema.names and key not in row:
                row[key] = self.tx.take_key(relation.junction)
            if "created_at" in schema.names:
                row["created_at"] = self.engine.spark.sql("SELECT cast(current_timestamp() AS timestamp_ntz)").first()[0]
            df = self.engine.spark.createDataFrame([tuple(coerce(row.get(f.name), f.dataType, f.name) for f in schema.fields)], T.StructType([T.StructField(f.name, f.dataType) for f in schema.fields]))
            check_rows(self.tx, relation.junction, self.tx.append(relation.junction, df))
            return f"Linked {names} by {op.relation}.", {"result": "linked"}
        if not there:
            return f"{names} are not linked by {op.relation}.", {"result": "not linked"}
        self.tx.change(relation.junction, lambda df: R.where_equal(df, pair), None, pair)
        check_removed(self.tx, relation.junction, self.tx.replaced)
        return f"Unlinked {names} from {op.relation}.", {"result": "unlinked"}
