"""Constraints of stored tables, checked against a transaction's staged state.

A table's constraints: ``not_null`` and ``unique`` (lists of columns), ``lengths`` and ``allowed`` (by column),
``foreign`` (list of [column, table, column]).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ConstraintViolation
from .store import Transaction


def from_schema(table: dict) -> dict:
    """Constraints of a generated schema's table."""
    columns = table["columns"]
    foreign = [[k["column"], k["references_table"], k["references_column"]] for k in table["foreign_keys"]]
    foreign += [[c["name"], c["references"]["table"], c["references"]["column"]] for c in columns if c.get("references")]
    return {
        "not_null": [c["name"] for c in columns if c.get("not_null")] + [k["column"] for k in table["foreign_keys"] if k.get("not_null")] + [table["primary_key"]],
        "unique": [table["primary_key"]] + [c["name"] for c in columns if c.get("unique")],
        "lengths": {c["name"]: 255 for c in columns if c["type"] == "string"} | ({table["primary_key"]: 64} if table.get("primary_key_type") == "text" else {}),
        "allowed": {c["name"]: list(c["allowed_values"]) for c in columns if c.get("allowed_values") and not c.get("references")},
        "foreign": foreign,
    }


def check_rows(tx: Transaction, name: str, rows: DataFrame, columns: set[str] | None = None) -> None:
    """Rows that a write has put into the table; only ``columns`` where given.

    The cheap row-wise rules are one pass; keys and references look only at the written values, in files that may hold them.
    """
    rules = tx.entry(name)["constraints"]
    wanted = lambda c: columns is None or c in columns
    tests = {f"{name}.{c} must not be null": F.col(c).isNull() for c in rules.get("not_null", ()) if wanted(c)}
    tests |= {f"{name}.{c} is longer than {n}": F.length(c) > n for c, n in rules.get("lengths", {}).items() if wanted(c)}
    tests |= {f"{name}.{c} must be one of {', '.join(v)}": ~F.col(c).isin(v) for c, v in rules.get("allowed", {}).items() if wanted(c)}
    if tests:
        row = rows.agg(*[F.max(F.when(t, 1)).alias(f"t{i}") for i, t in enumerate(tests.values())]).first()
        broken = [what for what, hit in zip(tests, row, strict=True) if hit]
        if broken:
            raise ConstraintViolation("; ".join(broken))
    for c in rules.get("unique", ()):
        span = tx.written(name, c)
        if wanted(c) and span is not None:
            written = rows.where(F.col(c).isNotNull()).select(c).distinct()
            twice = tx.near(name, c, span).join(written, c, "left_semi").groupBy(c).count().where("count > 1").limit(1).collect()
            if twice:
                raise ConstraintViolation(f"{name}.{c} must be unique; {twice[0][0]!r} is there already")
    for column, other, key in rules.get("foreign", ()):
        span = tx.written(name, column)
        if wanted(column) and span is not None:
            written = rows.where(F.col(column).isNotNull()).select(F.col(column).alias(key)).distinct()
            lost = written.join(tx.near(other, key, span).select(key), key, "left_anti").limit(1).collect()
            if lost:
                raise ConstraintViolation(f"{name}.{column}: {other} has no {key} {lost[0][0]!r}")
    tx.unchecked.discard(name)


def check_removed(tx: Transaction, name: str, removed: DataFrame) -> None:
    """Rows taken out of the table, or replaced: nothing may refer to what the table no longer has."""
    for child, entry in tx.state["tables"].items():
        for column, other, key in entry["constraints"].get("foreign", ()):
            if other == name:
                held = tx.rows(child).where(F.col(column).isNotNull()).select(F.col(column).alias(key))
                gone = removed.select(key).distinct().join(tx.rows(name).select(key), key, "left_anti")
                hit = held.join(gone, key, "left_semi").limit(1).collect()
                if hit:
                    raise ConstraintViolation(f"{child}.{column} still refers to {name}.{key} {hit[0][0]!r}")
    tx.unheld.discard(name)
