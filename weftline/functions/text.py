"""Results and failures of a batch as text."""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import chain, islice

from pyspark.sql import DataFrame

_DONE = {"create": "Created", "update": "Updated", "delete": "Deleted"}


def as_json(rows: list[dict]) -> str:
    return json.dumps(rows, indent=2, default=str)


def _cut(rows: list[dict], total: int) -> str:
    return f"\nNOT COMPLETE: the first {len(rows)} of {total} rows." if len(rows) < total else ""


def query_text(entity: str, rows: list[dict], total: int) -> str:
    if not total:
        return f"No {entity} records found."
    if total == 1 and len(rows) == 1 and len(rows[0]) == 1:
        return str(next(iter(rows[0].values())))
    return as_json(rows) + _cut(rows, total)


def write_text(op: str, entity: str, affected: int, rows: list[dict]) -> str:
    return as_json(rows) + _cut(rows, affected) if rows else f"{_DONE[op]} {affected} {entity} record(s)."


def invalid_text(errors: list[str]) -> str:
    return "\n".join(["The batch is not valid; nothing was run:", *(f"- {e}" for e in errors), "", "Correct the operations and send them again."])


def failed_text(number: int, error: str, before: int) -> str:
    lines = [f"Operation {number} FAILED:", error, ""]
    if before:
        lines += [f"The {before} operation(s) before it were rolled back; the store is unchanged.", ""]
    return "\n".join([*lines, "Correct the operation, ask for what is missing, or go another way; the same values will fail again."])


class Rows:
    """The rows of a result, read when they are asked for: the driver holds one partition of them at a time."""

    def __init__(self, frame: DataFrame):
        self.frame = frame

    def __iter__(self) -> Iterator[dict]:
        return (r.asDict() for r in self.frame.toLocalIterator())

    def __len__(self) -> int:
        return self.frame.count()


def json_pieces(rows: Iterator[dict]) -> Iterator[str]:
    """``as_json`` of at least one row, a row at a time."""
    between = "[\n"
    for row in rows:
        yield between + "\n".join(f"  {line}" for line in json.dumps(row, indent=2, default=str).split("\n"))
        between = ",\n"
    yield "\n]"


def query_pieces(entity: str, rows: Rows) -> Iterator[str]:
    """``query_text`` in pieces."""
    left = iter(rows)
    first = list(islice(left, 2))
    if not first or len(first) == 1 and len(first[0]) == 1:
        yield query_text(entity, first, len(first))
    else:
        yield from json_pieces(chain(first, left))


def write_pieces(op: str, entity: str, affected: int, rows: Rows) -> Iterator[str]:
    """``write_text`` in pieces."""
    left = iter(rows)
    first = list(islice(left, 1))
    if first:
        yield from json_pieces(chain(first, left))
    else:
        yield write_text(op, entity, affected, [])
