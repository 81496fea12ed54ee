"""A query operation whose anchor is a stream.

Filters, projections, scope and joins with static tables compile as for a table.  Sorting,
limits and aggregates over an endless anchor are refused, as they have no result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..errors import CompileError
from ..model.mapping import Mapping
from ..plans.compile import Compiler, Scope
from ..plans.operations import Query, parse


def stream_query(raw: dict, mapping: Mapping, anchor: DataFrame, source, scope: Scope | None = None) -> DataFrame:
    """The streaming DataFrame of a query; ``anchor`` stands for its entity's table."""
    q = parse(raw)
    if not isinstance(q, Query):
        raise CompileError("only a query can read a stream")
    if q.aggregate or q.sort or q.limit:
        raise CompileError("a stream has no total, order or limit; window it and aggregate the frame")
    name = mapping.table(q.entity).name
    return Compiler(mapping, lambda t: anchor if t == name else source.table(t), scope).query(q)
