"""Operators over DataFrames.  Everything stays declarative, so pushdown, pruning and join choice are Catalyst's."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import CompileError
from ..functions.literals import coerce


def equals(df: DataFrame, column: str, value, alias: str | None = None) -> Column:
    """column = value; a null value equals nothing, not even null."""
    if column not in df.columns:
        raise CompileError(f"there is no column {column}")
    kind = df.schema[column].dataType
    return F.col(alias or column) == F.lit(coerce(value, kind, column)).cast(kind)


def all_of(conditions: list[Column]) -> Column | None:
    return reduce(lambda a, b: a & b, conditions) if conditions else None


def where_equal(df: DataFrame, pairs: dict) -> DataFrame:
    condition = all_of([equals(df, c, v) for c, v in pairs.items()])
    return df if condition is None else df.where(condition)


def aggregate(df: DataFrame, fn: str, column: str | None) -> DataFrame:
    """One row with one column named after the function."""
    if fn == "count":
        out = F.count(F.col(column)) if column else F.count(F.lit(1))
    else:
        out = getattr(F, fn)(F.col(column))
    return df.agg(out.alias(fn))


def order(df: DataFrame, column: str, direction: str) -> DataFrame:
    """Nulls count as greater than all values."""
    return df.orderBy(F.col(column).asc_nulls_last() if direction == "asc" else F.col(column).desc_nulls_first())
