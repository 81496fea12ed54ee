"""Ranks and running totals over keys of any size: in two steps, so no key's rows meet in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Rows of a key that one window takes in ``running``.
BLOCK = 1024


def ranked(df: DataFrame, key: str, ranges: list, order: list, keep: list, scratch: Scratch, name: str) -> tuple[DataFrame, DataFrame]:
    """Rows in order with their place, and what the places mean.

    Rows are dealt by ranges of (key, ranges) and sorted by (key, order) within a range, so a large key lies in
    several; ``ranges`` must be a leading part of the order, or agree with it.  Gives the saved rows
    (key, keep, ``part``, ``at``) and ``spans`` of (key, part, lo, before, n, total): a row's rank in its key is
    before + at - lo, n counts the span's rows and total the key's.
    """
    spread = df.repartitionByRange(F.col(key), *ranges).sortWithinPartitions(F.col(key), *order)
    rows = scratch.save(spread.select(key, *keep, F.monotonically_increasing_id().alias("at")), name)
    rows = rows.withColumn("part", F.shiftright("at", 33))
    spans = rows.groupBy(key, "part").agg(F.min("at").alias("lo"), F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy(key)
    before = F.sum("n").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.select(key, "part", "lo", "n", F.coalesce(before, F.lit(0)).alias("before"), F.sum("n").over(own).alias("total"))
    return rows, scratch.save(spans, f"{name}-spans")


def running(df: DataFrame, key: str, place: str, values: dict[str, tuple[str, str]], downwards: bool = False) -> DataFrame:
    """Running aggregates by place within a key, the row included: ``values`` maps a new column to (``xor`` or ``sum``, column).

    ``place`` is a long from 0.  Downwards, they run from the last place to the first.  Within blocks
    of BLOCK places by windows; what lies before a block comes from the blocks' totals.
    """
    fold = {"xor": F.bit_xor, "sum": F.sum}
    join = {"xor": lambda a, b: a.bitwiseXOR(b), "sum": lambda a, b: a + b}
    start, side = Window.unboundedPreceding, F.col(place).desc() if downwards else F.col(place)
    df = df.withColumn("_block", F.floor(F.col(place) / F.lit(BLOCK)).cast("long"))
    inside = Window.partitionBy(key, "_block").orderBy(side).rowsBetween(start, Window.currentRow)
    over = Window.partitionBy(key).orderBy(F.col("_block").desc() if downwards else F.col("_block")).rowsBetween(start, -1)
    totals = df.groupBy(key, "_block").agg(*[fold[how](c).alias(f"_{new}") for new, (how, c) in values.items()])
    totals = totals.select(F.col(key).alias("_key"), F.col("_block").alias("_at"), *[F.coalesce(fold[how](f"_{new}").over(over), F.lit(0)).alias(f"_{new}") for new, (how, _) in values.items()])
    local = df.withColumns({new: fold[how](c).over(inside) for new, (how, c) in values.items()})
    both = local.join(totals, (F.col(key) == F.col("_key")) & (F.col("_block") == F.col("_at")))
    whole: dict[str, Column] = {new: join[how](F.col(new), F.col(f"_{new}")) for new, (how, _) in values.items()}
    return both.withColumns(whole).drop("_key", "_at", "_block", *[f"_{new}" for new in values])
