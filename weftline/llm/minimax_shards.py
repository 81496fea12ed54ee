"""Contiguous shards whose largest is as small as can be.

Rows of equal text are one atomic group.  Groups have an order, by the MD5 of their text, and shards are stretches of it.
The smallest capacity at which filling shards one after another, each as far as it goes, needs no more
than the shards there are is found by binary search.  Many cuts keep to that capacity; of these the order is cut where
shards are nearest to equal: each ends at the last group end before its even share, or later where the shards after it
could not hold the rest (so the last shard isn't the one that is left half empty).

A group that is larger than the mean of what is left after larger ones gets a shard of its own, and comes first in the order;
there are fewer such groups than shards.  The search is about the others, so the rest stays even
when one text is a third of all rows.

The check of a capacity asks, for each shard, how far it can be filled: the last group end at or before a
position.  The driver never sees all ends: it knows the smallest and largest end in each of POINTS equal stretches, and
answers are then bounds from below and above.  A capacity is settled if both bounds agree; what
stays open are stretches around the cuts, which the next job divides in turn, until cuts are exact.  Each round
narrows what is open by a factor of a thousand or so, so three or four jobs do for any number of groups.

Rows are numbered within shards by the same order and, in a group, by the MD5 of doc_id.  Everything
is DataFrame functions; texts are read once and not moved, and a group's rows are dealt out by the MD5 of doc_id.

Defined results: a null text counts as the empty one; null doc_ids come first in their group; repeated rows are rows of
their own; with fewer groups than shards some shards are empty; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, table

SHARDS = 24
#: Stretches that one job of the search tells apart: some hundred kilobytes for the driver.
POINTS = 8192
#: What a row weighs besides its text.
ROW_BYTES = 8


def digests(docs: DataFrame) -> DataFrame:
    """What a row weighs, its group and its place in it."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    place = F.coalesce(F.md5(F.col("doc_id").cast("string").cast("binary")), F.lit(""))
    return docs.select("doc_id", (F.octet_length(text) + F.lit(ROW_BYTES)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.md5(text).alias("group"), place.alias("place"))


def giants(rows: DataFrame, shards: int) -> list[tuple[str, int]]:
    """Groups that get a shard of their own, largest first: at most shards - 1."""
    groups = rows.groupBy("group").agg(F.sum("size").alias("size"))
    left = rows.agg(F.sum("size")).first()[0] or 0
    out = []
    for row in groups.orderBy(F.desc("size"), "group").limit(shards - 1).collect():
        if row["size"] * (shards - len(out)) <= left:
            break
        out.append((row["group"], row["size"]))
        left -= row["size"]
    return out


def cells(rows: DataFrame, large: list[tuple[str, int]]) -> DataFrame:
    """Groups, in parts by place, in order: ``before`` rows come first, and the group ends at byte ``end``.

    Sums within 4096 leading digits of the order, then over these: no task has more than its share.
    """
    part = F.substring("place", 1, 3)
    block = F.substring("group", 1, 3)
    for i, (group, _) in enumerate(large):  # sorts before all digits
        block = F.when(F.col("group") == group, F.lit(f"!{i:06d}")).otherwise(block)
    sums = rows.groupBy("group", part.alias("part")).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).withColumn("block", block)
    inside = Window.partitionBy("block")
    by_part = inside.orderBy("group", "part").rowsBetween(Window.unboundedPreceding, -1)
    placed = sums.withColumn("before", F.coalesce(F.sum("n").over(by_part), F.lit(0))).withColumn("end", F.sum("size").over(inside.orderBy("group")))
    order = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # over 4096 blocks and the large groups
    blocks = sums.groupBy("block").agg(F.sum("size").alias("_size"), F.sum("n").alias("_n"))
    blocks = blocks.select("block", F.coalesce(F.sum("_size").over(order), F.lit(0)).alias("_bytes"), F.coalesce(F.sum("_n").over(order), F.lit(0)).alias("_rows"))
    return placed.join(blocks, "block").select("group", "part", (F.col("before") + F.col("_rows")).alias("before"), (F.col("end") + F.col("_bytes")).alias("end"), "n")


class Ends:
    """Group ends as far as they are known: between neighbours that are not ``closed`` there may be others."""

    def __init__(self, start: int):
        self.known, self.closed = [start], {}

    def learn(self, stretches: list[tuple[int, int, bool]], low: int) -> None:
        """The smallest and largest end of each stretch after ``low``, and whether there is none between; nothing lies between stretches."""
        for a, b, alone in stretches:
            if low < a:
                self.closed[low] = True
            self.closed[a] = alone or a == b
            low = b
        self.known = sorted({*self.known, *(x for a, b, _ in stretches for x in (a, b))})

    def reach(self, position: int) -> tuple[int, int]:
        """The last end at or before a position, from below and from above."""
        i = bisect_right(self.known, position) - 1
        low = self.known[i]
        return low, low if low == position or i + 1 == len(self.known) or self.closed.get(low, False) else position

    def climb(self, position: int) -> tuple[int, int]:
        """The first end at or after a position, from below and from above."""
        i = bisect_left(self.known, position)
        high = self.known[i]
        return high if high == position or not i or self.closed.get(self.known[i - 1], False) else position, high

    def even(self, capacity: int, shards: int) -> list[tuple[int, int]]:
        """Where shards of that capacity end if they are as even as may be, and before that where each must end at least."""
        start, total = self.known[0], self.known[-1]
        least = [(total, total)]
        for _ in range(shards - 1):
            low, high = (max(start, x - capacity) for x in least[-1])
            least.append((self.climb(low)[0], self.climb(high)[1]))
        out, low, high = [], start, start
        for k, (a, b) in enumerate(reversed(least), 1):
            share = start + (total - start) * k // shards
            low, high = self.reach(min(low + capacity, max(a, share)))[0], self.reach(min(high + capacity, max(b, share)))[1]
            out.append((low, high))
        return [*least, *out]

    def cuts(self, capacity: int, shards: int) -> list[tuple[int, int]]:
        """Where each shard ends at most, from below and from above."""
        out, low, high = [], self.known[0], self.known[0]
        for _ in range(shards):
            low, high = self.reach(low + capacity)[0], self.reach(high + capacity)[1]
            out.append((low, high))
        return out


def _stretches(ends: DataFrame, ranges: list[tuple[int, int]]) -> list[list[tuple[int, int, bool]]]:
    """For each range (after a, before b), what POINTS equal parts of all ranges hold."""
    width = max(1, -(-sum(b - a for a, b in ranges) // POINTS))
    slot: Column = F.lit(None).cast("long")
    near, first, firsts = F.lit(False), 0, []
    for a, b in ranges:
        inside = (F.col("end") > a) & (F.col("end") < b)
        slot, near = F.when(inside, F.floor((F.col("end") - F.lit(a)) / F.lit(width)).cast("long") + F.lit(first)).otherwise(slot), near | inside
        firsts.append(first)
        first += -(-(b - a) // width) + 1
    found = ends.where(near).groupBy(slot.alias("slot")).agg(F.min("end").alias("a"), F.max("end").alias("b"), F.count(F.lit(1)).alias("n")).collect()
    out: list[list] = [[] for _ in ranges]
    for r in sorted(found, key=lambda r: r["a"]):
        out[bisect_right(firsts, r["slot"]) - 1].append((r["a"], r["b"], r["n"] <= 2 or r["b"] - r["a"] <= 1))
    return out


def smallest_capacity(ends: DataFrame, start: int, total: int, shards: int) -> tuple[int, list[int]]:
    """The smallest capacity at which ``shards`` stretches hold all groups from ``start`` to ``total``, and where they end.

    ``ends`` has each group's end (more than once does no harm).
    """
    seen, ranges = Ends(start), [(start, total + 1)]
    while True:
        for (a, b), stretches in zip(ranges, _stretches(ends, ranges), strict=True):
            seen.learn(stretches, a)
            if stretches and stretches[-1][1] < b < total + 1:
                seen.closed[stretches[-1][1]] = True
            elif not stretches:
                seen.closed[a] = True
        fits = lambda capacity, bound: seen.cuts(capacity, shards)[-1][bound] >= total
        least = lambda bound: _least(0, total - start, lambda c: fits(c, bound))
        below, above = least(1), least(0)  # by the bounds from above, a capacity may do; by those from below, it does
        if below == above:
            around = seen.even(above, shards)
            if all(low == high for low, high in around):
                return above, [low for low, _ in around[shards:]]
        else:
            around = [(low, high) for (low, _), (_, high) in zip(seen.cuts(below, shards), seen.cuts(above, shards), strict=True)]
        ranges = _open(seen, around)


def _least(low: int, high: int, holds) -> int:
    """The smallest number in low .. high that holds, given that high does and all after a first one do."""
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if holds(middle) else (middle + 1, high)
    return low


def _open(seen: Ends, around: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """For each of the given stretches, the one from its first unknown ends to its last; overlapping ones put together."""
    out: list[tuple[int, int]] = []
    for low, high in around:
        i = bisect_right(seen.known, low) - 1
        gaps = []
        while i + 1 < len(seen.known) and seen.known[i] <= high:
            if not seen.closed.get(seen.known[i], False):
                gaps.append((seen.known[i], seen.known[i + 1]))
            i += 1
        if gaps:
            out.append((gaps[0][0], gaps[-1][1]))
    merged: list[tuple[int, int]] = []
    for a, b in sorted(out):
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


def shards(docs: DataFrame, scratch: Scratch, n: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every row, and the ``capacity`` of the shards that share the rest."""
    rows = scratch.save(digests(docs), "rows")
    large = giants(rows, n)
    placed = scratch.save(cells(rows, large), "cells")
    total = placed.agg(F.max("end")).first()[0] or 0
    own, at = [], 0
    for _, size in large:
        at += size
        own.append(at)
    capacity, rest = smallest_capacity(placed.select("end"), at, total, n - len(large)) if total > at else (0, [])
    shard = F.lit(0)
    for cut in [*own, *rest]:
        shard = shard + F.when(F.col("end") > cut, 1).otherwise(0)
    placed = placed.withColumn("shard", shard.cast("int"))
    firsts = {r["shard"]: r["first"] for r in placed.groupBy("shard").agg(F.min("before").alias("first")).collect()}
    first = F.lit(0).cast("long")
    for s, b in firsts.items():
        first = F.when(F.col("shard") == s, F.lit(b).cast("long")).otherwise(first)
    placed = placed.select("group", "part", "shard", (F.col("before") - first).alias("first"))
    rows = rows.withColumn("part", F.substring("place", 1, 3))
    number = F.row_number().over(Window.partitionBy("group", "part").orderBy("place", "doc_id"))
    both = rows.withColumn("number", number).join(placed, ["group", "part"])
    slot = (F.col("first") + F.col("number") - 1).cast("long")
    return both.select("doc_id", "size", "text_crc32", "shard", slot.alias("slot"), F.lit(capacity).cast("long").alias("capacity"))


def op11_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shards(table(spark, sf_dir, "documents").select("doc_id", "text"), Scratch(spark, "shards"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "capacity")


_HEX = "list_transform(string_split(hex(encode(coalesce(text, ''))), ''), lambda c: strpos('0123456789ABCDEF', c) - 1)"
_ENTRY = "list_reduce(list_prepend(i, [0, 0, 0, 0]), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)"

#: CRC-32 goes by half bytes; the binary search halves (low, high) with the check of a capacity as a fold over sizes.
OP11_SQL = f"""
WITH RECURSIVE entries AS (SELECT list({_ENTRY} ORDER BY i) AS t FROM (SELECT unnest(range(16)) AS i)),
nibbles AS (SELECT doc_id, strlen(coalesce(text, '')) + {ROW_BYTES} AS size, md5(coalesce(text, '')) AS grp, coalesce(md5(CAST(doc_id AS VARCHAR)), '') AS place, {_HEX} AS x FROM documents),
rows_ AS (SELECT doc_id, size, grp, place, xor(list_reduce(list_prepend(4294967295::BIGINT, CASE WHEN size = {ROW_BYTES} THEN [] ELSE list_transform(range(len(x)), lambda i: x[xor(i, 1) + 1]) END), lambda c, v: xor(c >> 4, t[xor(c & 15, v) + 1])), 4294967295) AS text_crc32 FROM nibbles, entries),
groups_ AS (SELECT grp, sum(size) AS bytes FROM rows_ GROUP BY grp),
ranked AS (SELECT *, row_number() OVER w - 1 AS r, sum(bytes) OVER () - coalesce(sum(bytes) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest FROM groups_ WINDOW w AS (ORDER BY bytes DESC, grp)),
sized AS (SELECT *, bool_and(r < {SHARDS} - 1 AND bytes * ({SHARDS} - r) > rest) OVER (ORDER BY bytes DESC, grp) AS large FROM ranked),
ordered AS (SELECT grp, bytes, large, r, sum(bytes) OVER (ORDER BY grp) AS finish FROM sized WHERE NOT large),
sizes AS (SELECT list({{'n': 1, 'f': 0, 's': CAST(bytes AS BIGINT)}} ORDER BY grp) AS l, CAST(sum(bytes) AS BIGINT) AS total, {SHARDS} - (SELECT count(*) FROM sized WHERE large) AS k FROM ordered),
search AS (
  SELECT 0::BIGINT AS low, total AS high FROM sizes
  UNION ALL
  SELECT CASE WHEN fits THEN low ELSE middle + 1 END, CASE WHEN fits THEN middle ELSE high END
  FROM (SELECT low, high, (low + high) // 2 AS middle, list_max(list_transform(l, lambda e: e.s)) <= (low + high) // 2 AND list_reduce(list_prepend({{'n': 1, 'f': 0::BIGINT, 's': 0::BIGINT}}, l), lambda a, e: CASE WHEN a.f + e.s > (low + high) // 2 THEN {{'n': a.n + 1, 'f': e.s, 's': 0::BIGINT}} ELSE {{'n': a.n, 'f': a.f + e.s, 's': 0::BIGINT}} END).n <= k AS fits FROM search, sizes WHERE low < high)
),
capacity AS (SELECT max(low) AS c FROM search WHERE low = high),
ends AS (SELECT finish FROM ordered UNION ALL SELECT 0),
least AS (SELECT k AS i, total AS cut FROM sizes UNION ALL SELECT i - 1, (SELECT min(finish) FROM ends WHERE finish >= greatest(0, cut - c))::BIGINT FROM least, capacity WHERE i > 1),
cuts AS (SELECT 0 AS i, 0::BIGINT AS cut UNION ALL SELECT cuts.i + 1, (SELECT max(finish) FROM ends WHERE finish <= least(cuts.cut + c, greatest(least.cut, total * (cuts.i + 1) // k)))::BIGINT FROM cuts, capacity, sizes, least WHERE least.i = cuts.i + 1),
dealt AS (SELECT grp, r AS shard FROM sized WHERE large UNION ALL SELECT grp, (SELECT count(*) FROM sized WHERE large) + (SELECT max(i) FROM cuts WHERE cut < finish) FROM ordered)
SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'bytes' AS law, CAST(shard AS INTEGER) AS shard, row_number() OVER (PARTITION BY shard ORDER BY grp, place, doc_id) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard, CAST(c AS BIGINT) AS capacity
FROM rows_ JOIN dealt USING (grp), capacity
"""
