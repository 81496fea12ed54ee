"""Prefix tries of conversations, from whole sequences.

Every conversation has one digest of its turns in order; conversations of equal digest collapse to one weighted
sequence, which keeps a list of the conversations that end there.  Sequences that are a proper prefix of another are found,
and taken away, by an anti-join with the prefixes of all; what is left are the leaves.  Each sequence's prefixes
carry its weight, and summed by prefix they are the trie's nodes.  A node belongs to the sequence of its smallest
member; totals over a subtree are totals, along each sequence, of what belongs to it there and deeper, summed by prefix.

A turn counts in digests as two 64-bit hashes of role, text and place, and a sequence as their exclusive or,
so a prefix's digest is a running total: places, prefixes and subtree totals are all found in two steps by
blocks (see ``scans``), and no conversation's turns, however many, meet in one task.  Texts are moved once, to put turns in order.
End lists are joined in pieces of 4096 conversation ids, and pieces of one node are hashed in a stream.

Defined results: rows with equal turns are ordered by role, then text; null roles and texts are empty; repeated rows are turns of
their own; rows with a null conv_id belong to no conversation and are left out; an empty table has no nodes, not even a root;
other columns are ignored.  Equal digests of 128 bits count as equal turns.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table
from .scans import ranked, running

#: Of the dealt query: conversations come in families of FAMILY, and share up to MOST - 1 first turns.
FAMILY, MOST = 5, 9
#: Conversation ids in a piece of an end list, as a power of two.
PIECE_BITS = 12

_KEY = ["depth", "x", "y"]
NOTHING = hashlib.sha256(b"").hexdigest()


def turns(rows: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(conv_id, place, a, b, bytes) of each turn, places from 0, and (conv_id, n) of each conversation."""
    whole = rows.where("conv_id is not null").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    hashes = whole.select("*", F.xxhash64("role", "text").alias("a"), F.xxhash64(F.lit("b"), "text", "role").alias("b"), F.octet_length("text").cast("long").alias("bytes"))
    # ranges go by the beginnings of roles and texts: a bounded part of each, in the same order as the whole
    ranges = [F.col("turn").asc_nulls_first(), F.substring("role", 1, 17), F.when(F.length("role") <= 16, F.substring("text", 1, 32))]
    placed, spans = ranked(hashes, "conv_id", ranges, [F.col("turn").asc_nulls_first(), "role", "text"], ["a", "b", "bytes"], scratch, "placed")
    out = placed.join(spans, ["conv_id", "part"]).select("conv_id", (F.col("before") + F.col("at") - F.col("lo")).alias("place"), "a", "b", "bytes")
    return scratch.save(out, "turns"), spans.groupBy("conv_id").agg(F.max("total").alias("n"))


def rebuilt(own: DataFrame, sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations that take their first turns from the first of their family, as the dealt query has them."""
    convs = sizes.select("conv_id", (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % MOST).alias("h"))
    first = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("there"))
    convs = convs.join(first, "base", "left").select("conv_id", "base", "h", F.least("h", F.coalesce("there", F.lit(0))).alias("taken"))
    heads = own.where((F.col("place") < MOST - 1) & (F.col("conv_id") % FAMILY == 0)).withColumnRenamed("conv_id", "base").join(convs, "base").where("place < taken").select("conv_id", "place", "a", "b", "bytes")
    tails = own.join(convs, "conv_id").where("place >= h").select("conv_id", (F.col("taken") + F.col("place") - F.col("h")).alias("place"), "a", "b", "bytes")
    return heads.unionByName(tails), convs.select("conv_id")


def _end_lists(ends: DataFrame) -> DataFrame:
    """(depth, x, y, ends): SHA-256 of each sequence's conv_ids, ascending and comma-joined."""
    pieces = ends.groupBy(*_KEY, F.shiftright("conv_id", PIECE_BITS).alias("piece")).agg(F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    dealt = pieces.repartition(*_KEY).sortWithinPartitions(*_KEY, "piece").select(*_KEY, "ids")
    schema = pa.schema([("depth", pa.int64()), ("x", pa.int64()), ("y", pa.int64()), ("ends", pa.string())])

    def run(batches):
        at, digest, out = None, None, []
        for batch in batches:
            for depth, x, y, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at == (depth, x, y):
                    digest.update(b"," + ids.encode())
                    continue
                if at is not None:
                    out.append((*at, digest.hexdigest()))
                at, digest = (depth, x, y), hashlib.sha256(ids.encode())
            if len(out) > 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                out = []
        if at is not None:
            out.append((*at, digest.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return dealt.mapInArrow(run, "depth long, x long, y long, ends string")


def collapse(rows: DataFrame, convs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Each conversation's sequence (depth, x, y), and each distinct one with its weight and its smallest conv_id ``seq``."""
    one = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("depth"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
    zero = F.lit(0).cast("long")
    whole = convs.join(one, "conv_id", "left").select("conv_id", *[F.coalesce(c, zero).alias(c) for c in _KEY])
    whole = scratch.save(whole, "whole")
    return whole, scratch.save(whole.groupBy(*_KEY).agg(F.min("conv_id").alias("seq"), F.count(F.lit(1)).alias("weight")), "sequences")


def trie(rows: DataFrame, convs: DataFrame, scratch: Scratch) -> DataFrame:
    """A row for each node.  ``rows``: turns (conv_id, place, a, b, bytes); ``convs``: all conv_ids, turnless ones too."""
    rows = rows.select("conv_id", "place", F.xxhash64("a", "place").alias("x"), F.xxhash64("b", "place").alias("y"), "bytes")
    rows = scratch.save(rows, "rebuilt")
    whole, sequences = collapse(rows, convs, scratch)

    own = rows.withColumnRenamed("conv_id", "seq").join(sequences.select("seq", "weight", F.col("depth").alias("length")), "seq")
    both = running(own, "seq", "place", {"px": ("xor", "x"), "py": ("xor", "y")})
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    deeper = both.select("seq", (F.col("place") + 1).alias("depth"), F.col("px").alias("x"), F.col("py").alias("y"), F.col("px").bitwiseXOR(F.col("x")).alias("up_x"), F.col("py").bitwiseXOR(F.col("y")).alias("up_y"), "bytes", "weight", "length")
    roots = sequences.select("seq", zero.alias("depth"), zero.alias("x"), zero.alias("y"), none.alias("up_x"), none.alias("up_y"), zero.alias("bytes"), "weight", F.col("depth").alias("length"))
    prefixes = scratch.save(deeper.unionByName(roots), "prefixes")

    proper = prefixes.where("depth < length").select(*_KEY).distinct()
    leaves = sequences.join(proper, _KEY, "left_anti").select("seq", "depth", zero.alias("saved"), F.lit(1).cast("long").alias("leaf"))
    nodes = prefixes.groupBy(*_KEY).agg(F.min("seq").alias("conv_id"), F.sum("weight").alias("n_convs"), F.max("bytes").alias("bytes"), F.max("up_x").alias("up_x"), F.max("up_y").alias("up_y"))
    nodes = scratch.save(nodes, "nodes")

    # what belongs to a sequence at a depth: the node whose smallest member it is, and its own end if that is a leaf
    belongs = nodes.select(F.col("conv_id").alias("seq"), "depth", ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"), zero.alias("leaf")).unionByName(leaves)
    belongs = belongs.groupBy("seq", "depth").agg(F.sum("saved").alias("saved"), F.sum("leaf").alias("leaf"))
    along = prefixes.select("seq", *_KEY).join(belongs, ["seq", "depth"], "left").fillna(0, ["saved", "leaf"])
    below = running(along, "seq", "depth", {"saved_tokens": ("sum", "saved"), "n_leaves": ("sum", "leaf")}, downwards=True)

    empty = {"conv_id": none, "n_convs": none, "up_x": none, "up_y": none, "n_children": zero, "n_leaves": zero, "saved_tokens": zero, "ends": F.lit(None).cast("string")}
    part = lambda df, **has: df.select(*_KEY, *[has.get(c, v).alias(c) for c, v in empty.items()])
    here = {c: F.col(c) for c in ("conv_id", "n_convs", "up_x", "up_y")}
    parents = nodes.where("depth > 0").select((F.col("depth") - 1).alias("depth"), F.col("up_x").alias("x"), F.col("up_y").alias("y"))
    parts = part(nodes, **here)
    for more in (part(parents, n_children=F.lit(1).cast("long")), part(below, n_leaves=F.col("n_leaves"), saved_tokens=F.col("saved_tokens")), part(_end_lists(whole), ends=F.col("ends"))):
        parts = parts.unionByName(more)
    sums = {"n_children", "n_leaves", "saved_tokens"}
    full = parts.groupBy(*_KEY).agg(*[(F.sum(c) if c in sums else F.max(c)).alias(c) for c in empty])
    up = nodes.select((F.col("depth") + 1).alias("depth"), F.col("x").alias("up_x"), F.col("y").alias("up_y"), F.col("conv_id").alias("parent_conv_id"))
    named = full.join(up, ["depth", "up_x", "up_y"], "left")
    return named.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends", F.lit(NOTHING)).alias("ends_sha256"))


def op12_sequence_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "trie")
    own, sizes = turns(table(spark, sf_dir, "conversations"), scratch)
    return trie(*rebuilt(own, sizes), scratch)


_STEP = "list_reduce(list_prepend(xor(c, x), [0, 0, 0, 0, 0, 0, 0, 0]), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)"
_CRC = f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda ch: ascii(ch)::BIGINT)), lambda c, x: {_STEP}), 4294967295)"

OP12_SQL = f"""
WITH own AS (SELECT conv_id, list([coalesce(role, ''), coalesce(text, '')] ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS turns FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
heads AS (SELECT o.conv_id, {_CRC.replace("conv_id", "o.conv_id")} % {MOST} AS h, o.turns, coalesce(b.turns, []) AS base FROM own AS o LEFT JOIN own AS b ON b.conv_id = o.conv_id - o.conv_id % {FAMILY}),
rebuilt AS (SELECT conv_id, list_concat(base[1:h], turns[h + 1:]) AS turns FROM heads),
prefixes AS (SELECT conv_id, unnest(range(len(turns) + 1)) AS depth, turns FROM rebuilt),
members AS (SELECT conv_id, depth, turns[1:depth] AS node, len(turns) = depth AS is_end FROM prefixes),
nodes AS (SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (is_end), '')) AS ends_sha256, CASE WHEN depth = 0 THEN 0 ELSE (count(*) - 1) * strlen(node[depth][2]) END AS saved FROM members GROUP BY node, depth),
children AS (SELECT node[1:depth - 1] AS node, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL),
marked AS (SELECT a.*, coalesce(c.n, 0) AS n_children FROM nodes AS a LEFT JOIN children AS c ON c.node = a.node),
above AS (SELECT node, saved, n_children = 0 AS leaf, unnest(range(depth + 1)) AS d FROM marked),
below AS (SELECT node[1:d] AS node, sum(saved) AS saved_tokens, count(*) FILTER (leaf) AS n_leaves FROM above GROUP BY ALL)
SELECT m.conv_id, m.depth, p.conv_id AS parent_conv_id, m.n_convs, m.n_children, CAST(b.n_leaves AS BIGINT) AS n_leaves, CAST(b.saved_tokens AS BIGINT) AS saved_tokens, m.ends_sha256
FROM marked AS m JOIN below AS b ON b.node = m.node LEFT JOIN nodes AS p ON m.depth > 0 AND p.node = m.node[1:m.depth - 1]
"""
