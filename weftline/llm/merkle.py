"""A Merkle manifest of documents, and a proof for every document by descent from the root.

A document's leaf is the SHA-256 of its fields.  The leaves of a language, by doc_id, become a binary tree, whose root is
the language's subroot; the subroots, by language, become a second tree.  Digests are joined as hex text.

Trees are kept as records of content: a record's address is the digest of a node, its children are the digests
``bits`` levels further down (fewer at a tree's foot or top), from which the levels between follow.  So a
tree of n leaves is n / 2**bits records and a record is small, whatever n is.  Records of equal content at different places
are kept apart by the place of their node in its level, so that a long run of equal documents spreads over tasks.

A proof is found downwards: requests start at the root with an empty path, are joined to the records by digest, and
the digits of a leaf's rank choose a child at each level; the child not chosen goes to the path.  Requests that have
the path so far in common are one request, named after the node they have come to, and part only where
their paths do, so N leaves are N / 2**bits requests in the lowest join.  At the leaf the path is reversed,
and folded with the leaf into a root.

Defined results: a null lang is a language of its own, which comes first; null doc_ids come first in their language, and
leaves of equal doc_id go by digest; repeated rows are leaves of their own; a null field counts as ``-``; an empty table
gives no rows; other columns are ignored.  A document whose doc_id is null is never tampered with.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table
from .scans import ranked

#: Levels of a tree that one record spans.
BITS = 10
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]

_RECORD = "key string, block long, total long, digest binary, children binary, ids array<long>, others array<binary>"
_REQUEST = "key string, block long, digest binary, path binary, subroot binary, root binary"
_PROOF = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"

#: What a step of a path says of the sibling: there is none, it is the left one, it is the right one.
NONE, LEFT, RIGHT = 0, 1, 2
STEP = 33


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(fields: dict[str, Column]) -> Column:
    """A document's digest, as bytes."""
    return F.unhex(F.sha2(F.concat(*[_field(fields[c]) for c in FIELDS]).cast("binary"), 256))


def H(*parts: bytes) -> bytes:
    """SHA-256 of digests joined as hex text."""
    return hashlib.sha256("".join(p.hex() for p in parts).encode()).digest()


def heights(digests: list[bytes], bits: int | None) -> list[list[bytes]]:
    """The levels above a run of nodes, itself first: ``bits`` of them, or up to a single node."""
    out = [digests]
    while len(out) <= bits if bits is not None else len(out[-1]) > 1:
        last = out[-1]
        out.append([H(*last[i : i + 2]) for i in range(0, len(last), 2)])
    return out


def _levels(children: bytes, total: int, bits: int) -> list[list[bytes]]:
    """Of a record; the one record of a level is the top, where a tree ends."""
    return heights([children[i : i + 32] for i in range(0, len(children), 32)], None if total <= 1 << bits else bits)


def _down(levels: list[list[bytes]], i: int) -> bytes:
    """The steps from a record's node to its child i, top first: at each level what was not selected."""
    path = bytearray()
    for h in range(len(levels) - 2, -1, -1):
        at = i >> h
        other = at ^ 1
        path += bytes([NONE]) + bytes(32) if other >= len(levels[h]) else bytes([LEFT if at & 1 else RIGHT]) + levels[h][other]
    return bytes(path)


def _records(bits: int):
    """Rows in order of (key, block, rank) to one record a block."""

    def build(batches):
        out: list[tuple] = []
        at, held = None, []

        def put():
            key, block, total = at
            children = b"".join(d for d, _, _ in held)
            digest = _levels(children, total, bits)[-1][0]
            out.append((key, block, total, digest, children, [i for _, i, _ in held], [o for _, _, o in held]))

        for batch in batches:
            for key, block, total, digest, doc_id, other in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != (key, block, total):
                    if held:
                        put()
                    at, held = (key, block, total), []
                held.append((digest, doc_id, other))
            if len(out) >= 32:
                yield _batch(out, _RECORD_ARROW)
                out = []
        if held:
            put()
        if out:
            yield _batch(out, _RECORD_ARROW)

    return build


_RECORD_ARROW = pa.schema([("key", pa.string()), ("block", pa.int64()), ("total", pa.int64()), ("digest", pa.binary()), ("children", pa.binary()), ("ids", pa.list_(pa.int64())), ("others", pa.list_(pa.binary()))])
_REQUEST_ARROW = pa.schema([("key", pa.string()), ("block", pa.int64()), ("digest", pa.binary()), ("path", pa.binary()), ("subroot", pa.binary()), ("root", pa.binary())])
_PROOF_ARROW = pa.schema([(c, pa.string()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")] + [("verified", pa.bool_())])
_PROOF_ARROW = pa.schema([("doc_id", pa.int64()), *_PROOF_ARROW])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _rows(batches):
    """One at a time, since a record is tens of kilobytes."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def forest(leaves: DataFrame, spans: DataFrame, scratch: Scratch, label: str, bits: int = BITS) -> list[DataFrame]:
    """Records of a tree for each key, by level from the foot.

    ``leaves`` and ``spans`` are as ``ranked`` gives them, with columns digest, doc_id and other.
    """
    span = spans.select(F.col("key").alias("_key"), F.col("part").alias("_part"), "lo", "before", "total")
    rows = leaves.join(span, F.col("key").eqNullSafe(F.col("_key")) & (F.col("part") == F.col("_part")))
    rank = F.col("before") + F.col("at") - F.col("lo")
    nodes = rows.select("key", rank.alias("rank"), "total", "digest", "doc_id", "other")
    most = spans.agg(F.max("total")).first()[0] or 0
    levels: list[DataFrame] = []
    while most:
        blocks = nodes.withColumn("block", F.shiftright("rank", bits)).repartition("key", "block").sortWithinPartitions("key", "block", "rank")
        made = blocks.select("key", "block", "total", "digest", "doc_id", "other").mapInArrow(_records(bits), _RECORD)
        levels.append(scratch.save(made, f"{label}-{len(levels)}"))
        if most <= 1 << bits:
            break
        most = -(-most >> bits)
        higher = F.shiftright(F.col("total") + F.lit((1 << bits) - 1), bits)
        nodes = levels[-1].where(F.col("total") > 1 << bits).select("key", F.col("block").alias("rank"), higher.alias("total"), "digest", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("binary").alias("other"))
    return levels


def tops(levels: list[DataFrame], bits: int = BITS) -> DataFrame:
    """(key, digest) of every tree's root."""
    out = levels[0].where(F.col("total") <= 1 << bits).select("key", "digest")
    for level in levels[1:]:
        out = out.unionByName(level.where(F.col("total") <= 1 << bits).select("key", "digest"))
    return out


def descend(levels: list[DataFrame], starts: DataFrame, last, schema: str, scratch: Scratch, label: str, bits: int = BITS) -> DataFrame:
    """Requests from the roots of trees down to their feet; ``last`` makes rows of the lowest joins.

    ``starts`` has a request for each tree's root.  It meets the level at whose top the tree ends, since only there
    a record has its digest.
    """
    requests = starts
    for depth in range(len(levels) - 1, -1, -1):
        records = levels[depth].drop("key")
        wanted = requests if depth == len(levels) - 1 else requests.unionByName(starts)
        met = wanted.join(records, ["digest", "block"])
        if not depth:
            return met.select("key", "block", "total", "children", "ids", "others", "path", "subroot", "root").mapInArrow(last, schema)
        below = met.select("key", "block", "total", "children", "path", "subroot", "root").mapInArrow(_children(bits), _REQUEST)
        requests = scratch.save(below, f"{label}-{depth}")
    raise AssertionError("a forest has a level")


def _children(bits: int):
    def run(batches):
        for row in _rows(batches):
            levels = _levels(row["children"], row["total"], bits)
            yield _batch([(row["key"], (row["block"] << bits) + i, d, row["path"] + _down(levels, i), row["subroot"], row["root"]) for i, d in enumerate(levels[0])], _REQUEST_ARROW)

    return run


def _subroots(bits: int):
    """At the foot of the tree of languages: a request for each language's tree.  Ids are places, so names come by join."""

    def run(batches):
        for row in _rows(batches):
            levels = _levels(row["children"], row["total"], bits)
            yield _batch([(None, 0, d, row["path"] + _down(levels, i), d, row["root"]) for i, d in enumerate(levels[0])], _REQUEST_ARROW)

    return run


def fold(digest: bytes, path: bytes) -> tuple[bytes, list[bytes]]:
    """The root that a leaf and a path, top first, lead to, and the siblings from the leaf upwards."""
    siblings = []
    for at in range(len(path) - STEP, -1, -STEP):  # reversed: leaf first
        side, other = path[at], path[at + 1 : at + STEP]
        if side == NONE:
            digest = H(digest)
            continue
        siblings.append(other)
        digest = H(other, digest) if side == LEFT else H(digest, other)
    return digest, siblings


def _proofs(bits: int):
    def run(batches):
        for row in _rows(batches):
            levels, out = _levels(row["children"], row["total"], bits), []
            root, subroot = row["root"], row["subroot"].hex()
            for i, (digest, doc_id, other) in enumerate(zip(levels[0], row["ids"], row["others"], strict=True)):
                folded, siblings = fold(other or digest, row["path"] + _down(levels, i))
                out.append((doc_id, digest.hex(), subroot, root.hex(), H(*siblings).hex(), folded.hex(), folded == root))
            yield _batch(out, _PROOF_ARROW)

    return run


@dataclass
class Manifest:
    """The records of both trees; ``languages`` has the subroots of ``documents`` as its leaves."""

    documents: list[DataFrame]
    languages: list[DataFrame]
    scratch: Scratch
    bits: int

    def root(self) -> DataFrame:
        return tops(self.languages, self.bits).select("digest")

    def proofs(self) -> DataFrame:
        """A row for each document: its path folded with ``other`` where that is set, else with its leaf."""
        start = self.root().select(F.lit(None).cast("string").alias("key"), F.lit(0).cast("long").alias("block"), "digest", F.lit(b"").alias("path"), F.lit(None).cast("binary").alias("subroot"), F.col("digest").alias("root"))
        starts = self.scratch.save(descend(self.languages, start, _subroots(self.bits), _REQUEST, self.scratch, "to-language", self.bits), "starts")
        return descend(self.documents, starts, _proofs(self.bits), _PROOF, self.scratch, "to-leaf", self.bits)


def build(leaves: DataFrame, scratch: Scratch, bits: int = BITS) -> Manifest | None:
    """``leaves``: doc_id, lang, leaf and ``other``, a digest to be tried in place of the leaf or null.  None without rows."""
    nodes = leaves.select(F.col("lang").alias("key"), "doc_id", F.col("leaf").alias("digest"), "other", F.rand(7).alias("tie"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("digest"), F.col("tie")]
    rows, spans = ranked(nodes, "key", order, order, ["doc_id", "digest", "other"], scratch, "ranked")
    documents = forest(rows, spans, scratch, "documents", bits)
    if not documents:
        return None
    # the one key of the second tree is null; a language's place goes by its name, null first
    roots = tops(documents, bits).select(F.col("key").alias("lang"), "digest", F.lit(None).cast("string").alias("key"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("binary").alias("other"))
    by_name = [F.col("lang").asc_nulls_first()]
    rows, spans = ranked(roots, "key", by_name, by_name, ["digest", "doc_id", "other"], scratch, "subroots")
    return Manifest(documents, forest(rows, spans, scratch, "languages", bits), scratch, bits)


def op13_merkle_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "source", "lang", F.col("n_chars").cast("long"), "text")
    fields = {c: F.col(c) for c in FIELDS}
    tampered = leaf(fields | {"n_chars": F.col("n_chars").cast("decimal(20,0)") + 1})
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    scratch = Scratch(spark, "merkle")
    leaves = docs.select("doc_id", "lang", leaf(fields).alias("leaf"), F.when(chosen, tampered).alias("other"))
    manifest = build(scratch.save(leaves, "leaves"), scratch)
    return manifest.proofs() if manifest else spark.createDataFrame([], _PROOF)


def _crc32_sql(text: str) -> str:
    """Unsigned CRC-32 of an ASCII string: its reversed polynomial a bit at a time."""
    step = "list_reduce(list_prepend(xor(c, x), [0, 0, 0, 0, 0, 0, 0, 0]), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda ch: ascii(ch)::BIGINT)), lambda c, x: {step}), 4294967295)"


def _field_sql(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR) END"


def _tree_sql(name: str, source: str, key: str, depth: int) -> str:
    """Levels name_0 .. name_depth of (key, pos, h, n) over source (key, pos, h, n); a tree that is one node stays so."""
    out = [f"{name}_0 AS (SELECT * FROM {source})"]
    for d in range(depth):
        grown = "CASE WHEN count(*) > 1 OR any_value(n) > 1 THEN sha256(string_agg(h, '' ORDER BY pos)) ELSE any_value(h) END"
        out.append(f"{name}_{d + 1} AS (SELECT {key}, pos // 2 AS pos, {grown} AS h, (any_value(n) + 1) // 2 AS n FROM {name}_{d} GROUP BY {key}, pos // 2)")
    return ",\n".join(out)


def _paths_sql(name: str, source: str, key: str, depth: int) -> str:
    """Siblings and folded digests of source (key, pos, folded, siblings) up the tree, as name_p0 .. name_p<depth>."""
    out = [f"{name}_p0 AS (SELECT * FROM {source})"]
    for d in range(depth):
        joined = f"{name}_p{d} AS p LEFT JOIN {name}_{d} AS s ON s.{key} IS NOT DISTINCT FROM p.{key} AND s.pos = xor(p.pos, 1) JOIN {name}_{d} AS o ON o.{key} IS NOT DISTINCT FROM p.{key} AND o.pos = p.pos"
        up = "CASE WHEN o.n = 1 THEN p.folded WHEN s.h IS NULL THEN sha256(p.folded) WHEN p.pos % 2 = 1 THEN sha256(s.h || p.folded) ELSE sha256(p.folded || s.h) END"
        out.append(f"{name}_p{d + 1} AS (SELECT p.* REPLACE (p.pos // 2 AS pos, {up} AS folded, p.siblings || CASE WHEN o.n = 1 THEN '' ELSE coalesce(s.h, '') END AS siblings) FROM {joined})")
    return ",\n".join(out)


#: Levels that the SQL has: languages of up to 2**DEPTH documents, up to 2**LANGUAGES languages.
DEPTH, LANGUAGES = 17, 5
_FIELDS_SQL = " || ".join(_field_sql(c) for c in FIELDS)
_TAMPERED_SQL = " || ".join(_field_sql("n_chars + 1" if c == "n_chars" else c) for c in FIELDS)

OP13_SQL = f"""
WITH leaves AS (SELECT doc_id, lang, sha256({_FIELDS_SQL}) AS h, CASE WHEN {_crc32_sql("CAST(doc_id AS VARCHAR)")} % 7 = 0 THEN sha256({_TAMPERED_SQL}) END AS other FROM documents),
placed AS (SELECT doc_id, lang, h, other, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, h) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM leaves),
foot AS (SELECT lang, pos, h, n FROM placed),
{_tree_sql("tree", "foot", "lang", DEPTH)},
tops AS (SELECT 0 AS k, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS pos, h, count(*) OVER () AS n, lang FROM tree_{DEPTH}),
heads AS (SELECT k, pos, h, n FROM tops),
{_tree_sql("high", "heads", "k", LANGUAGES)},
starts AS (SELECT lang, pos, coalesce(other, h) AS folded, '' AS siblings, doc_id, h AS leaf FROM placed),
{_paths_sql("tree", "starts", "lang", DEPTH)},
middle AS (SELECT t.k, t.pos, p.folded, p.siblings, p.doc_id, p.leaf, t.h AS subroot FROM tree_p{DEPTH} AS p JOIN tops AS t ON t.lang IS NOT DISTINCT FROM p.lang),
{_paths_sql("high", "middle", "k", LANGUAGES)}
SELECT p.doc_id, p.leaf, p.subroot, r.h AS root, sha256(p.siblings) AS proof_sha256, p.folded AS folded_root, p.folded = r.h AS verified
FROM high_p{LANGUAGES} AS p JOIN high_{LANGUAGES} AS r ON r.k = p.k
"""
