"""Near-duplicate documents by HyperMinHash.

Every document gets REGISTERS registers over its set of word shingles.  A register keeps the
smallest of one hash function's values in 16 bits: the count of its leading
zeros (6 bits) and the 10 bits after its first one (the mantissa).  Four registers side by
side are a band's key, so banding works on the compressed registers.  Two documents
with a common band are compared by the share of equal registers, corrected for
registers that agree by chance, and those that may be similar enough are
verified on their full shingle sets.

No bucket is capped and none emits all its pairs:

* documents with equal word sequences are one node from the start;
* in a bucket every member is compared with the smallest one, and links verified so far
  give components;
* in a bucket that still holds several components, members outside its largest one are
  compared, in blocks and on registers alone, with all members of other components, each pair in
  the first bucket that it shares; what comes out is not pairs but the members of a block that
  may have a link there, each once;
* these meet again in the same block, cut further where their texts are long, and pairs are
  verified.  Pairs inside a component, or inside what a block's links have joined, can't change the result.

A pair at the threshold misses all bands with probability below 1e-5 and fails the
estimate with one below 1e-4.

Defined results: a null or blank text has no shingles and links with nothing; a text with fewer
words than a shingle is one shingle; rows with one doc_id are one node; a row with a
null doc_id links with nothing and has null component_id and kept; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, connected_components, giving_back, slices, table, word_hashes

WORDS = 5
PERCENT = 75
REGISTERS = 128
ROWS_PER_BAND = 4
#: Standard deviations of the estimate that a pair at the threshold may fall short.
SLACK = 4.0
#: Members of one block of a bucket.
BLOCK = 512
#: Shingles of one side of a block of texts.
BLOCK_SHINGLES = 1 << 16

#: ASCII white space parts words.
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])

SKETCH = "doc_id long, n_shingles long, key binary, bands array<long>"


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, with A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_set(text: str | None, k: int = WORDS) -> set:
    words = words_of(text)
    if not words:
        return set()
    return set(zip(*(words[i:] for i in range(k)))) if len(words) >= k else {tuple(words)}


def multipliers(n: int = REGISTERS) -> np.ndarray:
    """Odd 64-bit constants, one hash function each."""
    return np.array([xxhash.xxh64_intdigest(f"register {i}".encode()) | 1 for i in range(n)], dtype=np.uint64)


def compress(smallest: np.ndarray) -> np.ndarray:
    """64-bit minima to 16 bits: leading zeros, then the mantissa after the first one."""
    high = (smallest >> np.uint64(11)).astype(np.float64)  # exact in 53 bits
    bits = np.frexp(high)[1].astype(np.int64)  # 0 for 0, else position of the first one
    zeros = np.minimum(53 - bits, 63).astype(np.uint64)
    mantissa = ((smallest << (zeros + np.uint64(1))) >> np.uint64(54)) & np.uint64(1023)
    return ((zeros << np.uint64(10)) | mantissa).astype(np.uint16)


def chance(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Probability that a register of two disjoint sets of n and m shingles agrees by chance."""
    i = np.arange(0, 54, dtype=np.float64)[:, None, None]
    j = np.arange(0, 1024, 64, dtype=np.float64)[None, :, None]  # the density is smooth: 16 cells of 64 mantissas
    low, width = 2.0 ** -(i + 1) * (1 + j / 1024), 2.0 ** -(i + 1) * 64 / 1024

    def cell(count):
        count = np.asarray(count, dtype=np.float64)[None, None, :]
        return np.exp(count * np.log1p(-low)) - np.exp(count * np.log1p(-np.minimum(low + width, 1 - 1e-16)))

    return (cell(n) * cell(m)).sum((0, 1)) / 64


@lru_cache(maxsize=4096)
def _chance_of_powers(n: int, m: int) -> float:
    return float(chance(np.array([2.0**n]), np.array([2.0**m]))[0])


def estimate(equal: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard similarity from the share of equal registers, without chance collisions."""
    n, m = (np.round(np.log2(np.maximum(x, 1))).astype(np.int64) for x in (n, m))
    kinds, at = np.unique(n * 64 + m, return_inverse=True)
    c = np.array([_chance_of_powers(*divmod(k, 64)) for k in kinds.tolist()], dtype=np.float64)[at]
    return (equal - c) / (1 - c)


def floor_estimate(percent: int = PERCENT, registers: int = REGISTERS) -> float:
    s = percent / 100
    return s - SLACK * (s * (1 - s) / registers) ** 0.5


def word_hashes_of(text: str | None) -> np.ndarray:
    return word_hashes((text or "").encode("utf-8", "surrogatepass").lower(), _SPACE)


def hash_shingles(words: np.ndarray, k: int = WORDS) -> np.ndarray:
    """Distinct 64-bit hashes of the shingles of a text, given its words' hashes."""
    if not len(words):
        return words
    n = max(1, len(words) - k + 1)
    s = np.full(n, np.uint64(min(len(words), k)))
    for i in range(min(k, len(words))):
        s = s * np.uint64(0x9E3779B97F4A7C15) + words[i : i + n]
        s ^= s >> np.uint64(29)
    s *= np.uint64(0xBF58476D1CE4E5B9)
    s ^= s >> np.uint64(32)
    return np.unique(s)


def sketches(docs: DataFrame, k: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, key of the word sequence, and registers packed four to a long (null without shingles)."""
    mult = multipliers()

    @giving_back
    def run(batches):
        for batch in (part for batch in batches for part in slices(batch, 1)):
            counts, keys, bands = [], [], []
            for text in batch.column(1).to_pylist():
                words = word_hashes_of(text)
                s = hash_shingles(words, k)
                counts.append(len(s))
                keys.append(xxhash.xxh3_128_digest(words))
                if not len(s):
                    bands.append(None)
                    continue
                low = np.full(len(mult), np.uint64(2**64 - 1))
                for b in range(0, len(s), 512):
                    np.minimum(low, (s[b : b + 512, None] * mult).min(0), out=low)
                bands.append(compress(low).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "key", "bands"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SKETCH)


def _registers(column: pa.Array) -> np.ndarray:
    """(rows, REGISTERS) of a column of packed registers."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.ascontiguousarray(column.flatten().to_numpy(zero_copy_only=False)).view(np.uint16).reshape(len(column), -1)


def likely(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose estimated similarity can be the threshold."""
    least = floor_estimate(percent)
    full = pairs
    for side in "ab":
        full = full.join(reps.select(F.col("rep").alias(side), F.col("n_shingles").alias(f"n_{side}"), F.col("bands").alias(f"r_{side}")), side)

    @giving_back
    def run(batches):
        for batch in batches:
            n, m = (batch.column(c).to_numpy() for c in ("n_a", "n_b"))
            equal = (_registers(batch.column("r_a")) == _registers(batch.column("r_b"))).mean(1)
            keep = pa.array((estimate(equal, n, m) >= least) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m)))
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])

    return full.select("a", "b", "n_a", "n_b", "r_a", "r_b").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, texts: DataFrame, scratch: Scratch, label: str, percent: int, k: int) -> DataFrame:
    """Of the pairs (a, b), those whose full shingle sets are similar enough."""
    pairs = scratch.save(pairs, f"{label}-pairs")
    both = pairs.join(texts.select(F.col("rep").alias("a"), F.col("text").alias("t_a")), "a")
    both = both.join(texts.select(F.col("rep").alias("b"), F.col("text").alias("t_b")), "b")

    @giving_back
    def run(batches):
        last, last_set = None, set()
        for batch in batches:
            a, b, t_a, t_b = (batch.column(c) for c in ("a", "b", "t_a", "t_b"))
            keep = []
            for i in range(batch.num_rows):
                if last != b[i].as_py():
                    last, last_set = b[i].as_py(), shingle_set(t_b[i].as_py(), k)
                keep.append(_similar(shingle_set(t_a[i].as_py(), k), last_set, percent))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep)], ["a", "b"])

    return scratch.save(both.select("a", "b", "t_a", "t_b").mapInArrow(run, "a long, b long"), f"{label}-links")


def _similar(one: set, other: set, percent: int) -> bool:
    inter = len(one & other)
    return 100 * inter >= percent * (len(one) + len(other) - inter)


def _groups(batches, keys: list[str]):
    """Tables of rows with equal keys, from batches sorted by them."""
    held: list = []
    for batch in batches:
        if not batch.num_rows:
            continue
        ident = np.stack([batch.column(c).to_numpy() for c in keys], 1)
        cuts = [0, *(np.flatnonzero((ident[1:] != ident[:-1]).any(1)) + 1).tolist(), len(ident)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if held and held[0][0] != tuple(ident[a]):
                yield pa.Table.from_batches([p for _, p in held])
                held = []
            held.append((tuple(ident[a]), batch.slice(a, b - a)))
    if held:
        yield pa.Table.from_batches([p for _, p in held])


def _in_blocks(rows: DataFrame, sizes: DataFrame, on: list[str], seed: int = 0) -> DataFrame:
    """Rows of groups, so that each odd row meets each other row in one block (i, j).

    ``sizes`` has odd_blocks and blocks for each group.  Blocks that are dealt out again need another ``seed``.
    """
    rows = rows.join(sizes, on)
    block = lambda n: F.pmod(F.xxhash64(F.lit(seed), "rep"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    odd = rows.where("odd = 1").select("*", block("odd_blocks").alias("i"), every("blocks").alias("j"))
    return odd.unionByName(rows.where("odd = 0").select("*", every("odd_blocks").alias("i"), block("blocks").alias("j")))


class _Block:
    """Registers and sizes of one block's rows, of which the odd ones ask the others."""

    def __init__(self, group: pa.Table, percent: int):
        self.percent, self.least, self.band = percent, floor_estimate(percent), group.column("band")[0].as_py()
        self.odd = group.column("odd").to_numpy() == 1
        self.rest = np.flatnonzero(~self.odd)
        self.rep, self.n = (group.column(c).to_numpy() for c in ("rep", "n_shingles"))
        self.comp = group.column("component").to_numpy().copy()
        self.inner = self.comp == group.column("main").to_numpy()
        self.reg = _registers(group.column("bands"))
        self.keys = self.reg.view(np.int64)

    def candidates(self, x: int) -> np.ndarray:
        """Rows of other components that may be linked with x, the likeliest first, if the block's band is the first that they share."""
        rest, n = self.rest, self.n
        # of two documents outside the largest component the larger asks
        ok = (self.comp[rest] != self.comp[x]) & (self.inner[rest] | (self.rep[rest] < self.rep[x]))
        ok &= 100 * np.minimum(n[rest], n[x]) >= self.percent * np.maximum(n[rest], n[x])
        at = rest[ok]
        at = at[(self.keys[at] == self.keys[x]).argmax(1) == self.band]
        guess = estimate((self.reg[at] == self.reg[x]).mean(1), n[at], np.full(len(at), n[x]))
        return at[np.argsort(-guess, kind="stable")][: int((guess >= self.least).sum())]


def _asked(members: DataFrame, nodes: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """(block, band, main, odd, rep): documents of a block of a bucket that can hold links between components.

    ``members``: band, key, rep of all buckets with two rows or more; ``nodes``: rep, component and registers of all documents.
    """
    rows = scratch.save(members.join(nodes.select("rep", "component"), "rep"), "rest-rows")
    sizes = rows.groupBy("band", "key", "component").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.groupBy("band", "key").agg(F.max(F.struct("n", F.col("component").alias("main"))).alias("top"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    sizes = scratch.save(sizes.select("band", "key", F.col("top.main").alias("main"), blocks(F.col("n")).alias("blocks"), blocks(F.col("n") - F.col("top.n")).alias("odd_blocks")), "rest-sizes")
    rows = rows.join(sizes.select("band", "key", "main"), ["band", "key"])
    rows = rows.withColumn("odd", F.lit(0)).union(rows.where("component <> main").withColumn("odd", F.lit(1)))
    keys = ["band", "key", "i", "j"]
    dealt = _in_blocks(rows.drop("main"), sizes, ["band", "key"]).join(nodes.select("rep", "n_shingles", "bands"), "rep")
    dealt = dealt.select(*keys, "odd", "rep", "component", "main", "n_shingles", "bands").repartition(*keys).sortWithinPartitions(*keys)

    @giving_back
    def run(batches):
        for group in _groups(batches, keys):
            block = _Block(group, percent)
            met = np.zeros(len(block.odd), dtype=bool)
            for x in np.flatnonzero(block.odd):
                at = block.candidates(x)
                met[at] = True
                met[x] = len(at) > 0
            yield from group.select([*keys, "main", "odd", "rep"]).filter(pa.array(met)).to_batches()

    found = dealt.mapInArrow(run, "band int, key long, i int, j int, main long, odd int, rep long")
    return scratch.save(found.select(F.xxhash64(*keys).alias("block"), "band", "main", "odd", "rep"), "asked")


def _settled(asked: DataFrame, nodes: DataFrame, texts: DataFrame, scratch: Scratch, percent: int, k: int) -> DataFrame:
    """Verified links (a, b) that join all components which the asked documents can join.

    They meet in parts of their block, of bounded text. There, pairs that the registers don't
    rule out are compared on all hashes of their shingles, and those that pass are confirmed
    on the shingles themselves, but for documents that links of the part have joined already.
    """
    rows = scratch.save(asked.join(nodes.select("rep", "n_shingles"), "rep"), "ask-rows")
    blocks = lambda side: F.ceil(F.sum(F.when(F.col("odd") == side, F.col("n_shingles"))) / BLOCK_SHINGLES).cast("int")
    sizes = scratch.save(rows.groupBy("block").agg(blocks(1).alias("odd_blocks"), blocks(0).alias("blocks")), "ask-sizes")
    keys = ["block", "i", "j"]
    dealt = _in_blocks(rows.drop("n_shingles"), sizes, ["block"], 1).join(nodes.select("rep", "component", "n_shingles", "bands"), "rep").join(texts, "rep")
    dealt = dealt.select(*keys, "band", "odd", "rep", "component", "main", "n_shingles", "bands", "text").repartition(*keys).sortWithinPartitions(*keys)

    @giving_back
    def run(batches):
        for group in _groups(batches, keys):
            block, text, links = _Block(group, percent), group.column("text"), []
            rep, comp = block.rep, block.comp
            hashes: dict[int, np.ndarray] = {}

            def of(i, hashes=hashes, text=text):
                if i not in hashes:
                    hashes[i] = hash_shingles(word_hashes_of(text[i].as_py()), k)
                return hashes[i]

            for x in np.flatnonzero(block.odd).tolist():
                for i in block.candidates(x).tolist():
                    if comp[i] == comp[x]:
                        continue
                    own, other = of(x), of(i)
                    inter = int((own[np.minimum(np.searchsorted(own, other), len(own) - 1)] == other).sum())
                    if 100 * inter >= percent * (len(own) + len(other) - inter) and _similar(shingle_set(text[x].as_py(), k), shingle_set(text[i].as_py(), k), percent):
                        links.append((int(rep[x]), int(rep[i])))
                        comp[comp == comp[i]] = comp[x]
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in zip(*links, strict=True)], ["a", "b"])

    return scratch.save(dealt.mapInArrow(run, "a long, b long"), "ask-links")


def near_duplicates(docs: DataFrame, scratch: Scratch, percent: int = PERCENT, k: int = WORDS, first: DataFrame | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text).

    The member of a bucket that others are compared with first is the one of the smallest doc_id: copies mostly come after what they
    were made of.  Where doc_ids have no such order, ``first`` (doc_id, order) gives one; the result is the same.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    sketch = scratch.save(sketches(docs, k), "sketch")
    classes = sketch.where("n_shingles > 0 and doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"))
    classes = scratch.save(classes, "classes")
    reps = classes.select("rep", "n_shingles", "bands")
    bands = reps.select("rep", F.posexplode("bands").alias("band", "key"))
    pivot = F.min("rep")
    if first is not None:
        order = first.groupBy(F.col("doc_id").alias("rep")).agg(F.min("order").alias("order"))
        bands = reps.join(order, "rep", "left").select("rep", "order", F.posexplode("bands").alias("band", "key"))
        pivot = F.min(F.struct(F.col("order").isNull(), "order", "rep"))["rep"]
    buckets = scratch.save(bands.groupBy("band", "key").agg(pivot.alias("pivot"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "buckets")
    members = scratch.save(bands.select("rep", "band", "key").join(buckets, ["band", "key"]), "members")
    # repeated rows once; a document that shares no bucket has no link
    near = members.select("rep").distinct()
    texts = docs.select(F.col("doc_id").alias("rep"), "text").join(near, "rep").groupBy("rep", F.xxhash64("text")).agg(F.first("text").alias("text"))
    texts = scratch.save(texts.select("rep", "text"), "texts")
    star = members.where("rep <> pivot").select(F.col("rep").alias("a"), F.col("pivot").alias("b")).distinct()
    links = verified(likely(star, reps, percent), texts, scratch, "star", percent, k)
    labels = scratch.save(connected_components(links.select(F.col("a").alias("src"), F.col("b").alias("dst")), scratch, "cc1"), "labels1")
    nodes = reps.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    nodes = scratch.save(nodes, "nodes")
    asked = _asked(members.select("band", "key", "rep"), nodes, scratch, percent)
    more = _settled(asked, nodes, texts, scratch, percent, k)
    # the first components as stars, joined by the links found since
    edges = labels.select(F.col("node").alias("src"), F.col("component").alias("dst")).union(more.select("a", "b"))
    labels = connected_components(edges, scratch, "cc2")
    final = classes.select("key", "rep").join(labels, F.col("rep") == F.col("node"), "left").select("key", F.coalesce("component", "rep").alias("root"))
    # several classes may share a doc_id: a document's component is the smallest of its rows'
    final = scratch.save(final, "final")
    out = sketch.select("doc_id", "n_shingles", "key").join(final, "key", "left")
    root = F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.least("root", "doc_id"))
    return out.select("doc_id", "n_shingles", root.alias("component_id"), (F.col("doc_id") == root).alias("kept"))


def op3_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), Scratch(spark, "op3"))


#: The same rows by plain SQL, for small tables.
OP3_SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT r, doc_id, md5(array_to_string(w[i:i + 4], ' ')) AS g
  FROM (SELECT r, doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT r, doc_id, count(*) AS n FROM s GROUP BY ALL),
p AS (SELECT a.r AS a, b.r AS b, count(*) AS inter FROM s a JOIN s b ON a.g = b.g AND a.r < b.r GROUP BY ALL),
l AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM p JOIN n x ON x.r = p.a JOIN n y ON y.r = p.b
  WHERE 100 * inter >= 75 * (x.n + y.n - inter) AND x.doc_id IS NOT NULL AND y.doc_id IS NOT NULL),
both_ways AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
reach(doc_id, other) AS (SELECT DISTINCT doc_id, doc_id FROM d UNION SELECT reach.doc_id, b FROM reach JOIN both_ways ON a = other),
c AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d LEFT JOIN n ON n.r = d.r LEFT JOIN c ON c.doc_id = d.doc_id
"""
