"""Near-duplicate vectors by collision counting over many one-dimensional projections.

Vectors are scaled to length 1 and turned by a random rotation, whose coordinates are the
projections.  Equal vectors are one class from the start.  Classes are dealt by range into bands of about BAND classes along
the direction of greatest variance (of a bounded sample); two bands meet only if a query-centred window as wide as the
threshold's chord reaches from one to the other.  Inside, classes are again sorted and cut into blocks, and two blocks meet only
if their boxes over all projections come as near as the chord: both tests are bounds, which lose nothing.

For two blocks, every projection of the one is sorted, and the window of a vector of the other is a stretch of that order,
found by two binary searches.  With a bit for each vector and the sets of the first k in order kept, a window is the
difference of two such sets, and collisions of all pairs are counted 64 at a time by adding up these words, bit by bit.
A pair at the threshold lies in a window with probability COVER, and the least count is
the one that such a pair reaches with probability RECALL.  Pairs that reach it are verified by their
cosine in double precision.  What leaves a pair of bands is, for each vector, the number of
its links and the root of a spanning forest, so groups of near copies give rows in
proportion to their size.

Which bands meet is a join of the bands' ends; nothing that grows with the vectors is sent to the driver or broadcast.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components link with
nothing, as do rows with a null vec_id; vectors of different lengths are never linked; equal vectors are
links of each other; rows that share a vec_id are vectors of their own; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache
from math import comb, erf

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, connected_components, smallest_reachable, table

COSINE = 0.9
PROJECTIONS = 48
#: Probability that a pair at the threshold falls into a window.
COVER = 0.9
#: Probability that such a pair reaches the least count.
RECALL = 1 - 1e-6
#: Vectors of a band where they have WIDTH components at most; of longer ones fewer, in proportion.
BAND = 8192
WIDTH = 64
BLOCK = 1024
SAMPLE = 20_000

NODES = "node long, vec_id long, n long, size int, at double, unit binary"


@lru_cache(maxsize=8)
def rotation(dim: int) -> np.ndarray:
    return np.linalg.qr(np.random.Generator(np.random.PCG64(dim)).standard_normal((dim, dim)))[0]


def window(dim: int, cosine: float = COSINE, cover: float = COVER) -> float:
    """Half-width that holds ``cover`` of the differences of a pair at the threshold."""
    chord = (2 - 2 * cosine) ** 0.5
    if dim < 8:  # few coordinates are far from normal: the bound itself
        return chord
    low, high = 0.0, 10.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if erf(mid / 2**0.5) < cover else (low, mid)
    return high * chord / dim**0.5


def least_count(m: int, cover: float = COVER, recall: float = RECALL) -> int:
    """Largest count that a pair at the threshold reaches with the recall."""
    tail = 0.0
    for k in range(m + 1):
        tail += comb(m, k) * cover**k * (1 - cover) ** (m - k)
        if tail > 1 - recall:
            return k
    return m


def prefixes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each column sorted, and for each column and k the set of the first k rows in its order, a bit for each row."""
    n, m = values.shape
    row = np.arange(n)
    single = np.zeros((n, -(-n // 64)), dtype=np.uint64)
    single[row, row >> 6] = np.uint64(1) << (row & 63).astype(np.uint64)
    order = np.argsort(values, axis=0, kind="stable")
    sets = np.zeros((m, n + 1, single.shape[1]), dtype=np.uint64)
    for p in range(m):
        np.bitwise_or.accumulate(single[order[:, p]], axis=0, out=sets[p, 1:])
    return np.take_along_axis(values, order, 0), sets


def collisions(queries: np.ndarray, ordered: np.ndarray, sets: np.ndarray, half: float, need: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, row) that collide in ``need`` columns at least."""
    m = queries.shape[1]
    digits = [np.zeros((len(queries), sets.shape[2]), dtype=np.uint64) for _ in range(m.bit_length())]
    for p in range(m):
        low = np.searchsorted(ordered[:, p], queries[:, p] - half, "left")
        high = np.searchsorted(ordered[:, p], queries[:, p] + half, "right")
        carry = sets[p][high] ^ sets[p][low]
        for digit in digits[: (p + 1).bit_length()]:
            over = digit & carry
            digit ^= carry
            carry = over
    # counts of at least need, from the highest digit down
    above, level = np.zeros_like(digits[0]), ~np.zeros_like(digits[0])
    for i in reversed(range(len(digits))):
        if need >> i & 1:
            level &= digits[i]
        else:
            above |= level & digits[i]
            level &= ~digits[i]
    hits = np.unpackbits((above | level).view(np.uint8), axis=1, bitorder="little", count=len(ordered))
    return np.nonzero(hits)


def compare(left: np.ndarray, right: np.ndarray | None, weight_left: np.ndarray, weight_right: np.ndarray | None, cosine: float = COSINE):
    """Links between two bands of unit vectors, or within one.

    Returns the weight of each vector's links (left, right) and the root of each in a
    spanning forest over both, left before right.
    """
    same = right is None
    if same:
        right, weight_right = left, weight_left
    dim = left.shape[1]
    m, turn = min(PROJECTIONS, dim), rotation(dim)
    half, chord2 = window(dim, cosine), 2 - 2 * cosine + 1e-9
    need = least_count(m) if dim >= 8 else m
    turned = [left @ turn, right @ turn]
    order = [np.argsort(t[:, 0], kind="stable") for t in turned]
    links = [np.zeros(len(left), dtype=np.int64), np.zeros(len(right), dtype=np.int64)]
    shift = 0 if same else len(left)
    root = np.arange(len(left) + (0 if same else len(right)))
    blocks = [[o[i : i + BLOCK] for i in range(0, len(o), BLOCK)] for o in order]
    boxes = [[(t[b].min(0), t[b].max(0)) for b in bs] for t, bs in zip(turned, blocks, strict=True)]
    for j, other in enumerate(blocks[1]):
        kept = None
        for i, one in enumerate(blocks[0][: j + 1] if same else blocks[0]):
            gap = np.maximum(0, np.maximum(boxes[0][i][0] - boxes[1][j][1], boxes[1][j][0] - boxes[0][i][1]))
            if gap @ gap > chord2:
                continue
            kept = kept or prefixes(turned[1][other, :m])
            a, b = collisions(turned[0][one, :m], *kept, half + 1e-12, need)
            a, b = one[a], other[b]
            if same and i == j:  # each pair once
                once = a < b
                a, b = a[once], b[once]
            keep = np.concatenate([(np.einsum("ij,ij->i", left[a[s : s + 200_000]], right[b[s : s + 200_000]]) >= cosine) for s in range(0, len(a), 200_000)]) if len(a) else np.zeros(0, bool)
            a, b = a[keep], b[keep]
            if not len(a):
                continue
            np.add.at(links[0], a, weight_right[b])
            np.add.at(links[0] if same else links[1], b, weight_left[a])
            # the forest so far and the new links
            seen = np.flatnonzero(root != np.arange(len(root)))
            root = smallest_reachable(np.concatenate([seen, a]), np.concatenate([root[seen], b + shift]), len(root))
    return links, root


def meeting(parts: DataFrame, chord: float) -> DataFrame:
    """Pairs of parts (size, band, part, least, most) that a chord may join, each once and each with itself.

    Parts are compared where they or their neighbourhoods share a cell of a grid as wide as the chord.
    """
    cell = lambda c: F.floor(F.col(c) / chord).cast("int")
    spread = lambda low, high: F.explode(F.sequence(low, high)).alias("cell")
    one = parts.select("size", F.struct("band", "part").alias("one"), F.col("least").alias("least_1"), F.col("most").alias("most_1"), spread(cell("least"), cell("most")))
    other = parts.select("size", F.struct("band", "part").alias("other"), "least", "most", spread(cell("least") - 1, cell("most") + 1))
    near = (F.col("one") <= F.col("other")) & (F.col("least") - F.col("most_1") <= chord) & (F.col("least_1") - F.col("most") <= chord)
    return one.join(other, ["size", "cell"]).where(near).select("size", "one", "other").distinct()


def near_vectors(vectors: DataFrame, scratch: Scratch, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``vectors`` (vec_id, embedding)."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    good = F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", finite) & F.exists("embedding", lambda x: x != 0)
    rows = rows.withColumn("embedding", F.when(F.coalesce(good, F.lit(False)), F.col("embedding")))
    classes = rows.where("embedding is not null").groupBy("embedding").agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("n"))
    classes = scratch.save(classes.withColumn("node", F.monotonically_increasing_id()), "classes")

    # the direction of greatest variance in a sample, for each length
    sample = classes.select(F.size("embedding").alias("size"), "embedding").orderBy(F.xxhash64("embedding")).limit(SAMPLE).toPandas()
    lead: dict[int, np.ndarray] = {}
    for size, group in sample.groupby("size"):
        x = np.stack(group["embedding"].to_numpy())
        x = x / np.linalg.norm(x / np.abs(x).max(1, keepdims=True), axis=1, keepdims=True) / np.abs(x).max(1, keepdims=True)
        x = x - x.mean(0)
        lead[int(size)] = np.linalg.eigh(x.T @ x)[1][:, -1]
    sent = spark.sparkContext.broadcast(lead)

    def unit(batches):
        for batch in batches:
            out = [[] for _ in range(6)]
            for node, vec_id, n, x in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                x = np.array(x)
                x = x / np.abs(x).max()  # lengths neither overflow nor vanish
                x = x / np.linalg.norm(x)
                along = sent.value.get(len(x))
                for column, value in zip(out, (node, vec_id, n, len(x), 0.0 if along is None else float(x @ along), x.tobytes()), strict=True):
                    column.append(value)
            kinds = [pa.int64()] * 3 + [pa.int32(), pa.float64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], ["node", "vec_id", "n", "size", "at", "unit"])

    units = scratch.save(classes.select("node", "vec_id", "n", "embedding").mapInArrow(unit, NODES), "units")

    # bands along that direction, by range; a band of many classes is cut again by hash
    most = lambda size: F.greatest(F.lit(1), F.floor(F.lit(BAND * WIDTH) / F.greatest(size, F.lit(WIDTH)))).cast("int")
    wanted = units.select((1 / most(F.col("size"))).alias("share")).agg(F.sum("share").alias("n")).first()["n"]
    dealt = units.repartitionByRange(max(1, int(wanted or 0)), "size", "at").withColumn("slice", F.spark_partition_id())
    dealt = scratch.save(dealt, "dealt")
    # neighbouring slices, however many the range gave, make up a band
    found = dealt.groupBy("size", "slice").agg(F.count(F.lit(1)).alias("in_slice"), F.min("at").alias("least"), F.max("at").alias("most"))
    before = F.sum("in_slice").over(Window.partitionBy("size").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
    found = scratch.save(found.withColumn("band", F.floor(F.coalesce(before, F.lit(0)) / most(F.col("size"))).cast("int")), "slices")
    sizes = found.groupBy("size", "band").agg(F.sum("in_slice").alias("in_band"), F.min("least").alias("least"), F.max("most").alias("most"))
    sizes = scratch.save(sizes.withColumn("parts", F.ceil(F.col("in_band") / (2 * most(F.col("size")))).cast("int")), "sizes")
    banded = dealt.join(found.select("size", "slice", "band"), ["size", "slice"])
    parts = sizes.select("size", "band", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "least", "most")
    pairs = scratch.save(meeting(parts, (2 - 2 * cosine) ** 0.5 + 1e-9), "pairs")
    banded = banded.join(sizes.select("size", "band", "parts"), ["size", "band"]).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    sides = [pairs.select("size", F.col(f"{s}.band").alias("band"), F.col(f"{s}.part").alias("part"), "one", "other", F.lit(i).alias("side")) for i, s in enumerate(("one", "other"))]
    sides = sides[0].unionByName(sides[1].where("one <> other"))
    dealt = banded.join(sides, ["size", "band", "part"]).select("one", "other", "side", "node", "n", "size", "unit")

    def links_of(table_: pa.Table) -> pa.Table:
        side, node, n = (table_.column(c).to_numpy() for c in ("side", "node", "n"))
        dim = table_.column("size")[0].as_py() if len(table_) else 1
        x = np.frombuffer(b"".join(table_.column("unit").to_pylist()), np.float64).reshape(-1, dim)
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        ids = np.concatenate([node[a], node[b]])
        links, root = compare(x[a], x[b] if len(b) else None, n[a], n[b] if len(b) else None, cosine)
        links = np.concatenate([links[0], links[1]]) if len(b) else links[0]
        at = np.flatnonzero(links)
        return pa.table({"node": pa.array(ids[at], pa.int64()), "root": pa.array(ids[root[at]], pa.int64()), "links": pa.array(links[at], pa.int64())})

    found = scratch.save(dealt.groupBy("size", "one", "other").applyInArrow(links_of, "node long, root long, links long"), "links")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    labels = connected_components(found.select(F.col("node").alias("src"), F.col("root").alias("dst")), scratch)
    named = units.select("node", "vec_id", "n").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = named.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    smallest = scratch.save(smallest, "smallest")
    results = scratch.save(named.join(counts, "node", "left").select("node", "component", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")).join(smallest, "component").select("node", "n_links", "component_id"), "results")
    results = scratch.save(classes.select("embedding", "node").join(results, "node").drop("node"), "by_vector")
    out = rows.join(results, "embedding", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))


def op8_collision_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"), Scratch(spark, "op8"))


#: The same rows by plain SQL, for small tables.
OP8_SQL = """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
g AS (
  SELECT r, vec_id, e, sqrt(list_inner_product(e, e)) AS n FROM v
  WHERE vec_id IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NOT NULL AND isfinite(x))) = len(e) AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.r AS a, b.r AS b FROM g a JOIN g b ON a.r <> b.r AND len(a.e) = len(b.e) WHERE list_inner_product(a.e, b.e) / (a.n * b.n) >= 0.9),
reach(r, other) AS (SELECT r, r FROM v UNION SELECT reach.r, b FROM reach JOIN l ON a = other),
c AS (SELECT reach.r, min(vec_id) AS component_id FROM reach JOIN v ON v.r = other GROUP BY 1),
m AS (SELECT a AS r, count(*) AS n FROM l GROUP BY 1)
SELECT vec_id, CAST(coalesce(m.n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM v LEFT JOIN m ON m.r = v.r LEFT JOIN c ON c.r = v.r
"""
