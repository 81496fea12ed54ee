"""Helpers shared by the training-data operators: reading, scratch tables, graph components."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Edges that one task turns into components by itself; more go through distributed rounds.
TASK_EDGES = 1_000_000

#: Bytes that are hashed at once.  A worker needs some hundred times as many; results don't depend on it.
CHUNK = 1 << 18

_local_folder: str | None = None
_scratches: list["Scratch"] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, read by Spark alone so that any file system works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only where that is unset and all runs on one machine."""
    global _local_folder
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.partition("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    if _local_folder is None:
        _local_folder = tempfile.mkdtemp(prefix="weftline-")
    return f"file://{_local_folder}"


@lru_cache(maxsize=2)
def hash_tables(family: int = 0, n: int = CHUNK + 1024):
    """A random value for each byte, and powers of an odd base and of its inverse."""
    rng = np.random.Generator(np.random.PCG64(20240229 + family))
    values = rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    base = int(rng.integers(1, 2**62)) * 2 + 1
    inverse = pow(base, -1, 2**64)
    power = lambda b: np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, np.uint64(b))]).astype(np.uint64))
    return values, power(base), power(inverse)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def prefix_hashes(data: np.ndarray, family: int = 0) -> np.ndarray:
    """Running sums p of bytes, CHUNK and a little more at most, such that (p[b] - p[a]) * inverse[a] tells data[a:b] apart."""
    values, power, _ = hash_tables(family)
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(values[data] * power[: len(data)], out=out[1:])
    return out


def word_hashes(text: bytes, space: np.ndarray) -> np.ndarray:
    """64-bit hashes of a text's words in order; ``space`` tells for each byte whether it parts words."""
    data, at, out = np.frombuffer(text, np.uint8), 0, []
    while at < len(data):
        part = data[at : at + CHUNK]
        if len(part) == CHUNK:
            ends = np.flatnonzero(space[part])
            if not len(ends):  # a word that is longer than what is hashed at once
                end = at + CHUNK
                while end < len(data) and not space[data[end : end + CHUNK]].any():
                    end += CHUNK
                end = min(len(data), end + int(np.argmax(space[data[end : end + CHUNK]])) if end < len(data) else end)
                out.append(np.array([xxhash.xxh3_64_intdigest(text[at:end])], dtype=np.uint64))
                at = end
                continue
            part = part[: int(ends[-1]) + 1]  # up to the end of a word
        at += len(part)
        inside = np.zeros(len(part) + 2, dtype=np.int8)
        inside[1:-1] = ~space[part]
        edge = np.flatnonzero(np.diff(inside))
        a, b = edge[::2], edge[1::2]
        sums = prefix_hashes(part)
        out.append(mix((sums[b] - sums[a]) * hash_tables()[2][a]))
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)


def slices(batch: pa.RecordBatch, column: str | int, limit: int = 1 << 22):
    """Parts of a batch whose texts in ``column`` have ``limit`` bytes together at most, or one row.

    Workers then hold a few megabytes of Python objects at a time, however large the batch.
    """
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    at = 0
    total = np.cumsum(sizes)
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(total, limit + (total[at - 1] if at else 0), "right")))
        yield batch.slice(at, end - at)
        at = end


def give_back() -> None:
    """Free memory that Arrow's pool and the C library keep goes back to the system, where they can do so."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def giving_back(run):
    """A function for mapInArrow after which the worker keeps no free memory: Spark holds workers for later tasks, up to several for each core."""

    def through(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return through


class Scratch:
    """Tables written to the shared folder, which cut lineage and outlive lost executors.

    Parquet rather than ``checkpoint()``: compressed, column-pruned on the next
    read, and with sizes from which the planner can choose a join.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
        _scratches.append(self)

    def save(self, df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").option("compression", codec).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def drop(self, *names: str) -> None:
        """Delete tables nothing will read again; all of them without names."""
        sc = self.spark.sparkContext
        for name in names or ("",):
            target = sc._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))
            target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _forget() -> None:
    for scratch in _scratches:
        try:
            if scratch.spark.sparkContext._jsc is not None:
                scratch.drop()
        except Exception:  # the session has gone, and its folder with it
            pass


def connected_components(edges: DataFrame, scratch: Scratch, label: str = "cc") -> DataFrame:
    """(node, component): the smallest node reachable, for every node that has an edge.

    ``edges`` has long columns ``src`` and ``dst``.  Up to TASK_EDGES edges are a few megabytes, which
    one executor task turns into components.  Beyond that, alternates the large-star and
    small-star steps until the edge set stops changing.  Both steps are a
    map-side-combined minimum by node joined back to the edges, so a hub's
    edges are never gathered in one place; adaptive execution splits a hub's partition.
    """
    now = edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()
    now = scratch.save(now, f"{label}-0")
    if now.count() <= TASK_EDGES:
        return scratch.save(now.coalesce(1).mapInArrow(giving_back(_components_of), "node long, component long"), label)
    return _rounds(now, scratch, label)


def smallest_reachable(a: np.ndarray, b: np.ndarray, nodes: int) -> np.ndarray:
    """For each of the nodes 0 .. nodes - 1 the smallest one reachable over the edges (a, b)."""
    root = np.arange(nodes)
    while (root[a] != root[b]).any():
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while (root[root] != root).any():
            root = root[root]
    return root


def _components_of(batches):
    pairs = [(x.column("u").to_numpy(), x.column("v").to_numpy()) for x in batches]
    if pairs:
        u, v = (np.concatenate(x) for x in zip(*pairs, strict=True))
        nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        root = smallest_reachable(at[: len(u)], at[len(u) :], len(nodes))
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], ["node", "component"])


def _rounds(now: DataFrame, scratch: Scratch, label: str) -> DataFrame:
    """Components of the edges (u, v), u > v, by large-star and small-star steps."""

    def smallest(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("u").agg(F.min("v").alias("m"))

    def state(df: DataFrame) -> tuple:
        row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        return row["n"], row["h"]

    before, turn = None, 0
    seen = state(now)
    while seen != before and seen[0]:
        turn += 1
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = scratch.save(smallest(both), f"{label}-a{turn}")
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).where("u <> v").distinct()
        large = scratch.save(large, f"{label}-b{turn}")
        low = scratch.save(smallest(large), f"{label}-c{turn}")
        joined = large.join(low, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        after = scratch.save(small, f"{label}-{turn}")
        scratch.drop(f"{label}-{turn - 1}", f"{label}-a{turn}", f"{label}-b{turn}", f"{label}-c{turn}")
        now, before, seen = after, seen, state(after)
    # a star: every node points to its root
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
