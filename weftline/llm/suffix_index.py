"""Removal of repeated 200-byte strings with a logarithmic family of suffix indexes.

An index holds sampled suffixes.  Every window of LENGTH bytes picks the smallest hash among its GRAM-byte
strings, so equal windows pick suffixes that agree in GRAM bytes, and a run of windows that pick one gram is one entry:

    lead    the first 8 bytes of the suffix, as a number in the order of bytes
    gram    hash of the suffix's first GRAM bytes
    whole, rest   the two halves of a 128-bit hash of all bytes that the run's windows cover
    row, start, windows    where the run begins and how many windows it has, STRETCH at most

Documents come in batches.  A batch's entries are sorted by suffix (its lead, then its gram) into an index of their own
(a table bucketed by both, so that scanning two levels is a merge join without exchange), which is
merge-scanned against itself and against every level for suffixes that recur.  A gram with more entries
than half a bucket of its batch, of which there can be no more than twice as many as buckets, recurs for certain: its entries
are kept apart, in this batch and all later ones, and no bucket has to hold them.  Then levels of equal size
merge, as digits carry in a binary counter, so each entry is rewritten a logarithmic number of times; after the
last batch nothing is merged, since nothing will scan it.  What recurs is then taken out of all levels, each entry once.

Of those entries, ones with equal hashes of all their bytes repeat in all their windows.  The others
share a suffix start but not all of the context: their bytes are fetched and the windows compared, by gram, on hashes of 128 bits.
Windows of grams with more than HOT contexts are dealt out by window hash in packed
blocks instead, so no task gets a whole gram.  Windows that repeat within one run, as in text with a short
period, are told apart where the run is made.  Overlapping spans are merged by tiles of a document before
any document's are gathered.

A document that is there many times is one document where bytes are fetched, and its copies are put together before they are shuffled.
Rows are told apart by a hash of doc_id and text; rows in whose hash unlike documents agree get another one.

Strings are judged on the input and bytes counted in UTF-8.  Defined results: a null text counts as
empty; texts under LENGTH bytes keep everything; rows equal in doc_id and text count as two
places; null doc_ids are allowed; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import CHUNK, Scratch, giving_back, hash_tables, mix, prefix_hashes, slices, table

LENGTH = 200
GRAM = 64
#: Windows of one entry at most: as many as can hold one gram.
STRETCH = LENGTH - GRAM + 1
#: Bytes of a document within which spans are merged before they are gathered.
TILE = 1 << 16
#: Batches that a corpus is dealt into.
BATCHES = 4
#: Contexts of one gram that are compared in one task.
HOT = 4096
#: Entries of one gram in a batch from which it can count as common.
HOT_ENTRIES = 1000
BLOCK_WINDOWS = 1 << 20

ENTRY = "lead long, gram long, whole long, rest long, row long, start int, windows int"
KEY = ["lead", "gram"]
CONTEXT = [*KEY, "whole", "rest"]


def string_hashes(prefix: np.ndarray, size: int, family: int = 0) -> np.ndarray:
    """Hash of every string of ``size`` bytes."""
    inverse = hash_tables(family)[2]
    n = len(prefix) - size
    return mix((prefix[size:] - prefix[:n]) * inverse[:n])


def again(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Whether a pair of hashes occurs more than once."""
    order = np.argsort(one, kind="stable")
    a, b = one[order], two[order]
    same = a[1:] == a[:-1]
    if (same & (b[1:] != b[:-1])).any():  # the first hashes collide
        order = np.lexsort((two, one))
        a, b = one[order], two[order]
        same = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
    out = np.zeros(len(one), dtype=bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return x if have == width else np.minimum(x[: len(x) - (width - have)], x[width - have :])


def entries(data: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Entries of joined texts that end at ``ends``: (start, windows, lead, gram hash, two halves of the whole hash).

    An entry with -n windows tells of n windows that repeat within one run.
    """
    none = np.zeros(0, dtype=np.int64)
    if len(data) < length:
        return (none,) * 6
    prefix = prefix_hashes(data)
    grams = string_hashes(prefix, gram)
    order = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    pick = (_sliding_min(order, length - gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    at = np.arange(len(pick))
    valid = at + length <= np.repeat(ends, np.diff(np.concatenate([[0], ends])))[: len(pick)]
    picked = grams[pick]
    fresh = valid.copy()
    fresh[1:] &= (picked[1:] != picked[:-1]) | ~valid[:-1]
    start = np.flatnonzero(fresh)
    if not len(start):
        return (none,) * 6
    # a run goes to the next fresh window or to the last valid one
    counted = np.concatenate([[0], np.cumsum(valid)])
    windows = np.diff(np.concatenate([counted[start], [counted[-1]]]))
    stretch = length - gram + 1
    if windows.max() > stretch:  # text with a short period
        parts = -(-windows // stretch)
        step = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        start, windows = np.repeat(start, parts) + step * stretch, np.minimum(stretch, np.repeat(windows, parts) - step * stretch)
        fresh[start] = True
    view = memoryview(data)
    stop = start + windows - 1 + length
    whole = np.frombuffer(b"".join(xxhash.xxh3_128_digest(view[a:b]) for a, b in zip(start.tolist(), stop.tolist(), strict=True)), dtype=np.int64)
    first = pick[start]
    lead = np.zeros(len(start), dtype=np.uint64)
    for i in range(8):
        lead = (lead << np.uint64(8)) | data[first + i]
    lead ^= np.uint64(1 << 63)  # signed numbers in the order of bytes
    out = [start, windows, lead.view(np.int64), picked[start].view(np.int64), whole[::2], whole[1::2]]
    # equal windows of one run pick different places of one gram
    moved = np.flatnonzero((pick[1:] != pick[:-1]) & valid[1:] & ~fresh[1:]) + 1
    if len(moved):
        run = np.unique(np.searchsorted(start, moved, "right") - 1)
        owner = np.repeat(run, windows[run])
        window = np.arange(len(owner)) - np.repeat(np.cumsum(windows[run]) - windows[run] - start[run], windows[run])
        salt = mix(owner.astype(np.uint64))
        one, two = (string_hashes(p, length, f)[window] for f, p in enumerate((prefix, prefix_hashes(data, 1))))
        twice = np.flatnonzero(again(one ^ salt, two ^ salt))
        split = np.concatenate([[True], (window[twice][1:] != window[twice][:-1] + 1) | (owner[twice][1:] != owner[twice][:-1])]) if len(twice) else none
        a = np.flatnonzero(split)
        n = np.diff(np.concatenate([a, [len(twice)]])) if len(a) else none
        run = owner[twice[a]]
        more = [window[twice[a]], -n, *(x[run] for x in out[2:])]
        out = [np.concatenate([x, y.astype(x.dtype)]) for x, y in zip(out, more, strict=True)]
    return tuple(out)


def _chunks(sizes: list[int], limit: int = CHUNK):
    """Ranges of rows whose bytes together fit, at least one row each."""
    a, total = 0, 0
    for i, n in enumerate(sizes):
        if i > a and total + n > limit:
            yield a, i
            a, total = i, 0
        total += n
    if a < len(sizes):
        yield a, len(sizes)


def suffixes(docs: DataFrame) -> DataFrame:
    """Entries of all texts of ``docs`` (row, text)."""

    def batch_of(row, start, windows, *hashes):
        longs = [pa.array(np.ascontiguousarray(x), pa.int64()) for x in (*hashes, row)]
        return pa.RecordBatch.from_arrays([*longs, pa.array(start.astype(np.int32)), pa.array(windows.astype(np.int32))], [*CONTEXT, "row", "start", "windows"])

    @giving_back
    def run(batches):
        for batch in (part for batch in batches for part in slices(batch, 1)):
            rows, texts = batch.column(0).to_numpy(), batch.column(1).cast(pa.binary()).to_pylist()
            texts = [t or b"" for t in texts]
            for a, b in _chunks([len(t) for t in texts]):
                joined = b"".join(texts[a:b])
                if len(joined) <= CHUNK:
                    ends = np.cumsum([len(t) for t in texts[a:b]])
                    start, *rest = entries(np.frombuffer(joined, np.uint8), ends)
                    doc = np.searchsorted(ends, start, "right")
                    yield batch_of(rows[a:b][doc], start - np.concatenate([[0], ends])[doc], *rest)
                else:  # one long text, in blocks that share LENGTH - 1 bytes
                    for p in range(0, len(joined) - LENGTH + 1, CHUNK - LENGTH + 1):
                        piece = np.frombuffer(joined[p : p + CHUNK], np.uint8)
                        start, *rest = entries(piece, np.array([len(piece)]))
                        yield batch_of(np.full(len(start), rows[a]), start + p, *rest)

    return docs.select("row", "text").mapInArrow(run, ENTRY)


class SuffixIndex:
    """Levels of sorted entries whose sizes are powers of two batches."""

    def __init__(self, scratch: Scratch):
        self.scratch, self.spark = scratch, scratch.spark
        self.levels: dict[int, str] = {}
        self.count = 0
        self.hot: set[tuple[int, int]] = set()
        self.recurring: list[DataFrame] = []
        self.apart: list[DataFrame] = []
        self.tables: set[str] = set()
        self.buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))

    def _write(self, df: DataFrame) -> str:
        name = f"w{self.scratch.root.rpartition('-')[2]}_{self.count}"
        self.count += 1
        self.tables.add(name)
        df = df.repartition(self.buckets, *KEY).sortWithinPartitions(*KEY)
        df.write.format("parquet").option("path", self.scratch.path(name)).option("compression", "zstd").bucketBy(self.buckets, *KEY).sortBy(*KEY).saveAsTable(name)
        return name

    def _drop(self, name: str) -> None:
        self.tables.discard(name)
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.scratch.drop(name)

    def _grams(self, keys) -> DataFrame:
        return F.broadcast(self.spark.createDataFrame(sorted(keys), "lead long, gram long"))

    def add(self, batch: DataFrame, last: bool = False) -> DataFrame:
        """Index a batch; the suffixes (lead, gram), new or old, that recur because of it."""
        number = self.count
        rows = self.scratch.save(batch, f"batch{number}")
        entry, within = rows.where("windows > 0"), rows.where("windows < 0")
        limit = max(HOT_ENTRIES, rows.count() // (2 * self.buckets))
        fresh = {(r["lead"], r["gram"]) for r in entry.groupBy(*KEY).count().where(F.col("count") > limit).select(*KEY).collect()} - self.hot
        self.hot |= fresh
        hot = self._grams(self.hot)
        own = self._write(entry.join(hot, KEY, "left_anti"))
        grams = self.spark.table(own).groupBy(*KEY).agg((F.count(F.lit(1)) > 1).alias("twice"))
        recurs = grams.where("twice").select(*KEY)
        for name in self.levels.values():
            recurs = recurs.unionByName(self.spark.table(name).select(*KEY).distinct().join(grams.select(*KEY), KEY, "left_semi"))
        # entries of a gram from before it was common are in levels
        recurs = self.scratch.save(recurs.unionByName(self.spark.createDataFrame(sorted(fresh), "lead long, gram long")), f"recurs{number}")
        self.recurring.append(recurs)
        self.apart.append(self.scratch.save(entry.join(hot, KEY, "left_semi").unionByName(within), f"apart{number}"))
        self.scratch.drop(f"batch{number}")
        size, merged = 0, [own]
        while size in self.levels and not last:
            merged.append(self.levels.pop(size))
            size += 1
        if last:
            size = -1
        if len(merged) > 1:
            union = self.spark.table(merged[0])
            for name in merged[1:]:
                union = union.unionByName(self.spark.table(name))
            self.levels[size] = self._write(union)
            for name in merged:
                self._drop(name)
        else:
            self.levels[size] = own
        return recurs

    def found(self) -> DataFrame:
        """Every entry whose suffix recurs, once, and those that tell of repeats within a run."""
        recurs = reduce(DataFrame.unionByName, self.recurring).distinct()
        recurs = self.scratch.save(recurs, "recurs")
        levels = [self.spark.table(name).join(recurs, KEY, "left_semi") for name in self.levels.values()]
        return reduce(DataFrame.unionByName, [*levels, *self.apart])

    def close(self) -> None:
        for name in list(self.tables):
            self._drop(name)
        self.levels.clear()


SPAN = "row long, start int, stop int"


def _span_batch(row, start, stop):
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(row, np.int64)), pa.array(np.asarray(start, np.int32)), pa.array(np.asarray(stop, np.int32))], ["row", "start", "stop"])


def _compare_contexts(asked: DataFrame, docs: DataFrame, blocks: int) -> DataFrame:
    """Spans of windows that recur among entries of the same gram.

    ``asked``: entries with ``hot``.  Their bytes are cut from ``docs``, which has each row once, and sent by
    gram; windows of hot grams as packed blocks by hash.
    """
    by_row = asked.groupBy("row").agg(F.collect_list(F.struct("gram", "start", "windows", "hot")).alias("asked"))
    joined = docs.join(by_row, "row")
    names = ["hot", "key", "row", "start", "windows", "body", "more", "rows", "starts"]
    kinds = [pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]

    @giving_back
    def cut(batches):
        held: list[tuple] = []
        size = 0

        def flush():
            if not held:
                return
            w, x, r, s = (np.concatenate([h[i] for h in held]) for i in range(4))
            part = (w.view(np.uint64) % np.uint64(blocks)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            w, x, r, s, part = w[order], x[order], r[order], s[order], part[order]
            first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            ends = [*first[1:].tolist(), len(part)]
            rows = [(True, int(part[a]), 0, 0, 0, *(y[a:b].tobytes() for y in (w, x, r, s))) for a, b in zip(first.tolist(), ends, strict=True)]
            held.clear()
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in (part for batch in batches for part in slices(batch, "text")):
            out: list[tuple] = []
            for row, asks, text in zip(batch.column("row").to_pylist(), batch.column("asked").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                for ask in asks:
                    a, n = ask["start"], ask["windows"]
                    body = text[a : a + n - 1 + LENGTH]
                    if not ask["hot"]:
                        out.append((False, ask["gram"], row, a, n, body, None, None, None))
                        continue
                    w, x = (string_hashes(prefix_hashes(np.frombuffer(body, np.uint8), f), LENGTH, f).view(np.int64) for f in (0, 1))
                    held.append((w, x, np.full(n, row), np.arange(a, a + n)))
                    size += n
                    if size >= BLOCK_WINDOWS:
                        yield from flush()
                        size = 0
                if len(out) >= 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
        yield from flush()

    sent = joined.mapInArrow(cut, "hot boolean, key long, row long, start int, windows int, body binary, more binary, rows binary, starts binary")
    sent = sent.repartition("hot", "key").sortWithinPartitions("hot", "key")

    def compare(group: list) -> pa.RecordBatch | None:
        """Whole grams: (gram, row, start, windows, body)."""
        data = np.frombuffer(b"".join(x[4] for x in group), np.uint8)
        size = np.array([len(x[4]) for x in group])
        first = np.cumsum(size) - size
        windows = np.array([x[3] for x in group])
        owner = np.repeat(np.arange(len(group)), windows)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows) + first[owner]
        salt = mix(np.array([x[0] for x in group], dtype=np.int64).view(np.uint64))[owner]
        pieces = range(0, max(1, len(data) - LENGTH + 1), CHUNK - LENGTH + 1)
        one, two = (np.concatenate([string_hashes(prefix_hashes(data[p : p + CHUNK], f), LENGTH, f) for p in pieces])[at] ^ salt for f in (0, 1))
        return spans_of(owner, at - first[owner], again(one, two), np.array([x[1] for x in group]), np.array([x[2] for x in group]))

    def spans_of(owner, offset, twice, row, start):
        if not twice.any():
            return None
        owner, offset = owner[twice], offset[twice]
        split = np.concatenate([[True], (owner[1:] != owner[:-1]) | (offset[1:] != offset[:-1] + 1)])
        a = np.flatnonzero(split)
        b = np.concatenate([a[1:], [len(owner)]]) - 1
        return _span_batch(row[owner[a]], start[owner[a]] + offset[a], start[owner[a]] + offset[b] + LENGTH)

    def compare_block(group: list) -> pa.RecordBatch | None:
        w, x, r, s = (np.concatenate([np.frombuffer(g[i], np.int64) for g in group]) for i in range(4))
        twice = np.flatnonzero(again(w, x))
        if not len(twice):
            return None
        order = twice[np.lexsort((s[twice], r[twice]))]
        r, s = r[order], s[order]
        split = np.concatenate([[True], (r[1:] != r[:-1]) | (s[1:] > s[:-1] + LENGTH)])
        a = np.flatnonzero(split)
        b = np.concatenate([a[1:], [len(r)]]) - 1
        return _span_batch(r[a], s[a], s[b] + LENGTH)

    @giving_back
    def run(batches):
        small: list = []
        block: list = []
        block_key = None
        for batch in (part for batch in batches for part in slices(batch, "body")):
            columns = [batch.column(c).to_pylist() for c in names]
            for hot, key, row, start, windows, body, more, rows, starts in zip(*columns, strict=True):
                if hot:
                    if block and key != block_key:
                        found = compare_block(block)
                        block = []
                        if found:
                            yield found
                    block_key = key
                    block.append((body, more, rows, starts))
                else:
                    if len(small) >= HOT and small[-1][0] != key:
                        found = compare(small)
                        small = []
                        if found:
                            yield found
                    small.append((key, row, start, windows, body))
        for found in (compare(small) if small else None, compare_block(block) if block else None):
            if found:
                yield found

    return sent.mapInArrow(run, SPAN)


def with_rows(docs: DataFrame, key: F.Column | None = None) -> DataFrame:
    """``docs`` with ``row``, a hash of doc_id and text in which no two unlike documents agree.

    Of 10^10 documents a few pairs are expected to agree in 64 bits: they get a hash of other seed.
    """
    key = F.xxhash64("doc_id", "text") if key is None else key
    other = F.xxhash64(F.lit("row"), "text", "doc_id")
    keyed = docs.withColumn("row", key)
    pairs = keyed.select("row", other.alias("other")).groupBy("row").agg(F.min("other").alias("low"), F.max("other").alias("high"))
    both = [r["row"] for r in pairs.where("low <> high").select("row").collect()]
    return keyed.withColumn("row", F.when(F.col("row").isin(both), other).otherwise(F.col("row"))) if both else keyed


def merged_by_tile(spans: DataFrame) -> DataFrame:
    """Spans (row, start, stop) without overlaps among those that begin in one tile of a row."""
    tile = Window.partitionBy("row", "tile")
    spans = spans.withColumn("tile", (F.col("start") / TILE).cast("int"))
    reach = F.max("stop").over(tile.orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("fresh", F.when(F.col("start") <= reach, 0).otherwise(1))
    spans = spans.withColumn("part", F.sum("fresh").over(tile.orderBy("start").rowsBetween(Window.unboundedPreceding, 0)))
    return spans.groupBy("row", "tile", "part").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).select("row", "start", "stop")


def repeated_spans(docs: DataFrame, scratch: Scratch, batches: int = BATCHES) -> DataFrame:
    """(row, spans): spans of UTF-8 bytes that recur in ``docs`` (row, text), where ``row`` is that of ``with_rows``, or (doc_id, text)."""
    docs = docs if "row" in docs.columns else with_rows(docs)
    docs = docs.select("row", F.coalesce("text", F.lit("")).alias("text"))
    index = SuffixIndex(scratch)
    try:
        for i in range(batches):
            index.add(suffixes(docs.where(F.pmod("row", F.lit(batches)) == i)), last=i == batches - 1)
        found = scratch.save(index.found(), "found")
    finally:
        index.close()
    entry = found.where("windows > 0")
    within = found.where("windows < 0").select("row", "start", (F.col("start") - F.col("windows") - 1 + LENGTH).alias("stop"))
    classes = entry.groupBy(*CONTEXT).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("row", "start", "windows")).alias("one"))
    classes = scratch.save(classes, "classes")
    # equal contexts: all their windows recur
    same = entry.join(classes.where("n > 1").select(*CONTEXT), CONTEXT, "left_semi")
    same = same.select("row", "start", (F.col("start") + F.col("windows") - 1 + LENGTH).alias("stop"))
    # other contexts of one gram: compared window by window, one entry for each context
    grams = classes.groupBy(*KEY).agg(F.count(F.lit(1)).alias("contexts"), F.min("n").alias("least")).where("contexts > 1 and least = 1")
    grams = scratch.save(grams, "grams")
    asked = classes.join(grams, KEY).select("gram", "one.row", "one.start", "one.windows", (F.col("contexts") > HOT).alias("hot"))
    asked = scratch.save(asked, "asked")
    hot = asked.where("hot").agg(F.sum("windows").alias("w")).first()["w"] or 0
    # rows that are there twice
    twice = docs.select("row", F.octet_length("text").alias("stop")).groupBy("row").agg(F.count(F.lit(1)).alias("n"), F.min("stop").alias("stop")).where(f"n > 1 and stop >= {LENGTH}")
    twice = scratch.save(twice.select("row", F.lit(0).alias("start"), "stop"), "twice")
    copies = docs.join(twice.select("row"), "row", "left_semi").groupBy("row").agg(F.first("text").alias("text"))
    once = docs.join(twice.select("row"), "row", "left_anti").where(F.octet_length("text") >= LENGTH).unionByName(copies)
    other = _compare_contexts(asked, once, max(64, hot // (4 * BLOCK_WINDOWS)))
    spans = scratch.save(reduce(DataFrame.unionByName, [same, within, other, twice]), "spans")
    return merged_by_tile(spans).groupBy("row").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))


REMOVED = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def merge_spans(spans: list, n: int) -> list[tuple[int, int]]:
    """Sorted, disjoint and not touching."""
    out: list[list[int]] = []
    for a, b in sorted((x["start"], min(x["stop"], n)) for x in spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame, scratch: Scratch, batches: int = BATCHES, with_text: bool = True) -> DataFrame:
    """Every row's doc_id, n_bytes, n_removed, n_spans, kept_sha256, and kept (its remaining bytes; null unless asked for)."""
    docs = with_rows(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    joined = docs.join(repeated_spans(docs, scratch, batches), "row", "left").select("doc_id", "text", "spans")

    @giving_back
    def run(batches):
        for batch in (part for batch in batches for part in slices(batch, "text")):
            out = [[] for _ in range(6)]
            for doc_id, text, spans in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), batch.column("spans").to_pylist(), strict=True):
                text, at, parts = text or b"", 0, []
                merged = merge_spans(spans or [], len(text))
                for a, b in merged:
                    parts.append(text[at:a])
                    at = b
                parts.append(text[at:])
                kept = b"".join(parts)
                for column, value in zip(out, (doc_id, len(text), len(text) - len(kept), len(merged), hashlib.sha256(kept).hexdigest(), kept if with_text else None), strict=True):
                    column.append(value)
            kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return joined.mapInArrow(run, REMOVED)


def op7_suffix_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), Scratch(spark, "op7"), with_text=False).drop("kept")


#: The same rows by plain SQL, for small tables.
OP7_SQL = """
WITH b AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT r, i, md5_number(substr(h, 2 * i + 1, 400)) AS k FROM (SELECT r, h, unnest(range(0, length(h) // 2 - 199)) AS i FROM b WHERE length(h) >= 400)),
twice AS (SELECT k FROM w GROUP BY k HAVING count(*) > 1),
c AS (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 200 THEN 0 ELSE 1 END AS fresh FROM w SEMI JOIN twice USING (k)),
g AS (SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS span FROM c),
s AS (SELECT r, min(i) AS a, max(i) + 200 AS z FROM g GROUP BY r, span),
q AS (SELECT *, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a), 0) AS before FROM s),
k AS (SELECT r, sum(z - a) AS removed, count(*) AS spans, max(z) AS last, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept FROM q JOIN b USING (r) GROUP BY r)
SELECT b.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM b LEFT JOIN k ON k.r = b.r
"""
