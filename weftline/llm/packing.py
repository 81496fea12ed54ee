"""Mixture-controlled packing by deficit round-robin, with one token as the quantum.

Every token served gives each queue its share of a token as credit; the queue that first
reaches a whole token is next and pays one.  What a queue is owed so never exceeds a token or two and is carried
from window to window and from task to task.  The order needs no loop over
tokens: while a queue has tokens, its token j is paid for at (j + phase) / share, its due time, and what
a dry queue leaves goes to the others by their shares.

Documents are tokenised once.  Each task numbers the tokens of its rows within
their queue, and the totals per task and queue give every document its place in its
queue's stream.  Tasks work out from the queues' totals alone where windows end, for the stretch of the order
that their documents lie in, and cut the documents there, without moving their ids again.
Each source has a queue of its own, however many there are; of a source whose share is less than
a token a window, every token is a piece.

Defined results: null text counts as empty; an empty text is the end id alone; null sources
share one queue; rows with equal or null ids are packed each on their own;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import OrderedDict
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, giving_back, slices, table

WINDOW = 1024
END_ID = 0
#: Tokens whose order one step of the schedule finds, about, and steps whose windows a task keeps (16 bytes a window).
SLICE = 1 << 20
KEPT_SLICES = 1024
#: White space from which a run is too long for the fast encoder's regular expression.
LONG_RUN = 50_000
TOKENIZER = "byte_bpe_50k.json"

TOKENS = "doc_id long, queue string, task int, before long, n long, ids binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, queue string"


def _byte_of() -> dict[str, int]:
    """The printable stand-ins of bytes in a byte-level vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def encoder(path: str):
    """text -> uint32 ids, equal to ``Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids``.

    The vocabulary's ids are in merge order, so the same merges run in
    tiktoken at several times the speed.  Texts that hold the string of a special token, or so long a run
    of white space that tiktoken's look-ahead would exhaust the stack, go to the tokenizers library itself.
    """
    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"] for t in spec.get("added_tokens", ())}
    byte = _byte_of()
    ranks = {bytes(byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    fast = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    slow: list = []  # loaded when needed

    def encode(text: str) -> np.ndarray:
        long_run = len(text) >= LONG_RUN and max(map(len, re.findall(r"\s+", text)), default=0) >= LONG_RUN
        if long_run or any(s in text for s in special):
            if not slow:
                slow.append(Tokenizer.from_file(path))
            return np.array(slow[0].encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        return np.array(fast.encode_ordinary(text), dtype=np.uint32)

    return encode


def tokenize(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, queue, task, tokens of the queue earlier in this task, n, ids (unsigned 16 or 32 bit)."""
    path = tokenizer or public_tokenizers.path(TOKENIZER)

    @giving_back
    def run(batches):
        encode, task, before = encoder(path), TaskContext.get().partitionId(), {}
        for batch in (part for batch in batches for part in slices(batch, 1)):
            out = [[] for _ in range(6)]
            for doc_id, text, source in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                ids = np.append(encode(text or ""), np.uint32(END_ID))
                queue = source or ""
                at = before.get(queue, 0)
                before[queue] = at + len(ids)
                for column, value in zip(out, (doc_id, queue, task, at, len(ids), ids.astype("<u4" if ids.max() > 65535 else "<u2").tobytes()), strict=True):
                    column.append(value)
            yield _batch(out)

    kinds = (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.binary())

    def _batch(out):
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], ["doc_id", "queue", "task", "before", "n", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("source").cast("string")).mapInArrow(run, TOKENS)


class Schedule:
    """Which window takes which tokens of each queue, for any number of queues and tokens.

    Token j of a queue falls due at base + (j + phase) * step, where step is one over the queue's
    weight: served in that order, every queue has had its share, to a token, of all that was served,
    and what a dry queue leaves goes to the others by their weights.  Queues without a weight
    come after all others, in proportion to their tokens.  Phases of queues of like weight are spread evenly,
    so many small queues don't fall due at once.  Window k starts with the token of rank k * window;
    of tokens due at once the first queue's is the first.

    A schedule holds a few numbers for each queue.  Where windows start is found when asked for,
    for about SLICE tokens at a time.
    """

    def __init__(self, totals: dict[str, int], weights: dict[str, float] | None = None, window: int = WINDOW):
        self.window, self.names = window, sorted(totals)
        self.total = np.array([totals[q] for q in self.names], dtype=np.int64)
        tokens = int(self.total.sum())
        self.slice = SLICE
        self.windows, self.slices = -(-tokens // window), -(-tokens // self.slice)
        want = np.array([max(0.0, (weights or totals).get(q, 0.0)) for q in self.names], dtype=np.float64)
        want[self.total == 0] = 0
        if not want.any():
            want = self.total.astype(np.float64)
        late, share = want == 0, want / max(want.sum(), 1e-300)
        self.step = 1 / np.where(late, 1.0, share)
        ends = np.sort((self.total * self.step)[~late])
        last = float(ends[-1]) if len(ends) else 1.0
        self.base = np.where(late, last, 0.0)
        self.step[late] = last / np.maximum(self.total[late], 1)
        self.phase = np.empty(len(want))
        self.phase[np.argsort(self.step, kind="stable")] = ((np.arange(len(want)) + 0.5) * 0.6180339887498949) % 1
        # with tokens as a fluid, what is served by a time is piecewise linear: its corners
        order = np.argsort((self.total * self.step)[~late], kind="stable")
        rate, size = share[~late][order], self.total[~late][order]
        served = np.cumsum(size) + ends * (rate.sum() - np.cumsum(rate))
        self.served, self.ends = np.array([0.0, *served, max(tokens, 1)]), np.array([0.0, *ends, 2 * last])
        self.kept: OrderedDict = OrderedDict()

    def edge(self, i: int) -> float:
        """Due time at which slice i begins; never less than that of the slice before."""
        if i <= 0 or i >= self.slices:
            return 0.0 if i <= 0 else np.inf
        at = min(int(np.searchsorted(self.served, i * float(self.slice), "right")), len(self.served) - 1)
        low, high = self.served[at - 1 : at + 1]
        share = (i * float(self.slice) - low) / (high - low) if high > low else 1.0
        return float(min(self.ends[at - 1] + share * (self.ends[at] - self.ends[at - 1]), self.ends[at]))

    def slice_of(self, time: float) -> int:
        i = min(max(int(np.interp(time, self.ends, self.served) // self.slice), 0), self.slices - 1)
        while i > 0 and time < self.edge(i):
            i -= 1
        while i < self.slices - 1 and time >= self.edge(i + 1):
            i += 1
        return i

    def due(self, queue, j):
        return self.base[queue] + (j + self.phase[queue]) * self.step[queue]

    def before(self, queue, time):
        """Tokens of a queue that fall due before a time; either may be an array."""
        total = self.total[queue]
        j = np.clip(np.ceil((time - self.base[queue]) / self.step[queue] - self.phase[queue]), 0, total).astype(np.int64)
        j = j - ((j > 0) & (self.due(queue, j - 1) >= time))  # what rounding did
        return j + ((j < total) & (self.due(queue, j) < time))

    def bounds(self, i: int) -> tuple[int, np.ndarray, np.ndarray]:
        """Number of the first window that starts in a slice; due times and queues of the first tokens of all that do."""
        if i in self.kept:
            self.kept.move_to_end(i)
            return self.kept[i]
        every = np.arange(len(self.names))
        low, high = (self.before(every, self.edge(x)) for x in (i, i + 1))
        rank, n = int(low.sum()), high - low
        queue = np.repeat(every, n)
        time = self.due(queue, np.arange(len(queue)) - np.repeat(np.cumsum(n) - n - low, n))
        at = np.arange(-rank % self.window, len(queue), self.window)
        order = np.argsort(time, kind="stable")[at]
        self.kept[i] = -(-rank // self.window), time[order], queue[order]
        if len(self.kept) > KEPT_SLICES:
            self.kept.popitem(last=False)
        return self.kept[i]

    def ranks(self, queue: int, j: np.ndarray) -> np.ndarray:
        """Places of tokens of a queue in the order of all tokens, by counting every queue's."""
        every, out = np.arange(len(self.names))[None, :], []
        for part in np.array_split(j, max(1, len(j) * len(self.names) >> 20)):
            time = self.due(queue, part)[:, None]
            n = self.before(every, time)
            out.append((n + ((every < queue) & (n < self.total) & (self.due(every, n) == time))).sum(1))
        return np.concatenate(out)

    def windows_of(self, queue: int, j: np.ndarray) -> np.ndarray:
        """Windows of tokens of a queue, in order: by the slices they lie in or, where finding those takes longer, by rank."""
        due = self.due(queue, j)
        first, last = self.slice_of(due[0]), self.slice_of(due[-1])
        new = sum(i not in self.kept for i in range(first, last + 1)) if last - first < KEPT_SLICES else KEPT_SLICES
        if len(j) * len(self.names) < 2 * new * self.slice:
            return self.ranks(queue, j) // self.window
        out = np.empty(len(j), dtype=np.int64)
        at = 0
        while at < len(j):
            i = self.slice_of(due[at])
            end = max(at + 1, int(np.searchsorted(due, self.edge(i + 1), "left")))
            k, times, queues = self.bounds(i)
            place = np.searchsorted(times, due[at:end], "right") - 1
            while len(times) and (late := (place >= 0) & (times[place] == due[at:end]) & (queues[place] > queue)).any():
                place = place - late
            out[at:end] = k + place
            at = end
        return out

    def cut(self, queue: int, start: int, n: int) -> tuple[np.ndarray, ...]:
        """First ids, lengths, windows and places in the queue of the pieces of n tokens from ``start`` of a queue."""
        ends = np.array([start, start + n - 1])
        low, high = self.windows_of(queue, ends).tolist()
        if high - low < n:
            k = np.arange(low, high + 1)
            if high > low:
                found = [self.bounds(i) for i in range(*(self.slice_of(t) + x for x, t in enumerate(self.due(queue, ends))))]
                times, queues = (np.concatenate([f[x] for f in found])[low + 1 - found[0][0] :][: high - low] for x in (1, 2))
            else:
                times, queues = np.zeros(0), np.zeros(0, dtype=np.int64)
            edge = self.before(queue, times)
            edge = edge + ((edge < self.total[queue]) & (self.due(queue, edge) == times) & (queue < queues))
            edge = np.concatenate([[start], edge, [start + n]])
        else:  # fewer tokens than windows
            each = self.windows_of(queue, np.arange(start, start + n))
            new = np.flatnonzero(np.concatenate([[True], each[1:] != each[:-1]]))
            k, edge = each[new], np.append(new, n) + start
        length = np.diff(edge)
        some = np.flatnonzero(length)
        return edge[some] - start, length[some], k[some], edge[some]


def pack(docs: DataFrame, scratch: Scratch, weights: dict[str, float] | None = None, tokenizer: str | None = None) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, queue.

    ``weights``: the target share of each source in every window; by default
    the share it has of all tokens.  Only the last window can lack tokens.
    Sent to the driver and broadcast: a total for each queue, whatever the number of tokens.
    """
    spark = docs.sparkSession
    tokens = scratch.save(tokenize(docs, tokenizer), "tokens", "zstd")
    parts = tokens.groupBy("queue", "task").agg(F.sum("n").alias("tokens"))
    parts = scratch.save(parts.select("queue", "task", (F.sum("tokens").over(Window.partitionBy("queue").orderBy("task")) - F.col("tokens")).alias("base"), "tokens"), "parts")
    got = parts.groupBy("queue").agg(F.sum("tokens").alias("tokens")).toArrow()
    totals = dict(zip(got.column("queue").to_pylist(), got.column("tokens").to_pylist(), strict=True))
    if not totals:
        return spark.createDataFrame([], PIECES)
    plan = Schedule(totals, weights)
    numbers = spark.createDataFrame(pa.table({"queue": pa.array(plan.names, pa.string()), "number": pa.array(range(len(plan.names)), pa.int64())}))
    parts = scratch.save(parts.join(numbers, "queue").select("queue", "task", "base", "number"), "numbered")
    schedule = spark.sparkContext.broadcast(plan)

    @giving_back
    def run(batches):
        plan = schedule.value
        for batch in (part for batch in batches for part in slices(batch, "ids")):
            number, place, base, n = (batch.column(c).to_numpy() for c in ("number", "before", "base", "n"))
            place = place + base
            order = np.lexsort((place, number))
            found = []
            # rows that follow each other in their queue are cut together
            follows = (number[order][1:] == number[order][:-1]) & (place[order][1:] == (place + n)[order][:-1])
            for rows in np.split(order, np.flatnonzero(~follows) + 1):
                first, stop = int(place[rows[0]]), int(place[rows[-1]] + n[rows[-1]])
                _, _, window, at = plan.cut(int(number[rows[0]]), first, stop - first)
                edge = np.union1d(at, place[rows])
                row = rows[np.searchsorted(place[rows], edge, "right") - 1]
                found.append((row, edge - place[row], np.diff(edge, append=stop), window[np.searchsorted(at, edge, "right") - 1], edge))
            row, start, length, window, at = (np.concatenate(x) for x in zip(*found, strict=True))
            ids = batch.column("ids")
            crcs, last, raw = [], -1, memoryview(b"")
            for i, a, z in zip(row.tolist(), (4 * start).tolist(), (4 * (start + length)).tolist(), strict=True):
                if i != last:
                    last, held = i, ids[i].as_py()
                    raw = memoryview(np.frombuffer(held, "<u2" if len(held) == 2 * n[i] else "<u4").astype("<u4").tobytes())
                crcs.append(zlib.crc32(raw[a:z]))
            of = pa.array(row)
            columns = [batch.column("doc_id").take(of), pa.array(start), pa.array(length), pa.array(crcs, pa.int64()), batch.column("n").take(of), pa.array(window), pa.array(at), batch.column("queue").take(of)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "at", "queue"])

    placed = tokens.join(parts, ["queue", "task"])
    pieces = placed.select("doc_id", "queue", "number", "before", "base", "n", "ids").mapInArrow(run, PIECES.replace("offset", "at"))
    # a window's queues in order; of its rows there are no more than its tokens
    offset = F.sum("length").over(Window.partitionBy("sequence_id").orderBy("queue", "at")) - F.col("length")
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", offset.alias("offset"), "queue")


def op10_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), Scratch(spark, "op10"))
