"""Benchmark decontamination by latent semantic retrieval.

1. Document frequencies of hashed words are counted over all documents.
2. The benchmark's passages (PASSAGE words each, overlapping by half) are TF-IDF vectors, and a distributed randomised
   SVD finds the leading RANK right singular vectors of their matrix A: each task makes the
   product of its rows' part of A'A with a narrow matrix, and the parts are summed by stripes of STRIPE rows, of which a task has those that its words fall into.
3. Documents are searched in overlapping windows of two lengths.  The latent vector of a window is the weighted sum of its
   words' rows of V, and its cosine with every latent benchmark passage is computed.  Only words of the
   benchmark have rows: a window that has less than OWN_WEIGHT of its squared weight in them is no
   candidate, whatever the direction of the rest, and running sums tell such windows apart.
4. An item of fewer than LEAST_WORDS words has too little for a direction: it is looked for as it stands, by hashes of as many words in
   a row, and the words compared.  One of fewer than EXACT_WORDS words occurs anywhere by chance, and is found only where it is the whole text.
5. A candidate is checked on its words: the longest common subsequence of the item and the
   text around the window, as a share of the item, and the share of the item's answer found there
   in order.  The answer is the column ``answer`` where the benchmark has one, else the
   item's last words.

Sent to the driver: the product of step 2, SLOTS rows of RANK + OVERSAMPLE numbers at most, which tasks have summed.
Broadcast: SLOTS rows of RANK numbers at most, and BLOCK benchmark items or BLOCK_BYTES of their text at a time: a larger benchmark takes a further scan for each
further block, whose matches are written before the next block is sent.  Texts are searched whole, PRODUCT cosines at a time.

Defined results: null and empty texts hold nothing; items without words, with null
texts or null ids are not looked for; rows that share an item_id are one item's several wordings, the best of
which counts; repeated documents are reported as often as they occur; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, giving_back, mix, slices, table, word_hashes

SLOTS = 1 << 16  # 2 to the power of SLOT_BITS
RANK = 256
OVERSAMPLE = 16
PASSAGE = 48
#: (words, step) of the windows over documents.
WINDOWS = ((16, 8), (48, 16))
#: Part of a window's squared weight in words of the benchmark, and latent cosine, from which it is checked.
OWN_WEIGHT, CANDIDATE = 0.3, 0.6
#: Share of an item that is proof in itself, and with the answer found too.
ALONE, WITH_ANSWER = 0.85, 0.7
ANSWER_WORDS, ANSWER_SHARE = 5, 0.6
LEAST_WORDS, EXACT_WORDS = 8, 3
BLOCK, BLOCK_BYTES = 20_000, 16_000_000
#: Rows of a product that are summed together.
STRIPE = 1024
#: Cosines that are held at once.
PRODUCT = 1 << 22
#: Leading bits of a word's hash by which benchmark words are told from others, and its slot.
KNOWN_BITS, SLOT_BITS = 22, 16

#: ASCII letters and digits stay, other ASCII becomes a space, bytes of other letters stay.
_KEEP = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_SPACE = np.arange(256) == 32

MATCH = "doc_id long, item_id long, cosine double, lcs double, answer double"


def plain(text: str | None) -> bytes:
    """Lower case with single-byte marks as spaces."""
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_KEEP)


def words_of(text: str | None) -> list[bytes]:
    return plain(text).split()


def hashes_of(text: bytes) -> np.ndarray:
    """Hashes of a plain text's words in order."""
    return word_hashes(text, _SPACE)


def slots_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(SLOTS - 1)).astype(np.uint16)


def frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Documents that hold each slot's words, and all documents."""

    @giving_back
    def count(batches):
        n, total = np.zeros(SLOTS + 1, dtype=np.int64), 0
        for text in (t for batch in batches for part in slices(batch, 0) for t in part.column(0).to_pylist()):
            slots = np.sort(slots_of(hashes_of(plain(text))), kind="stable")  # by digits, as they are 16 bits
            if len(slots):
                n[slots[np.concatenate([[True], slots[1:] != slots[:-1]])]] += 1
            total += 1
        n[SLOTS] = total
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at])], ["slot", "n"])

    got = docs.select(F.col("text").cast("string")).mapInArrow(count, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(SLOTS + 1, dtype=np.int64)
    n[got.column("slot").to_numpy()] = got.column("n").to_numpy()
    return n[:SLOTS], int(n[SLOTS])


def in_a_row(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of every n words in a row."""
    out = np.zeros(len(hashes) - n + 1, dtype=np.uint64)
    for i in range(n):
        out = mix(out + hashes[i : len(hashes) - n + 1 + i])
    return out


def passages_of(words) -> list[tuple[int, int]]:
    """(start, end) of an item's passages."""
    if len(words) <= PASSAGE:
        return [(0, len(words))]
    return [(a, min(a + PASSAGE, len(words))) for a in range(0, len(words) - PASSAGE // 2, PASSAGE // 2)]


def _vectors(text: str | None, idf: np.ndarray):
    """TF-IDF of an item's passages as (slots, weights), of length 1."""
    slots = slots_of(hashes_of(plain(text)))
    if len(slots) < LEAST_WORDS:
        return
    for a, b in passages_of(slots):
        s, n = np.unique(slots[a:b], return_counts=True)
        x = n * idf[s]
        yield s, x / max(np.linalg.norm(x), 1e-12)


def randomised_svd(items: DataFrame, idf: np.ndarray, rank: int = RANK, rounds: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Leading right singular vectors of the matrix of all passages of ``items`` (text).

    Returns the row of each slot, -1 where no item has its words, and the rows.
    """
    spark = items.sparkSession
    texts = items.select("text").rdd.map(lambda r: r[0])
    used = np.array(sorted(texts.flatMap(lambda t: np.unique(slots_of(hashes_of(plain(t)))).tolist()).distinct().collect()), dtype=np.int64)
    row = np.full(SLOTS, -1, dtype=np.int64)
    row[used] = np.arange(len(used))
    width = min(rank + OVERSAMPLE, max(1, len(used)))
    q = np.random.Generator(np.random.PCG64(7)).standard_normal((len(used), width)).astype(np.float32)
    for i in range(rounds):
        q, _ = np.linalg.qr(q)
        sent = spark.sparkContext.broadcast((idf, row, q))

        def part(rows, sent=sent):
            weight, row, basis = sent.value
            out: dict[int, np.ndarray] = {}
            for text in rows:
                for s, x in _vectors(text, weight):
                    at = row[s]
                    more = np.outer(x, x @ basis[at]).astype(np.float32)
                    for stripe in np.unique(at // STRIPE).tolist():
                        if stripe not in out:
                            out[stripe] = np.zeros((min(STRIPE, len(basis) - stripe * STRIPE), basis.shape[1]), dtype=np.float32)
                        own = at // STRIPE == stripe
                        out[stripe][at[own] - stripe * STRIPE] += more[own]
            yield from out.items()

        product = np.zeros(q.shape, dtype=np.float32)
        for stripe, total in texts.mapPartitions(part).reduceByKey(lambda a, b: a + b).collect():
            product[stripe * STRIPE : stripe * STRIPE + len(total)] = total
        if i < rounds - 1:
            q = product
    # A'A within the basis
    value, vector = np.linalg.eigh((q.T @ product).astype(np.float64))
    top = np.argsort(-value)[:rank]
    return row, (q @ vector[:, top[value[top] > 1e-6]]).astype(np.float32)


def lcs(item: list, text: list) -> int:
    """Length of the longest common subsequence, bit-parallel over the item."""
    where: dict = {}
    for i, w in enumerate(item):
        where[w] = where.get(w, 0) | (1 << i)
    full = (1 << len(item)) - 1
    v = full
    for w in text:
        m = where.get(w)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(item) - v.bit_count()


class _Index:
    """Latent passages of a block of items, and the items' words."""

    def __init__(self, rows: list[tuple], idf: np.ndarray, row: np.ndarray, v: np.ndarray):
        self.idf, self.row = idf.astype(np.float32), row
        used = np.flatnonzero(row >= 0)
        self.weighted = np.zeros((len(used), v.shape[1]), dtype=np.float32)
        self.weighted[row[used]] = idf[used, None] * v[row[used]]
        self.items, latent, owner = [], [], []
        for item_id, text, answer in rows:
            words = words_of(text)
            for s, x in _vectors(text, idf):
                z = x @ v[row[s]]
                latent.append(z / max(np.linalg.norm(z), 1e-12))
                owner.append(len(self.items))
            self.items.append((item_id, words, words_of(answer) or words[-ANSWER_WORDS:]))
        self.known = np.zeros(1 << KNOWN_BITS, dtype=bool)
        for _, text, _ in rows:
            self.known[hashes_of(plain(text)) >> np.uint64(64 - KNOWN_BITS)] = True
        self.latent = np.array(latent, dtype=np.float32).reshape(len(latent), v.shape[1])
        self.owner = np.array(owner, dtype=np.int64)
        #: items too short for the latent search: number of words -> (hash of them in a row, item), sorted
        self.short: dict[int, list[tuple[int, int]]] = {}
        for i, (_, words, _) in enumerate(self.items):
            if 0 < len(words) < LEAST_WORDS:
                self.short.setdefault(len(words), []).append((int(in_a_row(hashes_of(b" ".join(words)), len(words))[0]), i))

    def exact(self, hashes: np.ndarray, words) -> set[int]:
        """Short items whose words stand in the text in a row."""
        out = set()
        for n, known in self.short.items():
            if n > len(hashes) or n < EXACT_WORDS and n != len(hashes):
                continue
            rows, keys = in_a_row(hashes, n), np.array([k for k, _ in known], dtype=np.uint64)
            for at in np.flatnonzero(np.isin(rows, keys)).tolist():
                here = words()[at : at + n]
                out |= {i for k, i in known if k == int(rows[at]) and self.items[i][1] == here}
        return out

    def search(self, text: str | None):
        """(item_id, cosine, lcs, answer) of the items that the text holds."""
        text = plain(text)
        hashes = hashes_of(text)
        n = len(hashes)
        best = {self.items[i][0]: (1.0, 1.0, 1.0) for i in self.exact(hashes, text.split)} if self.short and n else {}
        found = self._near(hashes) if n and len(self.owner) else {}
        self._check(text, found, best)
        for item_id, (share, told, c) in sorted(best.items()):
            yield item_id, min(1.0, c), share, told

    def _near(self, hashes: np.ndarray) -> dict[int, list]:
        """Windows near an item's passages, by item."""
        n = len(hashes)
        slots, found = slots_of(hashes), {}
        # a word that shares its leading bits with a benchmark word counts as one, which the check on words puts right
        own = self.known[hashes >> np.uint64(64 - KNOWN_BITS)] & (self.row[slots] >= 0)
        square = self.idf[slots].astype(np.float64) ** 2
        all_, theirs = (np.concatenate([[0.0], np.cumsum(x)]) for x in (square, square * own))
        place = np.flatnonzero(own)
        rows = self.row[slots[place]]
        for width, step in WINDOWS:
            begin = np.arange(0, max(1, n - width + step), step)
            end = np.minimum(begin + width, n)
            near = np.flatnonzero(theirs[end] - theirs[begin] >= OWN_WEIGHT * (all_[end] - all_[begin]))
            if not len(near):
                continue
            for some in np.array_split(near, -(-len(near) * len(self.latent) // PRODUCT)):
                first, last = (np.searchsorted(place, x[some]).tolist() for x in (begin, end))
                latent = np.stack([self.weighted[rows[a:b]].sum(0) for a, b in zip(first, last, strict=True)])
                norm = np.maximum(np.sqrt(np.einsum("ij,ij->i", latent, latent)), 1e-12)
                cos = (latent @ self.latent.T) / norm[:, None]
                for i, p in zip(*np.nonzero(cos >= CANDIDATE), strict=True):
                    found.setdefault(int(self.owner[p]), []).append((int(begin[some[i]]), int(end[some[i]]), float(cos[i, p])))
        return found

    def _check(self, text: bytes, found: dict[int, list], best: dict) -> None:
        """Words of candidates; the best of each item goes to ``best``."""
        if not found:
            return
        words = text.split()
        for i, spots in found.items():
            item_id, item, answer = self.items[i]
            spots.sort()
            regions: list[list] = []  # windows near each other are checked together
            for b, e, c in spots:
                if regions and b <= regions[-1][1] + len(item):
                    regions[-1][1] = max(regions[-1][1], e)
                    regions[-1][2] = max(regions[-1][2], c)
                else:
                    regions.append([b, e, c])
            for b, e, c in regions:
                around = words[max(0, b - len(item)) : e + len(item)]
                there = set(around)
                if sum(w in there for w in item) < WITH_ANSWER * len(item):  # no order can help
                    continue
                share = lcs(item, around) / len(item)
                if share >= WITH_ANSWER:
                    told = lcs(answer, around) / len(answer)
                    if share >= ALONE or told >= ANSWER_SHARE:
                        best[item_id] = max(best.get(item_id, (0.0, 0.0, 0.0)), (share, told, c))


def contaminated(docs: DataFrame, benchmark: DataFrame, rank: int = RANK) -> DataFrame:
    """(doc_id, item_id, cosine, lcs, answer) for every document and benchmark item that it holds."""
    spark = docs.sparkSession
    answer = F.col("answer").cast("string") if "answer" in benchmark.columns else F.lit(None).cast("string")
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string"), answer.alias("answer")).where("item_id is not null and text is not null")
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    n_items, n_bytes = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    if not n_items:
        return spark.createDataFrame([], MATCH)
    n, total = frequencies(docs)
    idf = np.log((1 + total) / (1 + n)) + 0.05
    row, v = randomised_svd(items, idf, rank)
    blocks, out, scratch = max(-(-n_items // BLOCK), -(-n_bytes // BLOCK_BYTES)), None, None
    for block in range(blocks):
        rows = [tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect()]
        sent = spark.sparkContext.broadcast(_Index(rows, idf, row, v))

        @giving_back
        def run(batches, sent=sent):
            for batch in (part for batch in batches for part in slices(batch, 1)):
                got = [(doc_id, *m) for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for m in sent.value.search(text)]
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*got, strict=True), (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()), strict=True)], ["doc_id", "item_id", "cosine", "lcs", "answer"])

        one = docs.mapInArrow(run, MATCH)
        if blocks > 1:
            scratch = scratch or Scratch(spark, "leaks")
            one = scratch.save(one, f"block{block}")
            sent.destroy()
        out = one if out is None else out.unionByName(one)
    return out


def op9_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
