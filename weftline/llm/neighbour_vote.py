"""Quality scores by votes of the nearest labelled documents in a latent semantic space.

A document is a bag of two kinds of terms: hashed byte trigrams, and recurrences.  For the latter each word becomes the class of
its distance to the same word before (new, next to it, and then by powers of two); single classes and pairs of
neighbouring ones are terms, as words would be.  The bag's TF-IDF vector is projected on the leading right singular vectors of the
labelled ones.  The labelled latent vectors are
broadcast; every document gets its exact cosine with all of them, in blocks, and the labels of its
NEIGHBOURS nearest are averaged with weights that grow with the cosine.

Bounds: TRAIN labelled documents, those with the smallest hash of doc_id among the rows that may be
learned from, FEATURES + RECURRENCES terms whose document frequencies are counted over all documents, and RANK dimensions, so the model takes
8 * RANK * (TRAIN + FEATURES + RECURRENCES) bytes at most.  Every document is scored over its whole text.

Defined results: null and empty texts, or ones that share no trigram with the labelled ones, get the
mean label; without labels every score is 0.5; labels that are null or of null doc_id are left out, of several labels of a
document the smallest counts; of equally near documents (cosines are rounded to DIGITS places, beyond which products of
blocks may differ) those with the smallest hash count; repeated rows are scored alike; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table, word_hashes

FEATURES = 1 << 12
TRAIN = 6000
#: Classes of distances, and terms made of one or two of them.
CLASSES = 16
RECURRENCES = CLASSES + CLASSES * CLASSES
TERMS = FEATURES + RECURRENCES
RANK = 64
DIGITS = 9
NEIGHBOURS = 25
BLOCK = 256
#: Weight of a neighbour: its cosine, where positive, to this power.
SHARPNESS = 8


_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def recurrences(text: bytes) -> np.ndarray:
    """Counts of the classes of words' distances to the same word before, and of neighbouring pairs of them."""
    words = word_hashes(text, _SPACE)
    order = np.argsort(words, kind="stable")
    same = np.flatnonzero(words[order][1:] == words[order][:-1])
    kind = np.full(len(words), CLASSES - 1)
    kind[order[same + 1]] = np.minimum(np.log2(order[same + 1] - order[same]).astype(np.int64), CLASSES - 2)
    return np.concatenate([np.bincount(kind, minlength=CLASSES), np.bincount(kind[:-1] * CLASSES + kind[1:], minlength=CLASSES * CLASSES)])


def counts_of(text: str | None) -> np.ndarray:
    """Counts of hashed byte trigrams and of recurrences."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(TERMS, dtype=np.int64)
    code = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    return np.concatenate([np.bincount((code * np.uint32(2654435761)) >> np.uint32(20), minlength=FEATURES), recurrences(raw)])


def held_out() -> F.Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(3)) == 1


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit rows of TERMS columns."""
    return _unit((np.log1p(counts) * idf).astype(np.float32))


def frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Documents that hold each term, and all documents."""

    def count(batches):
        n = np.zeros(TERMS + 1, dtype=np.int64)
        for text in (t for batch in batches for part in slices(batch, 0) for t in part.column(0).to_pylist()):
            n[:TERMS] += counts_of(text) > 0
            n[TERMS] += 1
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at])], ["slot", "n"])

    got = docs.select(F.col("text").cast("string")).mapInArrow(count, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(TERMS + 1, dtype=np.int64)
    n[got.column("slot").to_numpy()] = got.column("n").to_numpy()
    return n[:TERMS], int(n[TERMS])


def fit(docs: DataFrame, labels: DataFrame, train: int = TRAIN) -> tuple:
    """idf over all documents, right singular vectors, latent vectors of the labelled documents, their labels.

    ``labels``: doc_id, label.  Sent to the driver: counts of ``train`` documents.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~held_out())
    usable = usable.groupBy("doc_id").agg(F.min("label").alias("label"))
    usable = usable.join(docs.select("doc_id"), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(train)
    # one row a document: of rows that share a doc_id the one with the smallest counts
    rows = docs.select("doc_id", "text").join(F.broadcast(usable), "doc_id")

    def count(batches):
        for batch in (part for batch in batches for part in slices(batch, 1)):
            counts = [counts_of(text).astype("<u4").tobytes() for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(counts, pa.binary())], ["doc_id", "label", "counts"])

    got = rows.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("label").cast("int")).mapInArrow(count, "doc_id long, label int, counts binary")
    got = got.groupBy("doc_id").agg(F.first("label").alias("label"), F.min("counts").alias("counts")).orderBy(F.xxhash64("doc_id"), "doc_id").toArrow()
    if not got.num_rows:
        return np.zeros(TERMS), np.zeros((TERMS, 1)), np.zeros((0, 1)), np.zeros(0)
    n, total = frequencies(docs)
    idf = np.log((1 + total) / (1 + n)) + 0.1
    label, counts = np.array(got.column("label").to_pylist(), dtype=np.float64), got.column("counts")
    x = np.zeros((got.num_rows, TERMS), dtype=np.float32)
    for a in range(0, len(x), BLOCK):
        x[a : a + BLOCK] = weigh(np.stack([np.frombuffer(c, "<u4") for c in counts.slice(a, BLOCK).to_pylist()]), idf)
    del got, counts
    # randomised range finder with two power steps
    rank = min(RANK, *x.shape)
    q = np.random.Generator(np.random.PCG64(11)).standard_normal((x.shape[1], min(rank + 16, x.shape[1]))).astype(np.float32)
    for _ in range(3):
        q = np.linalg.qr(x.T @ (x @ q))[0]
    _, _, vt = np.linalg.svd(x @ q, full_matrices=False)
    v = (q @ vt[:rank].T).astype(np.float64)
    latent = np.vstack([x[a : a + BLOCK].astype(np.float64) @ v for a in range(0, len(x), BLOCK)])
    return idf, v, _unit(latent), label


def votes(latent: np.ndarray, model: tuple) -> np.ndarray:
    """Scores of unit or zero latent vectors."""
    _, _, known, label = model
    if not len(known):
        return np.full(len(latent), 0.5)
    cos = np.round(latent @ known.T, DIGITS)
    k = min(NEIGHBOURS, len(label))
    near = np.argpartition(-cos, k - 1, axis=1)[:, :k]
    last = np.take_along_axis(cos, near, 1).min(1)
    for i in np.flatnonzero((cos >= last[:, None]).sum(1) > k):  # more are as near as the last one
        some = np.flatnonzero(cos[i] >= last[i])
        near[i] = some[np.argsort(-cos[i, some], kind="stable")[:k]]
    near.sort(axis=1)
    weight = np.maximum(np.take_along_axis(cos, near, 1).astype(np.float64), 0) ** SHARPNESS
    total = weight.sum(1)
    mean = label.mean()
    return np.where(total > 0, (weight * label[near]).sum(1) / np.where(total > 0, total, 1), mean)


def score(docs: DataFrame, model: tuple) -> DataFrame:
    """doc_id and score of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = sent.value
        idf, v = model[0], model[1]
        for batch in (part for batch in batches for part in slices(batch, 1)):
            texts = batch.column(1).to_pylist()
            for a in range(0, len(texts), BLOCK):
                part = texts[a : a + BLOCK]
                x = weigh(np.stack([counts_of(t) for t in part]), idf)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, BLOCK), pa.array(np.clip(votes(_unit(x.astype(np.float64) @ v), model), 0, 1))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")


def op4_neighbour_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    out = score(docs, fit(docs, labels))
    return out.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
