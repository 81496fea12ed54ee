"""Language identification as a mixture of languages.

Each language gets smoothed probabilities of hashed byte trigrams of lower-cased text.  A
document is a mixture: expectation-maximisation finds the proportions of languages that
make its trigrams likeliest, then the largest ones are tried as sets of one, two and more
languages, and the set with the best likelihood less a penalty for each language (half
the logarithm of the text's length in trigrams, on a third of the log-likelihood as
neighbouring trigrams overlap) is selected.

The models are fitted on PER_LANGUAGE texts of each language at most, those with the
smallest hash of doc_id among the rows that may be learned from; of a language's rows that share a doc_id one text counts, that with the
smallest hash.  Every document is scored over its whole text, STEPS steps at a time: against 500 steps, 12 changed the
selected set of no text in 400, and a share by 0.03 at most.

Defined results: null texts and texts without a letter are ``und`` with score 0, as are all when no
language can be learned; equal proportions go to the first language by name; a null doc_id
counts as an empty string for holding out; repeated rows are scored alike; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import giving_back, slices, table

SLOTS = 1 << 16
PER_LANGUAGE = 1000
STEPS = 12
#: A language with less than this of the full mixture is not tried.
LEAST_SHARE = 0.02

COUNTS = "lang string, gram int, n long"
RESULT = ", lang_pred string, score double, languages array<string>, shares array<double>"


def grams(text: str) -> np.ndarray:
    """Hashes below SLOTS of the byte trigrams of a lower-cased text."""
    b = np.frombuffer(f" {text.lower()} ".encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    code = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    return (code * np.uint32(2654435761)) >> np.uint32(16)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def held_out() -> F.Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(5)) == 0


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> tuple[list[str], np.ndarray]:
    """Languages in order of name and log-probabilities (SLOTS, languages).

    Sent to the driver: SLOTS counts for each language at most.
    """
    rows = docs.where(F.col("lang").isNotNull() & ~held_out()).withColumn("key", F.xxhash64("doc_id"))
    # first to about twice as many keys as are wanted, by the order that counts, so that a common language isn't dealt to one task; a row for each language is broadcast, as many as the model has
    counts = rows.groupBy("lang").agg(F.approx_count_distinct("key").alias("keys"))
    place = F.pmod("key", F.lit(1 << 30))
    few = rows.select("key", "lang").join(F.broadcast(counts), "lang").where(place / F.lit(float(1 << 30)) * F.col("keys") <= 2 * per_language + 100).select("key", "lang").distinct()
    order = Window.partitionBy("lang").orderBy(place, "key")
    chosen = few.select("key", "lang", F.row_number().over(order).alias("at")).where(F.col("at") <= per_language).select("key", "lang")
    # per_language keys of each language at most are broadcast, and no text but theirs is moved; of rows that share a key one counts
    least = F.min(F.struct(F.col("text").isNull().alias("none"), F.xxhash64("text").alias("hash"), F.col("text").cast("string").alias("text")))
    sample = rows.join(F.broadcast(chosen), ["key", "lang"], "left_semi").groupBy("key", "lang").agg(least.alias("one")).select("lang", "one.text")

    @giving_back
    def count(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in ((x, y) for part in slices(batch, 1) for x, y in zip(*(c.to_pylist() for c in part.columns), strict=True)):
                if has_letter(text):
                    total[lang] = total.get(lang, 0) + np.bincount(grams(text), minlength=SLOTS)
        for lang, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(n[at].astype(np.int64))], ["lang", "gram", "n"])

    found = sample.mapInArrow(count, COUNTS).groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    langs, of = np.unique(found.column("lang").to_numpy(zero_copy_only=False).astype(str), return_inverse=True) if found.num_rows else (np.zeros(0, str), np.zeros(0, int))
    n = np.zeros((SLOTS, len(langs)))
    n[found.column("gram").to_numpy(), of] = found.column("n").to_numpy()
    prob = (n + 0.5) / (n.sum(0) + 0.5 * SLOTS) if len(langs) else n
    return langs.tolist(), np.log(prob).astype(np.float32)


def proportions(prob: np.ndarray, counts: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Mixture weights by expectation-maximisation and the log-likelihood there."""
    w = np.full(prob.shape[1], 1 / prob.shape[1])
    total = counts.sum()
    for _ in range(steps if len(w) > 1 else 0):
        w = w * (prob.T @ (counts / np.maximum(prob @ w, 1e-30))) / total
    return w, float(counts @ np.log(np.maximum(prob @ w, 1e-30)))


def select(log_prob: np.ndarray, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(selected languages, their shares, shares of the full mixture)."""
    g, counts = np.unique(grams(text), return_counts=True)
    lp = log_prob[g].astype(np.float64)
    prob = np.exp(lp - lp.max(1, keepdims=True))
    full, _ = proportions(prob, counts)
    order = np.argsort(-full, kind="stable")
    n = int(counts.sum())
    best = None
    for size in range(1, max(1, int((full >= LEAST_SHARE).sum())) + 1):
        chosen = order[:size]
        w, likelihood = proportions(prob[:, chosen], counts)
        value = likelihood / 3 - 0.5 * size * np.log(max(n, 2))
        if best is None or value > best[0]:
            best = (value, chosen, w)
    return best[1], best[2], full


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], keep: list[str] | None = None) -> DataFrame:
    """doc_id, lang_pred, score, and the selected languages with their shares.

    ``keep``: columns to hand through, instead of doc_id alone.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    keep = keep or ["doc_id"]
    kinds = {"doc_id": "long", "text": "string"}
    passed = docs.select(*[F.col(c).cast(kinds[c]) if c in kinds else F.col(c) for c in dict.fromkeys([*keep, "text"])])

    @giving_back
    def run(batches):
        langs, log_prob = sent.value
        for batch in (part for batch in batches for part in slices(batch, "text")):
            out = [[] for _ in range(4)]
            for text in batch.column("text").to_pylist():
                if not langs or not has_letter(text):
                    row = ("und", 0.0, [], [])
                else:
                    chosen, share, full = select(log_prob, text)
                    top = int(chosen[np.lexsort((chosen, -share))[0]])
                    row = (langs[top], float(min(1.0, full[top])), [langs[i] for i in chosen], share.tolist())
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            told = [pa.array(out[0], pa.string()), pa.array(out[1], pa.float64()), pa.array(out[2], pa.list_(pa.string())), pa.array(out[3], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *told], [*keep, "lang_pred", "score", "languages", "shares"])

    return passed.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in passed.schema if f.name in keep) + RESULT)


def op6_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = identify(docs, fit(docs))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "languages", "shares")
