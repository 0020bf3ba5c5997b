"""Toxic passages as maximum-scoring segments of token log-odds, calibrated by extreme-value statistics.

1. A token falls in two of a fixed number of hash buckets; the smaller weight holds. The toxic and the clean training texts that
   have a bucket (copies discounted) and all texts that have it (the Dirichlet prior) give log-odds with a variance; only what
   exceeds ``Z`` standard errors counts, less a constant drift.
2. All maximal scoring segments of a text come from one linear scan (its positive tokens and the negative sums between).
3. A segment of score S in n tokens has the expected number ``K n exp(-lambda S)``; lambda solves
   ``sum p exp(lambda s) = 1`` on clean tokens, K is its maximum-likelihood value on clean training texts. A text's evidence
   is the sum of ``lambda S - log(K n)`` over its significant segments, or the largest value if none is significant.
4. Evidence becomes a probability by monotone regression on a histogram of the training texts.

What leaves Spark is the significant part of the bucket table and the histogram, both of bounded size. Empty and null texts have the lowest evidence,
ties have equal scores, repeated rows are scored each, a null id is never training data; extra columns are ignored. With no
training text of either label every score is the base rate, or 0.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.llm.storage import stored
from curatrix.llm.words import blocks, word_hashes

BUCKETS = 1 << 18
PRIOR = 5000.0
Z = 2.0
DRIFT = 0.3
LABELS = 100_000
BINS = 400
SPAN = 100.0


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    rate: float
    log_k: float
    curve: np.ndarray


def _tokens(column: pa.Array):
    """(first row, last row + 1, 36 hash bits of each word, words before each row) of a text column, block by block."""
    for at, to, data, offsets in blocks(column):
        hashes, rows = word_hashes(data, offsets)
        yield at, to, (hashes >> np.uint64(28)).astype(np.int64), rows


def _buckets(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two buckets of each token, one in either half of the table."""
    return tokens & (BUCKETS - 1), (tokens >> 18 & (BUCKETS - 1)) + BUCKETS


def _counted(batches):
    """Texts of a task that have a bucket: toxic (0), clean (1), without label (2). And for the toxic ones a 64-bit sketch of the words
    before each bucket."""
    total = np.zeros((3, 2 * BUCKETS), np.int64)
    before = np.zeros(2 * BUCKETS * 64, bool)
    for batch in batches:
        kind = batch.column("kind").to_numpy(zero_copy_only=False)
        for at, to, tokens, rows in _tokens(batch.column("text")):
            owner = np.repeat(np.arange(to - at), np.diff(rows))
            once = np.unique((owner << 36) | tokens)
            whose = kind[at + (once >> 36)]
            bit = np.concatenate((tokens[:1], tokens[:-1])) >> 10 & 63
            toxic = kind[at + owner] == 0
            for place, found in zip(_buckets(tokens), _buckets(once & (1 << 36) - 1)):
                before[place[toxic] * 64 + bit[toxic]] = True
                for k in range(3):
                    total[k] += np.bincount(found[whose == k], minlength=2 * BUCKETS)
    seen = np.flatnonzero(total.any(0))
    sketch = np.packbits(before.reshape(-1, 64)[seen], axis=1).view(np.int64).ravel()
    yield pa.RecordBatch.from_arrays([pa.array(seen)] + [pa.array(total[k][seen]) for k in range(3)] + [pa.array(sketch)],
                                     names=["bucket", "c0", "c1", "c2", "s"])


def _counts(texts: DataFrame) -> DataFrame:
    """Texts by bucket: toxic, clean, all. A bucket that toxic texts have in few contexts counts these, not the texts:
    a family of near copies is one witness."""
    sums = (texts.mapInArrow(_counted, "bucket long, c0 long, c1 long, c2 long, s long").groupBy("bucket")
            .agg(*[F.sum(f"c{k}").alias(f"c{k}") for k in range(3)], F.bit_count(F.bit_or("s")).alias("bits")))
    contexts = F.when(F.col("bits") < 60, -64 * F.log1p(-F.least("bits", F.lit(60)) / 64)).otherwise(F.lit(float("inf")))
    return sums.select("bucket", F.least(F.col("c0").cast("double"), contexts).alias("toxic"), F.col("c1").cast("double").alias("clean"),
                       (F.col("c0") + F.col("c1") + F.col("c2")).cast("double").alias("everything"))


def token_odds(counts: DataFrame) -> tuple[DataFrame, float]:
    """(bucket, clean, sure): the log-odds that exceed ``Z`` standard errors under the Dirichlet prior of all texts; and the sum of clean counts."""
    total = counts.agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in ("toxic", "clean", "everything")]).first()
    prior = PRIOR * (F.col("everything") + 0.5) / (total["everything"] + BUCKETS)
    a, b = F.col("toxic") + prior, F.col("clean") + prior
    odds = F.ln(a / (total["toxic"] + PRIOR - a)) - F.ln(b / (total["clean"] + PRIOR - b))
    sure = F.signum(odds) * F.greatest(F.lit(0.0), F.abs(odds) - Z * F.sqrt(1 / a + 1 / b))
    return counts.select("bucket", "clean", sure.alias("sure")).where("sure != 0"), total["clean"]


def decay_rate(weights: np.ndarray, clean: np.ndarray) -> float:
    """The positive root of ``sum p exp(rate * s) = 1``."""
    p = clean / max(clean.sum(), 1)
    low, high = 1e-6, 1.0
    with np.errstate(over="ignore"):
        while p[weights > 0].sum() > 0 and (p * np.exp(high * weights)).sum() < 1 and high < 64:
            high *= 2
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if (p * np.exp(mid * weights)).sum() < 1 else (low, mid)
    return high


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first token, end, score) in one pass; only positive tokens can begin one."""
    before = np.concatenate(([0.0], np.cumsum(scores)))
    kept: list[tuple[int, int, float, float]] = []
    for i in np.flatnonzero(scores > 0):
        start, end, left, right = int(i), int(i) + 1, before[i], before[i + 1]
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= left:
                j -= 1
            if j < 0 or kept[j][3] >= right:
                break
            start, left = kept[j][0], kept[j][2]
            del kept[j:]
        kept.append((start, end, left, right))
    return [(a, b, float(r - l)) for a, b, l, r in kept]


def _scanned(column: pa.Array, weights: np.ndarray):
    for at, to, tokens, rows in _tokens(column):
        scores = np.minimum(*(weights[x] for x in _buckets(tokens)))
        hit = np.concatenate(([0], np.cumsum(scores > 0)))[rows]
        for i in range(to - at):
            yield rows[i + 1] - rows[i], segments(scores[rows[i]:rows[i + 1]]) if hit[i + 1] > hit[i] else []


def evidence(n: int, found: list, rate: float, log_k: float) -> float:
    values = [rate * s - log_k - np.log(max(n, 1)) for *_, s in found]
    return sum(v for v in values if v > 0) or max(values, default=-SPAN)


def _bins(values: np.ndarray) -> np.ndarray:
    return np.clip((np.asarray(values) + SPAN) / (2 * SPAN) * BINS, 0, BINS - 1e-9)


def monotone(toxic: np.ndarray, clean: np.ndarray) -> np.ndarray:
    """Non-decreasing probability of the toxic label in each bin, with half a count added to either label of a block."""
    pools: list[list[float]] = []
    for t, c in zip(toxic, clean):
        pools.append([t, c, 1])
        while len(pools) > 1 and pools[-2][0] * (pools[-1][0] + pools[-1][1]) >= pools[-1][0] * (pools[-2][0] + pools[-2][1]):
            t2, c2, n2 = pools.pop()
            pools[-1] = [pools[-1][0] + t2, pools[-1][1] + c2, pools[-1][2] + n2]
    shares = np.concatenate([np.full(int(n), (t + 0.05) / (t + c + 0.1)) for t, c, n in pools])
    return np.maximum.accumulate(shares)


def fit(docs: DataFrame, labels: DataFrame, most: int = LABELS) -> Model:
    """Fit on the labelled texts whose crc32(doc_id as text) mod 3 is not 1; the prior counts all texts.

    With more than ``most`` labels, those of the smallest hashes (about ``most`` rows) are used; they are broadcast, so that no
    text is shuffled.
    """
    truth = (labels.where("doc_id is not null and toxic is not null and crc32(cast(doc_id as string)) % 3 != 1")
             .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    share = most / max(most, truth.count())
    truth = F.broadcast(truth.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share * (1 << 20)).select(
        "doc_id", F.expr("if(toxic = 1, 0, 1)").alias("kind")))
    texts = docs.select("doc_id", "text")
    counts = stored(_counts(texts.join(truth, "doc_id", "left").select("text", F.coalesce("kind", F.lit(2)).alias("kind"))), "toxicity-counts")
    train = texts.join(truth, "doc_id").select("text", "kind")
    odds, everything = token_odds(counts)
    odds = odds.toPandas()
    weights = np.full(2 * BUCKETS, -DRIFT, np.float32)
    weights[odds["bucket"].to_numpy(np.int64)] += odds["sure"].to_numpy(np.float32)
    seen = odds["clean"].to_numpy(float)
    rate = decay_rate(np.append(odds["sure"].to_numpy(float), 0.0) - DRIFT, np.append(seen, everything - seen.sum()))
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def best(batches):
        for batch in batches:
            rows = [(int(n), [s for *_, s in found]) for n, found in _scanned(batch.column("text"), shared.value)]
            yield pa.RecordBatch.from_arrays([batch.column("kind").cast(pa.int32()), pa.array([n for n, _ in rows], pa.int64()),
                                              pa.array([s for _, s in rows], pa.list_(pa.float64()))], names=["kind", "n", "scores"])

    scanned = stored(train.mapInArrow(best, "kind int, n long, scores array<double>"), "toxicity-train")
    top = F.coalesce(F.array_max("scores"), F.lit(0.0))
    tail = scanned.where("kind = 1").agg(F.count("*").alias("m"), F.sum(F.col("n") * F.exp(-rate * top)).alias("mass")).first()
    log_k = float(np.log(tail["m"] / tail["mass"])) if tail["mass"] else 0.0
    value = f"transform(scores, s -> {rate!r}D * s - ({log_k!r}D) - ln(greatest(n, 1)))"
    proof = F.expr(f"aggregate({value}, 0D, (a, v) -> a + greatest(v, 0D))")
    proof = F.when(proof > 0, proof).otherwise(F.coalesce(F.array_max(F.expr(value)), F.lit(-SPAN)))
    place = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(BINS - 1e-9), (proof + SPAN) / (2 * SPAN) * BINS))).cast("int")
    shares = scanned.groupBy(place.alias("bin"), "kind").count().toPandas()
    table = np.zeros((2, BINS))
    for b, k, c in zip(shares["bin"], shares["kind"], shares["count"]):
        table[int(k), int(b)] += c
    return Model(weights, rate, log_k, monotone(*table) if table.sum() else np.zeros(BINS))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, keep: list[str] | None = None) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted, and ``passages`` (first word, end, score) of all maximal segments.

    ``keep`` names columns of ``docs`` to return instead of doc_id alone, for filters.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    names = keep or ["doc_id"]
    kinds = ", ".join(f"`{n}` {docs.schema[n].dataType.simpleString()}" for n in names)

    def score(batches):
        m = model.value
        for batch in batches:
            found = list(_scanned(batch.column("__text"), m.weights))
            bins = _bins(np.array([evidence(int(n), s, m.rate, m.log_k) for n, s in found], np.float64))
            spots = pa.array([[{"first_word": a, "end_word": b, "score": s} for a, b, s in segs] for _, segs in found],
                             pa.list_(pa.struct([("first_word", pa.int64()), ("end_word", pa.int64()), ("score", pa.float64())])))
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + [pa.array(m.curve[bins.astype(int)]), spots],
                                             names=[*names, "score", "passages"])

    out = docs.select(*names, F.col("text").alias("__text")).mapInArrow(
        score, f"{kinds}, score double, passages array<struct<first_word: long, end_word: long, score: double>>")
    return out.withColumn("predicted", F.expr(f"if(score >= {threshold}, 1, 0)")).withColumn(
        "held_out", F.expr("coalesce(crc32(cast(doc_id as string)) % 3 = 1, false)"))
