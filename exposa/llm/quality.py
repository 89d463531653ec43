"""Quality classifier by importance resampling (op 7).

Two generative models over hashed word uni- and bigrams (a word after itself counts as one common
bigram "repeat"): the target's, from labelled documents of good quality, and the raw text's, from all
documents. A document's weight is the logarithm of the ratio of the two models' probabilities of its
n-grams, over the square root of their number, which puts short and long texts on one scale.
Resampling without replacement is the Gumbel top-k: a document's key is its weight over ``TEMPERATURE``
plus Gumbel noise fixed by its doc_id and text, and the k documents of largest keys are sampled. k is
the number of documents whose weight reaches a threshold learned from the labels, so the noise decides
only near the border.

The labels used are at most ``LABELLED`` (those of smallest hash): one half fits the target model, the other
half the threshold, so that its weights are those of unseen documents. The raw model counts every document. The models are vectors of 2**``BITS`` counts added up on the executors.

Defined results: a null text is the empty text, of weight 0; labels that contradict each other count as
bad, null labels not at all; without a good and a bad label all documents stay; documents whose key equals
the k-th are all sampled; a null doc_id takes part; repeated rows share their key; an empty table gives an
empty result; other columns are ignored by ``score`` and kept by ``keep_good``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from exposa.llm.common import batch, in_batches, materialize, sample_by_hash, text_of

BITS = 16
LABELLED = 20_000
SMOOTHING = 1.0
TEMPERATURE = 0.05
#: Cost of losing a good document, in bad documents kept.
GOOD_COST = 10.0
#: Words a worker remembers the hashes of.
MEMORY = 150_000
# Odd multipliers that spread the bits of a pair of hashes.
_MIX1, _MIX2, _REPEAT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x3039 << 48)


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        h = xxhash.xxh64_intdigest(word.encode())
        if len(self) < MEMORY:
            self[word] = h
        return h


_HASHES = _Hashes()


def features(text: str) -> np.ndarray:
    """Bucket of each word and of each pair of neighbours, lower-cased."""
    words = text.lower().split()
    one = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    two = (one[:-1] * _MIX1 ^ one[1:] >> np.uint64(7)) * _MIX2
    two[one[:-1] == one[1:]] = _REPEAT
    return (np.concatenate([one, two]) >> np.uint64(64 - BITS)).astype(np.int64)


def sample_labels(labels: DataFrame) -> dict[int, int]:
    """doc_id -> quality of at most LABELLED labelled documents."""
    known = (labels.where("doc_id is not null and quality is not null")
             .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality")))
    rows = sample_by_hash(known, LABELLED, "doc_id").collect()
    return {r["doc_id"]: int(r["quality"]) for r in rows}


def fits_model(doc_id: int) -> bool:
    """Whether a labelled document is in the half that fits the target model."""
    return xxhash.xxh64_intdigest(str(doc_id), seed=1) % 2 == 0


def fit(documents: DataFrame, labels: dict[int, int]) -> np.ndarray:
    """Log-ratio of target to raw probability for each bucket."""
    good = {d for d, q in labels.items() if q > 0 and fits_model(d)}
    size = 1 << BITS
    schema = pa.schema([("bucket", pa.int32()), ("target", pa.int64()), ("raw", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, raw = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for rows in batches:
            for doc_id, text in zip(rows.column("doc_id").to_pylist(), rows.column("text").to_pylist()):
                n = np.bincount(features(text), minlength=size)
                raw += n
                if doc_id in good:
                    target += n
        used = np.flatnonzero(raw)
        for at in range(0, len(used), 10_000):
            u = used[at:at + 10_000]
            yield batch(schema, {"bucket": u.astype(np.int32), "target": target[u], "raw": raw[u]})

    sums = (in_batches(_inputs(documents), count, "bucket int, target long, raw long")
            .groupBy("bucket").agg(F.sum("target").alias("target"), F.sum("raw").alias("raw")).toPandas())
    target, raw = np.zeros(size), np.zeros(size)
    target[sums["bucket"]], raw[sums["bucket"]] = sums["target"], sums["raw"]
    return (np.log((target + SMOOTHING) / (target.sum() + SMOOTHING * size))
            - np.log((raw + SMOOTHING) / (raw.sum() + SMOOTHING * size))).astype(np.float32)


def weight(ratio: np.ndarray, text: str) -> float:
    f = features(text)
    return float(ratio[f].sum(dtype=np.float64)) / math.sqrt(len(f)) if len(f) else 0.0


def gumbel(doc_id: int | None, text: str) -> float:
    u = (xxhash.xxh64_intdigest(text.encode(), seed=(doc_id or 0) & 0xFFFFFFFF) + 0.5) / 2.0**64
    return -math.log(-math.log(min(max(u, 1e-300), 1 - 1e-16)))


def threshold(weights: list[tuple[float, int]]) -> float:
    """The weight that costs least on (weight, quality) pairs; the middle of the best gap."""
    pairs = sorted(weights)
    if not any(q > 0 for _, q in pairs) or all(q > 0 for _, q in pairs):
        return -math.inf
    cost = float(sum(q <= 0 for _, q in pairs))  # all kept
    best, cuts = cost, [-math.inf]
    for i, (w, q) in enumerate(pairs):  # what lies up to i goes
        cost += GOOD_COST if q > 0 else -1.0
        after = pairs[i + 1][0] if i + 1 < len(pairs) else w + 1.0
        if after > w and cost <= best:
            cuts = [(w + after) / 2] if cost < best else [*cuts, (w + after) / 2]
            best = cost
    return cuts[len(cuts) // 2]


def kth_largest(rows: DataFrame, column: str, k: int, bins: int = 4096, few: int = 5000) -> float:
    """The k-th largest value of a finite column, by counting in ever finer bins: only ``bins``
    counts and at last ``few`` values reach the driver."""
    lo, hi = rows.agg(F.min(column), F.max(column)).first()
    inside = rows.select(column)
    while lo < hi:
        width = (hi - lo) / bins
        if width <= 0 or lo + width == lo:
            break
        bin_of = F.least(F.floor((F.col(column) - F.lit(lo)) / F.lit(width)), F.lit(bins - 1))
        counts = dict(inside.groupBy(bin_of.alias("bin")).count().collect())
        for b in sorted(counts, reverse=True):
            if k <= counts[b]:
                break
            k -= counts[b]
        inside = inside.where(bin_of == b)
        if counts[b] <= few:
            return inside.orderBy(F.col(column).desc()).limit(k).agg(F.min(column)).first()[0]
        lo, hi = inside.agg(F.min(column), F.max(column)).first()
    return lo


def _scores(documents: DataFrame, labels: DataFrame) -> tuple[np.ndarray, DataFrame, float]:
    known = sample_labels(labels)
    ratio = fit(documents, known)
    schema = pa.schema([("doc_id", pa.int64()), ("weight", pa.float64()), ("key", pa.float64()), ("quality", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            ids, texts = rows.column("doc_id").to_pylist(), rows.column("text").to_pylist()
            w = [weight(ratio, t) for t in texts]
            yield batch(schema, {"doc_id": ids, "weight": w, "key": [key(x, d, t) for x, d, t in zip(w, ids, texts)],
                                 "quality": [known.get(d) for d in ids]})

    scored = materialize(in_batches(_inputs(documents), run, "doc_id long, weight double, key double, quality int"))
    labelled = scored.where("quality is not null").groupBy("doc_id").agg(F.min("weight"), F.min("quality")).collect()
    least = threshold([(w, q) for d, w, q in labelled if not fits_model(d)])
    k = scored.where(F.col("weight") >= F.lit(least)).count()
    cut = -math.inf if least == -math.inf else kth_largest(scored, "key", k) if k else math.inf
    return ratio, scored, cut


def key(weight: float, doc_id: int | None, text: str) -> float:
    return weight / TEMPERATURE + gumbel(doc_id, text)


def score(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, weight, key, kept."""
    _, scored, cut = _scores(documents, labels)
    return scored.select("doc_id", "weight", "key", (F.col("key") >= F.lit(cut)).alias("kept"))


def keep_good(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The sampled documents with all their columns."""
    ratio, _, cut = _scores(documents, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            ids = rows.column("doc_id").cast(pa.int64()).to_pylist()
            keep = [key(weight(ratio, t or ""), d, t or "") >= cut
                    for d, t in zip(ids, rows.column("text").to_pylist())]
            yield rows.filter(pa.array(keep, type=pa.bool_()))

    return in_batches(documents, run, documents.schema)


def _inputs(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
