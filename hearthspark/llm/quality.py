"""Importance resampling: which texts look drawn from the target, sampled without replacement.

Texts are bags of words and word pairs, hashed to BUCKETS values. Two generative models, bucket frequencies of the
target (documents labelled good) and of the raw corpus (all documents), give every text the log of its importance
weight: the mean over its n-grams of the log ratio of the two, times TEMPER. The mean and not the sum, because
a sum grows with length and length would decide alone. Gumbel noise is added to it, and the k largest sums are a
sample of k documents without replacement with chances in proportion to the weights (Gumbel top-k). The k-th
largest sum is found exactly, by narrowing counts, so that no task or driver sees all sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthspark.llm.common import batches, doc_key, written
from hearthspark.llm.hashing import P1, Words, mix, xxh64_spans
from hearthspark.llm.toxicity import fold, with_labels

#: Hash values of n-grams, as a power of two, and what is added to every count.
BUCKETS = 16
ADDED = 0.5
#: Weight of a text's mean log ratio against the noise.
TEMPER = 20.0
#: Share of all documents that is drawn.
SHARE = 0.5
SEED = 7
#: Bins of a narrowing step, and values from which on they are simply sorted.
BINS, FEW = 1024, 10_000


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Text and bucket of every word and every pair of neighbouring words, lowered."""
    words = Words([t.lower() for t in texts])
    one = xxh64_spans(words.buf, words.start, words.end - words.start)
    pair = np.flatnonzero(words.text[1:] == words.text[:-1])
    with np.errstate(over="ignore"):
        two = mix(one[pair] * P1 + one[pair + 1], 3)
    bucket = (mix(np.concatenate([one, two]), 9) >> np.uint64(64 - BUCKETS)).astype(np.int64)
    return np.concatenate([words.text, words.text[pair]]), bucket


def _counts(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, target, raw) summed up over the texts of a task."""
    raw, target = np.zeros(1 << BUCKETS, dtype=np.int64), np.zeros(1 << BUCKETS, dtype=np.int64)
    for batch in rows:
        good = np.array([x == 1 for x in batch.column("label").to_pylist()], dtype=bool)
        for first, texts in batches(batch.column("text")):
            text, bucket = grams(texts)
            raw += np.bincount(bucket, minlength=1 << BUCKETS)
            target += np.bincount(bucket[good[first + text]], minlength=1 << BUCKETS)
    at = np.flatnonzero(raw)
    columns = [pa.array(x) for x in (at, target[at], raw[at])]
    yield pa.RecordBatch.from_arrays(columns, names=["bucket", "target", "raw"])


@dataclass
class Model:
    """The log ratio of target and raw frequency of each bucket."""

    ratio: np.ndarray


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality") -> Model:
    """Raw frequencies from all documents, those of the target from documents labelled 1 whose fold is not 0.

    Without such documents, or without documents, all weights are equal.
    """
    rows = with_labels(docs.select(F.col(doc_id), F.col(text)), labels, doc_id, label)
    target = F.when(fold(F.col(doc_id)) != 0, F.col("__label")).cast("int")
    parts = rows.select(F.col(text).alias("text"), target.alias("label")).mapInArrow(
        _counts, "bucket long, target long, raw long"
    )
    found = parts.groupBy("bucket").agg(F.sum("target"), F.sum("raw")).collect()
    target, raw = np.zeros(1 << BUCKETS), np.zeros(1 << BUCKETS)
    for at, t, r in found:
        target[at], raw[at] = t, r
    if not target.sum():
        return Model(np.zeros(1 << BUCKETS))
    share = [np.log((x + ADDED) / (x + ADDED).sum()) for x in (target, raw)]
    return Model(share[0] - share[1])


def weigh(docs: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with ``log_weight`` and ``noisy_weight``, which has Gumbel noise drawn by a hash of doc_id and text.

    A text without words weighs 0. Rows that repeat doc_id and text get the same noise.
    """

    @F.arrow_udf(T.DoubleType())
    def weight(text: pa.Array) -> pa.Array:
        out = []
        for _, some in batches(text):
            owner, bucket = grams(some)
            total = np.bincount(owner, weights=model.ratio[bucket], minlength=len(some))
            out.append(TEMPER * total / np.maximum(np.bincount(owner, minlength=len(some)), 1))
        return pa.array(np.concatenate(out) if out else np.empty(0), type=pa.float64())

    even = (F.pmod(F.xxhash64(F.lit(SEED), doc_key(F.col(doc_id), F.col(text))), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    weighed = docs.withColumn("log_weight", weight(F.col(text)))
    return weighed.withColumn("noisy_weight", F.col("log_weight") - F.log(-F.log(even)))


def kth_largest(rows: DataFrame, value: str, k: int) -> float:
    """The exact k-th largest value, from counts of ever narrower bins."""
    low, high = rows.agg(F.min(value), F.max(value)).first()
    above = 0
    while True:
        inside = rows.filter(F.col(value).between(low, high))
        width = (high - low) / BINS
        if width <= 0 or low + width == low:
            return high if low == high else _sorted_kth(inside, value, k - above)
        at = F.least(F.floor((F.col(value) - low) / width), F.lit(BINS - 1))
        bins = inside.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.min(value).alias("a"), F.max(value).alias("b"))
        for found in sorted(bins.collect(), key=lambda r: -r.bin):
            if above + found.n >= k:
                break
            above += found.n
        low, high = found.a, found.b
        if found.n <= FEW:
            return _sorted_kth(rows.filter(F.col(value).between(low, high)), value, k - above)


def _sorted_kth(rows: DataFrame, value: str, k: int) -> float:
    return rows.select(value).orderBy(F.desc(value)).limit(k).agg(F.min(value)).first()[0]


def resample(
    docs: DataFrame, model: Model, share: float = SHARE, text: str = "text", doc_id: str = "doc_id"
) -> DataFrame:
    """``docs`` without its text, with ``log_weight``, ``noisy_weight`` and ``selected``, for the k = share of rows drawn.

    Rows that tie with the k-th largest noisy weight, which are repeated ones, are all selected. Columns of these
    names are replaced, all others kept; no rows give no rows.
    """
    own = [c for c in docs.columns if c not in (text, "log_weight", "noisy_weight", "selected")]
    weighed = written(weigh(docs, model, text, doc_id).select(*own, "log_weight", "noisy_weight"), "weights")
    k = round(weighed.count() * share)
    least = kth_largest(weighed, "noisy_weight", k) if k else None
    chosen = F.lit(False) if least is None else F.col("noisy_weight") >= F.lit(least)
    return weighed.withColumn("selected", chosen)
