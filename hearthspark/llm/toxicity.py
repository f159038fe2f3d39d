"""Toxicity by class-conditional Kneser-Ney models of the letters of words.

A word is read byte by byte behind a leading space, lowered. The highest order (ORDER bytes) is counted by class
from labelled rows; what is backed off to (n-grams of SHORTER bytes) is one set of continuation counts that both
classes share, gathered from all documents. So a rare expression falls back on the same probability under either class and tells the classes
apart only by what each has really seen:

    P_c(b | h) = (max(n_c(h b) - D, 0) + D * N_c(h) * P(b | h')) / n_c(h)

with n_c the counts of class c, N_c(h) the number of different bytes that class c has seen after h, and P the
shared Kneser-Ney estimate after a shorter context h'. The log ratio of the two classes is summed
over the bytes of a word, r. A text gives the length-normalised difference of its log-likelihoods, the ratio of its
most telling word, and, as most words of a toxic text are ordinary ones, the log-likelihood ratio of a mixture,
the sum of log(1 - q + q e^r) with q = OWN_WORDS, whole and by word, and the number and share of the words whose
ratio is clear. A logistic regression on labelled rows that
were not counted turns these into a probability.

Counts, contexts and shared estimates are tables and stay tables. Scoring needs the log ratios only, and all of them:
up to SENT_RATIOS they are sent to the tasks as sorted keys, beyond that they stay tables, too; the distinct words of
the texts are then rated by joins with them, and word ratios are joined back to the texts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthspark.llm.common import batches, text_key, written
from hearthspark.llm.hashing import mix

ORDER = 8
#: Bytes of the n-grams that are backed off to, and whose counts the classes share.
SHORTER = 5, 3, 1
DISCOUNT = 0.75
#: Log ratios, of n-grams and contexts together, up to which they are sent to all tasks (12 bytes each).
SENT_RATIOS = 1 << 22
#: Share of the words of a toxic text that are taken to be of its class; the others are ordinary words.
OWN_WORDS = 0.02
#: A word whose log ratio is above this speaks for the toxic class.
CLEAR = 3.0
#: Labelled rows that the logistic regression is fitted on at most; if there are more, those of the smallest hashes.
FIT_ROWS = 50_000
#: Labels are sent to all tasks up to this many rows (16 bytes each), and joined by a shuffle beyond.
SENT_LABELS = 1 << 20
#: Different n-grams that a task holds before it passes its counts on.
HELD = 1 << 20
FEATURES = ["mean_ratio", "top_word", "mixed_sum", "mixed_mean", "clear_words", "clear_share"]

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[9:14] = 32
_LOWER[33:48] = 32
_LOWER[58:65] = 32
_LOWER[91:97] = 32
_LOWER[123:127] = 32
_LOWER[48:58] = 48


def ngrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each byte of a word: its n-gram as a number, the index of its word, the index of the word's text.

    Lowered ASCII; digits count as one, punctuation parts words. Bytes before the space in front of a word are 0.
    """
    raw = _LOWER[np.frombuffer(b" ".join([b"", *texts]), dtype=np.uint8)]
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    text = np.repeat(np.arange(len(texts)), sizes + 1)
    letter = raw != 32
    word_start = letter.copy()
    word_start[1:] &= ~letter[:-1]
    at = np.flatnonzero(letter)
    word = np.cumsum(word_start)[at] - 1
    starts = np.flatnonzero(word_start)
    place = at - starts[word]
    keys = raw[at].astype(np.int64)
    for back in range(1, ORDER):
        before = raw[np.maximum(at - back, 0)].astype(np.int64)
        keys |= np.where(place >= back - 1, before, 0) << (8 * back)
    return keys, word, text[starts] if len(starts) else np.empty(0, dtype=np.int64)


def _suffix(key: str, size: int) -> Column:
    """The last bytes of an n-gram."""
    return F.col(key).bitwiseAND(F.lit((1 << 8 * size) - 1))


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([k for k, _ in parts])
    counts = np.concatenate([c for _, c in parts])
    found, inverse = np.unique(keys, return_inverse=True)
    return found, np.stack([np.bincount(inverse, weights=counts[:, i], minlength=len(found)) for i in (0, 1)], axis=1)


def _count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, toxic, ordinary) summed up over the texts of a task; label: 1, 0 or null."""

    def out(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        columns = [keys, *(counts[:, i].astype(np.int64) for i in (0, 1))]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "toxic", "ordinary"])

    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for batch in rows:
        labels = batch.column("label").to_pylist()
        for first, texts in batches(batch.column("text")):
            keys, word, owner = ngrams(texts)
            classes = np.array([-1 if x is None else x for x in labels[first : first + len(texts)]], dtype=np.int64)
            own = classes[owner[word]] if len(keys) else np.empty(0, dtype=np.int64)
            found, inverse = np.unique(keys, return_inverse=True)
            n = len(found)
            counts = [np.bincount(inverse, weights=own == 1, minlength=n), np.bincount(inverse, weights=own == 0, minlength=n)]
            held.append((found, np.stack(counts, axis=1)))
            size += n
            if size > HELD:
                held = [_merge(held)]
                size = len(held[0][0])
                if size > HELD // 2:
                    yield out(*held.pop())
                    size = 0
    if held:
        yield out(*_merge(held))


def gather(docs: DataFrame, text: str, label: str) -> DataFrame:
    """(key, toxic, ordinary) of every n-gram of the highest order in all documents."""
    rows = docs.select(F.col(text).alias("text"), F.col(label).cast("int").alias("label"))
    counted = rows.mapInArrow(_count, "key long, toxic long, ordinary long")
    return counted.groupBy("key").agg(*(F.sum(c).alias(c) for c in ("toxic", "ordinary")))


def shared_estimates(grams: DataFrame) -> DataFrame:
    """(key, shared): the Kneser-Ney estimate of the last byte of every n-gram of the longest shorter size.

    The count of a shorter n-gram is the number of different n-grams of the next longer size that end with it.
    The estimates are built up from single bytes; those back off to an even distribution over 256.
    """
    types, levels = grams.select("key"), []
    for size in SHORTER:
        levels.append(types.groupBy(_suffix("key", size).alias("key")).agg(F.count("*").alias("n")))
        levels[-1] = written(levels[-1], f"continuations-{size}")
        types = levels[-1].select("key")
    estimate, before = None, 0
    for size, level in zip(reversed(SHORTER), reversed(levels), strict=True):
        level = level.withColumn("context", F.shiftright("key", 8))
        seen = level.groupBy("context").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
        joined, below = level.join(seen, "context"), F.lit(1.0 / 256)
        if before:
            shorter = estimate.select(F.col("key").alias("short"), F.col("shared").alias("below"))
            joined, below = joined.withColumn("short", _suffix("key", before)).join(shorter, "short"), F.col("below")
        shared = (F.col("n") - DISCOUNT + DISCOUNT * F.col("kinds") * below) / F.col("total")
        estimate, before = joined.select("key", shared.alias("shared")), size
    return estimate


def log_ratios(grams: DataFrame, shared: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, ratio) of n-grams that a class has seen, and (key, ratio) for others after a context, which is the key."""
    labelled = grams.filter("toxic + ordinary > 0").withColumn("context", F.shiftright("key", 8))
    totals = [F.sum(c).alias(f"{c}_total") for c in ("toxic", "ordinary")]
    kinds = [F.sum((F.col(c) > 0).cast("long")).alias(f"{c}_kinds") for c in ("toxic", "ordinary")]
    contexts = written(labelled.groupBy("context").agg(*totals, *kinds), "contexts")

    def left(c: str) -> Column:
        return F.when(F.col(f"{c}_total") > 0, DISCOUNT * F.col(f"{c}_kinds") / F.col(f"{c}_total")).otherwise(1.0)

    def chance(c: str) -> Column:
        seen = F.greatest(F.col(c) - DISCOUNT, F.lit(0.0)) / F.col(f"{c}_total")
        return F.when(F.col(f"{c}_total") > 0, seen).otherwise(0.0) + left(c) * F.col("shared")

    rated = (
        labelled.join(contexts, "context")
        .withColumn("short", _suffix("key", SHORTER[0]))
        .join(shared.select(F.col("key").alias("short"), "shared"), "short")
        .select("key", F.log(chance("toxic") / chance("ordinary")).cast("float").alias("ratio"))
    )
    alone = contexts.select(
        F.col("context").alias("key"), F.log(left("toxic") / left("ordinary")).cast("float").alias("ratio")
    )
    return rated, alone


class Table:
    """Log ratios by key, all of them.

    A key is looked for in the slot of its hash; keys that lost their slot to another are searched for in order. Only
    keys and ratios are sent; slots are made where they are used.
    """

    def __init__(self, keys: np.ndarray, ratio: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.ratio = keys[order], ratio[order]
        self._place()

    def __getstate__(self):
        return self.keys, self.ratio

    def __setstate__(self, state):
        self.keys, self.ratio = state
        self._place()

    def _place(self) -> None:
        n = len(self.keys)
        self.bits = max(n, 1).bit_length() + 1
        own = self._slots(self.keys)
        self.slot = np.full(1 << self.bits, -1, dtype=np.int32)
        self.slot[own] = np.arange(n, dtype=np.int32)
        self.others = np.flatnonzero(self.slot[own] != np.arange(n))
        self.crowded = np.zeros(1 << self.bits, dtype=bool)
        self.crowded[own[self.others]] = True

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys.astype(np.uint64), 11) >> np.uint64(64 - self.bits)).astype(np.int64)

    def look(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each key is held, and its ratio."""
        if not len(self.keys):
            return np.zeros(len(keys), dtype=bool), np.zeros(len(keys), dtype=np.float32)
        at = self._slots(keys)
        place = self.slot[at]
        held = (place >= 0) & (self.keys[place] == keys)
        rest = np.flatnonzero(~held & self.crowded[at])
        if len(rest):
            found = np.minimum(np.searchsorted(self.keys[self.others], keys[rest]), len(self.others) - 1)
            place[rest] = self.others[found]
            held[rest] = self.keys[place[rest]] == keys[rest]
        return held, self.ratio[place]


def _table(rated: DataFrame) -> Table:
    found = rated.toArrow()
    return Table(found["key"].to_numpy(), found["ratio"].to_numpy())


def features(texts: list[bytes], grams: Table, contexts: Table) -> np.ndarray:
    """FEATURES of each text; a text without words has zeros."""
    keys, word, owner = ngrams(texts)
    out = np.zeros((len(texts), len(FEATURES)))
    if not len(keys):
        return out
    held, ratio = grams.look(keys)
    rest = np.flatnonzero(~held)
    known, alone = contexts.look(keys[rest] >> 8)
    ratio = ratio.astype(np.float64)
    ratio[rest] = np.where(known, alone, 0.0)
    by_word = np.bincount(word, weights=ratio, minlength=len(owner))
    mixed = np.log1p(OWN_WORDS * np.expm1(np.clip(by_word, -20, 20)))
    letters = np.maximum(np.bincount(owner[word], minlength=len(texts)), 1)
    words = np.maximum(np.bincount(owner, minlength=len(texts)), 1)
    top = np.full(len(texts), -np.inf)
    np.maximum.at(top, owner, by_word)
    total = np.bincount(owner, weights=mixed, minlength=len(texts))
    out[:, 0] = np.bincount(owner[word], weights=ratio, minlength=len(texts)) / letters
    out[:, 1] = np.where(np.isfinite(top), top, 0.0)
    out[:, 2] = np.clip(total, -20, 20)
    out[:, 3] = total / words
    clears = np.bincount(owner, weights=by_word > CLEAR, minlength=len(texts))
    out[:, 4] = np.log1p(clears)
    out[:, 5] = clears / words
    return out


@dataclass
class Model:
    """The log ratios of n-grams and contexts, sent to the tasks or as two tables, and the regression on FEATURES."""

    ratios: Broadcast | tuple[DataFrame, DataFrame]
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    offset: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        z = ((x - self.mean) / self.spread) @ self.weights + self.offset
        return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def _regression(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression with a small ridge, by Newton's method."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    ridge = np.full(len(w), 0.1)
    ridge[-1] = 1e-3
    for _ in range(50):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ w, -40, 40)))
        slope = x.T @ (y - p) - ridge * w
        bend = (x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        move = np.linalg.solve(bend, slope)
        w += move
        if np.abs(move).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def _features_column(text: Column, sent: Broadcast) -> Column:
    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def rate(text: pa.Array) -> pa.Array:
        parts = [features(some, *sent.value) for _, some in batches(text)]
        flat = np.concatenate(parts).ravel() if parts else np.empty(0)
        ends = np.arange(0, len(text) * len(FEATURES) + 1, len(FEATURES), dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, type=pa.float64()))

    return rate(text)


_WORDS = bytes(_LOWER)


def _words(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, word, n): the words of each text as ``ngrams`` reads them, and how often."""
    for batch in rows:
        for first, texts in batches(batch.column("body")):
            found = [Counter(w for w in t.translate(_WORDS).split(b" ") if w) for t in texts]
            owner = np.repeat(np.arange(len(texts)), [len(f) for f in found]) + first
            words, n = [w for f in found for w in f], [k for f in found for k in f.values()]
            columns = [batch.column("text").take(pa.array(owner)), pa.array(words, type=pa.binary()), pa.array(n, type=pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["text", "word", "n"])


def _word_grams(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, key, n): the n-grams of each word, and how often."""
    for batch in rows:
        for first, words in batches(batch.column("word")):
            keys, _, _ = ngrams(words)
            owner = np.repeat(np.arange(len(words)), [len(w) for w in words])
            order = np.lexsort((keys, owner))
            keys, owner = keys[order], owner[order]
            fresh = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])])[: len(keys)])
            n = np.diff(np.concatenate([fresh, [len(keys)]]))
            columns = [batch.column("word").take(pa.array(owner[fresh] + first)), pa.array(keys[fresh]), pa.array(n)]
            yield pa.RecordBatch.from_arrays(columns, names=["word", "key", "n"])


def joined_features(docs: DataFrame, text: str, rated: DataFrame, alone: DataFrame) -> DataFrame:
    """``docs`` with FEATURES as the array ``__x``: distinct words are rated by joins, then joined back to the texts."""
    keyed = docs.withColumn("__key", text_key(F.col(text)))
    rows = keyed.select(F.col("__key").alias("text"), F.col(text).alias("body")).dropDuplicates(["text"])
    words = written(rows.mapInArrow(_words, "text binary, word binary, n long"), "words")
    grams = words.select("word").distinct().mapInArrow(_word_grams, "word binary, key long, n long")
    grams = written(grams, "word-grams")
    keys = grams.select("key", F.shiftright("key", 8).alias("context")).distinct()
    ratios = keys.join(rated, "key", "left").join(
        alone.select(F.col("key").alias("context"), F.col("ratio").alias("below")), "context", "left"
    )
    ratios = ratios.select("key", F.coalesce("ratio", "below", F.lit(0.0)).cast("double").alias("ratio"))
    by_word = grams.join(ratios, "key").groupBy("word").agg(F.sum(F.expr("n * ratio")).alias("r"))
    mixed = F.log1p(OWN_WORDS * F.expm1(F.greatest(F.least("r", F.lit(20.0)), F.lit(-20.0))))
    by_text = words.join(by_word, "word").groupBy("text").agg(
        F.sum(F.expr("n * r")).alias("total"),
        F.sum(F.col("n") * F.octet_length("word")).alias("letters"),
        F.sum("n").alias("words"),
        F.max("r").alias("top"),
        F.sum(F.col("n") * mixed).alias("mixed"),
        F.sum(F.when(F.col("r") > CLEAR, F.col("n")).otherwise(0)).cast("double").alias("clears"),
    )
    x = F.array(
        F.expr("total / letters"), "top", F.greatest(F.least("mixed", F.lit(20.0)), F.lit(-20.0)),
        F.expr("mixed / words"), F.log1p("clears"), F.expr("clears / words"),
    )
    found = by_text.select(F.col("text").alias("__key"), x.alias("__x"))
    nothing = F.array(*(F.lit(0.0) for _ in FEATURES))
    return keyed.join(found, "__key", "left").withColumn("__x", F.coalesce("__x", nothing)).drop("__key")


def with_features(docs: DataFrame, text: str, ratios: Broadcast | tuple[DataFrame, DataFrame]) -> DataFrame:
    """``docs`` with FEATURES as the array ``__x``."""
    if isinstance(ratios, tuple):
        return joined_features(docs, text, *ratios)
    return docs.withColumn("__x", _features_column(F.col(text), ratios))


def with_labels(docs: DataFrame, labels: DataFrame, doc_id: str, label: str) -> DataFrame:
    """``docs`` with the label of each doc_id as ``__label`` (the largest where there are several), or null."""
    one = labels.filter(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("__id")).agg(F.max(label).alias("__label"))
    one = written(one, "labels")
    if one.count() <= SENT_LABELS:
        one = F.broadcast(one)
    return docs.join(one, F.col(doc_id) == F.col("__id"), "left").drop("__id")


def fold(doc_id: Column) -> Column:
    """0 to 4, by the crc32 of doc_id as text; a null doc_id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic") -> Model:
    """Learn from the labels of rows whose fold is not 0: folds 1 to 3 are counted, fold 4 sets the weights.

    Shared counts come from the texts of all documents. Null labels, and labels of unknown documents, are left
    out. If either class is missing in a part, every text scores the share of toxic labels among those learned.
    """
    rows = with_labels(docs.select(F.col(doc_id), F.col(text)), labels, doc_id, label)
    part = fold(F.col(doc_id))
    counted = rows.withColumn("__label", F.when(part.isin(1, 2, 3), F.col("__label")))
    grams = written(gather(counted, text, "__label"), "grams")
    rated, alone = log_ratios(grams, shared_estimates(grams))
    if grams.filter("toxic + ordinary > 0").count() + alone.count() <= SENT_RATIOS:
        ratios = docs.sparkSession.sparkContext.broadcast((_table(rated), _table(alone)))
    else:
        ratios = written(rated, "ratios"), written(alone, "context-ratios")
    sample = rows.filter((part == 4) & F.col("__label").isNotNull())
    many = sample.count()
    if many > FIT_ROWS:
        share = int(FIT_ROWS / many * (1 << 31))
        sample = sample.filter(F.pmod(F.xxhash64(F.col(doc_id)), F.lit(1 << 31)) < share)
    got = with_features(sample, text, ratios).select(F.col("__x").alias("x"), F.col("__label").alias("y")).toArrow()
    y = got["y"].to_numpy().astype(np.float64)
    x = np.array(got["x"].to_pylist(), dtype=np.float64).reshape(-1, len(FEATURES))
    if len(set(y.tolist())) < 2:
        share = float(np.clip(y.mean() if len(y) else 0.0, 1e-6, 1 - 1e-6))
        zeros = np.zeros(len(FEATURES))
        return Model(ratios, zeros, zeros + 1, zeros, float(np.log(share / (1 - share))))
    mean, spread = x.mean(0), np.maximum(x.std(0), 1e-9)
    weights, offset = _regression((x - mean) / spread, y)
    return Model(ratios, mean, spread, weights, offset)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``toxicity`` (0 to 1), from the text alone.

    Null and empty texts, and texts without letters, score what no evidence gives. A column of that name is
    replaced; all others are kept; rows that repeat stay.
    """

    if isinstance(model.ratios, tuple):
        terms = zip(model.mean.tolist(), model.spread.tolist(), model.weights.tolist(), strict=True)
        z = F.lit(model.offset)
        for i, (mean, spread, weight) in enumerate(terms):
            z = z + (F.col("__x")[i] - mean) / spread * weight
        chance = 1.0 / (1.0 + F.exp(-F.greatest(F.least(z, F.lit(40.0)), F.lit(-40.0))))
        return with_features(docs, text, model.ratios).withColumn("toxicity", chance).drop("__x")

    @F.arrow_udf(T.DoubleType())
    def rate(text: pa.Array) -> pa.Array:
        parts = [model.probability(features(some, *model.ratios.value)) for _, some in batches(text)]
        return pa.array(np.concatenate(parts) if parts else np.empty(0), type=pa.float64())

    return docs.withColumn("toxicity", rate(F.col(text)))
