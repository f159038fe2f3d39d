"""Language of texts by the nearest of several centroids per language.

A text is a vector of the counts of its letter n-grams (1 to GRAMS bytes of words, hashed to BUCKETS), damped by a
logarithm, weighted by inverse document frequency and scaled to length 1. The document frequencies come from all
documents. For every language the vectors of labelled rows are clustered by spherical k-means; a text gets the
language of the centroid with the largest cosine, and its distance from it, one minus the cosine. A text farther
from its centroid than nearly all rows of that cluster (REACH times the cluster's widest usual distance) is
rejected as none of the languages.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthspark.llm.common import batches
from hearthspark.llm.hashing import P1

GRAMS = 3
#: Hash values of n-grams, as a power of two.
BUCKETS = 13
CENTROIDS = 4
ROUNDS = 10
#: Labelled rows that centroids are fitted on at most, even by language: those of the smallest hashes.
FIT_ROWS = 6000
#: The widest usual distance is this quantile of a cluster's rows; rejection begins at REACH times it.
USUAL, REACH = 0.99, 1.25
#: Differences of cosines are multiplied by it before they become shares, the score.
SHARP = 20.0
UNKNOWN = "und"
#: Texts of one vectorised step at most.
TOGETHER = 256

_LETTER = regex.compile(r"\p{L}")
#: Lowered ASCII letters and bytes from 128 on; the rest parts words.
_PLAIN = bytes(b + 32 if 65 <= b < 91 else b if 97 <= b < 123 or b >= 128 else 32 for b in range(256))


def counts(texts: list[bytes]) -> np.ndarray:
    """(text, bucket): the counts of the n-grams of words, the space on either side of a word included."""
    plain = [t.translate(_PLAIN) for t in texts]
    raw = np.frombuffer(b" " + b" ".join(plain) + b" " * GRAMS, dtype=np.uint8)
    n = len(raw) - GRAMS
    owner = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in plain])
    owner = np.concatenate([owner[:1], owner, owner[-1:]])[:n]
    letter = raw != 32
    out = np.zeros(len(texts) << BUCKETS)
    gram = np.zeros(n, dtype=np.uint64)
    inside = np.ones(n, dtype=bool)
    for size in range(1, GRAMS + 1):
        gram = (gram << np.uint64(8)) | raw[size - 1 : size - 1 + n]
        inside &= letter[size - 2 : size - 2 + n] if size > 2 else True
        at = np.flatnonzero(inside & ((letter[:n] | letter[size - 1 : size - 1 + n]) if size > 1 else letter[:n]))
        with np.errstate(over="ignore"):
            bucket = ((gram[at] + np.uint64(size << 56)) * P1) >> np.uint64(64 - BUCKETS)
        out += np.bincount((owner[at] << BUCKETS) + bucket.astype(np.int64), minlength=len(out))
    return out.reshape(len(texts), 1 << BUCKETS)


def vectors(texts: list[bytes], idf: np.ndarray) -> np.ndarray:
    """Unit vectors of texts; a text without letters is zero."""
    many = counts(texts)
    out = (np.log1p(many) * idf).astype(np.float32)
    length = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(length > 0, length, 1)


def _steps(texts: pa.Array) -> Iterator[list[bytes]]:
    for _, some in batches(texts):
        for i in range(0, len(some), TOGETHER):
            yield some[i : i + TOGETHER]


def _frequencies(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many texts of a task each bucket is; under bucket -1, the number of texts."""
    seen, texts = np.zeros(1 << BUCKETS, dtype=np.int64), 0
    for batch in rows:
        for some in _steps(batch.column("text")):
            seen += (counts(some) > 0).sum(0)
            texts += len(some)
    at = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.append(at, -1)), pa.array(np.append(seen[at], texts))], names=["bucket", "n"]
    )


def inverse_frequencies(docs: DataFrame, text: str) -> np.ndarray:
    """The weight of each bucket, from all rows given."""
    rows = docs.select(F.col(text).alias("text")).mapInArrow(_frequencies, "bucket long, n long")
    found = dict(map(tuple, rows.groupBy("bucket").agg(F.sum("n")).collect()))
    texts = found.pop(-1, 0)
    seen = np.zeros(1 << BUCKETS)
    seen[list(found)] = list(found.values())
    return np.log((texts + 1) / (seen + 1)) + 1e-3


@dataclass
class Model:
    """Languages in order; centroids, with the language and the widest usual distance of each."""

    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray
    usual: np.ndarray


def _cluster(x: np.ndarray, k: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Centroids of unit vectors and the cluster of each; the first centroids are far apart."""
    pick = np.random.default_rng(seed)
    centres = [x[pick.integers(len(x))]]
    while len(centres) < min(k, len(x)):
        near = (x @ np.stack(centres).T).max(1)
        if near.min() > 1 - 1e-6:
            break
        chance = np.maximum(1 - near, 0) ** 2
        centres.append(x[pick.choice(len(x), p=chance / chance.sum())])
    c = np.stack(centres)
    own = (x @ c.T).argmax(1)
    for _ in range(ROUNDS):
        for i in range(len(c)):
            if (own == i).any():
                mean = x[own == i].mean(0)
                c[i] = mean / max(np.linalg.norm(mean), 1e-9)
        now = (x @ c.T).argmax(1)
        if (now == own).all():
            break
        own = now
    return c, own


def fold(doc_id: Column) -> Column:
    """0 to 3, by the crc32 of doc_id as text; a null doc_id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> Model:
    """Learn from rows with a language whose fold is not 2; nothing of any other row has a part in the model.

    Document frequencies come from all of these rows, centroids from FIT_ROWS of them. Rows without letters teach
    nothing. Without any labelled row the model knows no language.
    """
    known = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull() & (fold(F.col(doc_id)) != 2))
    idf = inverse_frequencies(known, text)
    many = {r[0]: r[1] for r in known.groupBy(lang).count().collect()}
    share = {name: min(1.0, FIT_ROWS / len(many) / n) for name, n in many.items()}
    chance = F.pmod(F.xxhash64(F.col(doc_id), F.col(text)), F.lit(1 << 30)) / float(1 << 30)
    empty = np.zeros((0, 1 << BUCKETS), dtype=np.float32)
    languages, centroids, owner, usual = sorted(many), [empty], [], []

    @F.arrow_udf(T.BinaryType())
    def packed(text: pa.Array) -> pa.Array:
        out = []
        for some in _steps(text):
            for v in vectors(some, idf):
                at = np.flatnonzero(v)
                out.append(at.astype("<u2").tobytes() + v[at].astype("<f2").tobytes())
        return pa.array(out, type=pa.binary())

    drawn = F.lit(False)
    for name, part in share.items():
        drawn |= (F.col(lang) == name) & (chance < part)
    sample = known.filter(drawn).select(F.col(lang).alias("lang"), packed(F.col(text)).alias("v")).toArrow()
    by_language: dict[str, list[bytes]] = {name: [] for name in languages}
    for name, v in zip(sample["lang"].to_pylist(), sample["v"].to_pylist(), strict=True):
        if v:
            by_language[name].append(v)
    for i, name in enumerate(languages):
        got = sorted(by_language[name])
        x = np.zeros((len(got), 1 << BUCKETS), dtype=np.float32)
        for k, v in enumerate(got):
            half = len(v) // 2
            x[k, np.frombuffer(v[:half], dtype="<u2")] = np.frombuffer(v[half:], dtype="<f2")
        if not len(x):
            continue
        c, own = _cluster(x, CENTROIDS, i)
        distance = 1 - (x * c[own]).sum(1)
        centroids.append(c)
        owner += [i] * len(c)
        usual += [float(np.quantile(distance[own == k], USUAL)) if (own == k).any() else 1.0 for k in range(len(c))]
    return Model(languages, idf, np.concatenate(centroids), np.array(owner, dtype=np.int64), np.array(usual))


_FOUND = T.StructType(
    [
        T.StructField("nearest", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("distance", T.DoubleType()),
        T.StructField("rejected", T.BooleanType()),
    ]
)


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``language``, ``nearest``, ``score``, ``distance`` and ``rejected``, from the text alone.

    nearest is the language of the nearest centroid, language the same or ``und`` where that is rejected. Texts
    that are null or have no letter are ``und`` in both, with score 0 and distance 1, as is everything if no
    language is known. Of equally near centroids the first in the order of languages counts. Columns of these
    names are replaced, all others kept; rows that repeat stay.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(_FOUND)
    def find(text: pa.Array) -> pa.Array:
        m = sent.value
        out = []
        for some in _steps(text):
            cosine = vectors(some, m.idf) @ m.centroids.T if len(m.owner) else np.zeros((len(some), 0))
            for k, t in enumerate(some):
                if not len(m.owner) or not _LETTER.search(t.decode()):
                    out.append((UNKNOWN, 0.0, 1.0, True))
                    continue
                best = np.full(len(m.languages), -1.0)
                np.maximum.at(best, m.owner, cosine[k])
                at = int(cosine[k].argmax())
                odds = np.exp(SHARP * (best - best.max()))
                far = float(1 - cosine[k, at])
                out.append((m.languages[m.owner[at]], float(odds[m.owner[at]] / odds.sum()), far, far > REACH * m.usual[at]))
        names = [f.name for f in _FOUND]
        columns = list(zip(*out, strict=True)) if out else [[]] * len(names)
        kinds = [pa.string(), pa.float64(), pa.float64(), pa.bool_()]
        return pa.StructArray.from_arrays([pa.array(c, type=t) for c, t in zip(columns, kinds, strict=True)], names=names)

    found = docs.withColumn("__found", find(F.col(text)))
    language = F.when(F.col("__found.rejected"), UNKNOWN).otherwise(F.col("__found.nearest"))
    return found.withColumns(
        {"language": language, **{f.name: F.col(f"__found.{f.name}") for f in _FOUND}}
    ).drop("__found")
