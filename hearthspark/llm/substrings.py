"""Repeated passages: every run of consecutive sentences that another place of the corpus has before.

A text is cut into sentences: after a word that ends in . ! or ? or another stop (closing quotes and brackets may
follow), and at the end of a line. Words are parted by white space; a character of a script that is written without
it is a word of its own. Beyond its LONG-th word a sentence is also cut after every word whose hash is the smallest among the
NEAR words on either side, so that running text without such ends is cut, too, and alike wherever it stands. Sentences
with the white space after them are together exactly the text. From every sentence on, the shortest run of RUN sentences
or more that has WORDS words is a span, compared by 128 bits over its lowered words. Of the places of a span the first stays, by
doc_id, then text, then position; sentences covered by any other place go. The first place of a sentence in
the corpus is therefore never removed.

The hashes of all spans are counted before anything else moves, and only spans that occur twice are looked at
again. Places of a span are never gathered: the first is a minimum, summed up before the shuffle, and the others
meet it in an equality join that Spark may split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthspark.llm.common import batches, without, written
from hearthspark.llm.hashing import P1, P3, mix, xxh64_spans

#: Sentences of a span at least, and the words that it must have.
RUN = 3
WORDS = 12
#: A hash is hot if it has more than one place in so many; the tasks that meet the places of a hot hash.
HOT, SALTS = 1024, 64
#: Words after which a sentence may be cut within, and the words on either side that decide where.
LONG, NEAR = 12, 3

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True
_STOP = np.zeros(256, dtype=bool)
_STOP[[33, 46, 63]] = True
_CLOSE = np.zeros(256, dtype=bool)
_CLOSE[[34, 39, 41, 93, 125]] = True
#: The same beyond ASCII, by code point: white space, stops, closing quotes and brackets, scripts without spaces.
_WIDE_SPACE = [0x85, 0xA0, 0x1680, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]
_WIDE_STOP = [
    0x589, 0x61F, 0x6D4, 0x964, 0x965, 0xE2F, 0xE5A, 0xE5B, 0xF0D, 0xF0E, 0x104A, 0x104B, 0x1362, 0x1367, 0x17D4, 0x17D5,
    0x2026, 0x203C, 0x203D, 0x2047, 0x2048, 0x2049, 0x3002, 0xFE52, 0xFF01, 0xFF0E, 0xFF1F, 0xFF61,
]
_WIDE_CLOSE = [0xBB, 0x2019, 0x201D, 0x203A, 0x3009, 0x300B, 0x300D, 0x300F, 0x3011, 0x3015, 0xFF02, 0xFF07, 0xFF09, 0xFF3D, 0xFF63]
_WIDE_LINE = [0x85, 0x2028, 0x2029]
_UNSPACED = [
    (0xE00, 0xEFF), (0xF00, 0xFFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x19E0, 0x19FF), (0x3005, 0x3007), (0x3040, 0x30FF),
    (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xA9E0, 0xA9FF), (0xAA60, 0xAA7F), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x20000, 0x3FFFF),
]


def _wide(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, size in bytes and code point of every character beyond ASCII of UTF-8."""
    at = np.flatnonzero(raw >= 0xC0)
    lead = raw[at].astype(np.int64)
    size = 2 + (lead >= 0xE0) + (lead >= 0xF0)
    code = lead & np.array([0, 0, 0x1F, 0x0F, 0x07])[size]
    for k in range(1, 4):
        code = np.where(k < size, code << 6 | raw[np.minimum(at + k, len(raw) - 1)] & 0x3F, code)
    return at, size, code


class Sentences:
    """Sentences of some texts: ``text`` their texts, ``start`` and ``end`` bytes in ``raw``, ``words`` and two hashes."""

    def __init__(self, texts: list[bytes]):
        body = b"\n".join(texts) + b"\n"
        self.raw = np.frombuffer(body, dtype=np.uint8)
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        self.begin = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
        self.finish = self.begin + sizes
        low = _LOWER[self.raw]
        space, self.final, self.line = _SPACE[self.raw], _STOP[self.raw], self.raw == 10
        self.close, self.whole = _CLOSE[self.raw], np.ones(len(self.raw), dtype=np.int8)
        at, size, code = _wide(self.raw)
        unspaced = np.zeros(len(at), dtype=bool)
        for lo, hi in _UNSPACED:
            unspaced |= (code >= lo) & (code <= hi)
        stop, close = np.isin(code, _WIDE_STOP), np.isin(code, _WIDE_CLOSE)
        self.line[at[np.isin(code, _WIDE_LINE)]] = True
        blank = np.isin(code, _WIDE_SPACE)
        for k in range(4):
            space[at[blank & (k < size)] + k] = True
        # The last byte of a character stands for it, with its size.
        last = at + size - 1
        self.final[last[stop]], self.close[last[close]], self.whole[last] = True, True, size
        # A character of an unspaced script begins a word and ends one; stops, quotes and brackets stay with it.
        alone = unspaced & ~stop
        begins, ends = np.zeros(len(space) + 1, dtype=bool), np.zeros(len(space) + 1, dtype=bool)
        begins[at[alone]] = ends[(at + size)[alone]] = True
        mark = np.concatenate([self.final | self.close, [False]])
        mark[at[stop | close]] = True
        ends &= ~mark
        edge = np.diff(np.concatenate([[1], space.astype(np.int8), [1]]))
        inner = np.concatenate([~space, [False]]) & (begins | ends)
        inner[1:] &= ~space
        inner[0] = False
        start = np.flatnonzero((edge == -1) | inner)
        end = np.flatnonzero((edge == 1) | inner)
        owner = np.searchsorted(self.begin, start, side="right") - 1
        hashes = xxh64_spans(low.tobytes(), start, end - start)
        ends = self._ends(start, end, owner)
        # Place of a word within its sentence, before cuts within.
        n = len(start)
        first = np.ones(n, dtype=bool)
        first[1:] = ends[:-1]
        head = np.maximum.accumulate(np.where(first, np.arange(n), 0))
        place = np.arange(n) - head
        ends |= self._cuts(mix(hashes, 5), owner, place)
        first[1:] = ends[:-1]
        heads = np.flatnonzero(first)
        self.text = owner[heads]
        self.words = np.diff(np.concatenate([heads, [n]]))
        self.start = start[heads]
        final = np.ones(len(heads), dtype=bool)
        final[:-1] = self.text[1:] != self.text[:-1]
        self.end = np.concatenate([self.start[1:], [0]])[: len(heads)]
        self.end[final] = self.finish[self.text[final]]
        place = np.arange(n) - np.repeat(heads, self.words)
        self.hashes = [self._fold(mix(hashes, salt), place, heads) for salt in (1, 2)]
        self.edges = np.searchsorted(self.text, np.arange(len(texts) + 1))

    def _ends(self, start: np.ndarray, end: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Whether a sentence ends with each word."""
        last = end - 1
        for _ in range(3):
            before = last - self.whole[last]
            last = np.where(self.close[last] & (before >= start), before, last)
        lines = np.concatenate([[0], np.cumsum(self.line)])
        ends = self.final[last]
        ends[:-1] |= (lines[start[1:]] > lines[end[:-1]]) | (owner[1:] != owner[:-1])
        ends[-1:] = True
        return ends

    @staticmethod
    def _cuts(hashes: np.ndarray, owner: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Whether a long sentence is cut after a word: the smallest hash nearby. Of equal ones closer than that the first."""
        least = place >= LONG - 1
        for k in range(1, NEAR + 1):
            same = owner[k:] == owner[:-k]
            least[k:] &= ~same | (hashes[k:] <= hashes[:-k])
            least[:-k] &= ~same | (hashes[:-k] <= hashes[k:])
        at = np.flatnonzero(least)
        if len(at) > 1 and ((np.diff(at) <= NEAR) & (owner[at[1:]] == owner[at[:-1]])).any():
            before = -1
            for i in at.tolist():
                if before >= 0 and i - before <= NEAR and owner[i] == owner[before]:
                    least[i] = False
                else:
                    before = i
        return least

    @staticmethod
    def _fold(hashes: np.ndarray, place: np.ndarray, heads: np.ndarray) -> np.ndarray:
        """One hash of the words of each sentence, in order."""
        if not len(heads):
            return np.empty(0, dtype=np.uint64)
        with np.errstate(over="ignore"):
            most = int(place.max()) + 1
            powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(most - 1, P3, dtype=np.uint64)]))
            return mix(np.add.reduceat(hashes * powers[place], heads), 3)

    def runs(self) -> tuple[np.ndarray, np.ndarray]:
        """The first sentences of spans, and how many sentences each has."""
        n = len(self.text)
        total = np.concatenate([[0], np.cumsum(self.words)])
        enough = np.searchsorted(total, total[:-1] + WORDS)
        end = np.maximum(enough, np.arange(n) + RUN)
        at = np.flatnonzero(end <= self.edges[1:][self.text])
        return at, end[at] - at

    def spans(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Text, position of the first sentence within it, and two hashes of every span."""
        at, size = self.runs()
        out = []
        with np.errstate(over="ignore"):
            for h in self.hashes:
                together = np.zeros(len(at), dtype=np.uint64)
                for k in range(int(size.max()) if len(at) else 0):
                    on = np.flatnonzero(size > k)
                    together[on] = mix(together[on] * P1 + h[at[on] + k], 7)
                out.append(together)
        return self.text[at], at - self.edges[self.text[at]], *out


_SPAN = "doc_id {id}, body long, position int, h1 long, h2 long"


def spans(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """(doc_id, body, position, h1, h2) of every span; body is a hash of the whole text."""

    def each(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for first, texts in batches(batch.column("text")):
                owner, position, h1, h2 = Sentences(texts).spans()
                own = pa.array(owner + first)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(own),
                        batch.column("body").take(own),
                        pa.array(position, type=pa.int32()),
                        pa.array(h1.view(np.int64)),
                        pa.array(h2.view(np.int64)),
                    ],
                    names=["doc_id", "body", "position", "h1", "h2"],
                )

    rows = docs.select(F.col(doc_id).alias("doc_id"), body(F.col(text)).alias("body"), F.col(text).alias("text"))
    return rows.mapInArrow(each, _SPAN.format(id=rows.schema["doc_id"].dataType.simpleString()))


def body(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def repeated(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, body, positions): where each document has spans that an earlier place has, too.

    A hash that over one repeated place in HOT has is hot; there are HOT of them at most, which all tasks are told, and their
    places meet what they are joined with in SALTS tasks each.
    """
    places = spans(docs, text, doc_id)
    twice = written(places.groupBy("h1").agg(F.count("*").alias("n")).filter("n > 1"), "repeated-hashes")
    total = twice.agg(F.sum("n")).first()[0] or 0
    hot = written(twice.filter(F.col("n") * HOT > total).select("h1", F.lit(SALTS).alias("salts")), "hot-spans")

    def salted(rows: DataFrame) -> DataFrame:
        """One row for each salt of its hash."""
        every = F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)
        return rows.join(F.broadcast(hot), "h1", "left").withColumn("salt", F.explode(every)).drop("salts")

    own = F.when(F.col("salts").isNotNull(), F.pmod(F.xxhash64("body", "position"), F.lit(SALTS))).otherwise(0)
    dealt = places.join(F.broadcast(hot), "h1", "left").withColumn("salt", own.cast("int")).drop("salts")
    again = written(dealt.join(salted(twice.select("h1")), ["h1", "salt"], "left_semi"), "spans")
    place = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "body", "position")
    first = again.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1")
    other = again.withColumn("place", place).join(salted(first), ["h1", "h2", "salt"]).filter("place != first")
    return other.groupBy("doc_id", "body").agg(F.collect_set("position").alias("positions"))


_CLEANED = T.StructType(
    [
        T.StructField("text", T.StringType()),
        T.StructField("sentences", T.IntegerType()),
        T.StructField("removed", T.ArrayType(T.ArrayType(T.IntegerType()))),
    ]
)


@F.arrow_udf(_CLEANED)
def _without_spans(text: pa.Array, positions: pa.Array) -> pa.Array:
    out: list[dict] = []
    for first, texts in batches(text):
        found = Sentences(texts)
        size = dict(zip(*(x.tolist() for x in found.runs()), strict=True))
        for i, whole in enumerate(texts):
            lo, hi = int(found.edges[i]), int(found.edges[i + 1])
            gone = np.zeros(hi - lo, dtype=bool)
            for at in positions[first + i].as_py() or ():
                gone[at : at + size[lo + at]] = True
            base = int(found.begin[i])
            cuts = [(int(found.start[lo + k]) - base, int(found.end[lo + k]) - base) for k in np.flatnonzero(gone)]
            kept, at, removed = [], 0, []
            for a, b in cuts:
                kept.append(whole[at:a])
                at = b
                if removed and removed[-1][1] == a:
                    removed[-1][1] = b
                else:
                    removed.append([a, b])
            kept.append(whole[at:])
            out.append({"text": b"".join(kept).decode(), "sentences": hi - lo, "removed": removed})
    return pa.array(out, type=pa.struct([("text", pa.string()), ("sentences", pa.int32()), ("removed", pa.list_(pa.list_(pa.int32())))]))


def remove_repeated(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with repeated passages cut out of the text, ``n_sentences`` and ``removed`` (ranges of UTF-8 bytes).

    All rows stay, also those of which nothing is left. Rows that repeat doc_id and text are the same places
    and are cut alike. Null texts stay null, with 0 sentences and nothing removed; a text that no span covers
    stays as it is, byte for byte. Null doc_ids come last in the order of places. Columns named n_sentences or
    removed are replaced, all others kept; no rows give no rows.
    """
    found = repeated(docs, text, doc_id).select(
        F.col("doc_id").alias("__id"), F.col("body").alias("__body"), F.col("positions").alias("__positions")
    )
    own = without(docs, "n_sentences", "removed").columns
    rows = docs.select(*own, body(F.col(text)).alias("__own"))
    joined = rows.join(found, F.col(doc_id).eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__body")), "left")
    cut = joined.withColumn("__cut", _without_spans(F.col(text), F.col("__positions")))
    texts = F.when(F.col(text).isNotNull(), F.col("__cut.text")).alias(text)
    return cut.select(
        *(texts if c == text else F.col(c) for c in own),
        F.col("__cut.sentences").alias("n_sentences"),
        F.col("__cut.removed").alias("removed"),
    )
