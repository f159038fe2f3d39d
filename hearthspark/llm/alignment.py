"""Two tokenizers side by side: which of their tokens stand for the same bytes, and how often a pair does so.

Both encode a space and the text, so that their tokens are two ways to cut the same bytes. Where both cut, a group of
tokens ends; all A tokens of a group are linked to all its B tokens. The count of a pair of ids is the number of
documents that have it linked.

Rows of equal text are one text: rows are shuffled by the whole text and counted, each distinct text is encoded and
aligned once, and its pairs weigh as many documents as have it. A task gathers distinct texts in chunks of CHUNK_BYTES
and lists the pairs of a chunk once, so what is shuffled for the counts is the pairs of chunks, not of texts. The counts
return to the chunks by an equality join; the texts of a chunk, kept as places in its list, then add them up. The
measures return to the documents by the SHA-256 of the text; a text that over one row in HOT has is spread there.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthspark.llm.bpe import PATTERN, byte_characters
from hearthspark.llm.common import batches, without, written

#: Bytes of text whose pairs are listed together.
CHUNK_BYTES = 8 << 20
#: Links of a group above which its distinct ids are paired instead of its tokens.
WIDE = 1024
#: A text is hot if it has more than one row in so many: at most so many texts are.
HOT = 1024

_MEASURES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
_ALIGNED = (
    "chunk long, key binary, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string,"
    " steps binary, times binary, pairs array<struct<pair: long, n: long>>"
)


class Vocabulary:
    """Bytes of every id, one after the other, and how they are written in a list of groups."""

    def __init__(self, words: list[bytes], last: str):
        self.words = words
        self.sizes = np.array([len(w) for w in words], dtype=np.int64)
        #: The id with a comma, or with what follows the last one of a group.
        self.said = [x for i in range(len(words)) for x in (b"%d," % i, b"%d%s" % (i, last.encode()))]


class Pair:
    """Tokenizers A (byte-level) and B (pieces) and what aligns them."""

    def __init__(self, byte_path: str, piece_path: str):
        with open(byte_path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = byte_characters()
        vocab = {i: word for word, i in spec["model"]["vocab"].items()}
        vocab |= {t["id"]: t["content"] for t in spec["added_tokens"]}
        special = {t["id"] for t in spec["added_tokens"]}
        words = [b"" if i in special else bytes(letters[c] for c in vocab.get(i, "")) for i in range(max(vocab) + 1)]
        ranks = {w: i for i, w in enumerate(words) if w}
        self.bytes = tiktoken.Encoding("A", pat_str=PATTERN.pattern, mergeable_ranks=ranks, special_tokens={})
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        self.a = Vocabulary(words, "|")
        self.b = Vocabulary([self._piece(i) for i in range(self.pieces.get_piece_size())], ";")
        self.said = self.a.said + self.b.said

    def _piece(self, i: int) -> bytes:
        piece = self.pieces.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.pieces.is_byte(i) else piece.replace("▁", " ").encode()

    def encode(self, texts: list[bytes]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of both for each text; none for both where the bytes of either are not a space and the text."""
        plain = [t.decode() for t in texts]
        a = [self.bytes.encode_to_numpy(" " + t).astype(np.int64) for t in plain]
        lists = self.pieces.encode(plain, num_threads=1)
        flat = np.fromiter(chain.from_iterable(lists), dtype=np.int64, count=sum(map(len, lists)))
        b = np.split(flat, np.cumsum([len(x) for x in lists])[:-1]) if lists else []
        none = np.empty(0, dtype=np.int64)
        for i, text in enumerate(texts):
            if not text or any(
                b"".join(map(v.words.__getitem__, ids.tolist())) != b" " + text for v, ids in ((self.a, a[i]), (self.b, b[i]))
            ):
                a[i] = b[i] = none
        return a, b


@lru_cache(maxsize=2)
def tokenizers(byte_path: str, piece_path: str) -> Pair:
    return Pair(byte_path, piece_path)


class Alignment:
    """Groups and links of some texts, by arrays over all their tokens.

    ``groups``, ``links`` and ``digests`` are by text. ``text``, ``pair`` and ``times`` are the linked pairs of each
    text in order, pair being A id * size of B's vocabulary + B id.
    """

    def __init__(self, both: Pair, texts: list[bytes]):
        lists = both.encode(texts)
        self.n_a, self.n_b = (np.array([len(x) for x in some], dtype=np.int64) for some in lists)
        a, b = (np.concatenate(some) if some else np.empty(0, dtype=np.int64) for some in lists)
        end_a, end_b = np.cumsum(both.a.sizes[a]), np.cumsum(both.b.sizes[b])
        cut = np.zeros(int(end_a[-1]) + 1 if len(a) else 1, dtype=np.int8)
        cut[end_a] = 1
        cut[end_b] += 2
        last_a, last_b = cut[end_a] == 3, cut[end_b] == 3
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        in_a, in_b = np.bincount(group_a), np.bincount(group_b)
        owner = np.repeat(np.arange(len(texts)), self.n_a)[last_a]
        self.groups = np.bincount(owner, minlength=len(texts))
        links = in_a * in_b
        self.links = np.zeros(len(texts), dtype=np.int64)
        np.add.at(self.links, owner, links)
        first_a, first_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
        self._digests(both, a, b, last_a, last_b, first_b[group_a], (first_a + in_a)[group_b])
        # Links of ordinary groups: every A token as often as its group has B tokens.
        base = both.b.sizes.size
        ordinary = np.flatnonzero(links[group_a] <= WIDE)
        many = in_b[group_a[ordinary]]
        step = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        keys = np.repeat(owner[group_a[ordinary]] * (len(both.a.words) * base) + a[ordinary] * base, many)
        keys += b[np.repeat(first_b[group_a[ordinary]], many) + step]
        keys, times = np.unique(keys, return_counts=True)
        found = [(keys, times)]
        for g in np.flatnonzero(links > WIDE).tolist():
            x, n = np.unique(a[first_a[g] : first_a[g] + in_a[g]], return_counts=True)
            y, m = np.unique(b[first_b[g] : first_b[g] + in_b[g]], return_counts=True)
            pairs = x[:, None] * base + y[None, :] + owner[g] * (len(both.a.words) * base)
            found.append((pairs.ravel(), (n[:, None] * m[None, :]).ravel()))
        if len(found) > 1:
            keys, at = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
            times = np.zeros(len(keys), dtype=np.int64)
            np.add.at(times, at, np.concatenate([n for _, n in found]))
        self.text, self.pair = np.divmod(keys, len(both.a.words) * base)
        self.times = times

    def _digests(self, both: Pair, a, b, last_a, last_b, before_a, before_b) -> None:
        """SHA-256 of the ids by group, A's before B's; no tokens: no digest."""
        said = np.empty(len(a) + len(b), dtype=np.int64)
        said[np.arange(len(a)) + before_a] = 2 * a + last_a
        said[np.arange(len(b)) + before_b] = len(both.a.said) + 2 * b + last_b
        edges = np.concatenate([[0], np.cumsum(self.n_a + self.n_b)]).tolist()
        self.digests = []
        for lo, hi in zip(edges, edges[1:], strict=False):
            line = b"".join(map(both.said.__getitem__, said[lo:hi].tolist()))[:-1]
            self.digests.append(hashlib.sha256(line).hexdigest() if line else "")


class _Chunk:
    """Rows of the texts of a chunk; their pairs are numbered when it is full."""

    def __init__(self, number: int):
        self.number, self.bytes = number, 0
        self.parts: list[tuple[list[bytes], np.ndarray, Alignment]] = []

    def add(self, texts: list[bytes], copies: np.ndarray, found: Alignment) -> None:
        self.bytes += sum(map(len, texts))
        self.parts.append(([hashlib.sha256(t).digest() for t in texts], copies, found))

    def rows(self) -> Iterator[pa.RecordBatch]:
        pairs, at = np.unique(np.concatenate([f.pair for _, _, f in self.parts]), return_inverse=True)
        documents = np.zeros(len(pairs), dtype=np.int64)
        np.add.at(documents, at, np.concatenate([copies[f.text] for _, copies, f in self.parts]))
        done = 0
        for keys, _, found in self.parts:
            places = at[done : done + len(found.pair)]
            done += len(found.pair)
            edges = np.searchsorted(found.text, np.arange(len(keys) + 1)).tolist()
            spans = list(zip(edges, edges[1:], strict=False))
            columns = [
                pa.array(np.full(len(keys), self.number)),
                pa.array(keys, type=pa.binary()),
                *(pa.array(x) for x in (found.n_a, found.n_b, found.groups, found.links)),
                pa.array(found.digests, type=pa.string()),
                pa.array([np.diff(places[lo:hi], prepend=0).astype("<u4").tobytes() for lo, hi in spans], type=pa.binary()),
                pa.array([found.times[lo:hi].astype("<i8").tobytes() for lo, hi in spans], type=pa.binary()),
                pa.nulls(len(keys), _PAIRS),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=_NAMES)
        listed = pa.StructArray.from_arrays([pa.array(pairs), pa.array(documents)], names=["pair", "n"])
        one = pa.ListArray.from_arrays(pa.array([0, len(pairs)], type=pa.int32()), listed).cast(_PAIRS)
        kinds = [pa.binary(), *[pa.int64()] * 4, pa.string(), pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array([self.number]), *(pa.nulls(1, k) for k in kinds), one], names=_NAMES)


_PAIRS = pa.list_(pa.struct([("pair", pa.int64()), ("n", pa.int64())]))
_NAMES = ["chunk", "key", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "steps", "times", "pairs"]


def aligned_texts(texts: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """Distinct (text, copies) as aligned rows by text, and one row of pairs by chunk, which has no key."""

    def each(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = tokenizers(byte_path, piece_path)
        number = TaskContext.get().partitionId() << 32
        chunk = _Chunk(number)
        for batch in rows:
            copies = batch.column("copies").to_numpy()
            for first, some in batches(batch.column("text")):
                chunk.add(some, copies[first : first + len(some)], Alignment(both, some))
                if chunk.bytes >= CHUNK_BYTES:
                    yield from chunk.rows()
                    number += 1
                    chunk = _Chunk(number)
        if chunk.parts:
            yield from chunk.rows()

    return texts.mapInArrow(each, _ALIGNED)


def _measured(aligned: DataFrame, counts: DataFrame, best: np.ndarray, base: int) -> DataFrame:
    """(key, measures) of every text; counts has (of, place, pair, n) for the pairs of every chunk."""

    def each(texts: pa.Table, pairs: pa.Table) -> pa.Table:
        order = np.argsort(pairs["place"].to_numpy())
        n = pairs["n"].to_numpy()[order]
        top = n == best[pairs["pair"].to_numpy()[order] // base]
        n_best, total = [], []
        for steps, times in zip(texts["steps"].to_pylist(), texts["times"].to_pylist(), strict=True):
            at = np.cumsum(np.frombuffer(steps, dtype="<u4").astype(np.int64))
            many = np.frombuffer(times, dtype="<i8")
            n_best.append(int(many[top[at]].sum()))
            total.append(int((many * n[at]).sum()))
        return pa.table(
            [texts[c] for c in _TEXT] + [pa.array(n_best, type=pa.int64()), pa.array(total, type=pa.int64())],
            names=[*_TEXT, "n_best", "count_sum"],
        )

    schema = "key binary, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    left = aligned.filter("key IS NOT NULL").select("chunk", *_TEXT, "steps", "times")
    return left.groupBy("chunk").cogroup(counts.groupBy("of")).applyInArrow(each, schema)


_TEXT = ["key", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]


def pair_counts(aligned: DataFrame, base: int) -> DataFrame:
    """(a, b, pair, n): in how many documents the ids a and b are linked."""
    listed = aligned.filter("key IS NULL").select(F.explode("pairs").alias("p")).select("p.*")
    totals = listed.groupBy("pair").agg(F.sum("n").alias("n"))
    return totals.select(F.floor(F.col("pair") / base).alias("a"), (F.col("pair") % base).alias("b"), "pair", "n")


def _best(totals: DataFrame, size: int) -> np.ndarray:
    """The highest count of every A id: one number for each id of the vocabulary, whatever the corpus."""
    found = totals.groupBy("a").agg(F.max("n").alias("n")).toArrow()
    best = np.zeros(size, dtype=np.int64)
    best[found["a"].to_numpy()] = found["n"].to_numpy()
    return best


def _key(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def align(docs: DataFrame, byte_path: str, piece_path: str, text: str = "text") -> DataFrame:
    """``docs`` without its text, with n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256.

    A text that is null or empty, or whose tokens of either side are other bytes than a space and the text, has no
    tokens: zeros and an empty digest. Rows that repeat are documents of their own. Of equal counts of an A id all are
    the highest. Columns of the measures' names are replaced, all others kept; no rows give no rows.
    """
    own = without(docs, text, *_MEASURES, "groups_sha256").columns
    rows = docs.select(*own, F.col(text).alias("__text"))
    texts = rows.filter("__text != ''").groupBy(F.col("__text").alias("text")).agg(F.count("*").alias("copies"))
    aligned = written(aligned_texts(texts, byte_path, piece_path), "aligned")
    both = tokenizers(byte_path, piece_path)
    base = len(both.b.words)
    totals = written(pair_counts(aligned, base), "pair-counts")
    listed = aligned.filter("key IS NULL").select("chunk", F.posexplode("pairs").alias("place", "p"))
    counts = listed.select(F.col("chunk").alias("of"), "place", F.col("p.pair").alias("pair")).join(totals.select("pair", "n"), "pair")
    measures = written(_measured(aligned, counts, _best(totals, len(both.a.words)), base), "measures")
    return _returned(rows, measures, own)


def _returned(rows: DataFrame, measures: DataFrame, own: list[str]) -> DataFrame:
    """The measures of each document's text; a hot text is met in HOT places, rows without text in as many."""
    keyed = rows.select(
        *own,
        F.when(F.col("__text") != "", _key(F.col("__text"))).alias("__key"),
        (F.monotonically_increasing_id() % HOT).cast("int").alias("__place"),
    )
    keyed = written(keyed, "keys")
    n = keyed.count()
    copies = keyed.filter("__key IS NOT NULL").groupBy("__key").agg(F.count("*").alias("__n"))
    hot = written(copies.filter(F.col("__n") * HOT > n).select("__key", F.lit(HOT).alias("__spread")), "hot-texts")
    salt = F.when(F.col("__key").isNull() | F.col("__spread").isNotNull(), F.col("__place")).otherwise(0)
    salted = keyed.join(F.broadcast(hot), "__key", "left").withColumn("__salt", salt)
    found = measures.withColumnRenamed("key", "__key").join(F.broadcast(hot), "__key", "left")
    spread = found.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("__spread"), F.lit(1)) - 1)))
    values = [F.coalesce(F.col(f"__m.{c}"), F.lit(0)).cast("long").alias(c) for c in _MEASURES]
    packed = spread.select("__key", "__salt", F.struct(*_MEASURES, "groups_sha256").alias("__m"))
    joined = salted.join(packed, ["__key", "__salt"], "left")
    return joined.select(*own, *values, F.coalesce("__m.groups_sha256", F.lit("")).alias("groups_sha256"))
