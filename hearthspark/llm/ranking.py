"""Ranked lexical search: the best documents of every item by an integer BM25, found in trees of balls.

A document is a vector over the terms of the items: the impact of each term that it has. An item is a vector of term
weights times occurrences, so a score is an inner product. Items are taken in blocks; each block goes through all
documents:

1. Documents are read once and projected on the block's vocabulary (no other term has a part in any score). What is
   needed of the whole corpus (documents, terms, documents by term) is counted on the way.
2. The projected documents of a task are taken in chunks. Of each chunk a tree of balls is built: every node has a
   centroid and, for each subspace of terms, a radius within which all its documents lie. By Cauchy and Schwarz no
   document of a node scores above  q . centroid + sum over subspaces of |q| * radius.  Radii and bounds are rounded up
   by more than floating point can lose, so a node that is cut off holds no document that belongs in the result.
   For every item, nodes are opened best first until the best bound left is below the k-th score known to the task;
   the documents of opened leaves are scored in 64-bit integers.
3. A task gives at most k documents of a chunk for an item. They are cut to k per item and salt, then to k per item.

The bounds only save work: the result is that of scoring everything.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hearthspark.llm.common import batches, written

#: Documents of an item that are returned.
BEST = 10
#: Items and bytes of items in a block, about; items are dealt to blocks by hash.
BLOCK_ITEMS, BLOCK_BYTES = 256, 1 << 18
#: Numbers in the matrix of a chunk, and documents in a leaf at most.
CELLS, LEAF = 1 << 23, 16
#: Subspaces of terms that have a radius of their own at most.
SUBSPACES = 4096
#: Groups of an item's candidates before the last cut.
SALTS = 64

#: Fixed values of the score: share of the length in the norm in hundredths, scale of an impact.
LENGTH, SCALE = 75, 1_000_000_000

#: Bytes that are no part of a term become spaces, A-Z become lower case.
_TERMS = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


def terms(text: bytes) -> list[bytes]:
    """The terms of a text: maximal runs of ASCII letters, digits and characters beyond ASCII; only A-Z lowered."""
    return text.translate(_TERMS).split()


@dataclass
class Block:
    """Items as sparse integer vectors over their vocabulary."""

    size: int
    starts: np.ndarray
    terms: np.ndarray
    values: np.ndarray
    documents: int
    total: int

    def item(self, q: int) -> tuple[np.ndarray, np.ndarray]:
        lo, hi = self.starts[q], self.starts[q + 1]
        return self.terms[lo:hi], self.values[lo:hi]


def _projected(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, at, times) of documents with a term of the block; one row of counts for each task.

    n is the number of the document's terms, at and times are the places of its terms in the vocabulary and their
    occurrences, 64-bit little-endian.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def each(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        documents, total = 0, 0
        holding = np.zeros(len(known), dtype=np.int64)
        names = ["doc_id", "n", "at", "times", "documents", "total", "holding"]
        place = None
        for batch in rows:
            place = batch.schema.field("doc_id").type
            for first, texts in batches(batch.column("text")):
                picked, sizes, at, times = [], [], [], []
                for i, text in enumerate(texts):
                    found = terms(text)
                    if not found:
                        continue
                    documents += 1
                    total += len(found)
                    some = [x for x in map(known.get, found) if x is not None]
                    if some:
                        which, many = np.unique(np.array(some, dtype=np.int64), return_counts=True)
                        holding[which] += 1
                        picked.append(first + i)
                        sizes.append(len(found))
                        at.append(which.astype("<i8").tobytes())
                        times.append(many.astype("<i8").tobytes())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(pa.array(picked, type=pa.int64())),
                        pa.array(sizes, type=pa.int64()),
                        pa.array(at, type=pa.binary()),
                        pa.array(times, type=pa.binary()),
                        pa.nulls(len(picked), pa.int64()),
                        pa.nulls(len(picked), pa.int64()),
                        pa.nulls(len(picked), _HOLDING),
                    ],
                    names=names,
                )
        if place is not None:
            on = np.flatnonzero(holding)
            entries = pa.StructArray.from_arrays([pa.array(on), pa.array(holding[on])], names=["term", "n"])
            one = pa.ListArray.from_arrays(pa.array([0, len(on)], type=pa.int32()), entries).cast(_HOLDING)
            columns = [pa.nulls(1, place), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([documents]), pa.array([total]), one], names=names)

    schema = f"doc_id {kind}, n long, at binary, times binary, documents long, total long, holding array<struct<term: long, n: long>>"
    return docs.mapInArrow(each, schema)


_HOLDING = pa.list_(pa.struct([("term", pa.int64()), ("n", pa.int64())]))


def _up(x: np.ndarray) -> np.ndarray:
    """Above any rounding of sums of up to four million products that are not negative."""
    return x * (1 + 1e-9) + 1e-6


class BallTree:
    """Balls over the rows of an integer matrix that is not negative. ``rows`` is their order; leaves are slices of it."""

    def __init__(self, matrix: np.ndarray):
        self.rows = np.arange(len(matrix))
        self.lo: list[int] = []
        self.hi: list[int] = []
        self.children: list[tuple[int, int] | None] = []
        self._split(matrix.astype(np.float32), 0, len(matrix))
        n, width = len(self.lo), matrix.shape[1]
        share = max(1, -(-width // SUBSPACES))
        self.heads = np.arange(0, width, share)
        self.centres = np.zeros((n, width))
        self.radii = np.zeros((n, len(self.heads)))
        # Children come after their parents: the last nodes first.
        for node in range(n - 1, -1, -1):
            below = self.children[node]
            if below is None:
                points = matrix[self.rows[self.lo[node] : self.hi[node]]].astype(np.float64)
                self.centres[node] = points.mean(0)
                self.radii[node] = _up(self._lengths(points - self.centres[node]).max(0))
            else:
                sizes = [self.hi[c] - self.lo[c] for c in below]
                self.centres[node] = np.average(self.centres[list(below)], axis=0, weights=sizes)
                away = [_up(self._lengths(self.centres[c] - self.centres[node]) + self.radii[c]) for c in below]
                self.radii[node] = np.maximum(*away)

    def _lengths(self, x: np.ndarray) -> np.ndarray:
        """Lengths within each subspace."""
        if len(self.heads) == x.shape[-1]:
            return np.abs(x)
        return np.sqrt(np.add.reduceat(x * x, self.heads, axis=-1))

    def _split(self, points: np.ndarray, lo: int, hi: int) -> int:
        """Nodes of the rows lo..hi: halves along the line between two points far from each other."""
        node = len(self.lo)
        self.lo.append(lo)
        self.hi.append(hi)
        self.children.append(None)
        if hi - lo > LEAF:
            some = points[self.rows[lo:hi]]
            one = some[_farthest(some, some.mean(0))]
            along = some @ (some[_farthest(some, one)] - one)
            half = (hi - lo) // 2
            self.rows[lo:hi] = self.rows[lo:hi][np.argpartition(along, half)]
            left = self._split(points, lo, lo + half)
            self.children[node] = left, self._split(points, lo + half, hi)
        return node

    def bounds(self, vectors: np.ndarray) -> np.ndarray:
        """(nodes, vectors): no row of a node has a larger inner product with a vector."""
        return _up(self.centres @ vectors.T + self.radii @ self._lengths(vectors).T)


def _farthest(points: np.ndarray, place: np.ndarray) -> int:
    return int(np.argmax(np.einsum("ij,ij->i", points, points) - 2 * (points @ place)))


class Searcher:
    """The best documents of the items of a block, chunk by chunk."""

    def __init__(self, block: Block, best: int):
        self.block, self.best = block, best
        n = len(block.starts) - 1
        self.scores: list[list[int]] = [[] for _ in range(n)]
        self.vectors = np.zeros((n, block.size))
        for q in range(n):
            at, values = block.item(q)
            self.vectors[q, at] = values
        #: Leaves opened and leaves there are, over all items.
        self.opened = self.leaves = 0

    def least(self, q: int) -> int:
        """The score that a document must reach."""
        return self.scores[q][0] if len(self.scores[q]) == self.best else 1

    def impacts(self, sizes: list[int], at: list[bytes], times: list[bytes]) -> np.ndarray:
        """The matrix of a chunk: SCALE * tf div (1000 * tf + 8 * m) by document and term."""
        matrix = np.zeros((len(sizes), self.block.size), dtype=np.int32)
        for i, n in enumerate(sizes):
            m = 100 - LENGTH + LENGTH * n * self.block.documents // self.block.total
            tf = np.frombuffer(times[i], dtype="<i8")
            matrix[i, np.frombuffer(at[i], dtype="<i8")] = SCALE * tf // (1000 * tf + 8 * m)
        return matrix

    def search(self, matrix: np.ndarray, order: np.ndarray) -> list[tuple[int, int, int]]:
        """(item, score, row): at most ``best`` rows for an item, the highest first; of equal scores those of lowest order."""
        tree = BallTree(matrix)
        bounds = tree.bounds(self.vectors)
        ordered = matrix[tree.rows]
        leaves = tree.children.count(None)
        out = []
        for q in np.flatnonzero(bounds[0] >= [self.least(q) for q in range(len(self.scores))]).tolist():
            terms_of, values = self.block.item(q)
            bound = bounds[:, q].tolist()
            found: list[tuple[int, int, int]] = []
            queue = [(-bound[0], 0)]
            least = self.least(q)
            self.leaves += leaves
            while queue and -queue[0][0] >= least:
                _, node = heapq.heappop(queue)
                below = tree.children[node]
                if below is not None:
                    for child in below:
                        if bound[child] >= least:
                            heapq.heappush(queue, (-bound[child], child))
                    continue
                self.opened += 1
                lo, hi = tree.lo[node], tree.hi[node]
                scores = ordered[lo:hi, terms_of].astype(np.int64) @ values
                for i in np.flatnonzero(scores >= least).tolist():
                    row = int(tree.rows[lo + i])
                    entry = int(scores[i]), -int(order[row]), row
                    if len(found) < self.best:
                        heapq.heappush(found, entry)
                    elif entry > found[0]:
                        heapq.heapreplace(found, entry)
                if len(found) == self.best:
                    least = max(least, found[0][0])
            out += [(q, score, row) for score, _, row in found]
            self.scores[q] = sorted(self.scores[q] + [s for s, _, _ in found])[-self.best :]
        return out


def _candidates(projected: DataFrame, block: Block, best: int) -> DataFrame:
    """(q, score, doc_id): the best documents of every chunk."""
    kind = projected.schema["doc_id"].dataType.simpleString()
    sent = projected.sparkSession.sparkContext.broadcast(block)
    most = max(LEAF, CELLS // max(1, block.size))

    def each(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = Searcher(sent.value, best)

        def result(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            chunk = pa.Table.from_batches(held).combine_chunks()
            ids = chunk["doc_id"]
            order = np.empty(len(ids), dtype=np.int64)
            order[pc.sort_indices(ids, null_placement="at_end").to_numpy()] = np.arange(len(ids))
            matrix = searcher.impacts(chunk["n"].to_pylist(), chunk["at"].to_pylist(), chunk["times"].to_pylist())
            found = searcher.search(matrix, order)
            taken = ids.take(pa.array([r for _, _, r in found], type=pa.int64()))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([q for q, _, _ in found], type=pa.int32()),
                    pa.array([s for _, s, _ in found], type=pa.int64()),
                    taken.combine_chunks() if isinstance(taken, pa.ChunkedArray) else taken,
                ],
                names=["q", "score", "doc_id"],
            )

        held: list[pa.RecordBatch] = []
        count = 0
        for batch in rows:
            at = 0
            while at < batch.num_rows:
                some = batch.slice(at, most - count)
                held.append(some)
                at += some.num_rows
                count += some.num_rows
                if count == most:
                    yield result(held)
                    held, count = [], 0
        if count:
            yield result(held)

    rows = projected.filter("at IS NOT NULL").select("doc_id", "n", "at", "times")
    return rows.mapInArrow(each, f"q int, score long, doc_id {kind}")


def _first(df: DataFrame, best: int, *keys) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= best)


def _block(docs: DataFrame, texts: list[bytes], best: int) -> DataFrame | None:
    """(q, rank, doc_id, score) for the items of one block; q is an item's place in it."""
    counted = [Counter(terms(t)) for t in texts]
    vocabulary = {t: i for i, t in enumerate(sorted({t for c in counted for t in c}))}
    if not vocabulary:
        return None
    projected = written(_projected(docs, vocabulary), "projected")
    counts = projected.filter("documents IS NOT NULL")
    documents, total = counts.agg(F.sum("documents"), F.sum("total")).first()
    if not documents:
        return None
    # One row for each term of the block, whatever the corpus.
    holding = {r.term: r.n for r in counts.select(F.explode("holding").alias("h")).groupBy("h.term").agg(F.sum("h.n").alias("n")).collect()}
    vectors = []
    for c in counted:
        at = sorted((vocabulary[t], n) for t, n in c.items())
        weights = [math.floor(1000 * math.log((2 * documents + 2) / (2 * holding[i] + 1))) if i in holding else 0 for i, _ in at]
        vectors.append([(i, n * w) for (i, n), w in zip(at, weights, strict=True) if w])
    flat = np.array([p for v in vectors for p in v], dtype=np.int64).reshape(-1, 2)
    starts = np.concatenate([[0], np.cumsum([len(v) for v in vectors])])
    block = Block(len(vocabulary), starts, flat[:, 0], flat[:, 1], documents, total)
    found = _candidates(projected, block, best)
    salted = found.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    return _first(_first(salted, best, "q", "salt").drop("rank", "salt"), best, "q")


def search(docs: DataFrame, items: DataFrame, best: int = BEST, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id") -> DataFrame:
    """(item_id, rank, doc_id, score): the ``best`` documents of every item with a score above 0, highest first.

    Of equal scores the smaller doc_id comes first, null last. Null and empty texts have no terms: such a document is
    no document of the counts and never found, such an item finds nothing. Rows that repeat are documents or items of
    their own, with ranks of their own. No rows on either side give no rows. Other columns are not looked at.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    asked = items.select(F.col(item_id).alias("item_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    asked = written(asked.withColumn("row", F.monotonically_increasing_id()), "items")
    n, size = asked.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    blocks = max(1, -(-n // BLOCK_ITEMS), -(-(size or 0) // BLOCK_BYTES))
    parts = []
    for b in range(blocks):
        some = asked.filter(F.pmod(F.xxhash64("row"), F.lit(blocks)) == b).orderBy("row").collect()
        found = _block(rows, [r.text.encode() for r in some], best)
        if found is not None:
            names = asked.sparkSession.createDataFrame(
                [(q, r.item_id) for q, r in enumerate(some)], f"q int, item_id {asked.schema['item_id'].dataType.simpleString()}"
            )
            parts.append(written(found.join(F.broadcast(names), "q").select("item_id", "rank", "doc_id", "score"), "ranked"))
    if not parts:
        none = asked.select("item_id").limit(0).join(rows.select("doc_id").limit(0), F.lit(False))
        return none.select("item_id", F.lit(1).alias("rank"), "doc_id", F.lit(1).cast("long").alias("score"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return out
