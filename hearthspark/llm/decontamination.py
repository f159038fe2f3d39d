"""Documents that hold test items, by size-partitioned MinHash containment and an exact check.

An item is contained in a document if the document has CONTAINED or more of its distinct shingles of SHINGLE
words. Against a long document the similarity of whole sets says nothing, however large a signature of fixed
size is, so the MinHash sketch is one of the items: the smallest hashes of an item with m shingles, one more
than may be missing, m - ceil(CONTAINED * m) + 1. A document that contains the item has at least one of them:
no contained item is missed. Items are partitioned by size (powers of two); the sketches of a partition lie below
a bound of their own, the sketch of a document for that partition is all its hashes below the bound, and what
the two have in common names the candidates. Candidates are then verified on all shingles of the item, by 128
bits.

Words are runs of letters, digits and bytes from 128 on, A-Z lowered. A text with fewer than SHINGLE words has
the whole sequence as its one shingle; without words it has none and contains, or is contained in, nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthspark.llm.common import CHUNK, batches, written
from hearthspark.llm.hashing import Words, segments, xxh64_spans
from hearthspark.llm.substrings import body

SHINGLE = 5
CONTAINED = 0.8
SEEDS = 42, 43
#: Shingles of items (16 bytes each) that are sent to all tasks at most; more are joined by a shuffle.
SENT = 1 << 20

_PLAIN = bytes(
    b + 32 if 65 <= b < 91 else b if 48 <= b < 58 or 97 <= b < 123 or b >= 128 else 32 for b in range(256)
)


def shingle_rows(texts: list[bytes]) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Buffer, text, start, size and first hash of the shingles, in parts of bounded size."""
    pieces, owner = [], []
    for i, text in enumerate(texts):
        plain = b" ".join(text.translate(_PLAIN).split())
        for piece in segments(plain, SHINGLE, CHUNK):
            pieces.append(piece)
            owner.append(i)
    owners, first, size = np.array(owner), 0, 0
    for i, piece in enumerate(pieces):
        size += len(piece)
        if size > CHUNK or i + 1 == len(pieces):
            words = Words(pieces[first : i + 1])
            text, start, length = words.shingles(SHINGLE)
            yield words.buf, owners[first + text], start, length, xxh64_spans(words.buf, start, length, SEEDS[0])
            first, size = i + 1, 0


def _rows(batch: pa.RecordBatch, names: list[str], at: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> pa.RecordBatch:
    own = pa.array(at, type=pa.int64())
    hashes = [pa.array(h.view(np.int64)) for h in (h1, h2)]
    return pa.RecordBatch.from_arrays([*(batch.column(n).take(own) for n in names), *hashes], names=[*names, "h1", "h2"])


def _distinct(at: np.ndarray, h1: np.ndarray) -> np.ndarray:
    """Where each (text, hash) is first."""
    order = np.lexsort((h1, at))
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = (at[order][1:] != at[order][:-1]) | (h1[order][1:] != h1[order][:-1])
    return np.sort(order[fresh])


def shingles(rows: DataFrame, names: list[str]) -> DataFrame:
    """``names`` with (h1, h2) of each distinct shingle of ``text``."""

    def each(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for first, texts in batches(batch.column("text")):
                for buf, text, start, size, h1 in shingle_rows(texts):
                    at = _distinct(text, h1)
                    h2 = xxh64_spans(buf, start[at], size[at], SEEDS[1])
                    yield _rows(batch, names, first + text[at], h1[at], h2)

    kinds = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in names)
    return rows.select(*names, "text").mapInArrow(each, f"{kinds}, h1 long, h2 long")


def _matches_sent(docs: DataFrame, names: list[str], parts: list[np.ndarray], every: np.ndarray) -> DataFrame:
    """The items' shingles in documents that share a sketch hash with an item of some part; all lists are small and sorted.

    A document's sketch for a part is its hashes up to the largest of that part, and meets that part alone.
    """
    sent = docs.sparkSession.sparkContext.broadcast((parts, every))

    def among(values: np.ndarray, listed: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(listed, values), len(listed) - 1)
        return listed[at] == values

    def each(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketches, whole = sent.value
        for batch in rows:
            for first, texts in batches(batch.column("text")):
                found = []
                candidate = np.zeros(len(texts), dtype=bool)
                for buf, text, start, size, h1 in shingle_rows(texts):
                    for sketch in sketches:
                        below = np.flatnonzero(h1 <= sketch[-1])
                        candidate[text[below[among(h1[below], sketch)]]] = True
                    at = np.flatnonzero(among(h1, whole))
                    found.append((text[at], h1[at], xxh64_spans(buf, start[at], size[at], SEEDS[1])))
                if candidate.any():
                    text, h1, h2 = (np.concatenate(x) for x in zip(*found, strict=True))
                    keep = np.flatnonzero(candidate[text])
                    keep = keep[_distinct(text[keep], h1[keep])]
                    yield _rows(batch, names, first + text[keep], h1[keep], h2[keep])

    kinds = ", ".join(f"{n} {docs.schema[n].dataType.simpleString()}" for n in names)
    return docs.select(*names, "text").mapInArrow(each, f"{kinds}, h1 long, h2 long")


def document_sketches(docs: DataFrame, names: list[str], bounds: dict[int, int]) -> DataFrame:
    """``names`` with (part, h1): for each part the distinct hashes of a document up to the part's bound."""
    limits = sorted(bounds.items())

    def each(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for first, texts in batches(batch.column("text")):
                for _, text, _, _, h1 in shingle_rows(texts):
                    kept = _distinct(text, h1)
                    for part, bound in limits:
                        at = kept[h1[kept] <= np.uint64(bound)]
                        own = pa.array(first + text[at], type=pa.int64())
                        columns = [pa.array(np.full(len(at), part, dtype=np.int64)), pa.array(h1[at].view(np.int64))]
                        yield pa.RecordBatch.from_arrays(
                            [*(batch.column(n).take(own) for n in names), *columns], names=[*names, "part", "h1"]
                        )

    kinds = ", ".join(f"{n} {docs.schema[n].dataType.simpleString()}" for n in names)
    return docs.select(*names, "text").mapInArrow(each, f"{kinds}, part long, h1 long")


def _matches_joined(docs: DataFrame, names: list[str], sketches: DataFrame, every: DataFrame) -> DataFrame:
    """The same by joins, for lists of any size. There is one bound for each part, of which there are 64 at most."""
    largest = sketches.groupBy("part").agg(F.max(_unsigned("h1")).alias("bound")).collect()
    probes = document_sketches(docs, names, {r.part: r.bound + (1 << 63) for r in largest})
    met = probes.join(sketches.select("part", "h1").distinct(), ["part", "h1"], "left_semi")
    candidates = met.select(*names).distinct()
    same = [F.col(f"d.{n}").eqNullSafe(F.col(f"c.{n}")) for n in names]
    whole = docs.alias("d").join(candidates.alias("c"), same, "left_semi")
    return shingles(whole, names).join(every.select("h1").distinct(), "h1", "left_semi")


def _unsigned(name: str) -> Column:
    """Longs in the order of the unsigned hashes that they hold: the hash less 2 ** 63."""
    return F.col(name).bitwiseXOR(F.lit(-(1 << 63)))


def item_sketches(every: DataFrame) -> DataFrame:
    """(item, h1, h2, m, part): the sketch of every item, from (item, h1, h2) of all its shingles."""
    own = Window.partitionBy("item")
    ranked = every.withColumn("m", F.count("*").over(own)).withColumn(
        "rank", F.row_number().over(own.orderBy(_unsigned("h1"), "h2"))
    )
    least = F.col("m") - F.ceil(F.col("m") * F.lit(CONTAINED)) + 1
    return ranked.filter(F.col("rank") <= least).withColumn("part", F.floor(F.log2("m")).cast("long")).drop("rank")


def contained_items(
    docs: DataFrame, items: DataFrame, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id", sent: int = SENT
) -> DataFrame:
    """(doc_id, body, item_id, n_shingles, n_shared, containment) of every contained item of every document.

    body is a hash of the document's text; rows that repeat doc_id and text give one result, rows that repeat an
    item_id and text are one item, an item_id with several texts is searched for each of them. Null ids are
    ids like any other; null and empty texts match nothing; no rows on either side give no rows.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), body(F.col(text)).alias("body"), F.col(text).alias("text"))
    tests = items.select(F.col(item_id).alias("item_id"), F.col(text).alias("text")).distinct()
    tests = tests.withColumn("item", F.struct("item_id", body(F.col("text")).alias("body")))
    every = written(shingles(tests, ["item"]).distinct(), "items")
    sketches = written(item_sketches(every), "sketches")
    names = ["doc_id", "body"]
    if every.count() <= sent:
        of = sketches.select("part", "h1").distinct().toArrow()
        part, hashes = of["part"].to_numpy(), of["h1"].to_numpy().view(np.uint64)
        whole = np.sort(every.select("h1").distinct().toArrow()["h1"].to_numpy().view(np.uint64))
        parts = [np.sort(hashes[part == p]) for p in np.unique(part)]
        matches = _matches_sent(rows, names, parts, whole) if len(whole) else shingles(rows.limit(0), names)
    else:
        matches = _matches_joined(rows, names, sketches, every)
    doc = F.struct(*names).alias("doc")
    matches = written(matches.distinct().select(doc, "h1", "h2"), "matches")
    # Candidates first: only their shingles are looked for, however many items share a phrase.
    candidates = matches.join(sketches.select("item", "h1", "h2"), ["h1", "h2"]).select("doc", "item").distinct()
    sizes = every.groupBy("item").agg(F.count("*").alias("n_shingles"))
    wanted = candidates.join(every, "item").join(matches, ["doc", "h1", "h2"])
    verified = wanted.groupBy("doc", "item").agg(F.count("*").alias("n_shared")).join(sizes, "item")
    containment = F.col("n_shared") / F.col("n_shingles")
    return (
        verified.withColumn("containment", containment)
        .filter(F.col("containment") >= CONTAINED)
        .select("doc.*", F.col("item.item_id").alias("item_id"), "n_shingles", "n_shared", "containment")
    )


def decontaminated(docs: DataFrame, items: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` without the documents that contain an item; all columns are kept."""
    found = contained_items(docs, items, text, doc_id).select(F.col("doc_id").alias("__id"), F.col("body").alias("__body"))
    found = written(found.distinct(), "contaminated")
    same = F.col(doc_id).eqNullSafe(F.col("__id")) & (body(F.col(text)) == F.col("__body"))
    return docs.join(found, same, "left_anti")
