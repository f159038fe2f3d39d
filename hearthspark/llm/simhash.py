"""Near duplicates by SimHash, found by meeting in the middle of small Hamming balls.

Two fingerprints of 64 bits that differ in at most 3 bits have a value between them that is at most 1 bit
from one and at most 2 bits from the other. So every fingerprint emits all values within half the radius, and
fingerprints that emit the same value meet there:

- 0 or 2 differing bits: the parities of the two are equal, and both emit their ball of radius 1;
- 1 or 3 differing bits: one parity is even, the other odd. The odd one also emits values 2 bits away; of any
  three bits two lie in one half of the word, so pairs of bits within a half are enough (992, not 2,016).

All fingerprints that emit one value are within 4 bits of each other, and those within 3 of one that emits it
at radius 1. Such a value therefore links its members in a star around the smallest of its radius-1 members:
every link is a true one, every true link is implied by a path, and no pairs within a group are listed. A
value has at most 1 + 64 + 992 members, whatever the input, so no key is hot.

Most fingerprints are near no other. Before the balls are emitted, a cheaper round keeps only those that share
one half up to one bit with another fingerprint, which every link implies; it emits 17 half words on average
for each half.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthspark.llm.common import CHUNK, batches, doc_key_of_parts, text_key, without, written
from hearthspark.llm.components import connected_components
from hearthspark.llm.hashing import Words, segments, xxh64_spans

SHINGLE = 3
SEED = 42
#: Radius 3 is what the emitted balls are made for.
RADIUS = 3


def _majority(sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Words of 64 bits; bit i is 1 where over half of the hashes have it."""
    bits = (2 * sums > counts[:, None]).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()


def _bit_sums(hashes: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """By owner: how often each bit is set, and the number of hashes. Owners come in order."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    edges = np.searchsorted(owner, np.arange(n + 1))
    sums = np.zeros((n, 64), dtype=np.int64)
    for i in range(n):
        if edges[i + 1] > edges[i]:
            sums[i] = bits[edges[i] : edges[i + 1]].sum(0, dtype=np.int64)
    return sums, np.diff(edges)


def simhash64(texts: list[bytes]) -> np.ndarray:
    """Fingerprints of whole texts: A-Z lowered, words between ASCII white space, 3-word shingles with repeats."""
    pieces: list[bytes] = []
    owner: list[int] = []
    for i, text in enumerate(texts):
        text = text.lower()
        for piece in segments(text, SHINGLE, 4 * CHUNK) if len(text) > 4 * CHUNK and _spaced(text) else (text,):
            pieces.append(piece)
            owner.append(i)
    sums = np.zeros((len(texts), 64), dtype=np.int64)
    counts = np.zeros(len(texts), dtype=np.int64)
    for first in range(0, len(pieces), 4096):
        words = Words(pieces[first : first + 4096])
        text, start, size = words.shingles(SHINGLE)
        some, many = _bit_sums(xxh64_spans(words.buf, start, size, SEED), text, len(words.count))
        at = np.array(owner[first : first + 4096])
        np.add.at(sums, at, some)
        np.add.at(counts, at, many)
    return _majority(sums, counts)


def _spaced(text: bytes) -> bool:
    """Whether single spaces are the only white space, so that the text may be cut at them."""
    return text == b" ".join(text.split())


@F.arrow_udf(T.LongType())
def fingerprint(text: pa.Array) -> pa.Array:
    """64-bit SimHash of each text as a signed long; no words: 0."""
    parts = [simhash64(t) for _, t in batches(text)]
    return pa.array(np.concatenate(parts).view(np.int64) if parts else [], type=pa.int64())


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _near_masks() -> list[int]:
    return [0] + [_signed(1 << i) for i in range(64)]


def _far_masks() -> list[int]:
    return [_signed(1 << i | 1 << j) for half in (0, 32) for i in range(half, half + 32) for j in range(half, i)]


def half_words(prints: DataFrame) -> DataFrame:
    """(key, fp): the halves that each (view, fp) emits; halves within 1 bit of each other share a key.

    A half of even parity emits itself and its 32 neighbours, one of odd parity itself. A key holds the view,
    which half it is, and the value.
    """
    spread = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    distinct = prints.select("view", "fp").distinct().repartition(spread)
    halves = F.array(
        F.struct(F.lit(0).alias("part"), F.col("fp").bitwiseAND(0xFFFFFFFF).alias("half")),
        F.struct(F.lit(1).alias("part"), F.shiftrightunsigned("fp", 32).alias("half")),
    )
    flips = F.lit([0] + [1 << i for i in range(32)])
    place = (F.col("view").cast("long") * 2 + F.col("h.part")) * (1 << 32)
    return (
        distinct.select("view", "fp", F.explode(halves).alias("h"))
        .select("view", "fp", "h", F.explode(flips).alias("flip"))
        .filter("flip = 0 OR bit_count(h.half) % 2 = 0")
        .select((place + F.col("h.half").bitwiseXOR(F.col("flip"))).alias("key"), "fp")
    )


def _view() -> Column:
    return F.shiftright("key", 33).cast("int").alias("view")


def with_neighbours(prints: DataFrame) -> DataFrame:
    """The rows of (node, view, fp) that share half a fingerprint, up to one bit, with another fingerprint.

    Whoever is within 3 bits of another is within 1 bit of it in the low or in the high half.
    """
    same = Window.partitionBy("key")
    kept = (
        half_words(prints)
        .withColumns({"lo": F.min("fp").over(same), "hi": F.max("fp").over(same)})
        .filter("lo != hi")
        .select(_view(), "fp")
        .distinct()
    )
    return prints.join(kept, ["view", "fp"], "left_semi")


def balls(prints: DataFrame) -> DataFrame:
    """(node, view, fp, z): every value z that a fingerprint emits within half the radius."""
    near, far = F.lit(_near_masks()), F.lit(_far_masks())
    odd = prints.filter("bit_count(fp) % 2 = 1")
    z = F.col("fp").bitwiseXOR(F.col("mask")).alias("z")
    return (
        prints.withColumn("mask", F.explode(near)).unionAll(odd.withColumn("mask", F.explode(far))).select("node", "view", "fp", z)
    )


def star_links(prints: DataFrame) -> DataFrame:
    """(a, b): links that join all fingerprints within 3 bits of each other; prints has node = fp."""
    whole = Window.partitionBy("view", "z")
    return (
        balls(prints)
        .withColumn("hub", F.min(F.expr("if(bit_count(z ^ fp) <= 1, node, null)")).over(whole))
        .filter("hub != node")
        .select(F.col("hub").alias("a"), F.col("node").alias("b"))
        .distinct()
    )


def _rooted(by_print: DataFrame) -> DataFrame:
    """``by_print`` (one row for each fp) with the root of the component of each."""
    prints = by_print.select(F.col("fp").alias("node"), F.lit(0).alias("view"), "fp")
    survivors = written(with_neighbours(prints), "neighbours")
    roots = connected_components(star_links(survivors))
    joined = by_print.join(roots, by_print.fp == roots.node, "left")
    return joined.select(*by_print.columns, F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` without its text, with ``fingerprint`` (16 lowercase hex digits) and ``component_id``.

    Fingerprints link at 3 or fewer differing bits; component_id is the smallest doc_id that links reach,
    the document's own included. Null and empty texts, and texts of white space only, have fingerprint 0 and
    are linked like any other. Rows that repeat a doc_id all stay. A null doc_id is never the smallest; a
    component of such rows alone has a null component_id. No rows give no rows. Columns named fingerprint or
    component_id are replaced, other columns are kept.
    """
    own = [c for c in without(docs, text, "fingerprint", "component_id").columns]
    slim = written(docs.select(*own, fingerprint(F.col(text)).alias("__fp")), "fingerprints")
    rooted = _rooted(slim.groupBy(F.col("__fp").alias("fp")).agg(F.min(doc_id).alias("first_id")))
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    labels = rooted.join(smallest, "root").select(F.col("fp").alias("__fp"), "component_id")
    return slim.join(labels, "__fp").select(
        *own, F.lower(F.lpad(F.hex("__fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def deduplicated(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with one document of each component of ``near_duplicates``: that of the smallest doc_id.

    Of rows that share that doc_id the one of the smallest text key stays, of rows that repeat both one. Null doc_ids
    come last. All columns are kept as they are; no rows give no rows.
    """
    slim = written(
        docs.select(F.col(doc_id).alias("doc_id"), text_key(F.col(text)).alias("text_key"), fingerprint(F.col(text)).alias("fp")),
        "fingerprints",
    )
    rank = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "text_key")
    rooted = _rooted(slim.groupBy("fp").agg(F.min(rank).alias("first")))
    stays = rooted.groupBy("root").agg(F.min("first").alias("first")).select(
        doc_key_of_parts(F.col("first.doc_id"), F.col("first.text_key")).alias("__key")
    )
    copies = slim.groupBy(doc_key_of_parts(F.col("doc_id"), F.col("text_key")).alias("__key")).agg(F.count("*").alias("copies"))
    stays = written(copies.join(stays, "__key", "left_semi"), "rows-to-keep")
    keyed = docs.withColumn("__key", doc_key_of_parts(F.col(doc_id), text_key(F.col(text))))
    once = keyed.join(stays.filter("copies = 1").select("__key"), "__key", "left_semi")
    repeated = keyed.join(stays.filter("copies > 1").select("__key"), "__key", "left_semi").dropDuplicates(["__key"])
    return once.unionByName(repeated).drop("__key")
