"""Threshold-scaled sketches of documents, in SQL functions only.

A sketch holds every shingle hash below a fixed fraction of the hash space (the first FIGURES hexadecimal
digits of an MD5, below LIMIT), and the smallest hash in any case, so that no text with words has an empty one.
Sketches of different texts are samples by the same rule: the sketch of several texts together is the union of
theirs (less a smallest hash that is not below the limit and no longer smallest), and what two sketches share
estimates what the texts share, however unequal their lengths are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHINGLE = 5
#: One hash in eight is kept: those whose first hexadecimal digits are below this.
LIMIT = "20"
FIGURES = 16
#: Splitters between ranges of documents, by shuffle partition; each range is one group of a window.
RANGES = 4


def sketch(text: Column) -> Column:
    """The sketch of a text, an ascending array of hexadecimal numbers; empty if the text has no words.

    Words are what is between ASCII white space, A-Z lowered; shingles have five words, fewer words are one.
    """
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.filter(F.split(low, "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != "")

    def of_words(w: Column) -> Column:
        heads = F.sequence(F.lit(1), F.greatest(F.size(w) - (SHINGLE - 1), F.lit(1)))
        digest = F.transform(heads, lambda i: F.substring(F.md5(F.concat_ws(" ", F.slice(w, i, SHINGLE))), 1, FIGURES))
        return F.when(F.size(w) > 0, digest).otherwise(F.array().cast("array<string>"))

    return kept(_let(words, of_words))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value evaluated once per row: inside a lambda, outer expressions are evaluated anew."""
    return F.get(F.transform(F.array(value), use), 0)


def kept(hashes: Column) -> Column:
    """The distinct hashes below the limit and the smallest one, ascending."""

    def chosen(h: Column) -> Column:
        return _let(F.array_min(h), lambda least: F.filter(h, lambda x: (x < LIMIT) | (x == least)))

    return F.sort_array(F.array_distinct(_let(hashes, chosen)))


def merged(sketches: Column) -> Column:
    """The sketch of several texts together, from an array of their sketches."""
    return kept(F.flatten(sketches))


def containment(a: Column, b: Column) -> Column:
    """The share of the smaller sketch that the other has, too; two empty ones: 1, one empty: 0."""
    least = F.least(F.size(a), F.size(b))
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when(least == 0, 0.0).otherwise(shared / least)


def fingerprint(hashes: Column) -> Column:
    """A sketch as a string."""
    return F.array_join(hashes, "")


def _range_of(value: Column, splitters: list) -> Column:
    """How many of the descending splitters are at or above the value, by halving."""
    listed = F.array(*map(F.lit, splitters)) if splitters else F.array().cast("array<long>")
    steps = [1 << k for k in reversed(range(max(len(splitters), 1).bit_length()))]
    found = F.lit(0)
    if not splitters:
        return found
    return F.aggregate(
        F.array(*map(F.lit, steps)),
        F.lit(0),
        lambda at, step: F.when(
            (at + step <= len(splitters)) & (F.get(listed, at + step - 1) >= value), at + step
        ).otherwise(at),
    )


def with_next(docs: DataFrame, columns: list[str], text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``columns`` of each document and, as ``next``, of the one after it by descending doc_id.

    After the last comes the first. Equal doc_ids follow each other by text, null ones come last. The documents
    are shuffled once, into ranges between sampled splitters (actual doc_ids); the rows at a splitter also go,
    as guests, to the end of the range before, so that no range needs another one's answer.
    """
    spark = docs.sparkSession
    order = F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63)))
    n = max(1, RANGES * int(spark.conf.get("spark.sql.shuffle.partitions")))
    shares = [k / n for k in range(1, n)] or [0.5]
    row = docs.agg(F.approx_percentile(order, shares, 20 * n).alias("at"), F.max(order).alias("top")).first()
    if row["top"] is None:
        return docs.select(F.struct(*columns).alias("own"), F.struct(*columns).alias("next"))
    splitters = sorted({int(x) for x in row["at"]} - {row["top"]}, reverse=True)
    placed = docs.select(F.struct(*columns).alias("own"), order.alias("order"), F.md5(F.coalesce(text, F.lit(""))).alias("tie"))
    home = _range_of(F.col("order"), splitters)
    guest = F.when(F.col("order") == row["top"], len(splitters)).when(
        F.col("order").isin(splitters) if len(splitters) <= 16 else F.array_contains(F.array(*map(F.lit, splitters)), F.col("order")),
        home - 1,
    )
    rows = placed.select("own", "order", "tie", F.explode(F.array_compact(F.array(
        F.struct(home.alias("range"), F.lit(False).alias("guest")),
        F.when(guest.isNotNull(), F.struct(guest.alias("range"), F.lit(True).alias("guest"))),
    ))).alias("at"))
    rows = rows.select("own", "order", "tie", "at.range", "at.guest")
    sequence = Window.partitionBy("range").orderBy("guest", F.desc("order"), "tie")
    return rows.withColumn("next", F.lead("own").over(sequence)).filter("NOT guest").select("own", "next")


def edited(own: Column, after: Column) -> Column:
    """A text whose last half (of code points, rounded down) is replaced by as many of the next text's first, or all."""
    n = F.char_length(own)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(own, F.lit(1), n - half), F.substring(after, F.lit(1), half))


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_chars, edited, sketch, edited_sketch, next_sketch) of every document.

    Null texts count as empty. Rows that repeat doc_id and text follow each other; a single document is its own
    next one; no rows give no rows. Other columns are left out.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    paired = with_next(rows.withColumn("sketch", sketch(F.col("text"))), ["doc_id", "text", "sketch"])
    changed = paired.withColumn("edited", edited(F.col("own.text"), F.col("next.text")))
    return changed.select(
        F.col("own.doc_id").alias("doc_id"),
        F.char_length("own.text").cast("long").alias("n_chars"),
        "edited",
        F.col("own.sketch").alias("sketch"),
        sketch(F.col("edited")).alias("edited_sketch"),
        F.col("next.sketch").alias("next_sketch"),
    )
