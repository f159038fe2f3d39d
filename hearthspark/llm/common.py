"""Helpers that the operators share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthspark import session
from hearthspark.session import shared_dir

#: Bytes of text that one vectorised step works on; it bounds the memory of a Python worker.
CHUNK = 1 << 19


#: Rows that a Python worker gets at a time: texts are long, and both sides hold a batch several times over.
ROWS = 1000


def ship(spark: SparkSession) -> None:
    """Give Python workers this package, as ``--py-files`` would, once per application, and texts in small batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS)
    session.ship(spark)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df``, written to the shared folder and read back.

    Cuts the lineage: a lost executor costs a reread, never a recomputation of everything before, and
    what was decided from data (row ids, sampled boundaries) stays as it was.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/hearthspark-llm/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_key(text: Column) -> Column:
    """128 bits that stand for a whole text; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def doc_key_of_parts(doc_id: Column, key: Column) -> Column:
    """128 bits that stand for a doc_id, which may be null, and the key of its text."""
    return F.unhex(F.md5(F.concat_ws(" ", F.coalesce(doc_id.cast("string"), F.lit("null")), F.hex(key))))


def doc_key(doc_id: Column, text: Column) -> Column:
    """128 bits that stand for (doc_id, whole text): rows that repeat both are one document."""
    return doc_key_of_parts(doc_id, text_key(text))


def utf8(column: pa.Array) -> pa.Array:
    """A string column as bytes, null as empty."""
    return pc.fill_null(column.cast(pa.large_binary()), b"")


def batches(texts: pa.Array, most: int = CHUNK) -> Iterator[tuple[int, list[bytes]]]:
    """Consecutive texts as bytes, in lists of about ``most`` bytes; a longer text comes alone."""
    texts = utf8(texts)
    sizes = pc.binary_length(texts).to_pylist()
    first, held = 0, 0
    for i, size in enumerate(sizes):
        if i > first and held + size > most:
            yield first, texts.slice(first, i - first).to_pylist()
            first, held = i, 0
        held += size
    if first < len(sizes):
        yield first, texts.slice(first).to_pylist()


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns of these names: an operator's own columns replace clashing ones."""
    return df.drop(*names)
