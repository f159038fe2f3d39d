"""BPE encoding, decoding and token counts of tables of texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthspark.llm.bpe import Decoder
from hearthspark.llm.common import batches, without
from hearthspark.llm.machine import tokenize

_ROUND_TRIP = T.StructType([T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())])


def encoded(text: Column, path: str) -> Column:
    """The ids of each text, as little-endian unsigned 32-bit words."""

    @F.arrow_udf(T.BinaryType())
    def ids(text: pa.Array) -> pa.Array:
        return pa.array([i for _, some in batches(text) for i in tokenize(path, some, True)[1]], type=pa.binary())

    return ids(text)


def decoded(ids: Column, path: str) -> Column:
    """The text of each list of ids."""

    @F.arrow_udf(T.StringType())
    def texts(ids: pa.Array) -> pa.Array:
        back = Decoder(path)
        return pa.array([back.feed(i.as_py() or b"") + back.close() for i in ids], type=pa.string())

    return texts(ids)


def _both(text: Column, path: str) -> Column:
    @F.arrow_udf(_ROUND_TRIP)
    def both(text: pa.Array) -> pa.Array:
        back = Decoder(path)
        ids: list[bytes] = []
        said: list[str] = []
        for _, some in batches(text):
            for i in tokenize(path, some, True)[1]:
                ids.append(i)
                said.append(back.feed(i) + back.close())
        return pa.StructArray.from_arrays(
            [pa.array(ids, type=pa.binary()), pa.array(said, type=pa.string())], names=["ids", "decoded"]
        )

    return both(text)


def encode_and_decode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``docs`` without its text, with ``ids`` (binary, little-endian 32-bit words) and ``decoded``.

    Null counts as empty: no ids, empty text. Strings of special tokens inside a text become those tokens, as
    the tokenizer file has it; no token is added. Both ways run in one pass over the rows, without a shuffle.
    Columns named ids or decoded are replaced, all others kept; rows that repeat stay; no rows give no rows.
    """
    own = without(docs, text, "ids", "decoded").columns
    both = docs.select(*own, _both(F.col(text), path).alias("__both"))
    return both.select(*own, F.col("__both.ids").alias("ids"), F.col("__both.decoded").alias("decoded"))


def count_tokens(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``docs`` without its text, with ``n_bytes`` (UTF-8) and ``n_tokens``.

    Null counts as empty: no bytes, no tokens. Strings of special tokens inside a text count as one each.
    Columns of these names are replaced, all others kept; rows that repeat stay; no rows give no rows.
    """

    @F.arrow_udf(T.LongType())
    def tokens(text: pa.Array) -> pa.Array:
        parts = [tokenize(path, some)[0] for _, some in batches(text)]
        return pa.array(np.concatenate(parts) if parts else np.empty(0, dtype=np.int64), type=pa.int64())

    own = without(docs, text, "n_bytes", "n_tokens").columns
    size = F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long")
    return docs.select(*own, size.alias("n_bytes"), tokens(F.col(text)).alias("n_tokens"))
