"""Documents to tokens: toxic documents, near copies, repeated passages and test items go, the rest is encoded.

Each stage works on all that the one before kept and is written as Parquet before the next reads it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthspark.llm import decontamination, simhash, substrings, token_columns, toxicity
from hearthspark.llm.common import ship
from hearthspark.llm.queries import tokenizer
from hearthspark.session import shared_dir


def _packed(docs: DataFrame) -> DataFrame:
    """doc_id, text and all other columns in one, so that no name of an operator's meets one of theirs."""
    rest = [F.col(c) for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", (F.struct(*rest) if rest else F.lit(None)).alias("__rest"))


def _columns(names: list[str]) -> list[Column]:
    """Columns of documents out of packed rows."""
    return [F.col(c) if c in ("doc_id", "text") else F.col("__rest").getField(c).alias(c) for c in names]


def _unpacked(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*_columns(docs.columns))


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model gives less than one half; the model is learned from ``docs`` and labels.

    Null and empty texts are scored like any other; without labels of both classes all scores are equal. Rows that
    repeat are judged alike, no rows give no rows.
    """
    ship(spark)
    model = toxicity.fit(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _unpacked(toxicity.score(_packed(docs), model).filter("toxicity < 0.5"), docs)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near duplicates (3-word shingles, 3 bits), that of the smallest doc_id.

    Texts without words are one group. Null doc_ids come last; of rows that repeat doc_id and text one stays.
    """
    ship(spark)
    return _unpacked(simhash.deduplicated(_packed(docs)), docs)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the passages that an earlier one has; n_chars counts what is left.

    Null texts stay null, texts that are covered wholly become empty; rows that repeat are cut alike.
    """
    ship(spark)
    kept = _unpacked(substrings.remove_repeated(_packed(docs)), docs)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept


def without_test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item. Null and empty texts and items contain and are nothing."""
    ship(spark)
    return _unpacked(decontamination.decontaminated(_packed(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet")), docs)


#: What the last stage adds; columns of ``documents`` of these names are replaced.
ADDED = ["ids", "n_tokens", "round_trip"]


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' columns without text, with the token ids, their number, and whether they decode to the text.

    Null counts as empty: no ids. Rows that repeat stay, no rows give no rows.
    """
    ship(spark)
    both = token_columns.encode_and_decode(_packed(docs).withColumn("__text", F.col("text")), tokenizer())
    added = {
        "ids": F.col("ids"),
        "n_tokens": (F.octet_length("ids") / 4).cast("long"),
        "round_trip": F.col("decoded") == F.coalesce("__text", F.lit("")),
    }
    own = [c for c in docs.columns if c not in ("text", *ADDED)]
    return both.select(*_columns(own), *(added[c].alias(c) for c in ADDED))


STAGES = [
    ("toxicity", without_toxic),
    ("simhash near-dedup", without_near_duplicates),
    ("substring dedup", without_repeated_passages),
    ("benchmark decontamination", without_test_items),
    ("bpe", encoded),
]

#: The scores of the first stage come from a fitted model and the groups of the second from XXH64: no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that the last stage gives for ``documents``."""
    folder = f"{shared_dir(spark)}/corpus-pipeline/{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
