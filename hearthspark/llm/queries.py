"""One query per operator, over whole tables, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthspark.llm import alignment, decontamination, languages, quality, ranking, secrets, sharding, simhash, sketches, substrings, token_columns, toxicity
from hearthspark.llm.common import ship


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op7_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of every document and of its edited text, and how alike they are."""
    found = sketches.fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        sketches.fingerprint(F.col("sketch")).alias("fingerprint"),
        sketches.fingerprint(F.col("edited_sketch")).alias("edited_fingerprint"),
        sketches.containment(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        sketches.containment(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )


def tokenizer() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document, by near equal bytes."""
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    docs = docs.withColumn("text_crc32", F.crc32(F.coalesce(F.col("text"), F.lit(""))))
    return sharding.shard(docs, carry=["doc_id", "text_crc32"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the passages that an earlier place has, and what was removed."""
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    return substrings.remove_repeated(docs)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items that documents contain."""
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    return decontamination.contained_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("body")


def op4_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from three quarters of the rows."""
    docs = _documents(spark, sf_dir).select("doc_id", "text", "lang")
    found = languages.predict(docs.select("doc_id", "text"), languages.fit(docs))
    return found.select(
        "doc_id",
        (languages.fold(F.col("doc_id")) == 2).alias("held_out"),
        F.col("nearest").alias("lang_pred"),
        "score",
        "distance",
        "rejected",
    )


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance weight of every document, and whether it is in the sample."""
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    return quality.resample(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labels of four fifths of the labelled rows."""
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model).select(
        "doc_id",
        (toxicity.fold(F.col("doc_id")) == 0).alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= 0.5).cast("int").alias("predicted"),
    )


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the token ids of every document and of what they decode to."""
    both = token_columns.encode_and_decode(_documents(spark, sf_dir).select("doc_id", "text"), tokenizer())
    return both.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    counts = token_columns.count_tokens(_documents(spark, sf_dir).select("doc_id", "text"), tokenizer())
    return counts.withColumn("over_limit", F.col("n_tokens") > 1024)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.near_duplicates(_documents(spark, sf_dir).select("doc_id", "text"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the tokens of two tokenizers line up in every document."""
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    return alignment.align(docs, tokenizer(), public_tokenizers.path("piece_bpe_32k.model"))


def op12_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    return ranking.search(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("item_id", "rank", "doc_id", "score")


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document: those of the rules, and those that the network adds."""
    return secrets.scan(_documents(spark, sf_dir).select("doc_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_substrings": op2_substrings,
    "op3_decontamination": op3_decontamination,
    "op4_languages": op4_languages,
    "op5_quality": op5_quality,
    "op6_toxicity": op6_toxicity,
    "op7_sketch": op7_sketch,
    "op8_bpe": op8_bpe,
    "op9_token_counts": op9_token_counts,
    "op10_simhash": op10_simhash,
    "op11_alignment": op11_alignment,
    "op12_ranking": op12_ranking,
    "op13_secrets": op13_secrets,
}

_LETTERS = "abcdefghijklmnopqrstuvwxyz"


def _words_sql() -> str:
    low = f"translate(text, '{_LETTERS.upper()}', '{_LETTERS}')"
    return f"regexp_extract_all({low}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')"


def _shingles_sql(table: str, key: str) -> str:
    """Distinct shingles of 5 words, of fewer words the whole sequence, of none none."""
    return f"""SELECT DISTINCT {key}, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1),
        lambda i: array_to_string(w[i:i + 4], ' '))) AS shingle
        FROM (SELECT {key}, {_words_sql()} AS w FROM {table}) WHERE len(w) > 0"""


def _sketch_sql(text: str) -> str:
    low = f"translate({text}, '{_LETTERS.upper()}', '{_LETTERS}')"
    return f"""(SELECT list_sort(list_distinct(list_filter(h, lambda x: x < '20' OR x = list_min(h)))) FROM (
        SELECT list_transform(range(1, CASE WHEN len(w) = 0 THEN 1 ELSE greatest(len(w) - 4, 1) + 1 END),
            lambda i: substr(md5(array_to_string(w[i:i + 4], ' ')), 1, 16)) AS h
        FROM (SELECT list_filter(regexp_split_to_array({low}, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w)))"""


def _containment_sql(a: str, b: str) -> str:
    return f"""CASE WHEN len({a}) = 0 AND len({b}) = 0 THEN 1.0 WHEN least(len({a}), len({b})) = 0 THEN 0.0
        ELSE len(list_intersect({a}, {b})) / least(len({a}), len({b})) END::DOUBLE"""


#: The reflected polynomial of CRC-32, and all ones.
_CRC, _ONES = 3988292384, 4294967295

CHECKS: dict[str, str] = {
    "op1_sharding": f"""
WITH steps AS (SELECT list(c ORDER BY n) AS t FROM (SELECT n, list_reduce(list_prepend(n::BIGINT, range(8)),
    lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, {_CRC}) ELSE c >> 1 END) AS c FROM range(256) r(n))),
d AS (SELECT doc_id, md5(coalesce(text, '')) AS k, octet_length(encode(coalesce(text, ''))) + 16 AS size,
    hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT d.*, xor(list_reduce(list_prepend({_ONES}::BIGINT, list_transform(range(len(h) // 2),
    lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), {_ONES}) AS crc
    FROM d, steps),
p AS (SELECT *, coalesce(sum(size) OVER (ORDER BY k, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    sum(size) OVER () AS total FROM c),
s AS (SELECT *, least(39, before * 40 // total)::INTEGER AS shard FROM p)
SELECT doc_id, size::BIGINT AS size, crc AS text_crc32, 'bytes' AS law, shard,
    row_number() OVER (PARTITION BY shard ORDER BY k, doc_id) - 1 AS slot, NULL::INTEGER AS grown_shard
FROM s
""",
    "op7_sketch": f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
p AS (SELECT doc_id, t, coalesce(lead(t) OVER o, first(t) OVER o) AS n FROM d
    WINDOW o AS (ORDER BY doc_id DESC NULLS LAST, md5(t) ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
e AS (SELECT doc_id, t, n, left(t, length(t) - length(t) // 2) || left(n, length(t) // 2) AS e FROM p),
s AS (SELECT doc_id, t, e, {_sketch_sql("t")} AS a, {_sketch_sql("e")} AS b, {_sketch_sql("n")} AS c FROM e)
SELECT doc_id, length(t) AS n_chars, sha256(e) AS edited_sha256, array_to_string(a, '') AS fingerprint,
    array_to_string(b, '') AS edited_fingerprint, {_containment_sql("a", "b")} AS near_edited,
    {_containment_sql("a", "c")} AS near_next
FROM s
""",
    "op12_ranking": f"""
WITH d AS (SELECT doc_id, {_words_sql()} AS w FROM documents),
i AS (SELECT item_id, {_words_sql()} AS w FROM benchmark),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM d) GROUP BY ALL),
qf AS (SELECT item_id, term, count(*) AS qf FROM (SELECT item_id, unnest(w) AS term FROM i) GROUP BY ALL),
s AS (SELECT count(*) AS docs, sum(len(w))::BIGINT AS total FROM d WHERE len(w) > 0),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::BIGINT AS w FROM df, s),
m AS (SELECT doc_id, 100 - 75 + ((75 * len(w) * docs) // total) AS m FROM d, s),
r AS (SELECT item_id, doc_id, sum(qf * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
    FROM qf JOIN tf USING (term) JOIN w USING (term) JOIN m USING (doc_id) GROUP BY ALL),
o AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score
    FROM r WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM o WHERE rank <= 10
""",
    "op3_decontamination": f"""
WITH d AS ({_shingles_sql("documents", "doc_id")}),
i AS ({_shingles_sql("benchmark", "item_id")}),
n AS (SELECT item_id, count(*) AS n_shingles FROM i GROUP BY item_id),
s AS (SELECT doc_id, item_id, count(*) AS n_shared FROM d JOIN i USING (shingle) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_shingles, n_shared, n_shared / n_shingles AS containment
FROM s JOIN n USING (item_id) WHERE n_shared / n_shingles >= 0.8
""",
}
