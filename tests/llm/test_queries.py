"""The registered queries: SQL where there is some, contract columns, the pipeline's stages."""

import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import brute
import corpus_pipeline
from compare import rows
from odd_rows import ODD
from hearthspark.llm import queries

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for table in ("documents", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF_DIR}/{table}.parquet')")
    return con


@pytest.mark.parametrize("name", list(queries.CHECKS))
def test_query_matches_sql(spark, db, name):
    df = queries.QUERIES[name](spark, SF_DIR)
    result = db.execute(queries.CHECKS[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(columns, result.fetchall())


def test_all_queries_are_registered():
    names = entry.queries()
    assert set(queries.QUERIES) | {"pipeline"} <= set(names)
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{k}" for k in range(1, 14)}


@pytest.mark.parametrize(
    ("name", "kinds"),
    [
        ("op1_sharding", {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"}),
        ("op4_languages", {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"}),
        ("op6_toxicity", {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}),
        ("op7_sketch", {"doc_id": "bigint", "n_chars": "bigint", "edited_sha256": "string", "fingerprint": "string", "edited_fingerprint": "string", "near_edited": "double", "near_next": "double"}),
        ("op8_bpe", {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}),
        ("op9_token_counts", {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"}),
        ("op10_simhash", {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"}),
        ("op11_alignment", {"doc_id": "bigint", **dict.fromkeys(("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"), "bigint"), "groups_sha256": "string"}),
        ("op13_secrets", {"doc_id": "bigint", "n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_sha256": "string", "spans": "string"}),
    ],
)
def test_contract_columns(spark, name, kinds):
    df = queries.QUERIES[name](spark, SF_DIR)
    assert kinds.items() <= dict(df.dtypes).items()
    assert df.count() == spark.read.parquet(f"{SF_DIR}/documents.parquet").count()


def test_simhash_query_by_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    prints = [brute.simhash(t) for _, t in docs]
    roots = brute.components([i for i, _ in docs], lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 3)
    want = {docs[k][0]: (f"{prints[k]:016x}", roots[k]) for k in range(len(docs))}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op10_simhash(spark, SF_DIR).collect()} == want


def test_shard_query_by_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    found = queries.op1_sharding(spark, SF_DIR).collect()
    sizes, slots = {}, {}
    for r in found:
        assert (r.size, r.text_crc32) == (len(docs[r.doc_id].encode()) + 16, zlib.crc32(docs[r.doc_id].encode()))
        sizes[r.shard] = sizes.get(r.shard, 0) + r.size
        slots.setdefault(r.shard, set()).add(r.slot)
    assert all(s == set(range(len(s))) for s in slots.values())
    most = max(r.size for r in found)
    assert max(sizes.values()) - min(sizes.get(k, 0) for k in range(40)) <= 2 * most


def test_pipeline_keeps_columns_and_round_trips(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    out = corpus_pipeline.run(spark, SF_DIR)
    assert 0 < out.count() < docs.count()
    assert out.filter("NOT round_trip").count() == 0
    assert out.select("doc_id").distinct().count() == out.count()


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_and_empty_tables(spark, odd, docs, stage):
    out = stage(spark, odd, SF_DIR)
    if stage is not corpus_pipeline.STAGES[-1][1]:
        assert out.columns == odd.columns
    assert 0 < out.count() <= len(ODD)
    assert stage(spark, docs([]), SF_DIR).count() == 0


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_leave_columns_of_any_name_alone(spark, odd, stage):
    names = ["toxicity", "removed", "n_sentences", "__key", "body", "decoded", "positions", "key", "fp"]
    clash = odd.withColumns({c: F.lit("mine") for c in names}).withColumns({c: F.lit(-1) for c in ("ids", "n_tokens")})
    out = stage(spark, clash, SF_DIR)
    assert set(names) <= set(out.columns) and len(set(out.columns)) == len(out.columns)
    rows = out.collect()
    assert rows and all(r[c] == "mine" for r in rows for c in names)
    if stage is not corpus_pipeline.STAGES[-1][1]:
        assert out.columns == clash.columns and all(r.n_tokens == -1 for r in rows)
    else:
        assert all(r.n_tokens >= 0 for r in rows)
