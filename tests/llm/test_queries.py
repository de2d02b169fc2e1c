"""Every dealt operator is a query; those with SQL agree with it; the pipeline's stages hold what they promise."""

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from brute import contamination, quality
from check import TABLES, values
from taskloom.llm.queries import ORACLE, QUERIES
from test_similar import kept

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def test_all_thirteen_are_there():
    assert [q.split("_")[0] for q in QUERIES] == [f"op{n}" for n in range(1, 14)]
    assert [len(s) for s in corpus_pipeline.STAGES] == [2] * 5


@pytest.mark.parametrize("name", list(ORACLE))
def test_query_equals_sql(spark, db, name):
    got, want = QUERIES[name](spark, FOLDER).toPandas(), db.sql(ORACLE[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns) and len(got) > 0
    assert values(got, columns) == values(want, columns)


def test_contract_columns(spark):
    want = {
        "op2_pii": "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string",
        "op3_packing": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
        "op4_simhash": "doc_id bigint, fingerprint string, component_id bigint",
        "op5_substring": "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string",
        "op6_quality": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
        "op9_urls": "page_id bigint, host string, path string, rule string, verdict string",
        "op10_decontamination": "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean",
        "op11_centroids": "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string",
        "op12_fim": "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output_sha256 string, restored_sha256 string",
        "op13_mixing": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    }
    for name, columns in want.items():
        have = dict(QUERIES[name](spark, FOLDER).dtypes)
        assert dict(c.split() for c in columns.split(", ")).items() <= have.items(), name


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, rows = docs.columns, docs.select("doc_id", "text").collect()
    first = corpus_pipeline.quality_rules(spark, docs, FOLDER)
    assert first.columns == columns
    assert not any(quality(r["text"])[-1] for r in first.collect())
    second = corpus_pipeline.line_dedup(spark, docs, FOLDER)
    assert second.columns == columns and second.count() == len(rows)
    assert second.where(F.col("n_chars") != F.char_length("text")).count() == 0
    third = corpus_pipeline.near_dedup(spark, docs, FOLDER)
    assert third.columns == columns
    found, want = {r["doc_id"] for r in third.collect()}, set(kept([tuple(r) for r in rows]))
    assert want <= found and len(found) <= len(want) + 1  # a pair in twelve at Jaccard 0.8 may be missed
    fourth = corpus_pipeline.decontamination(spark, docs, FOLDER)
    items = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    assert fourth.columns == columns
    assert sorted(r["doc_id"] for r in fourth.collect()) == sorted(d for d, *_, bad in contamination([tuple(r) for r in rows], items) if not bad)
    last = corpus_pipeline.run(spark, FOLDER)
    assert last.count() > 0 and last.columns == ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
