"""Registered queries of the subpackage and the pipeline on the smallest table."""

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from boardsift.llm import catalog

KEYS = {"op1_latent_leaks": "doc_id", "op10_preference_pairs": "conv_id", "op8_wrapper_text": "page_id",
        "op12_walsh_codes": "vec_id", "op13_rotated_clusters": "vec_id"}


def test_one_query_for_each_operator():
    assert [sum(k.startswith(f"op{n}_") for k in entry.queries()) for n in range(1, 14)] == [1] * 13
    assert "pipeline" in entry.queries() and len(corpus_pipeline.STAGES) == 5


@pytest.mark.parametrize("name", catalog.ORACLES)
def test_equal_sql(spark, sf_dir, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    con = duckdb.connect()
    for t in ("conversations", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS FROM '{sf_dir}/{t}.parquet'")
    rel = con.sql(catalog.ORACLES[name])
    assert sorted(rel.columns) == sorted(df.columns)
    assert sorted(str(tuple(r[c] for c in rel.columns)) for r in df.collect()) == sorted(map(str, rel.fetchall()))


@pytest.mark.parametrize("name", [k for k in catalog.QUERIES if k not in KEYS])
def test_one_row_for_each_document(spark, sf_dir, name):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = catalog.QUERIES[name](spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in docs.select("doc_id").collect())


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        path = corpus_pipeline.fresh_path(spark, "test-stage")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        ids = [r.doc_id for r in docs.select("doc_id").collect()]
        assert len(ids) == len(set(ids)) and set(ids) <= before
        before = set(ids)
    assert before and docs.filter("n_tokens <> size(ids)").isEmpty()
