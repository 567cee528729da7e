"""Registered queries against their SQL, and the pipeline."""

import duckdb
import pytest

import __spark_entry__ as contract
import corpus_pipeline
from llm_brute import near_groups
from veilgauge.llm import registry

TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(registry.statements()))
def test_query_equals_sql(spark, folder, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    df = contract.queries()[name](spark, folder)
    columns = sorted(df.columns)
    result = con.execute(contract.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted(repr([row[names.index(c)] for c in columns]) for row in result.fetchall())
    assert sorted(repr([r[c] for c in columns]) for r in df.collect()) == want


def test_one_query_per_operator():
    names = contract.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)] == [1] * 13 and "pipeline" in names


def test_pipeline_stages_equal_brute_force(spark, folder):
    folder = folder.replace("sf0.001", "sf0.01")  # enough labels for the classifier to reject something
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, ids = docs.columns, {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:3]:
        kept = stage(spark, docs, folder).cache()
        now = {r.doc_id for r in kept.collect()}
        assert kept.columns == columns and now < ids, name
        if name == "near copies":
            want = near_groups([(r.doc_id, r.text) for r in docs.collect()], 5, 80, 100)
            assert now == {d for d, _, c in want if d == c}
        docs, ids = kept, now
    packed = corpus_pipeline.STAGES[3][1](spark, docs, folder).collect()
    assert {r.doc_id for r in packed} == ids


def test_pipeline_with_odd_rows(spark, folder, odd_documents, no_documents):
    for docs in (odd_documents, no_documents):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, docs, folder).collect()
