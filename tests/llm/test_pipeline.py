"""The pipeline on the smallest data and on the fixture, and the SQL of the subpackage."""

import oracle
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tempora.llm import queries

SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_sql(spark, sf_dir, name):
    assert oracle.difference(spark, sf_dir, queries.queries()[name], SQL[name]) == ""


def test_stages_keep_columns_and_clean_documents(spark, tricky, nothing, sf_dir):
    for docs in (tricky, nothing):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, sf_dir)
            assert out.columns == docs.columns and out.schema["text"].dataType == docs.schema["text"].dataType, name
            assert out.count() <= docs.count()
            docs = out
    kept = {r.doc_id for r in corpus_pipeline.STAGES[2][1](spark, tricky, sf_dir).collect()}
    assert {3, 4, 5, 7, 12} <= kept and 6 not in kept and 8 not in kept


def test_near_dedup_keeps_rows_without_an_id(spark, tricky, sf_dir):
    stage = corpus_pipeline.STAGES[2][1]
    kept = [r.text for r in stage(spark, tricky, sf_dir).collect() if r.doc_id is None]
    assert kept == ["a row without an id"]
    body = " ".join(f"w{i}" for i in range(300))
    rows = [(None, body), (None, body + " and more"), (None, "only here"), (None, "only here"), (None, None), (7, "Only  here"), (8, "x y"), (None, body + " " + " ".join(f"v{i}" for i in range(45)))]
    out = stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), sf_dir).collect()
    assert sorted((r.doc_id or 0) for r in out) == [0, 0, 7, 8]
    assert None in {r.text for r in out if r.doc_id is None} and len({r.text for r in out}) == 4


def test_run(spark, sf_dir):
    pieces = corpus_pipeline.run(spark, sf_dir)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert pieces.join(docs, "doc_id", "left_anti").count() == 0
    bad = pieces.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t")).where("n <> t")
    assert bad.count() == 0
