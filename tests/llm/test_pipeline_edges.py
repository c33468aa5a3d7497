"""The pipeline and its stages on nulls, empty tables and columns with clashing names."""

import pytest
from helpers import edge_docs
from pyspark.sql import functions as F

import corpus_pipeline

LABELS = "doc_id long, quality int, toxic int"


def clashing(spark):
    """Edge cases with columns named like those that the operators make themselves."""
    docs = edge_docs(spark).withColumn("n_chars", F.length("text")).withColumn("n_lines", F.lit(777)).withColumn("n_removed", F.lit(778))
    return docs.withColumns({c: F.lit(9) for c in ("t1", "t2", "places", "of", "copies", "taken", "kept", "component_id", "t", "at", "k1", "sites")})


@pytest.fixture()
def folder(spark, tmp_path):
    clashing(spark).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 1, 0), (5, 0, 0), (6, 0, 0), (None, 1, 0), (3, None, 0)], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_run_with_nulls_and_clashing_names(spark, folder):
    last = corpus_pipeline.run(spark, folder)
    assert {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(last.columns)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    ids = {r.doc_id for r in docs.collect()}
    assert {r.doc_id for r in last.collect()} <= ids


def test_stages_keep_clashing_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString()
        got = out.collect()
        assert all((r.n_lines, r.n_removed, r.t1, r.kept, r.copies) == (777, 778, 9, 9, 9) for r in got)
    rows = corpus_pipeline.line_dedup(spark, docs, folder).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(r.doc_id) for r in docs.collect())
    assert all((r.text is None) == (r.n_chars is None) and (r.text is None or r.n_chars == len(r.text)) for r in rows)


def test_empty_tables(spark, folder, tmp_path_factory):
    nothing = str(tmp_path_factory.mktemp("empty"))
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{nothing}/documents.parquet")
    spark.createDataFrame([], LABELS).write.parquet(f"{nothing}/labels.parquet")
    assert corpus_pipeline.run(spark, nothing).collect() == []
    docs = spark.read.parquet(f"{nothing}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, nothing).collect() == []
