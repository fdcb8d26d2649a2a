"""The pipeline's stages keep what they should, and all queries are registered."""

import corpus_pipeline
import duckdb
import pytest
from conftest import SF
from pyspark.sql import functions as F

import __spark_entry__ as entry_point
from loamline.llm.oracle import ORACLE
from loamline.llm.queries import QUERIES


def test_registered():
    assert {*QUERIES, "pipeline"} <= entry_point.queries().keys()
    assert set(ORACLE) <= set(QUERIES) and len(QUERIES) == 13


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("_sig", F.lit(1))
    columns, before = docs.columns, docs.count()
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = str(tmp_path / name)
        stage(spark, docs, SF).write.parquet(out)
        docs = spark.read.parquet(out)
        if number < 4:
            assert docs.columns == columns and 0 < docs.count() <= before
            before = docs.count()
    assert docs.filter(F.col("offset") + F.col("length") > 2048).isEmpty()
    assert docs.select("doc_id").distinct().count() == before


def test_no_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql_gives_the_same_rows(spark, name):
    """On whole tables."""
    db = duckdb.connect()
    for table in ("documents", "conversations", "embeddings"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = db.execute(ORACLE[name])
    columns = [d[0] for d in want.description]
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    rows = sorted(map(repr, map(tuple, got.select(*columns).collect())))
    assert rows == sorted(map(repr, want.fetchall())) and rows
