"""The stages one after the other, each written and read again, and the registered queries against their SQL."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from periodica.llm import queries

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DIR).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        now = docs.count()
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns and 0.5 * n < now <= n, name
            assert docs.select("text").distinct().count() == now or k == 0
        else:
            assert now == n and docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        n = now


def test_every_operator_has_a_query():
    names = queries.queries()
    assert sorted(int(x[2:].split("_")[0]) for x in names) == list(range(1, 11))
    assert set(queries.oracle_sql()) <= set(names) and "pipeline" in entry.queries()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_is_its_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{DIR}/documents.parquet'")
    want = con.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, DIR).select(*want.columns)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want.fetchall(), key=str)
