"""The training-data queries that SQL can express against their DuckDB equivalents, and the rest for rows, on the smallest tables."""

import os

import duckdb
import pytest

from quire.llm import queries as Q
from tests.test_oracle import SF, TABLES, plain

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_matches_duckdb(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = Q.queries()[name](spark, SF)
    columns = sorted(df.columns)
    result = con.sql(Q.oracle_sql()[name])
    assert sorted(result.columns) == columns
    at = [result.columns.index(c) for c in columns]
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in result.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(Q.queries()) - set(Q.oracle_sql())))
def test_queries_without_sql_have_a_row_for_each_document(spark, name):
    rows, documents = Q.queries()[name](spark, SF).count(), spark.read.parquet(f"{SF}/documents.parquet").count()
    assert 0 < rows < documents if name == "pipeline" else rows == documents
