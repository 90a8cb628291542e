"""Queries over whole tables against their SQL."""

import duckdb
import pytest

from entityflow.llm import queries

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = queries.queries()[name](spark, SF)
    want = con.execute(queries.oracle_sql()[name])
    names = sorted(got.columns)
    assert names == sorted(d[0] for d in want.description)
    order = {d[0]: k for k, d in enumerate(want.description)}
    rows = sorted((tuple(r[order[c]] for c in names) for r in want.fetchall()), key=repr)
    assert rows and sorted((tuple(r[c] for c in names) for r in got.collect()), key=repr) == rows
