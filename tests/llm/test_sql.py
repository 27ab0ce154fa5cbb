"""The queries that SQL can express against DuckDB, on whole small tables."""

import duckdb
import pytest

from docloom.llm.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_is_its_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "conversations", "benchmark"):
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    want = con.sql(oracle_sql()[name])
    got = queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda rows: sorted(tuple(str(r[c]) for c in sorted(got.columns)) for r in rows)
    assert rows(r.asDict() for r in got.collect()) == rows(dict(zip(want.columns, x)) for x in want.fetchall())
    if name == "op6_warc_revisits":
        assert {r.status for r in got.collect()} == {"resolved", "validator_mismatch", "no_response"}
