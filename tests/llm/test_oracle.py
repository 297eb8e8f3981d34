"""The operators' queries give DuckDB's rows on the smallest tables."""

import duckdb
import pytest

from variora.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(ORACLE_SQL[name])
    made = QUERIES[name](spark, SF).select(*want.columns)
    assert sorted(map(tuple, made.collect()), key=repr) == sorted(want.fetchall(), key=repr)
