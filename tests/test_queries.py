"""Every core query with SQL gives DuckDB's rows on the smallest tables."""

import decimal

import duckdb
import pytest

from variora import corpus_queries, source_queries, study_queries  # noqa: F401  (add their queries to the core ones)
from variora.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    if name not in ORACLE_SQL:
        return
    rel = duck.sql(ORACLE_SQL[name])
    columns, rows = rel.columns, rel.fetchall()
    plain = lambda v: float(v) if isinstance(v, decimal.Decimal) else v
    order = lambda names, data: sorted(repr(tuple(plain(r[names.index(c)]) for c in sorted(names))) for r in data)
    assert sorted(columns) == sorted(df.columns)
    assert order(df.columns, got) == order(columns, rows)
