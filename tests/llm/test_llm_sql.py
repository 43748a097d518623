import duckdb
import pytest

from concourse.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for name_ in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name_} AS SELECT * FROM '{sf}/{name_}.parquet'")
    want = con.execute(queries.ORACLE_SQL[name]).df()
    got = queries.QUERIES[name](spark, sf).toPandas()
    cols = sorted(want.columns)
    assert cols == sorted(got.columns)
    order = lambda df: df[cols].sort_values(cols).reset_index(drop=True)
    assert order(got).equals(order(want).astype(order(got).dtypes))
