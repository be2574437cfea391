"""The operators' queries with SQL, on the smallest tables, against DuckDB."""

import duckdb
import pytest

from millrace.llm import queries

from ..test_oracle import SF, TABLES, canon


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df, want = queries.queries()[name](spark, SF), con.sql(queries.oracle_sql()[name])
    cols = sorted(df.columns)
    assert sorted(want.columns) == cols
    got = sorted(canon(r) for r in df.select(*[f"`{c}`" for c in cols]).collect())
    assert got == sorted(canon(r) for r in want.project(",".join(f'"{c}"' for c in cols)).fetchall())
