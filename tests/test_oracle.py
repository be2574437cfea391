"""Every query with SQL, on the smallest tables, against DuckDB."""

import os

import duckdb
import pytest

from millrace.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def canon(row):
    return tuple("~" if x is None else repr(round(x, 9)) if isinstance(x, float) else str(x) for x in row)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    want = duck.sql(registry.oracle_sql()[name])
    assert sorted(want.columns) == cols
    got = sorted(canon(r) for r in df.select(*[f"`{c}`" for c in cols]).collect())
    assert got == sorted(canon(r) for r in want.project(",".join(f'"{c}"' for c in cols)).fetchall())
