"""Every query of the engine against its SQL, on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from veldt.plans import catalogue

SF = os.environ.get("VELDT_TEST_SF", "/root/testdata/sf0.001")
QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{name}')")
    return con


def plain(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype.kind not in "fiub" or str(df[c].dtype)[0].isupper():
            df[c] = df[c].astype(str)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query(spark, duck, key):
    got = QUERIES[key](spark, SF).toPandas()
    if key not in SQL:
        assert len(got)
        return
    want = duck.execute(SQL[key]).df()
    assert sorted(got.columns) == sorted(want.columns)
    pd.testing.assert_frame_equal(plain(got), plain(want), check_dtype=False, rtol=1e-6, atol=2e-6)
