"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from docloom.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and np.isnan(v)):
        return None
    if isinstance(v, (float, np.floating)):
        return f"{v:.9g}"
    if isinstance(v, (list, np.ndarray)):
        return str([plain(x) for x in v])
    return f"{float(v):.9g}" if isinstance(v, (int, np.integer)) and not isinstance(v, (bool, np.bool_)) else str(v)


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(map(str, map(plain, r))) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_rows(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    want = duck.execute(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
