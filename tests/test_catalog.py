import glob

import duckdb
import numpy as np
import pandas as pd
import pytest

from tidemark import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {p.rsplit('/', 1)[1][:-8]} AS SELECT * FROM '{p}'")
    return c


def rows(df):
    def cell(v):
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and np.isnan(v)):
            return "null"
        return f"{v:.9g}" if isinstance(v, (int, float, np.number)) and not isinstance(v, (bool, np.bool_)) else str(v)

    columns = sorted(df.columns)
    return columns, sorted(tuple(map(cell, r)) for r in df[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_oracle(spark, duck, name):
    assert rows(catalog.queries()[name](spark, SF).toPandas()) == rows(duck.sql(catalog.oracle_sql()[name]).df())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1 and set(e.oracle_sql()) <= set(e.queries())
