"""Every query with SQL gives the rows that DuckDB gives on the same tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from quern.plans import catalogue

DATA = "/root/testdata/sf0.01"
ROWS_ONLY = sorted(set(catalogue.queries()) - set(catalogue.oracle_sql()))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return c


def canonical(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    return sorted((tuple(None if pd.isna(x) else float(x) if isinstance(x, float) else x for x in row) for row in df.astype(object).itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_same_rows(spark, duck, name):
    ours = catalogue.queries()[name](spark, DATA).toPandas()
    theirs = duck.execute(catalogue.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert canonical(ours) == canonical(theirs)


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_runs(spark, name):
    df = catalogue.queries()[name](spark, DATA)
    assert df.count() > 0 and df.columns
