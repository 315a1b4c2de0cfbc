"""Every query of the library beside its SQL on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

FOLDER = "/root/testdata/sf0.001"


def _norm(x):
    if x is None or x is pd.NaT or x is pd.NA or x != x:
        return "null"
    return f"{x:.10g}" if isinstance(x, float) else str(x)


def rows(df):
    return sorted(tuple(map(_norm, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def test_queries_match_their_sql(spark, tables):
    from tessera.plans import catalog

    sql, wrong = catalog.oracle_sql(), []
    for name, f in catalog.queries().items():
        made = f(spark, FOLDER).toPandas()
        if name in sql and rows(made) != rows(tables.sql(sql[name]).df()):
            wrong.append(name)
        elif name not in sql:
            assert len(made)
    assert not wrong


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
