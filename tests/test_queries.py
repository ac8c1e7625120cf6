"""Every query of the catalogue with SQL gives the rows of that SQL; the others run."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from motifmill import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def cells(df, columns):
    return sorted(tuple(None if v != v or v is None else round(v, 4) if isinstance(v, float) else v for v in row) for row in df[columns].astype(object).itertuples(index=False, name=None)) if len(df) else []


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(spark, con, name):
    got = catalogue.QUERIES[name](spark, SF).toPandas()
    want = con.sql(catalogue.ORACLES[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    a, b = (sorted(map(repr, cells(x, columns))) for x in (got, want))
    assert len(a) == len(b)
    off = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    assert not off, off[:3]


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_query_runs(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    out = entry.entry(spark)
    assert out.columns == ["i", "s", "w", "z_hat"] and out.count() == 450
    assert set(catalogue.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
