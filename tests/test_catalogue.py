"""Every catalogue query against its SQL on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest
from conftest import SF

from loomcrest.plans import catalogue

TABLES = [p.stem for p in Path(SF).glob("*.parquet")]


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(df):
    df = df[sorted(df.columns)]
    plain = lambda x: None if x is None or isinstance(x, float) and math.isnan(x) else round(float(x), 5) if isinstance(x, float) else str(x)
    return list(df.columns), sorted(repr([plain(x) for x in r]) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", catalogue.QUERIES)
def test_query(spark, sql, name):
    got = catalogue.QUERIES[name](spark, SF).toPandas()
    if name in catalogue.ORACLES:
        assert rows(got) == rows(sql.execute(catalogue.ORACLES[name]).fetchdf())
    else:
        assert len(got)


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
