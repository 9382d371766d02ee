"""Every deterministic query equals its DuckDB oracle on the smallest tables."""
import math

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF_SMALL
from retention.sources.tables import TABLES, table_path

SQL = E.oracle_sql()


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v


def _key(row):
    return tuple((0, "") if v is None else (1, str(v)) for v in row)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{table_path(SF_SMALL, t)}')")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, con, name):
    sdf = E.queries()[name](spark, SF_SMALL)
    rel = con.execute(SQL[name])
    dcols = [d[0] for d in rel.description]
    assert sorted(sdf.columns) == sorted(dcols)
    order = [dcols.index(c) for c in sdf.columns]
    srows = sorted((tuple(_norm(v) for v in r) for r in sdf.collect()), key=_key)
    drows = sorted((tuple(_norm(r[i]) for i in order) for r in rel.fetchall()), key=_key)
    assert len(srows) == len(drows)
    assert [[str(x) for x in r] for r in srows] == [[str(x) for x in r] for r in drows]


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "churn_rate_pct" in df.columns
