"""Registered queries against their SQL at the smallest size."""

import os

import duckdb
import pytest

from bagloom.plans import registry

SMALL = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SMALL}/{f}'")
    df = registry.QUERIES[name](spark, SMALL)
    found = con.execute(registry.ORACLES[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    near = lambda v: float(f"{v:.9g}") if isinstance(v, float) else v
    want = sorted((tuple(near(v) for v in r) for r in found.fetchall()), key=repr)
    assert sorted((tuple(near(r[c]) for c in columns) for r in df.collect()), key=repr) == want


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_other_queries_give_rows(spark, name):
    assert registry.QUERIES[name](spark, SMALL).count() > 0


def test_entry_points():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and registry.FLAGSHIP in e.queries()
