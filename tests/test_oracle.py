"""Every registered query that has SQL against DuckDB on the smallest tables."""

import os

import duckdb
import numpy as np
import pytest

from lattica import plans, registry  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return c


def cell(v):
    if v is None or (isinstance(v, (float, np.floating)) and np.isnan(v)):
        return "~"
    if isinstance(v, (float, np.floating)):
        return f"{v:.5f}".replace("-0.00000", "0.00000")
    if isinstance(v, (int, np.integer)) and not isinstance(v, (bool, np.bool_)):
        return f"{int(v):.5f}"
    return str(v)


def rows(frame):
    return sorted(tuple(cell(v) for v in r) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query(spark, duck, name):
    got, want = registry.QUERIES[name](spark, SF).toPandas(), duck.execute(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, name):
    frame = registry.QUERIES[name](spark, SF).toPandas()
    assert len(frame.columns)
