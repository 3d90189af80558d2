"""Driver contract: entry() runs on sf0.001; every SQL oracle has a query."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL


def test_oracles_have_queries():
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs)
    assert len(sql) >= 60


@pytest.mark.skipif(not os.path.isdir(SF_SMALL), reason="no test data")
def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 2
    assert {"model", "wmape", "wrmsse", "bias", "pinball_p10", "pinball_p50", "pinball_p90", "n_series"} <= set(df.columns)
