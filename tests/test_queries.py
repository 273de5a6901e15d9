"""Every query of the library against its SQL, or that it runs and has columns."""

from __future__ import annotations

import pytest
from oracle import DATA, check

from tessera.plans import registry


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, name):
    check(spark, registry.QUERIES[name], registry.SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_query_runs(spark, name):
    df = registry.QUERIES[name](spark, DATA)
    assert df.columns and df.count() >= 0


def test_entry(spark):
    import __spark_entry__ as e

    rows = e.entry(spark).collect()
    assert {r["scope"] for r in rows} >= {"overall"}
    assert set(e.oracle_sql()) <= set(e.queries())
