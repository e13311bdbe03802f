"""The correctness gate: every registered query equals its DuckDB oracle at sf0.01."""

import pytest

from churnlab.plans.catalog import NO_ORACLE, QUERIES
from conftest import SF01
from oracle_harness import compare


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in NO_ORACLE])
def test_query_matches_oracle(spark, name):
    r = compare(spark, name, SF01)
    assert r["ok"], r


def test_entry_smoke(spark):
    import __spark_entry__ as E

    df = E.entry(spark)
    assert len(df.columns) == 18 and df.count() > 0
    assert set(E.oracle_sql()) <= set(E.queries())
