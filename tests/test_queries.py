"""Every core query runs; those with SQL give the same rows as it."""

from __future__ import annotations

import pytest
from conftest import DATA, differences

from fieldtrace.plans import registered

# Three drops of either sensor in one recording: none at the smallest scale.
RARE = {"w17_first_drops"}

QUERIES = {k: f for m in registered() for k, f in m.queries().items()}
SQL = {k: q for m in registered() for k, q in m.oracle_sql().items()}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DATA)
    if name in SQL:
        assert differences(got.toPandas(), duck.execute(SQL[name]).df()) == ""
    else:
        assert got.count() > 0 or name in RARE


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(QUERIES)
