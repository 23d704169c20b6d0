"""The package's queries run; those with SQL give the same rows as it."""

from __future__ import annotations

import pytest
from conftest import DATA, differences

from fieldtrace.llm.queries import oracle_sql, queries


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, duck, name):
    got = queries()[name](spark, DATA)
    if name in oracle_sql():
        assert differences(got.toPandas(), duck.execute(oracle_sql()[name]).df()) == ""
    else:
        assert got.count() > 0
