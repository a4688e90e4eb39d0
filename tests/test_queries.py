"""Every query with SQL against DuckDB; those without must run."""

from __future__ import annotations

import pytest
from compare import differences, duck

from threadloom.plans import registry


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", registry.QUERIES)
def test_query(spark, con, sf_dir, name):
    df = registry.QUERIES[name](spark, sf_dir)
    if name in registry.ORACLES:
        here, there, some = differences(df, con, registry.ORACLES[name])
        assert here == there and not some, some
        assert here > 0
    else:
        assert df.count() > 0
