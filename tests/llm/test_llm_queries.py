"""Queries that SQL can express against DuckDB, over whole tables."""

from __future__ import annotations

import pytest
from compare import differences, duck

from threadloom.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, sf_dir, name):
    here, there, odd = differences(queries.QUERIES[name](spark, sf_dir), duck(sf_dir), queries.ORACLES[name])
    assert here == there > 0 and not odd
