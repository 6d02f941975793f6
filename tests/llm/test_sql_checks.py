"""Queries that SQL can express, on whole tables."""

from __future__ import annotations

import pytest
from harness import compare, connect

from wiretally.llm.queries import oracle_sql, queries

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", oracle_sql())
def test_query_equals_sql(spark, name):
    assert compare(queries()[name], oracle_sql()[name], spark, connect(SF_DIR), SF_DIR) == []
