"""Every registered query equals its SQL check on whole tables."""

from __future__ import annotations

import re

import pytest
from harness import compare, connect

import __spark_entry__ as contract

SF_DIR = "/root/testdata/sf0.001"
# Training-data operators are checked in tests/llm, where that folder is installed.
_OTHER = re.compile(r"op\d+_|pipeline$")
ORACLES = {n: sql for n, sql in contract.oracle_sql().items() if not _OTHER.match(n)}
QUERIES = {n: query for n, query in contract.queries().items() if not _OTHER.match(n)}


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_has_a_check():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_check(spark, con, name):
    assert compare(QUERIES[name], ORACLES[name], spark, con, SF_DIR) == []


def test_entry(spark):
    rows = contract.entry(spark)
    assert {"capture_id", "packet_id", "n", "sizes", "backwards"} <= set(rows.columns)
    assert rows.count() == 20


def test_fixture_totals(spark):
    packets = QUERIES["decode_headers"](spark, SF_DIR)
    assert packets.count() == 703
    assert QUERIES["reversals"](spark, SF_DIR).count() == 337
    assert QUERIES["event_packets"](spark, SF_DIR).count() == 132
    assert QUERIES["event_runs"](spark, SF_DIR).count() == 100
