"""Every registered query with SQL against DuckDB on the smallest tables."""

from pathlib import Path

import pytest

from meetlake.plans.queries import ORACLES, PLANS
from tests.oracle import compare, connect

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def tables():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, tables, name):
    state, rows, _, note = compare(spark, tables, PLANS[name], ORACLES[name], SF_DIR)
    assert state == "ok", note


def test_flagship_query(spark):
    import __spark_entry__ as entry
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_left_out_columns_are_reached(spark):
    assert PLANS["group_bodyweights"](spark, SF_DIR).count() > 0
    assert PLANS["format_headers"](spark, SF_DIR).where("header_examples <> ''").count() > 0
