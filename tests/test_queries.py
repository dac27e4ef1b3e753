"""Every registered query against its SQL on the smallest test tables."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
from check_oracle import compare, connect

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query_equals_sql(spark, con, name):
    verdict, note = compare(spark, con, SF, name, entry.oracle_sql(), entry.queries())
    assert verdict in ("equal", "rows only"), note


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
