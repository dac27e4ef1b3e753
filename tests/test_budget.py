import duckdb
import pytest

from corrobora.plans import catalog, monitor_queries
from corrobora.plans.sqlparts import lcb_fraction_sql, lcb_sql


def test_budgets():
    """Five budgets; query and SQL follow from the same constant."""
    assert monitor_queries.BUDGETS == (25, 50, 100, 200, 300)
    assert "unnest([25, 50, 100, 200, 300])" in catalog.SQL["budget_curve"]


@pytest.mark.parametrize("delta", [0.05, 0.2])
def test_fraction_and_series_agree(delta):
    """Both forms of the quantile in SQL, whole and decayed counts, and equal counts under several keys."""
    con = duckdb.connect()
    con.execute("""CREATE TABLE counts AS SELECT row_number() OVER () AS k, s AS succ, f AS fail
      FROM (SELECT unnest([0.0, 0.37, 1, 4, 33.5, 90, 90]::DOUBLE[]) AS s), (SELECT unnest([0.0, 0.81, 2, 17, 64.25]::DOUBLE[]) AS f)""")
    one, other = lcb_sql("counts", "k", delta), lcb_fraction_sql("counts", "k", delta)
    n, apart = con.execute(f"SELECT count(*), max(abs(a.trust - b.trust)) FROM ({one}) a JOIN ({other}) b USING (k)").fetchone()
    assert n == 35 and apart < 1e-9
