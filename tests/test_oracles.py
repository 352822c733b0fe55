from __future__ import annotations

import pytest

import __spark_entry__ as entry
from tests.oracle import connection, difference

FOLDER = "/root/testdata/sf0.001"
#: Queries that find nothing in the smallest tables.
MAY_BE_EMPTY = {"j09_weighted_product", "a19_cell_stats", "i03_newey_west_lag3", "i04_ic_summary_quarters", "p17_edge_to_cost", "p18_ic_gate", "c10_morning_long_short", "w15_occurrence_rank", "y30_spread_floor"}


@pytest.fixture(scope="module")
def con():
    return connection(FOLDER)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_its_sql(spark, con, name):
    said = difference(spark, con, entry.queries()[name], entry.oracle_sql()[name], FOLDER)
    assert not said or (said == "no rows" and name in MAY_BE_EMPTY)
