"""Prices of zero: Spark's rows are those of the SQL, infinite or NaN as in IEEE 754."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tests.oracle import connection, difference

SOURCE = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def zeros(tmp_path_factory):
    """The smallest tables with zeros among the events: scattered, all of a day and all of an hour."""
    folder = str(tmp_path_factory.mktemp("zeros"))
    for name in os.listdir(SOURCE):
        if name != "events.parquet":
            os.symlink(f"{SOURCE}/{name}", f"{folder}/{name}")
    zero = "event_id % 7 = 0 OR (day(ts) = 9 AND event_type = 'purchase') OR (hour(ts) = 11 AND event_type = 'signup')"
    duckdb.connect().execute(f"COPY (SELECT * REPLACE (CASE WHEN {zero} THEN 0.0 ELSE value END AS value) FROM '{SOURCE}/events.parquet' ORDER BY event_id) TO '{folder}/events.parquet' (FORMAT parquet)")
    return folder


@pytest.mark.parametrize("name", ["j11_previous_day_extremes", "j12_prior_session_extremes", "w31_range_volatility", "a01_tick_microstructure", "j19_forward_extremes", "w01_log_returns", "w35_gap", "w46_percent_change"])
def test_query_equals_its_sql_where_prices_are_zero(spark, zeros, name):
    assert not difference(spark, connection(zeros), entry.queries()[name], entry.oracle_sql()[name], zeros)
