"""Groups of many rows: no task holds one whole, and the rows are those of the SQL."""

from __future__ import annotations

import os

import duckdb

import __spark_entry__ as entry
from tests.oracle import connection, difference

SOURCE = "/root/testdata/sf0.001"


def changed(folder, **tables: str) -> str:
    """The smallest tables with some replaced by what a SELECT gives."""
    for name in os.listdir(SOURCE):
        table = name.removesuffix(".parquet")
        if table in tables:
            duckdb.connect().execute(f"COPY ({tables[table].format(f'{SOURCE}/{name}')}) TO '{folder}/{name}' (FORMAT parquet)")
        else:
            os.symlink(f"{SOURCE}/{name}", f"{folder}/{name}")
    return str(folder)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_squared_errors_need_no_window(spark, tmp_path):
    flags = "CASE WHEN l_orderkey = 1 AND l_linenumber = 1 THEN 'X' WHEN l_orderkey % 5 > 0 THEN l_returnflag END"
    folder = changed(tmp_path, lineitem=f"SELECT * REPLACE ({flags} AS l_returnflag) FROM '{{}}'")
    query = entry.queries()["i18_r_squared"]
    assert not difference(spark, connection(folder), query, entry.oracle_sql()["i18_r_squared"], folder)
    assert "Window" not in plan(query(spark, folder))


def test_papers_are_ranked_as_far_as_turns_go(spark, tmp_path):
    folder = changed(tmp_path, documents="SELECT nullif(i, 7) AS doc_id, 'breakout momentum vwap garch' AS text FROM range(90) AS r(i)")
    query = entry.queries()["z17_hypothesis_catalogue"]
    assert not difference(spark, connection(folder), query, entry.oracle_sql()["z17_hypothesis_catalogue"], folder)
    found = plan(query(spark, folder))
    assert "WindowGroupLimit" in found and "text#" not in found
