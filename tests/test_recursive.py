from __future__ import annotations

from datetime import datetime, timedelta

from heliograph.functions.recursive import ewm, rule_walk, seeded
from heliograph.operators.scan import scan


def run(how, rows):
    return how.run(rows)


def test_means():
    assert run(ewm(0.5), [(1.0,), (3.0,), (None,), (4.0,)]) == [(1.0,), (2.0,), (2.0,), (3.0,)]
    assert run(ewm(0.5, 2), [(1.0,), (3.0,)]) == [(None,), (2.0,)]
    assert run(seeded(2), [(1.0,), (3.0,), (4.0,)]) == [(None,), (2.0,), (3.0,)]


def test_a_walk_stops_at_the_open_beyond_the_stop():
    rows = [(100.0, 99.0, True, False, 1.0), (95.0, 94.0, False, False, 1.0), (95.0, 94.0, True, False, 1.0), (96.0, 95.5, False, True, 1.0)]
    assert run(rule_walk(2.0), rows) == [(None, None), (None, -2.5), (None, None), (0.5, None)]


def test_scan_keeps_state_over_batches_and_symbols(spark):
    begin = datetime(2024, 1, 1)
    rows = [(s, begin + timedelta(hours=i), float(i), "x") for i in range(300) for s in ("a", "b", None)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.createDataFrame(rows[::-1], "symbol string, ts timestamp_ntz, x double, y string")
        got = scan(df, ["x"], "y double", seeded(1)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 900 and all(r.y == (r.ts - begin).total_seconds() / 3600 for r in got)
    assert scan(df.limit(0), ["x"], "y double", seeded(1)).count() == 0
