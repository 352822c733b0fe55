"""The cleaning of ticks, with each kind of fault."""

from __future__ import annotations

from datetime import datetime, timedelta

from heliograph.plans.cleaning import clean_sql

MONDAY = datetime(2024, 1, 1)


def test_every_fault_is_mended(spark):
    at = lambda h, m=0: MONDAY + timedelta(hours=h, minutes=m)
    rows = [(i, at(i, 1), "view", 100.0 + i % 3) for i in range(60) if i not in (7, 8)]
    rows += [(900, at(3, 1), "view", 555.0)]  # the same time again: the first counts
    rows += [(901, at(10, 30), "view", 90.0), (902, at(10, 50), "view", 101.5)]  # more ticks of one hour
    rows += [(903, at(5 * 24 + 12), "view", 100.0)]  # Saturday
    rows += [(904, at(7 * 24), "view", 150.0)]  # next Monday, over the weekend's gap
    rows += [(905, at(40, 5), "view", 900.0)]  # far off, back an hour later
    rows += [(906, at(4), "other", 1.0), (907, at(4, 2), "view", None)]
    ticks = spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, event_type string, value double")
    got = {r.ts: r for r in spark.sql(clean_sql(False), events=ticks).collect()}
    assert {r.symbol for r in got.values()} == {"view"}
    assert got[at(3)].close == 100.0 and got[at(3)].volume == 1
    assert (got[at(10)].open, got[at(10)].high, got[at(10)].low, got[at(10)].close, got[at(10)].volume) == (101.0, 101.5, 90.0, 101.5, 3)
    assert (got[at(7)].close, got[at(8)].close, got[at(7)].volume) == (100.0, 100.0, 0)  # filled from hour 6
    assert at(5 * 24 + 12) not in got and at(4 * 24 + 22) not in got and got[at(4 * 24 + 21)].volume == 0 and got[at(6 * 24 + 22)].volume == 0
    assert at(40) not in got and at(41) not in got  # the step up and the step back
    assert at(7 * 24) not in got or got[at(7 * 24)].close == 150.0
    assert min(got) == MONDAY and all(r.low <= min(r.open, r.close) and r.high >= max(r.open, r.close) for r in got.values())
