"""Whole forms of operators, against plain Python."""

from __future__ import annotations

import itertools
import math
from datetime import datetime, timedelta
from statistics import mean, stdev

import __spark_entry__ as entry
from heliograph.functions.recursive import rule_walk_sides
from heliograph.plans.tables import account_sql
from heliograph.sources.tables import daily_bars

FOLDER = "/root/testdata/sf0.001"


def test_all_weights_of_all_symbols(spark):
    bars = {}
    for r in daily_bars(spark, FOLDER).orderBy("symbol", "ts").collect():
        bars.setdefault(r.symbol, []).append((r.ts, r.close))
    first, last = (f(t for x in bars.values() for t, _ in x) for f in (min, max))
    n = (last - first).days + 1
    legs = {s: [0.0] * n for s in sorted(bars)}
    for s, x in bars.items():
        for (_, a), (t, b) in itertools.pairwise(x):
            legs[s][(t - first).days] = b / a - 1
    got = {r.quarters: r for r in entry.queries()["f11_all_weights"](spark, FOLDER).collect()}
    assert len(got) == 5 ** len(legs) - 1
    for quarters in list(itertools.product(range(5), repeat=len(legs)))[1::379]:
        days = [sum(q / 4 * x[i] for q, x in zip(quarters, legs.values(), strict=True)) for i in range(n)]
        run = list(itertools.accumulate(days))
        dd = max(t - c for t, c in zip(itertools.accumulate(run, max), run, strict=True))
        year = sum(days) / ((n - 1) / 365.25)
        r = got[",".join(f"{s} {q}" for s, q in zip(legs, quarters, strict=True))]
        want = year, dd, year / dd, mean(days) / stdev(days) * math.sqrt(365), min(days), sum(quarters) / 4
        assert all(math.isclose(a, b, rel_tol=1e-5, abs_tol=1e-4) for a, b in zip((r.r_year, r.max_dd, r.romad, r.sharpe, r.worst, r.total_weight), want, strict=True))


def test_accounts_fail_pass_or_go_on(spark):
    moves = {"fails": [0.02, -0.13, 0.5], "passes": [0.03, -0.06, 0.08, 0.09], "goes on": [0.01] * 5, "is short": [0.2], "trails": [0.3, 0.0, 0.0, -0.11, 0.2]}
    rows = [(s, datetime(2024, 1, 1) + timedelta(days=i), r) for s, x in moves.items() for i, r in enumerate(x)]
    days = spark.createDataFrame(rows, "symbol string, ts timestamp, r double")
    got = {r.symbol: (r.verdict, r.trading_days, r.failed_at, r.locked_days, float(r.equity)) for r in spark.sql(account_sql("{days}", least_days=4, day_share=None), days=days).collect()}
    assert got == {"fails": ("FAILED", 2, 2, 1, 0.89), "passes": ("PASSED", 4, None, 1, 1.14), "goes on": ("IN_PROGRESS", 5, None, 0, 1.05), "is short": ("IN_PROGRESS", 1, None, 0, 1.2), "trails": ("PASSED", 5, None, 1, 1.39)}
    trailing = {r.symbol: r.verdict for r in spark.sql(account_sql("{days}", peak=True, day_share=0.5), days=days).collect()}
    assert trailing == {"fails": "FAILED", "passes": "FAILED", "goes on": "IN_PROGRESS", "is short": "FAILED", "trails": "FAILED"}


def test_walks_have_sides_targets_and_costs(spark):
    def run(rows, **more):
        return rule_walk_sides(2.0, **more).run(rows)

    up = [(100.0, 101.0, 99.0, True, False, 1.0), (102.0, 104.0, 101.0, False, False, 1.0), (103.0, 103.0, 97.0, False, False, 1.0)]
    assert run(up, target_width=3.0, cost=0.5) == [(None, None), (None, 1.25), (None, None)]
    assert run(up) == [(None, None), (None, None), (None, -1.0)]
    assert run(up, side=-1) == [(None, None), (None, -1.0), (None, None)]
    gap = [(100.0, 101.0, 99.0, True, False, 1.0), (105.0, 106.0, 104.0, False, False, 1.0)]
    assert run(gap, side=-1, cost=1.0) == [(None, None), (None, -3.0)]
    down = [(100.0, 100.0, 99.0, True, False, 1.0), (96.0, 97.0, 95.0, False, False, 1.0)]
    assert run(down, side=-1, target_width=3.0) == [(None, None), (None, 1.5)]
    assert run([(100.0, 102.0, 97.0, True, False, 1.0)], side=-1, target_width=3.0) == [(None, -1.0)]
    assert run(down, side=-1, most=0) == [(None, None), (2.0, None)]
    got = entry.queries()["x03_rule_walk_sides"](spark, FOLDER).collect()
    assert {r.side for r in got} == {1, -1} and all(any(r.at_open is not None or r.in_bar is not None for r in got if r.side == s) for s in (1, -1))


def test_every_text_has_its_own_index(spark, tmp_path):
    import hashlib

    rows = [(1, "b a  b a c"), (1, "another text of one id"), (2, None), (3, ""), (4, " x "), (None, "no id no"), (5, "Ä ä a Ä")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    df = entry.queries()["z13_inverted_index"](spark, str(tmp_path))
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(((i, None if t is None else hashlib.sha256(t.encode()).hexdigest()) for i, t in rows), key=repr)
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
