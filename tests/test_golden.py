"""Literal cases with known answers, through the SQL that the queries use."""

from __future__ import annotations

import math
from datetime import date, datetime, timedelta

import pytest

from heliograph.functions.linear import ema, fading, seeded, wilder
from heliograph.functions.recursive import ewm
from heliograph.functions.recursive import seeded as seeded_step
from heliograph.functions.series import drawdown, true_range
from heliograph.operators.asof import as_of
from heliograph.operators.resample import tick_bars
from heliograph.operators.staged import with_stages
from heliograph.plans import calendar, statistics
from heliograph.plans.tables import account_sql
from heliograph.plans.trades import Arrays, resolved

BEGIN = datetime(2024, 1, 1)


def bars_of(spark, rows, name="s"):
    """Hourly bars from (open, high, low, close)."""
    return spark.createDataFrame([(name, BEGIN + timedelta(hours=i), *map(float, r), 1.0) for i, r in enumerate(rows)], "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double")


@pytest.mark.parametrize(
    ("side", "stop", "take", "high", "low", "close", "want"),
    [
        (1, 98, 103, 101, 97.5, 100, ("stop", 98)),
        (1, 98, 103, 103.5, 99, 102, ("take", 103)),
        (1, 98, 103, 104, 97, 100, ("stop", 98)),
        (1, 90, 110, 101, 99, 100.5, ("time_exit", 100.5)),
        (-1, 102, 97, 102.5, 99, 100, ("stop", 102)),
        (-1, 102, 97, 100.5, 96.5, 98, ("take", 97)),
    ],
)
def test_one_bar_against_its_barriers(spark, side, stop, take, high, low, close, want):
    inner = f"SELECT 's' AS symbol, {side} AS side, 100D AS entry, {stop}D AS stop, {take}D AS take, 2D AS risk, 0D AS cost, array(named_struct('o', 100D, 'h', {high}D, 'l', {low}D, 'c', {close}D)) AS rest"
    r = spark.sql(resolved(Arrays(False), inner)).first()
    assert (r.reason, r.leave) == want and r.r == side * (want[1] - 100) / 2


@pytest.mark.parametrize(("changes", "want"), [({6: (100, 100, 98, 100)}, -1.0), ({7: (97, 97, 97, 97)}, -1.5), ({8: (100, 104.5, 100, 100)}, 2.0 + 0.25 * 0), ({7: (100, 104.5, 98, 100)}, -1.0)])
def test_results_with_gaps_and_their_mirror(spark, changes, want):
    """Flat at 100, in at the open of bar 6, risk 2, target 2 risks, 10 bars; the mirror series gives the same for the other side."""
    for side in (1, -1):
        turn = lambda x, side=side: x if side > 0 else 200 - x
        rows = [changes.get(i, (100, 100, 100, 100)) for i in range(6, 16)]
        rest = ", ".join(f"named_struct('o', {turn(o)}D, 'h', {max(turn(h), turn(low))}D, 'l', {min(turn(h), turn(low))}D, 'c', {turn(c)}D)" for o, h, low, c in rows)
        inner = f"SELECT 's' AS symbol, {side} AS side, 100D AS entry, {100 - side * 2}D AS stop, {100 + side * 4}D AS take, 2D AS risk, 0D AS cost, array({rest}) AS rest"
        r = spark.sql(resolved(Arrays(False), inner, gaps=True)).first()
        assert math.isclose(r.r, want, abs_tol=1e-9)


def test_range_warm_up(spark):
    rows = [(i, i + 1, i - 1, i) for i in range(1, 31)]
    got = with_stages(bars_of(spark, rows), [{"tr": f"coalesce({true_range()}, high - low)"}, *fading({"atr": wilder("tr", 14, 14)})]).orderBy("ts").collect()
    assert all(r.atr is None for r in got[:13]) and all(r.atr > 0 for r in got[13:])


def test_drawdown(spark):
    for equity, want in (([100, 120, 90, 110, 80, 130], 40), ([100, 101, 102, 103], 0)):
        got = with_stages(bars_of(spark, [(x, x, x, x) for x in equity]), [{"dd": drawdown("close")}]).collect()
        assert min(r.dd for r in got) == -want


def test_account_verdicts(spark):
    def verdict(equity, **more):
        days = spark.createDataFrame([("a", BEGIN + timedelta(days=i), (b - a) / 100_000) for i, (a, b) in enumerate(zip(equity, equity[1:], strict=False))], "symbol string, ts timestamp, r double")
        return spark.sql(account_sql("{days}", **more), days=days).first()

    assert verdict([100_000, 89_999]).verdict == "FAILED"
    assert verdict([100_000, 120_000, 109_000], peak=True).verdict == "FAILED"
    assert verdict([100_000, 94_900, 94_900], day_share=None).locked_days == 1
    assert verdict([100_000, 111_000, 111_000, 111_000], day_share=None).verdict == "IN_PROGRESS"
    assert verdict([100_000] + [111_000] * 6, day_share=None).verdict == "PASSED"
    assert verdict([100_000, 108_000, 108_500, 109_000, 109_500, 110_000], least_days=1, day_share=0.4).verdict == "FAILED"
    r = verdict([100_000, 103_000, 106_000, 109_000, 111_000], least_days=3, day_share=0.9)
    assert r.verdict == "PASSED" and math.isclose(float(r.equity), 1.11)


def test_fading_sums_equal_the_row_by_row_recursion(spark):
    import random

    rng = random.Random(1)
    rows = [("ab"[i % 2], BEGIN + timedelta(hours=i), None if i < 4 or i % 37 == 5 else rng.gauss(100, 5)) for i in range(1500)]
    means = {"e": ema("x", 12), "w": wilder("x", 14, 14), "s": seeded("x", 14), "h": ("x", 0.5), "slow": ema("x", 200)}
    got = {(r.symbol, r.ts): r for r in with_stages(spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, x double"), fading(means)).collect()}
    for symbol in "ab":
        steps = {"e": ewm(2 / 13), "w": ewm(1 / 14, 14), "s": seeded_step(14), "h": ewm(0.5), "slow": ewm(2 / 201)}
        own = [(ts, x) for s, ts, x in rows if s == symbol]
        for name, how in steps.items():
            for (ts, _), (y,) in zip(own, how.run([(x,) for _, x in own]), strict=True):
                found = got[symbol, ts][name]
                assert (y is None) == (found is None) and (y is None or math.isclose(y, found, rel_tol=1e-12))


def test_as_of_over_slices_ties_and_nulls(spark):
    right = [("a", BEGIN + timedelta(hours=h), v) for h, v in ((1, 1), (1, 3), (30, 5), (200, None), (201, 9))] + [("b", None, 4), (None, BEGIN, 7)]
    left = [(k, BEGIN + timedelta(hours=h), i) for i, (k, h) in enumerate([("a", 0), ("a", 1), ("a", 29), ("a", 31), ("a", 150), ("a", 200), ("a", 500), ("b", 9), ("c", 9), (None, 3)])] + [("a", None, 99)]
    df = as_of(spark.createDataFrame(left, "k string, ts timestamp_ntz, i int"), spark.createDataFrame(right, "k string, ts timestamp_ntz, v int"), "ts", ["k"], ["v"])
    assert {r.i: r.v for r in df.collect()} == {0: None, 1: 3, 2: 3, 3: 5, 4: 5, 5: None, 6: 9, 7: None, 8: None, 9: 7, 99: None}


def test_ticks_at_one_time_are_ordered_by_key(spark):
    rows = [("s", BEGIN, 3.0, 2), ("s", BEGIN, 7.0, 1), ("s", BEGIN, 5.0, 3), ("s", BEGIN, None, 0)]
    for some in (rows, rows[::-1]):
        r = tick_bars(spark.createDataFrame(some, "symbol string, ts timestamp_ntz, price double, id int").repartition(2), 60, key="id").first()
        assert (r.open, r.close, r.volume) == (7.0, 5.0, 3.0)


def test_holidays(spark):
    orders = spark.createDataFrame([(date(y, 5, 1),) for y in (2021, 2024, 2026)], "o_orderdate date")
    got = {(r.y, r.name): r.day for r in spark.sql(calendar.holidays(0), orders=orders).collect()}
    assert got[2024, "good_friday"] == date(2024, 3, 29) and got[2024, "thanksgiving"] == date(2024, 11, 28) and got[2024, "memorial"] == date(2024, 5, 27)
    assert got[2021, "independence"] == date(2021, 7, 5) and got[2021, "christmas"] == date(2021, 12, 24) and got[2026, "independence"] == date(2026, 7, 3)
    assert (2021, "juneteenth") not in got and got[2024, "king"] == date(2024, 1, 15) and got[2026, "labor"] == date(2026, 9, 7)
    short = {(r.y, r.day) for r in spark.sql(calendar.short_days(0), orders=orders).collect()}
    assert {(2024, date(2024, 7, 3)), (2024, date(2024, 11, 29)), (2024, date(2024, 12, 24))} <= short and (2021, date(2021, 7, 3)) not in short


def test_swap_units_of_a_week(spark):
    def units(day, held):
        return spark.sql(f"SELECT {statistics._UNITS[0]} AS u FROM (SELECT DATE'{day}' AS day, {held} AS held)").first().u

    assert units("2024-01-08", 7) == 7 and units("2024-01-08", 0) == 0 and units("2024-01-10", 1) == 3 and units("2024-01-12", 3) == 1


def test_block_statistics_find_a_planted_signal(spark):
    import random

    rng = random.Random(2)

    def summary(planted):
        rows = [("s", i, rng.gauss(0, 1)) for i in range(2000)]
        rows = [(s, i, x, (x if planted else 0) + rng.gauss(0, 1)) for s, i, x in rows]
        df = spark.createDataFrame(rows, "symbol string, rn long, s double, f double")
        blocks = [r.ic for r in spark.sql(statistics.block_ic("SELECT * FROM {d}"), d=df).collect()]
        mean = sum(blocks) / len(blocks)
        return mean, mean / (sum((x - mean) ** 2 for x in blocks) / (len(blocks) - 1)) ** 0.5 * len(blocks) ** 0.5

    mean, t = summary(True)
    assert mean > 0.3 and t > 10
    assert abs(summary(False)[0]) < 0.08


def test_two_sided_p(spark):
    """Against tabled quantiles of Student's distribution."""
    for t, df, p in ((12.706, 1, 0.05), (2.776, 4, 0.05), (2.228, 10, 0.05), (3.169, 10, 0.01), (2.042, 30, 0.05), (2.045, 29, 0.05), (1.0, 2, 0.42265)):
        text = statistics.P_SPARK.replace(statistics._T, f"SELECT 1 AS l_partkey, {df} AS df, {t}D AS t")
        assert math.isclose(spark.sql(text).first().p, p, rel_tol=2e-3)
