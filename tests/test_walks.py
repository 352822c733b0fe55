"""Chunked scans, automata, pointer doubling and permutations against plain loops; resampling against what is known."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from heliograph.functions.permutation import permuted
from heliograph.functions.recursive import adaptive, parabolic, rule_walk_sides, seeded, trend_bands
from heliograph.operators import chunks, scan
from heliograph.operators.automaton import automaton
from heliograph.operators.occupancy import next_entries, taken
from heliograph.plans import walks
from heliograph.sources.tables import daily_bars

BEGIN = datetime(2024, 1, 1)


def bars(n=700, symbols=("a", "b", None), seed=1):
    rng, rows = random.Random(seed), []
    for s in symbols:
        price = 100.0
        for i in range(n):
            o = price
            price += rng.gauss(0, 1)
            rows.append((s, BEGIN + timedelta(hours=i), o, max(o, price) + rng.random(), min(o, price) - rng.random(), price, rng.random() < 0.1, rng.random() < 0.1, 1 + rng.random()))
    return rows


SCHEMA = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, entry boolean, leave boolean, atr double"


@pytest.mark.parametrize(
    ("how", "inputs", "outputs"),
    [
        (trend_bands(1.5), ["high", "low", "close", "atr"], "side int"),
        (parabolic(), ["high", "low"], "side int, level double"),
        (rule_walk_sides(2.0, 12, -1, 3.0, 0.01), ["open", "high", "low", "entry", "leave", "atr"], "x double, y double"),
        (adaptive(), ["close", "atr"], "y double"),
        (seeded(5), ["close"], "y double"),
    ],
)
@pytest.mark.parametrize("rounds", [6, 1])
def test_scan_in_chunks_equals_one_pass(spark, monkeypatch, how, inputs, outputs, rounds):
    monkeypatch.setattr(chunks, "CHUNK_BITS", 5)
    monkeypatch.setattr(scan, "ROUNDS", rounds)
    rows = bars()
    got = {(r["symbol"], r["ts"]): tuple(r)[2:] for r in scan.scan(spark.createDataFrame(rows, SCHEMA).repartition(5), inputs, outputs, how).collect()}
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    for s in ("a", "b", None):
        own = [r for r in rows if r[0] == s]
        want = how.run([tuple(r[names.index(c)] for c in inputs) for r in own])
        assert [got[s, r[1]] for r in own] == want


def test_a_symbol_lies_in_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(chunks, "CHUNK_BITS", 5)
    cut = chunks.packed(spark.createDataFrame(bars(), SCHEMA), "symbol", ["ts"], ["ts", "close"])
    found = cut.select("symbol", "leads", F.size("rows").alias("n")).collect()
    assert sum(r["n"] for r in found) == 2100 and max(r["n"] for r in found) <= 32 and len(found) >= 66 and sum(r["leads"] for r in found) == 3


def test_taken_entries_equal_a_greedy_walk(spark):
    rng, rows, want = random.Random(2), [], set()
    for key in ("a", "b", None):
        free = 0
        for n in range(1, 400):
            if rng.random() < 0.4:
                hold = rng.choice([1, 1, 2, 7, 60])
                rows.append((key, n, n + hold))
                if n >= free:
                    want.add((key, n))
                    free = n + hold
    df = spark.createDataFrame(rows, "symbol string, n bigint, free bigint").repartition(3)
    for cell in (4096, 7):
        assert {tuple(r) for r in taken(df, cell=cell).collect()} == want
    after = {(r["symbol"], r["n"]): r["nxt"] for r in next_entries(df, cell=11).collect()}
    assert after == {(k, n): min((m for s, m, _ in rows if s == k and m >= f), default=None) for k, n, f in rows}


def test_known_entries_are_taken(spark):
    rows = [("x", n, f) for n, f in zip([0, 1, 2, 20, 21, 40], [10, 11, 12, 30, 31, 50], strict=True)]
    assert sorted(r["n"] for r in taken(spark.createDataFrame(rows, "symbol string, n bigint, free bigint")).collect()) == [0, 20, 40]
    assert taken(spark.createDataFrame([], "symbol string, n bigint, free bigint")).collect() == []


def test_automaton_equals_a_loop(spark):
    rng = random.Random(4)
    rows = [(s, BEGIN + timedelta(hours=i), [rng.randrange(5) for _ in range(5)]) for s in ("a", None) for i in range(300)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, map array<int>").repartition(3)
    for bits in (2, 12):
        got = {(r["symbol"], r["ts"]): (r["before"], r["state"]) for r in automaton(df, ["map"], [], 5, lambda m: np.array(list(m)), start=3, bits=bits).collect()}
        for s in ("a", None):
            state = 3
            for _, ts, m in (r for r in rows if r[0] == s):
                assert got[s, ts] == (state, m[state])
                state = m[state]
    assert automaton(df.limit(0), ["map"], [], 5, lambda m: np.array(list(m)).reshape(-1, 5)).collect() == []


def literal_setups(rows):
    """The pullback's phases bar by bar, from bars with trend and qualification of either side."""
    out = [0] * len(rows)
    for side in (1, -1):
        phase, start, ext = 0, -1, 0.0
        f = [r["high"] if side > 0 else -r["low"] for r in rows]
        b = [r["low"] if side > 0 else -r["high"] for r in rows]
        for i in range(1, len(rows)):
            if rows[i]["trend"] != side:
                phase = 0
                continue
            if phase > 0 and (f[i] > ext or i - start > walks.MOST):
                phase = 0
            if phase == 0:
                if b[i] < b[i - 1]:
                    phase, start, ext = 1, i, f[i - 1]
                else:
                    continue
            elif phase % 2 == 1:
                phase += f[i] > f[i - 1]
            else:
                phase += f[i] < f[i - 1]
            if phase == 3 and rows[i]["ok"] == side:
                out[i] = side
    return out


def test_pullbacks_with_resets_and_flips_equal_a_loop(spark):
    rng, rows = random.Random(6), []
    for s in ("a", "b"):
        price, trend = 100.0, 1
        for i in range(900):
            if rng.random() < 0.03:
                trend = -trend
            o = price
            price += rng.gauss(0.15 * trend, 1)
            rows.append((s, BEGIN + timedelta(hours=i), o, max(o, price) + rng.random() / 2, min(o, price) - rng.random() / 2, price, 1.0))
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double").repartition(3)
    sides = walks.with_stages(df, [*walks.TREND, {"trend": walks._LAST_FLIP[0]}, {"up": walks.QUALIFIES.format(s=1), "dn": walks.QUALIFIES.format(s=-1)}])
    table = sides.select("symbol", "ts", "high", "low", "trend", F.expr("CASE WHEN trend = 1 AND up THEN 1 WHEN trend = -1 AND dn THEN -1 ELSE 0 END").alias("ok")).orderBy("symbol", "ts").collect()
    want = {}
    for s in ("a", "b"):
        own = [r for r in table if r["symbol"] == s]
        want |= {(s, r["ts"]): x for r, x in zip(own, literal_setups(own), strict=True)}
    for bits in (4, 12):
        assert {(r["symbol"], r["ts"]): r["setup"] for r in walks.setups(df, bits).collect()} == want
    assert set(want.values()) == {-1, 0, 1} and sum(map(abs, want.values())) > 10


def test_permutations_are_one_to_one_and_even():
    for n in (1, 2, 3, 7, 64, 1000):
        for key in (0, 5, 10**9):
            assert sorted(permuted(np.arange(n), np.array(n), np.array(key)).tolist()) == list(range(n))
    first = permuted(np.zeros(20_000, np.int64), np.array(10), np.arange(20_000) * 7919)
    counts = np.bincount(first, minlength=10)
    assert ((counts - 2000) ** 2 / 2000).sum() < 40
    assert len({tuple(permuted(np.arange(8), np.array(8), np.array(k)).tolist()) for k in range(300)}) > 200


def test_a_day_has_one_open_whatever_the_order(spark, tmp_path):
    lines = [(7840, 5, 3082.0, 1.0), (7840, 5, 2461.0, 1.0), (784, 65, 9.0, 1.0), (1, 1, 5.0, 1.0), (9000, 1, 6.0, 1.0), (9000, 1, 6.5, 2.0)]
    rows = [("A", "F", k, n, p * q, q, datetime(2000, 11, 11, 3)) for k, n, p, q in lines]
    found = set()
    for seed in range(6):
        random.Random(seed).shuffle(rows)
        folder = str(tmp_path / str(seed))
        spark.createDataFrame(rows, "l_returnflag string, l_linestatus string, l_orderkey bigint, l_linenumber int, l_extendedprice double, l_quantity double, l_shipdate timestamp").repartition(3).write.parquet(f"{folder}/lineitem.parquet")
        found |= {(r["open"], r["close"], r["volume"]) for r in daily_bars(spark, folder).collect()}
    assert found == {(5.0, 6.5, 7.0)}


def test_sliding_ranks_and_quantiles_equal_whole_windows(spark):
    from heliograph.operators.sliding import sliding

    rng, rows = random.Random(11), []
    for s in ("a", None):
        for i in range(700):
            rows.append((s, BEGIN + timedelta(hours=i), None if i % 17 == 3 else float("nan") if i % 31 == 5 else float(rng.randrange(40))))
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, v double").repartition(5)
    for window, least, block in ((50, 20, 8), (300, 150, 4096), (1, 1, 3)):
        got = {(r["symbol"], r["ts"]): (r["rank"], r["q0"], r["q1"]) for r in sliding(df, "v", window, least, (0.5, 0.7), block).collect()}
        assert len(got) == len(rows)
        for s in ("a", None):
            x = [r[2] if r[2] is not None and r[2] == r[2] else None for r in rows if r[0] == s]
            for i in range(0, 700, 7):
                held = [v for v in x[max(0, i - window + 1) : i + 1] if v is not None]
                found = got[s, BEGIN + timedelta(hours=i)]
                if len(held) < least:
                    assert found == (None, None, None)
                    continue
                assert found[1:] == pytest.approx((np.quantile(held, 0.5), np.quantile(held, 0.7)))
                want = None if x[i] is None else (sum(v < x[i] for v in held) + (sum(v == x[i] for v in held) + 1) / 2) / len(held)
                assert found[0] == (None if want is None else pytest.approx(want))
    assert sliding(df.limit(0), "v", 10, 1).collect() == []


def test_ranks_of_the_past_do_not_change(spark):
    from heliograph.operators.sliding import slide

    rng = random.Random(12)
    x = [rng.gauss(0, 1) for _ in range(5000)]
    later = [v + 50 if i >= 2500 else v for i, v in enumerate(x)]
    a, b = slide(x, 1000, 500, ()), slide(later, 1000, 500, ())
    assert a[:2500] == b[:2500] and sum(r[0] is not None for r in a) == 4501 and a[2500:] != b[2500:]
