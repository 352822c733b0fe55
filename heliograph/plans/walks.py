"""One position at a time, and machines of few states, without a pass over a symbol's rows.

Entries that are taken are chains of pointers (``heliograph.operators.occupancy``),
pullbacks and latches are automata (``heliograph.operators.automaton``). The SQL
beside them goes row by row, in recursive queries.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.functions.linear import ema, fading, seeded
from heliograph.functions.recursive import parabolic
from heliograph.functions.series import lag, prior, sma, true_range
from heliograph.operators.automaton import automaton
from heliograph.operators.occupancy import taken
from heliograph.operators.scan import scan
from heliograph.operators.staged import staged_sql, with_stages
from heliograph.plans.registry import query, rounded
from heliograph.plans.trades import BOTH, Arrays, outcomes
from heliograph.sources.tables import EVENT_BARS_SQL, event_bars

_N = "row_number() OVER (PARTITION BY symbol ORDER BY ts)"


def walked(rows: str, free: str, shown: str, enters: str) -> str:
    """DuckDB's walk: ``rows`` has symbol and n from 1 on; a row that ``enters`` while free takes a position until row ``free``."""
    on = f"({enters}) AND b.n >= w.f"
    return f"WITH RECURSIVE r AS MATERIALIZED ({rows}), w AS (SELECT b.*, CASE WHEN {enters} THEN {free} ELSE CAST(0 AS BIGINT) END AS f, CASE WHEN {enters} THEN 1 ELSE 0 END AS t FROM r AS b WHERE n = 1 UNION ALL SELECT b.*, CASE WHEN {on} THEN {free} ELSE w.f END, CASE WHEN {on} THEN 1 ELSE 0 END FROM w JOIN r AS b ON b.symbol = w.symbol AND b.n = w.n + 1) {shown}"


def chosen(rows: DataFrame, enters: str, free: str) -> DataFrame:
    """``rows`` (symbol, n) of the entries that are taken."""
    entries = rows.where(enters).select("symbol", "n", F.expr(free).cast("bigint").alias("free"))
    return rows.where(enters).join(taken(entries), ["symbol", "n"])


_GREEDY = [{"entry": f"coalesce(close > max(high) {prior(10)}, false)", "n": f"CAST({_N} AS BIGINT)"}]


@query("x04_greedy_walk", walked(staged_sql(EVENT_BARS_SQL, _GREEDY), "b.n + 6", "SELECT symbol, ts, CAST(CASE WHEN entry THEN t END AS INTEGER) AS taken FROM w", "b.entry"))
def greedy(spark: SparkSession, folder: str) -> DataFrame:
    """1 for an entry that is taken, 0 for one while a position of six rows is open, null without an entry."""
    rows = with_stages(event_bars(spark, folder), _GREEDY).select("symbol", "ts", "n", "entry")
    on = taken(rows.where("entry").select("symbol", "n", (F.col("n") + 6).alias("free"))).withColumn("on", F.lit(1))
    return rows.join(on, ["symbol", "n"], "left").select("symbol", "ts", F.expr("CAST(CASE WHEN entry THEN coalesce(on, 0) END AS INT)").alias("taken"))


# --- a table of outcomes of both sides, entered at every bar's open; what is decided there was known at the close before
_SCORE = [{"n": f"CAST({_N} AS BIGINT)", "hi": f"max(high) {prior(12)}", "lo": f"min(low) {prior(12)}"}, {"signal": lag("CASE WHEN close > hi THEN 1 WHEN close < lo THEN -1 ELSE 0 END"), "p": lag("(close - low) / nullif(high - low, 0)")}]
_TRAIN = "TIMESTAMP '2024-01-11'"


def outcome_rows(a: Arrays, bars: str) -> str:
    """Bars with the signal and the probability-like score ``p`` of a rise, its thresholds from the first days, and results and lengths of both sides."""
    sides = {k: outcomes(a, s).replace("{bars}", f"({bars})") for k, s in (("l", 1), ("s", -1))}
    base = staged_sql(bars, _SCORE)
    share = "quantile_cont({x}, 0.6)" if a.duck else "percentile({x}, 0.6)"
    limits = f"SELECT symbol, {share.format(x='p')} AS p_l, {share.format(x='1 - p')} AS p_s FROM ({base}) AS q WHERE ts < {_TRAIN} AND p IS NOT NULL GROUP BY symbol"
    return f"SELECT b.symbol, b.ts, b.n, b.signal, b.p, t.p_l, t.p_s, l.r AS r_l, CAST(l.held AS BIGINT) AS h_l, s.r AS r_s, CAST(s.held AS BIGINT) AS h_s FROM ({base}) AS b LEFT JOIN ({limits}) AS t ON b.symbol = t.symbol LEFT JOIN ({sides['l']}) AS l ON b.symbol = l.symbol AND b.ts = l.ts LEFT JOIN ({sides['s']}) AS s ON b.symbol = s.symbol AND b.ts = s.ts"


def outcome_frame(spark: SparkSession, folder: str) -> DataFrame:
    return spark.sql(outcome_rows(BOTH[0], "SELECT * FROM {bars}").replace("(SELECT * FROM {bars}) AS s", "{bars} AS s"), bars=event_bars(spark, folder))


_DUCK = outcome_rows(BOTH[1], EVENT_BARS_SQL)
#: Each side's test, result and length; ``b.`` stands before columns where another table is in sight.
LONG_ON, SHORT_ON = "coalesce(b.p >= b.p_l AND b.r_l IS NOT NULL, false)", "coalesce(1 - b.p >= b.p_s AND b.r_s IS NOT NULL, false)"
TAKE_LONG = f"({LONG_ON} AND (NOT {SHORT_ON} OR b.p - b.p_l >= 1 - b.p - b.p_s))"
SIGNAL_R, SIGNAL_HELD = "(CASE WHEN b.signal > 0 THEN b.r_l ELSE b.r_s END)", "(CASE WHEN b.signal > 0 THEN b.h_l ELSE b.h_s END)"
AFTER = f"b.ts >= {_TRAIN}"


def table_walk(name: str, enters: str, held: str, out: dict[str, str], rearm: int) -> None:
    """Register a walk over the table of outcomes; ``rearm``: rows from the exit's row to the first that may enter."""
    free = f"b.n + greatest({held}, {1 - rearm}) - 1 + {rearm}"
    columns = ", ".join(f"{e} AS {k}" for k, e in out.items())

    @query(name, walked(_DUCK, free, f"SELECT b.symbol, b.ts, {columns} FROM w AS b WHERE t = 1", enters))
    def run(spark: SparkSession, folder: str) -> DataFrame:
        bare = lambda e: e.replace("b.", "")
        return chosen(outcome_frame(spark, folder), bare(enters), bare(free)).select("symbol", "ts", *(F.expr(bare(e)).alias(k) for k, e in out.items()))


# A signal of the close before row n enters at its open; a signal on the exit's own row may enter at the open after it.
table_walk("x09_table_walk", f"coalesce(b.signal <> 0 AND {SIGNAL_R} IS NOT NULL, false)", SIGNAL_HELD, {"side": "CAST(b.signal AS INTEGER)", "r": rounded(SIGNAL_R), "held": f"CAST({SIGNAL_HELD} AS INTEGER)"}, rearm=1)
table_walk("x11_single_side_walk", f"{AFTER} AND {LONG_ON}", "b.h_l", {"r": rounded("b.r_l"), "held": "CAST(b.h_l AS INTEGER)"}, rearm=1)
table_walk("x12_two_sided_walk", f"{AFTER} AND ({LONG_ON} OR {SHORT_ON})", f"CASE WHEN {TAKE_LONG} THEN b.h_l ELSE b.h_s END", {"side": f"CAST(CASE WHEN {TAKE_LONG} THEN 1 ELSE -1 END AS INTEGER)", "r": rounded(f"CASE WHEN {TAKE_LONG} THEN b.r_l ELSE b.r_s END"), "held": f"CAST(CASE WHEN {TAKE_LONG} THEN b.h_l ELSE b.h_s END AS INTEGER)"}, rearm=1)

COST = 0.1
_NET = "SELECT symbol, ts, r_l - {cost} AS r FROM {walk}"
_SUMS = f"count(*) AS n, {rounded('avg(CASE WHEN r > 0 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END)')} AS win, {rounded('avg(r)')} AS expectancy, {rounded('sum(r)')} AS total, {rounded('sum(CASE WHEN r > 0 THEN r ELSE 0 END) / nullif(-sum(CASE WHEN r < 0 THEN r ELSE 0 END), 0)', 5)} AS profit_factor, {rounded('min(fall)')} AS drawdown"
_FALL = "SELECT *, eq - max(eq) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fall FROM (SELECT *, sum(r) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS eq FROM ({net}) AS x) AS y"


@query("x13_walk_with_cost", walked(_DUCK, "b.n + greatest(b.h_l, 1)", f"SELECT symbol, {_SUMS} FROM ({_FALL.format(net=_NET.format(cost=COST, walk='w WHERE t = 1'))}) AS z GROUP BY symbol", f"{AFTER} AND {LONG_ON}"))
def walk_with_cost(spark: SparkSession, folder: str) -> DataFrame:
    """What the single-sided walk comes to after a cost a trade, by symbol."""
    bare = lambda e: e.replace("b.", "")
    rows = chosen(outcome_frame(spark, folder), bare(f"{AFTER} AND {LONG_ON}"), "n + greatest(h_l, 1)")
    return spark.sql(f"SELECT symbol, {_SUMS} FROM ({_FALL.format(net=_NET.format(cost=f'CAST({COST} AS DOUBLE)', walk='{rows}'))}) AS z GROUP BY symbol", rows=rows).select("symbol", "n", *(F.col(c).cast("double").alias(c) for c in ("win", "expectancy", "total", "profit_factor", "drawdown")))


# --- pullbacks of two legs
MOST, WARM, TICK, RISK_LIMIT = 20, 30, 0.01, 2.0
PHASES = 4  # outside is state 0; first leg, its end, second leg (armed), beyond
TREND = [
    {"tr": f"coalesce({true_range()}, high - low)", "n": _N, "span": "high - low", "ph": lag("high"), "pl": lag("low")}, *fading({"e20": ema("close", 20), "atr": seeded("tr", 14)}),
    {"body": "CASE WHEN span > 0 THEN abs(close - open) / span ELSE 0 END", "pos": "CASE WHEN span > 0 THEN (close - low) / span ELSE 0.5 END", "big": "coalesce(span >= atr, false)"},
    {"flip": "CASE WHEN close > open AND body >= 0.5 AND 3 * pos >= 2 AND big AND close > ph AND close > e20 THEN 1 WHEN close < open AND body >= 0.5 AND 3 * pos <= 1 AND big AND close < pl AND close < e20 THEN -1 END"},
]
_LAST_FLIP = ("coalesce(last_value(flip) IGNORE NULLS OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0)", "coalesce(last_value(flip IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0)")
#: Either side sees rising prices: what runs with the trend (f) and against it (b).
FACING = {1: ("high", "low"), -1: ("-low", "-high")}
RISK = f"(high + {TICK}) - (low - {TICK})"
QUALIFIES = f"n > {WARM} AND atr > 0 AND ({RISK}) > 0 AND ({RISK}) <= {RISK_LIMIT} * atr AND CASE WHEN {{s}} > 0 THEN close > open AND 3 * pos >= 2 ELSE close < open AND 3 * pos <= 1 END"


def pullback_maps(on: np.ndarray, f: np.ndarray, b: np.ndarray, b_before: np.ndarray, back: np.ndarray) -> np.ndarray:
    """Each bar's map over state 0 and (phase, age): 1 + (phase - 1) * (MOST + 1) + age. ``back``: the values of f before this bar, newest first."""
    n, ages = len(f), MOST + 1
    past = np.full((n, MOST + 2), np.nan)
    for i, x in enumerate(back):
        if x is not None and len(x):
            past[i, : len(x)] = np.asarray(x, float)[: MOST + 2]
    out = np.zeros((n, 1 + PHASES * ages), np.int64)
    on = on.astype(bool)
    begins = np.where(b < b_before, 1, 0)  # a pullback bar: phase 1 of age 0
    out[:, 0] = begins
    rises, falls = f > past[:, 0], f < past[:, 0]
    for phase in range(1, PHASES + 1):
        moved = np.where(rises if phase % 2 else falls, min(phase + 1, PHASES), phase)
        for age in range(ages):
            now = age + 1  # rows since the pullback began; the high that it must not pass is one row older
            if now > MOST:
                out[:, 1 + (phase - 1) * ages + age] = begins
                continue
            over = f > past[:, now]
            out[:, 1 + (phase - 1) * ages + age] = np.where(over, begins, 1 + (moved - 1) * ages + now)
    out[~on] = 0
    return out


def setups(bars: DataFrame, bits: int | None = None) -> DataFrame:
    """``symbol``, ``ts``, ``high``, ``low`` and ``setup``: the side of the pullback that a bar completes, else 0."""
    rows, sides = with_stages(bars, [*TREND, {"trend": _LAST_FLIP[0]}]), []
    for side, (f, b) in FACING.items():
        faced = with_stages(rows, [{"on": f"trend = {side} AND n > 1", "f": f, "b": b, "ok": f"coalesce({QUALIFIES.format(s=side)}, false)"}, {"b_before": lag("b"), "back": f"reverse(collect_list(f) {prior(MOST + 2)})"}])
        states = automaton(faced, ["on", "f", "b", "b_before", "back"], ["high", "low", "ok"], 1 + PHASES * (MOST + 1), pullback_maps, bits=bits)
        armed = F.col("state").between(1 + 2 * (MOST + 1), 3 * (MOST + 1))
        sides.append(states.select("symbol", "ts", "high", "low", F.when(armed & F.col("ok"), side).otherwise(0).alias("setup")))
    # No bar is of both trends.
    return sides[0].unionByName(sides[1]).groupBy("symbol", "ts").agg(F.max("high").alias("high"), F.max("low").alias("low"), F.sum("setup").cast("int").alias("setup"))


def _duck_setups() -> str:
    rows, parts = staged_sql(EVENT_BARS_SQL, [*TREND, {"trend": _LAST_FLIP[1]}]), []
    for side, (f, b) in FACING.items():
        faced = staged_sql(rows, [{"fx": f, "bx": b, "ok": f"coalesce({QUALIFIES.format(s=side)}, false)"}, {"f0": lag("fx"), "b0": lag("bx")}])
        left = f"(CASE WHEN w.ph0 > 0 AND (b.fx > w.ext OR b.n - w.st > {MOST}) THEN 0 ELSE w.ph0 END)"
        begins = f"({left} = 0 AND b.bx < b.b0)"
        phase = f"CASE WHEN b.trend <> {side} THEN 0 WHEN {left} = 0 THEN CASE WHEN b.bx < b.b0 THEN 1 ELSE 0 END WHEN {left} % 2 = 1 AND b.fx > b.f0 THEN {left} + 1 WHEN {left} % 2 = 0 AND b.fx < b.f0 THEN {left} + 1 ELSE {left} END"
        parts.append(f"SELECT symbol, ts, high, low, CASE WHEN ph0 = 3 AND ok THEN {side} ELSE 0 END AS setup FROM (WITH RECURSIVE r AS MATERIALIZED ({faced}), w AS (SELECT b.*, 0 AS ph0, CAST(-1 AS BIGINT) AS st, CAST(NULL AS DOUBLE) AS ext FROM r AS b WHERE n = 1 UNION ALL SELECT b.*, {phase}, CASE WHEN {begins} THEN b.n ELSE w.st END, CASE WHEN {begins} THEN b.f0 ELSE w.ext END FROM w JOIN r AS b ON b.symbol = w.symbol AND b.n = w.n + 1) SELECT * FROM w) AS s{'' if side > 0 else '2'}")
    return "SELECT symbol, ts, max(high) AS high, max(low) AS low, CAST(sum(setup) AS INTEGER) AS setup FROM (" + " UNION ALL ".join(parts) + ") AS u GROUP BY symbol, ts"


DUCK_SETUPS = _duck_setups()


@query("r14_two_leg_pullbacks", f"SELECT symbol, ts, setup FROM ({DUCK_SETUPS}) AS s")
def pullbacks(spark: SparkSession, folder: str) -> DataFrame:
    """1 or -1 on bars that complete a pullback of two legs in a trend, on a strong bar."""
    return setups(event_bars(spark, folder)).select("symbol", "ts", "setup")


#: An order lives for the next bar, so that bar's place on the clock decides; a round trip may cost a fifth of the risk.
_NEXT = ("convert_timezone('UTC', 'America/New_York', ts + INTERVAL 1 HOUR)", "timezone('America/New_York', timezone('UTC', ts + INTERVAL 1 HOUR))")
ROUND_TRIP = (10 + 2 * 1) * TICK
ARMED = [f"CAST(CASE WHEN setup <> 0 AND hour(t) * 60 + minute(t) BETWEEN 570 AND 930 AND {dow} AND ({RISK}) > {ROUND_TRIP / 0.2!r} THEN -1 ELSE 0 END AS INTEGER)" for dow in ("weekday(t) < 5", "isodow(t) <= 5")]


@query("g40_armed_fades", f"SELECT symbol, ts, {ARMED[1]} AS armed FROM (SELECT *, {_NEXT[1]} AS t FROM ({DUCK_SETUPS}) AS s) AS n")
def armed_fades(spark: SparkSession, folder: str) -> DataFrame:
    """-1 on pullbacks whose next bar lies in the session and whose risk pays the costs: a sale below the bar."""
    return with_stages(setups(event_bars(spark, folder)), [{"t": _NEXT[0]}]).select("symbol", "ts", F.expr(ARMED[0]).alias("armed"))


# --- a latch of weighted means
def lwma(x: str, n: int) -> str:
    """Weighted mean with weights 1 to n, oldest first, from two running sums; ``n`` is a row's number."""
    w = f"OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN n >= {n} THEN (({n} - n) * sum({x}) {w} + sum(n * {x}) {w}) / {n * (n + 1) / 2!r} END"


LATCH = [
    {"n": _N}, *fading({"e5": ema("close", 5), "e26": ema("close", 26), "e15": ema("close", 15)}), {"w85": lwma("low", 85), "w75": lwma("low", 75), "m": "e26 - e15"},
    {"w1": lag("w85"), "w2": lag("w75"), "e1": lag("e5"), "m2": lag("m", 2)},
    {"live": "n > 90 AND w1 IS NOT NULL AND m2 IS NOT NULL", "is_above": "e1 > w1 AND e1 > w2", "is_below": "e1 < w1 AND e1 < w2"},
    {"above": "coalesce(live AND is_above, false)", "below": "coalesce(live AND is_below, false)", "up": "coalesce(m2 < 0, false)", "dn": "coalesce(m2 > 0, false)"},
]


def latch_maps(above: np.ndarray, below: np.ndarray, up: np.ndarray, dn: np.ndarray) -> np.ndarray:
    """Over states armed for a rise (1) and for a fall (2), 0 to 3."""
    above, below, up, dn = (x.astype(bool)[:, None] for x in (above, below, up, dn))
    rise, fall = np.arange(4)[None, :] % 2, np.arange(4)[None, :] // 2
    new_rise = np.where(below, 1, np.where(above & up, 0, rise))
    new_fall = np.where(above, 1, np.where(below & dn, 0, fall))
    return new_rise + 2 * new_fall


_RISE, _FALL_SET = "CASE WHEN b.below THEN 1 ELSE w.sb END", "CASE WHEN b.above THEN 1 ELSE w.ss END"
_BUY, _SELL = f"(b.above AND ({_RISE}) = 1 AND b.up)", f"(b.below AND ({_FALL_SET}) = 1 AND b.dn)"


@query("g58_weighted_latch", f"WITH RECURSIVE r AS MATERIALIZED ({staged_sql(EVENT_BARS_SQL, LATCH)}), w AS (SELECT b.*, 0 AS sb, 0 AS ss, 0 AS signal FROM r AS b WHERE n = 1 UNION ALL SELECT b.*, CASE WHEN {_BUY} THEN 0 ELSE {_RISE} END, CASE WHEN NOT {_BUY} AND {_SELL} THEN 0 ELSE {_FALL_SET} END, CASE WHEN {_BUY} THEN 1 WHEN {_SELL} THEN -1 ELSE 0 END FROM w JOIN r AS b ON b.symbol = w.symbol AND b.n = w.n + 1) SELECT symbol, ts, CAST(signal AS INTEGER) AS signal FROM w")
def weighted_latch(spark: SparkSession, folder: str) -> DataFrame:
    """A fast mean beyond two weighted means of lows, once it was on their other side, where the slower difference of means agrees."""
    rows = with_stages(event_bars(spark, folder), LATCH)
    states = automaton(rows, ["above", "below", "up", "dn"], ["above", "below", "up", "dn"], 4, latch_maps)
    return states.select("symbol", "ts", F.expr("CAST(CASE WHEN above AND before % 2 = 1 AND up THEN 1 WHEN below AND before >= 2 AND dn THEN -1 ELSE 0 END AS INT)").alias("signal"))


# --- rules on the level of a parabolic stop
_V = "(w.v + w.a * (w.e - w.v))"
_CROSS = f"(CASE WHEN w.d > 0 THEN b.low < {_V} ELSE b.high > {_V} END)"
_NEW = "(CASE WHEN w.d > 0 THEN b.high > w.e ELSE b.low < w.e END)"


def duck_levels(step: float, most: float = 0.2) -> str:
    """Bars with the level of the stop, row by row."""
    d = lambda x: f"CAST({x} AS DOUBLE)"
    return f"SELECT symbol, ts, v AS level FROM (WITH RECURSIVE r AS MATERIALIZED (SELECT *, {_N} AS i FROM ({EVENT_BARS_SQL}) AS q), w AS (SELECT b.symbol, b.ts, b.i, b.low AS v, b.high AS e, {d(step)} AS a, 1 AS d FROM r AS b WHERE i = 1 UNION ALL SELECT b.symbol, b.ts, b.i, CASE WHEN {_CROSS} THEN w.e ELSE {_V} END, CASE WHEN {_CROSS} THEN CASE WHEN w.d > 0 THEN b.low ELSE b.high END WHEN {_NEW} THEN CASE WHEN w.d > 0 THEN b.high ELSE b.low END ELSE w.e END, CASE WHEN {_CROSS} THEN {d(step)} WHEN {_NEW} THEN least(w.a + {d(step)}, {d(most)}) ELSE w.a END, CASE WHEN {_CROSS} THEN -w.d ELSE w.d END FROM w JOIN r AS b ON b.symbol = w.symbol AND b.i = w.i + 1) SELECT * FROM w) AS lv"


def level_rule(name: str, step: float, stages: list, out: dict[str, str]) -> None:
    """Register a rule on bars, means and the level of a stop that starts at ``step``."""

    @query(name, f"SELECT symbol, ts, {', '.join(f'{e} AS {k}' for k, e in out.items())} FROM ({staged_sql(f'SELECT b.*, lv.level FROM ({EVENT_BARS_SQL}) AS b JOIN ({duck_levels(step)}) AS lv ON b.symbol = lv.symbol AND b.ts = lv.ts', stages)}) AS x")
    def run(spark: SparkSession, folder: str) -> DataFrame:
        bars = event_bars(spark, folder)
        levels = scan(bars, ["high", "low"], "side int, level double", parabolic(step)).select("symbol", "ts", "level")
        return with_stages(bars.join(levels, ["symbol", "ts"]), stages).select("symbol", "ts", *(F.expr(e).alias(k) for k, e in out.items()))


POINT = 0.01
_TURN = [{"med": "(high + low) / 2"}, *fading({"f": ema("med", 3), "s": ema("med", 34), "e13": ema("close", 13)}), {"bear": "low - e13", "bull": "high - e13"}, {"bear1": lag("bear"), "bull1": lag("bull"), "gate": "hour(ts) > 8 AND hour(ts) < 17"}, {"sell": "coalesce(f < s AND level > high AND bear < 0 AND bear > bear1 AND gate, false)", "buy": "coalesce(f > s AND level < low AND bull > 0 AND bull < bull1 AND gate, false)"}]
level_rule("g59_power_turn", 0.02, _TURN, {"signal": "CAST(CASE WHEN sell THEN -1 WHEN buy THEN 1 ELSE 0 END AS INTEGER)", "stop": f"CASE WHEN sell THEN CAST({400 * POINT} AS DOUBLE) WHEN buy THEN CAST({2000 * POINT} AS DOUBLE) ELSE CAST(0 AS DOUBLE) END", "take": f"CASE WHEN sell THEN CAST({2000 * POINT} AS DOUBLE) WHEN buy THEN CAST({400 * POINT} AS DOUBLE) ELSE CAST(0 AS DOUBLE) END"})
_CATCH = [{"m25": sma("close", 25), "m50": sma("close", 50), "m200": sma("close", 200), "c1": lag("close"), "v1": lag("level")}, {"buy": "coalesce(close > level AND c1 < v1 AND m50 > m200 AND close > m25, false)", "sell": "coalesce(close < level AND c1 > v1 AND m50 < m200 AND close < m25, false)"}]
level_rule("g60_level_cross", 0.004, _CATCH, {"signal": "CAST(CASE WHEN buy THEN 1 WHEN sell THEN -1 ELSE 0 END AS INTEGER)", "stop": rounded(f"least(greatest(abs(level - close), CAST({10 * POINT} AS DOUBLE)), CAST({200 * POINT} AS DOUBLE))")})
