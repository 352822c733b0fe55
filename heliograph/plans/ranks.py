"""Ranks and quantiles over long windows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.functions.linear import fading, seeded
from heliograph.functions.series import last, true_range
from heliograph.operators.sliding import sliding, windowed
from heliograph.operators.staged import staged_sql, with_stages
from heliograph.plans.registry import query, rounded
from heliograph.sources.tables import EVENT_BARS_SQL, event_bars

WINDOW, LEAST = 100, 25
_L = f"(SELECT symbol, ts, close, list(close) {last(WINDOW)} AS l FROM ({EVENT_BARS_SQL}) AS b) AS x"


@query("w14_rolling_percent_rank", f"SELECT symbol, ts, CASE WHEN len(l) >= {LEAST} THEN round((len(list_filter(l, lambda v: v < close)) + (len(list_filter(l, lambda v: v = close)) + 1) / 2) / len(l), 6) + 0.0 END AS x FROM {_L}")
def rolling_percent_rank(spark: SparkSession, folder: str) -> DataFrame:
    """A bar's close among the last hundred."""
    return sliding(event_bars(spark, folder), "close", WINDOW, LEAST).select("symbol", "ts", F.expr(rounded("rank")).alias("x"))


#: Of five-minute bars, those with a signal; a rank counts a thousand of them, and five hundred at least.
OCCURRENCES, LEAST_OCCURRENCES = 1000, 500
_FIVE = EVENT_BARS_SQL.replace("date_trunc('hour', ts)", "time_bucket(INTERVAL 5 MINUTE, ts)")
_SIGNAL = "hour(ts) BETWEEN 4 AND 22"


@query("w15_occurrence_rank", f"SELECT symbol, ts, round((len(list_filter(l, lambda v: v < x)) + (len(list_filter(l, lambda v: v = x)) + 1) / 2) / len(l), 6) AS rank FROM (SELECT symbol, ts, x, list(x) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {OCCURRENCES - 1} PRECEDING AND CURRENT ROW) AS l FROM (SELECT symbol, ts, close - 10 * floor(close / 10) AS x FROM ({_FIVE}) AS b WHERE {_SIGNAL}) AS o) AS r WHERE len(l) >= {LEAST_OCCURRENCES}")
def occurrence_rank(spark: SparkSession, folder: str) -> DataFrame:
    """A signal's rank among its last occurrences; bars without the signal are no rows of the window."""
    seen = event_bars(spark, folder, 5).where(_SIGNAL).selectExpr("symbol", "ts", "close - 10 * floor(close / 10) AS x")
    return sliding(seen, "x", OCCURRENCES, LEAST_OCCURRENCES).where("rank IS NOT NULL").select("symbol", "ts", F.round("rank", 6).alias("rank"))


LONG, LEAST_LONG = 4000, 200
_Q = {"q70": 0.7, "med": 0.5}


@query("w16_rolling_quantile", "SELECT symbol, ts, " + ", ".join(f"round(CASE WHEN count(close) {last(LONG)} >= {LEAST_LONG} THEN quantile_cont(close, {q}) {last(LONG)} END, 6) + 0.0 AS {n}" for n, q in _Q.items()) + f" FROM ({EVENT_BARS_SQL}) AS b")
def rolling_quantile(spark: SparkSession, folder: str) -> DataFrame:
    """The last four thousand bars' median and 70th percentile."""
    found = sliding(event_bars(spark, folder), "close", LONG, LEAST_LONG, tuple(_Q.values()))
    return found.select("symbol", "ts", *(F.expr(rounded(f"q{k}")).alias(n) for k, n in enumerate(_Q)))


# --- a function of one's own over the window: the slope of log prices, in deviations of its own fit
SPAN = 20


def slope(windows: np.ndarray) -> np.ndarray:
    """Least-squares slope of each row."""
    t = np.arange(windows.shape[1]) - (windows.shape[1] - 1) / 2
    return windows @ t / (t @ t)


_NUMBERED = f"SELECT symbol, ts, ln(close) AS y, CAST(row_number() OVER (PARTITION BY symbol ORDER BY ts) AS DOUBLE) AS i FROM ({EVENT_BARS_SQL}) AS b WHERE close > 0"


@query("u03_window_kernel", f"SELECT symbol, ts, round(CASE WHEN count(y) {last(SPAN)} = {SPAN} THEN regr_slope(y, i) {last(SPAN)} END, 8) + 0.0 AS slope FROM ({_NUMBERED}) AS n")
def window_kernel(spark: SparkSession, folder: str) -> DataFrame:
    """A kernel in numpy over every window."""
    found = windowed(event_bars(spark, folder).where("close > 0"), "ln(close)", SPAN, slope)
    return found.select("symbol", "ts", (F.round("y", 8) + F.lit(0.0)).alias("slope"))


# --- sleeves: a side where a session's signal ranks in the tails of its own past, and the stop that goes with it
SLEEVE_WINDOW, SLEEVE_LEAST, TAIL, IC_SIGN, STOP_RANGES = 100, 40, 0.9, -1, 3.0
_SLEEVE = ({"day": "CAST(ts AS DATE)", "tr": f"coalesce({true_range()}, high - low)"}, *fading({"atr": seeded("tr", 14)}), {"pv": "sum((high + low + close) / 3 * volume) OVER (PARTITION BY symbol, day ORDER BY ts)", "vv": "sum(volume) OVER (PARTITION BY symbol, day ORDER BY ts)"}, {"x": "CASE WHEN hour(ts) BETWEEN 13 AND 20 AND atr > 0 THEN (close - pv / nullif(vv, 0)) / atr END"})
_SIDE = f"CASE WHEN rank >= {TAIL} THEN {IC_SIGN} WHEN rank <= 1 - {TAIL} THEN {-IC_SIGN} END"
_DECIDED = f"CAST({_SIDE} AS INTEGER) AS side, {rounded(f'{STOP_RANGES} * atr')} AS stop_distance"
_D_RANKED = f"SELECT *, (len(list_filter(l, lambda v: v < x)) + (len(list_filter(l, lambda v: v = x)) + 1) / 2) / len(l) AS rank FROM (SELECT symbol, ts, x, atr, list(x) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {SLEEVE_WINDOW - 1} PRECEDING AND CURRENT ROW) AS l FROM ({staged_sql(EVENT_BARS_SQL, _SLEEVE)}) AS s WHERE x IS NOT NULL) AS o WHERE len(l) >= {SLEEVE_LEAST}"


@query("g41_sleeve_decisions", f"SELECT symbol, ts, {_DECIDED} FROM ({_D_RANKED}) AS r WHERE {_SIDE} IS NOT NULL")
def sleeve_decisions(spark: SparkSession, folder: str) -> DataFrame:
    """Against the tails of the distance from the session's mean price, ranked among its own past occurrences only."""
    rows = with_stages(event_bars(spark, folder), _SLEEVE).where("x IS NOT NULL").select("symbol", "ts", "x", "atr")
    ranked = sliding(rows, "x", SLEEVE_WINDOW, SLEEVE_LEAST).where("rank IS NOT NULL").join(rows.select("symbol", "ts", "atr"), ["symbol", "ts"])
    return ranked.where(f"{_SIDE} IS NOT NULL").selectExpr("symbol", "ts", f"CAST({_SIDE} AS INTEGER) AS side", f"{rounded(f'{STOP_RANGES} * atr')} AS stop_distance")
