"""Rule signals over bars: -1, 0 or 1, or a signed strength."""

from __future__ import annotations

from heliograph.functions.linear import fading, wilder
from heliograph.functions.series import crossed_down, crossed_up, lag, last, log_return, prior, rolling, sma, true_range
from heliograph.plans.registry import series

TR = {"tr": f"coalesce({true_range()}, high - low)", "r": log_return()}
#: Wilder's mean of the true range; a few stages.
ATR = fading({"atr": wilder("tr", 14, 14)})
SIDE = {"signal": "CAST(signal AS BIGINT)"}
DAY = {"m": "hour(ts) * 60 + minute(ts)", "day": "date_trunc('day', ts)", "tr": f"coalesce({true_range()}, high - low)"}
IN = "m >= 480 AND m < 960"


def side(up: str, down: str) -> str:
    return f"CASE WHEN {up} THEN 1 WHEN {down} THEN -1 ELSE 0 END"


series("g01_time_series_momentum", SIDE, {"chg": f"close / {lag('close', 60)} - 1"}, {"signal": "coalesce(sign(chg), 0)"})
series("g02_z_score_reversion", SIDE, {"mu": sma("close", 20), "sd": rolling("stddev_samp", "close", 20)}, {"z": "(close - mu) / nullif(sd, 0)"}, {"signal": side("z <= -1.5", "z >= 1.5")})
series("g03_channel_breakout", SIDE, TR, *ATR, {"hi": f"max(high) {prior(20)}", "lo": f"min(low) {prior(20)}", "n": f"count(high) {prior(20)}"}, {"signal": side("n = 20 AND close > hi + 0.5 * atr", "n = 20 AND close < lo - 0.5 * atr")})
series("g05_scaled_momentum", ["x"], TR, *ATR, {"s": rolling("sum", "coalesce(r, 0)", 20), "n": f"count(r) {last(20)}"}, {"x": "CASE WHEN n = 20 THEN s / nullif(atr / close * sqrt(20.0), 0) END"})
series("g06_channel_position", ["x"], {"hh": rolling("max", "high", 20), "ll": rolling("min", "low", 20)}, {"x": "(close - ll) / nullif(hh - ll, 0) - 0.5"})
_FIRST = "OVER (PARTITION BY symbol, day)"
series("g07_session_move", ["x"], DAY, *ATR, {"o": f"min_by(CASE WHEN {IN} THEN open END, CASE WHEN {IN} THEN ts END) {_FIRST}"}, {"x": f"CASE WHEN {IN} THEN (close - o) / nullif(atr, 0) END"})
series("g08_opening_range_distance", ["x"], DAY, *ATR, {"pos": f"CASE WHEN {IN} THEN sum(CASE WHEN {IN} THEN 1 ELSE 0 END) OVER (PARTITION BY symbol, day ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 ELSE -1 END"}, {"h": f"max(CASE WHEN pos BETWEEN 0 AND 1 THEN high END) {_FIRST}", "l": f"min(CASE WHEN pos BETWEEN 0 AND 1 THEN low END) {_FIRST}"}, {"x": "CASE WHEN pos >= 2 THEN (CASE WHEN close > h THEN close - h WHEN close < l THEN close - l ELSE 0 END) / nullif(atr, 0) END"})
series("g09_range_expansion", ["x"], TR, *ATR, {"x": f"(close - {lag('close', 10)}) / nullif(atr * sqrt(10.0), 0)"})
series("g13_mean_ibs", ["x"], {"ibs": "(close - low) / nullif(high - low, 0)"}, {"x": f"-(avg(ibs) {last(3)} - 0.5)"})
series("g15_return_z", ["x"], TR, {"s": rolling("sum", "r", 5)}, {"mu": rolling("avg", "s", 100, 50), "sd": rolling("stddev_samp", "s", 100, 50)}, {"x": "-(s - mu) / nullif(sd, 0)"})
series("g18_fix_window", ["x"], DAY, *ATR, {"x": f"CASE WHEN abs(m - 960) <= 120 THEN (close - {lag('close', 4)}) / nullif(atr, 0) END"})
series("g21_turn_of_month", {"signal": "CAST(signal AS BIGINT)"}, {"dom": "day(ts)", "dim": "day(last_day(CAST(ts AS DATE)))"}, {"signal": "CASE WHEN dom > dim - 2 OR dom <= 2 THEN 1 ELSE 0 END"}, daily=True)
series("g24_volatility_ratio", ["x"], TR, {"a": rolling("stddev_samp", "r", 10), "b": rolling("stddev_samp", "r", 40)}, {"x": "ln(nullif(a, 0) / nullif(b, 0))"})
series("g27_volatility_of_volatility", ["x"], TR, *ATR, {"q": "atr / close"}, {"x": f"({rolling('stddev_samp', 'q', 20)}) / nullif({rolling('avg', 'q', 20)}, 0)"})
series("g25_atr_ratio", ["x"], TR, *fading({"a": wilder("tr", 7, 7), "b": wilder("tr", 28, 28)}), {"x": "ln(nullif(a, 0) / nullif(b, 0))"})
series("g42_prior_day_levels", SIDE, {"day": "date_trunc('day', ts)"}, {"dh": "max(high) OVER (PARTITION BY symbol, day)", "dl": "min(low) OVER (PARTITION BY symbol, day)", "first": "CASE WHEN row_number() OVER (PARTITION BY symbol, day ORDER BY ts) = 1 THEN 1 END"}, {"ph": f"CASE WHEN first = 1 THEN {lag('dh')} END", "pl": f"CASE WHEN first = 1 THEN {lag('dl')} END"}, {"hi": "max(ph) OVER (PARTITION BY symbol, day)", "lo": "min(pl) OVER (PARTITION BY symbol, day)"}, {"signal": side("close > hi", "close < lo")})
series("g47_inside_day", SIDE, {"signal": f"CASE WHEN high < {lag('high')} AND low > {lag('low')} THEN 1 ELSE 0 END"}, daily=True)
series("g47_golden_cross", SIDE, {"f": sma("close", 50), "s": sma("close", 200)}, {"signal": f"CASE WHEN {crossed_up('f', 's')} THEN 1 WHEN {crossed_down('f', 's')} THEN -1 ELSE 0 END"}, daily=True)
series("g47_turnaround_tuesday", SIDE, {"dow": "weekday(ts)"}, {"signal": f"CASE WHEN dow = 0 AND close < {lag('close')} THEN 1 ELSE 0 END"}, duck=({"dow": "isodow(ts) - 1"}, {"signal": f"CASE WHEN dow = 0 AND close < {lag('close')} THEN 1 ELSE 0 END"}), daily=True)
series("g47_third_friday", SIDE, {"dow": "weekday(ts)"}, {"signal": "CASE WHEN dow = 4 AND day(ts) BETWEEN 15 AND 21 THEN 1 ELSE 0 END"}, duck=({"dow": "isodow(ts) - 1"}, {"signal": "CASE WHEN dow = 4 AND day(ts) BETWEEN 15 AND 21 THEN 1 ELSE 0 END"}), daily=True)
series("g47_band_position", SIDE, {"mu": sma("close", 20), "sd": rolling("stddev_samp", "close", 20)}, {"b": "(close - mu + 2 * sd) / nullif(4 * sd, 0)"}, {"signal": side("b < 0.05", "b > 0.95")}, daily=True)
series("g47_donchian", SIDE, {"hi": f"max(high) {prior(20)}", "lo": f"min(low) {prior(10)}"}, {"signal": side("close > hi", "close < lo")}, daily=True)
series("g47_rate_of_change", SIDE, {"x": f"close / {lag('close', 12)} - 1"}, {"signal": side("x > 0.2", "x < -0.2")}, daily=True)
series("g48_floor_pivots", ["p", "r1", "s1"], {"p": f"({lag('high')} + {lag('low')} + {lag('close')}) / 3"}, {"r1": f"2 * p - {lag('low')}", "s1": f"2 * p - {lag('high')}"}, daily=True)
series("g54_commodity_channel_index", ["cci"], {"tp": "(high + low + close) / 3"}, {"mu": sma("tp", 14), "l": f"collect_list(tp) {last(14)}"}, {"cci": "(tp - mu) / nullif(0.015 * aggregate(l, CAST(0 AS DOUBLE), (s, v) -> s + abs(v - mu)) / 14, 0)"}, duck=({"tp": "(high + low + close) / 3"}, {"mu": sma("tp", 14), "l": f"list(tp) {last(14)}"}, {"cci": "(tp - mu) / nullif(0.015 * list_sum(list_transform(l, lambda v: abs(v - mu))) / 14, 0)"}))
series("g57_shifted_average_cross", SIDE, {"f": sma("close", 13), "s": sma("close", 55)}, {"d": "s - f"}, {"signal": f"CASE WHEN d >= 0.01 AND {lag('d', 2)} <= -0.01 THEN -1 WHEN d <= -0.01 AND {lag('d', 2)} >= 0.01 THEN 1 ELSE 0 END"})
series("g61_envelope_fade", SIDE, {"mid": "(high + low) / 2"}, {"w": f"(3 * mid + 2 * {lag('mid')} + {lag('mid', 2)}) / 6"}, {"signal": f"CASE WHEN {lag('low')} < 0.9 * {lag('w')} AND close < 0.9 * {lag('w')} THEN 1 WHEN {lag('high')} > 1.1 * {lag('w')} AND close > 1.1 * {lag('w')} THEN -1 ELSE 0 END"})
series("g69_accelerator", ["ac"], {"mid": "(high + low) / 2"}, {"ao": f"({sma('mid', 5)}) - ({sma('mid', 34)})"}, {"ac": f"ao - ({rolling('avg', 'ao', 5)})"})
series("y45_prior_high_exit", SIDE, {"signal": f"CASE WHEN close > {lag('high')} THEN 1 ELSE 0 END"}, daily=True)
series("b08_stop_with_floor", ["dist"], TR, *ATR, {"dist": "CASE WHEN atr IS NOT NULL THEN greatest(3 * atr, 25 * 0.01 * close) END"})
series("b03_barrier_prices", ["sl", "tp"], TR, *ATR, {"sl": "close - 2 * atr", "tp": "close + 3 * atr"})
series("p13_signal_clamp", SIDE, {"x": f"sign(close - {lag('close')})"}, {"signal": "coalesce(CAST(x AS BIGINT), 0)"})
