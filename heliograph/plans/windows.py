"""Rolling, cumulative and session features over bars."""

from __future__ import annotations

from heliograph.functions.series import ORDERED, SO_FAR, WHOLE, crossed_down, crossed_up, drawdown, following, lag, last, lead, log_return, natural_log, ordered_sma, over, prior, ratio, rolling, sma, true_range, wma
from heliograph.plans.registry import series

R = {"r": log_return()}
TR = {"tr": true_range()}
DAY = {"day": "date_trunc('day', ts)"}
MIN_DAY = "OVER (PARTITION BY symbol, day ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"

series("w01_log_returns", [f"r{n}" for n in (1, 3, 5, 10, 20, 50)], {"log_close": natural_log("close")}, {f"r{n}": f"log_close - {lag('log_close', n)}" for n in (1, 3, 5, 10, 20, 50)}, duck=[{f"r{n}": log_return(n=n) for n in (1, 3, 5, 10, 20, 50)}])
series("w02_forward_return", ["fwd1", "fwd3", "fwd12"], {f"fwd{k}": f"{ratio(lead('close', k), 'close')} - 1" for k in (1, 3, 12)})
series("w03_rolling_sum", ["x"], R, {"x": rolling("sum", "r", 20)})
series("w04_sma", ["sma10", "sma50"], {"sma10": sma("close", 10), "sma50": sma("close", 50)})
series("w05_rolling_std_population", ["x"], {"x": rolling("stddev_pop", "close", 20)})
series("w06_rolling_std_sample", ["x"], {"x": rolling("stddev_samp", "close", 20)})
series("w07_rolling_extremes", ["hi", "lo"], {"hi": rolling("max", "high", 20), "lo": rolling("min", "low", 20)})
series("w08_extremes_without_warm_up", ["hi", "lo"], {"hi": f"max(high) {last(12)}", "lo": f"min(low) {last(12)}"})
series("w09_prior_channel", ["hi", "lo"], {"hi": f"CASE WHEN count(high) {prior(20)} = 20 THEN max(high) {prior(20)} END", "lo": f"CASE WHEN count(low) {prior(20)} = 20 THEN min(low) {prior(20)} END"})
series("w10_rolling_slope", ["x"], {"n": f"CAST(row_number() {ORDERED} AS DOUBLE)", "lc": "ln(close)"}, {"x": f"CASE WHEN n >= 10 THEN regr_slope(lc, n) {last(10)} END"})
_M = {f"m{k}": f"avg(pow(r, {k})) {last(30)}" for k in (1, 2, 3)}
series("w11_rolling_skew", ["x"], {**R}, {"cnt": f"count(r) {last(30)}", **_M}, {"x": "CASE WHEN cnt = 30 THEN (m3 - 3 * m1 * m2 + 2 * pow(m1, 3)) / nullif(pow(greatest(m2 - m1 * m1, 0), 1.5), 0) * sqrt(30.0 * 29.0) / 28.0 END"})
series("w12_rolling_beta", ["c", "beta"], {"r": log_return(), "v": f"ln(volume) - ln({lag('volume')})"}, {"sr": f"stddev_pop(r) {last(60)}", "sv": f"stddev_pop(v) {last(60)}", "cov": f"covar_pop(r, v) {last(60)}", "cs": f"covar_samp(r, v) {last(60)}", "k": f"count(v) {last(60)}"}, {"c": "CASE WHEN k = 60 THEN cov / nullif(sr * sv, 0) END", "beta": "CASE WHEN k = 60 THEN cs / nullif(sv * sv, 0) END"})
series("w13_lagged_beta_residual", ["resid"], {"r": log_return(), "v": f"ln(volume) - ln({lag('volume')})"}, {"k": f"count(v) {prior(60)}", "beta": f"covar_samp(r, v) {prior(60)} / nullif(var_samp(v) {prior(60)}, 0)", "rs": rolling("sum", "r", 5), "vs": rolling("sum", "v", 5)}, {"resid": "CASE WHEN k = 60 THEN -(rs - beta * vs) END"})
series("w17_daily_vwap", ["vwap"], DAY, {"pv": f"sum((high + low + close) / 3 * volume) {MIN_DAY}", "v": f"sum(volume) {MIN_DAY}"}, {"vwap": "pv / nullif(v, 0)"})
_NY = {"m": "hour(ts) * 60 + minute(ts)", "day": "date_trunc('day', ts)"}
_IN = "m >= 480 AND m < 960"
series("w18_session_vwap_distance", ["x"], _NY, {**TR, "pv": f"sum(CASE WHEN {_IN} THEN (high + low + close) / 3 * greatest(volume, 1) END) {MIN_DAY}", "v": f"sum(CASE WHEN {_IN} THEN greatest(volume, 1) END) {MIN_DAY}"}, {"atr": rolling("avg", "tr", 14)}, {"x": f"CASE WHEN {_IN} THEN -(close - pv / v) / nullif(atr, 0) END"})
series("w19_cumulative_by_day", ["hi", "lo", "vol"], DAY, {"hi": f"max(high) {MIN_DAY}", "lo": f"min(low) {MIN_DAY}", "vol": f"sum(volume) {MIN_DAY}"})
_SLOT = "OVER (PARTITION BY symbol, slot ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
series("w20_slot_volume_z", ["z"], {"slot": "hour(ts)"}, {"k": f"count(volume) {_SLOT}", "mu": f"avg(volume) {_SLOT}", "sd": f"stddev_samp(volume) {_SLOT}"}, {"z": "CASE WHEN k >= 20 THEN (volume - mu) / nullif(sd, 0) END"})
_FIRST = "OVER (PARTITION BY symbol, day ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
series("w21_group_first", ["first_open"], _NY, {"first_open": f"first_value(CASE WHEN {_IN} THEN open END) IGNORE NULLS {_FIRST}"}, duck=(_NY, {"first_open": f"first_value(CASE WHEN {_IN} THEN open END IGNORE NULLS) {_FIRST}"}))
series("w22_session_position", {"pos": "CAST(pos AS BIGINT)"}, _NY, {"pos": f"CASE WHEN {_IN} THEN sum(CASE WHEN {_IN} THEN 1 ELSE 0 END) {MIN_DAY} - 1 ELSE -1 END"})
_SIGN = {"s": f"CASE WHEN close > {lag('close')} THEN 1 WHEN close < {lag('close')} THEN -1 ELSE 0 END"}
series("w23_streak", {"streak": "CAST(streak AS BIGINT)"}, _SIGN, {"chg": f"CASE WHEN s = {lag('s')} THEN 0 ELSE 1 END"}, {"island": f"sum(chg) {SO_FAR}"}, {"streak": "greatest(-50, least(50, s * row_number() OVER (PARTITION BY symbol, island ORDER BY ts)))"})
_EV = {"hi": f"max(high) {prior(10)}", "lo": f"min(low) {prior(10)}"}
_EV2 = {"ev": "CASE WHEN close > hi THEN 1 WHEN close < lo THEN -1 END"}
series("w24_persisting_side", {"side": "CAST(side AS BIGINT)"}, _EV, _EV2, {"side": f"coalesce(last_value(ev) IGNORE NULLS {SO_FAR}, 0)"}, duck=(_EV, _EV2, {"side": f"coalesce(last_value(ev IGNORE NULLS) {SO_FAR}, 0)"}))
series("w25_crossings", {"up": "up", "down": "down"}, {"fast": sma("close", 5), "slow": sma("close", 20)}, {"up": f"CAST({crossed_up('fast', 'slow')} AS INT)", "down": f"CAST({crossed_down('fast', 'slow')} AS INT)"})
series("w26_hull_average", ["hma"], {"w8": wma("close", 8), "w16": wma("close", 16)}, {"d": "2 * w8 - w16"}, {"hma": wma("d", 4)})
series("w27_ordered_sma", ["x"], {"x": ordered_sma("close", 7)})
series("w28_stochastic", ["k", "d"], {"hh": rolling("max", "high", 14), "ll": rolling("min", "low", 14)}, {"k": "100 * (close - ll) / nullif(hh - ll, 0)"}, {"d": ordered_sma("k", 3)})
series("w29_true_range", ["tr"], TR)
series("w33_money_flow_index", ["mfi"], {"tp": "(high + low + close) / 3"}, {"dtp": f"tp - {lag('tp')}"}, {"up": f"sum(CASE WHEN dtp > 0 THEN tp * volume ELSE 0 END) {last(14)}", "dn": f"sum(CASE WHEN dtp < 0 THEN tp * volume ELSE 0 END) {last(14)}", "k": f"count(dtp) {last(14)}"}, {"mfi": "CASE WHEN k < 14 THEN NULL WHEN dn = 0 THEN 100.0 ELSE 100 - 100 / (1 + up / dn) END"})
_LOG_RANGES = {"hl": f"pow({natural_log('hl_ratio')}, 2)", "co": f"pow({natural_log('co_ratio')}, 2)"}
_RANGE_VOLATILITY = [{"parkinson": f"sqrt(CASE WHEN count(hl) {last(20)} = 20 THEN avg(hl) {last(20)} END / (4 * ln(2.0)))", "garman_klass": f"sqrt(greatest(CASE WHEN count(hl) {last(20)} = 20 THEN avg(0.5 * hl - (2 * ln(2.0) - 1) * co) {last(20)} END, 0))", "mid": sma("close", 20), "sd": rolling("stddev_pop", "close", 20)}, {"bands": "(close - (mid - 2 * sd)) / nullif(4 * sd, 0)"}]
series("w31_range_volatility", ["parkinson", "garman_klass", "bands"], {"hl_ratio": over("high", "low"), "co_ratio": over("close", "open")}, _LOG_RANGES, *_RANGE_VOLATILITY, duck=[{"hl": "pow(ln(high / low), 2)", "co": "pow(ln(close / open), 2)"}, *_RANGE_VOLATILITY])
series("w32_volume_features", ["volume_z", "obv_z", "cmf"], {"step": f"coalesce(sign(close - {lag('close')}), 0) * volume", "mf": "coalesce((2 * close - high - low) / nullif(high - low, 0), 0) * volume"}, {"obv": f"sum(step) {SO_FAR}"}, {"volume_z": f"(volume - ({sma('volume', 20)})) / nullif({rolling('stddev_pop', 'volume', 20)}, 0)", "obv_z": f"(obv - ({sma('obv', 20)})) / nullif({rolling('stddev_pop', 'obv', 20)}, 0)", "cmf": f"CASE WHEN count(mf) {last(21)} = 21 THEN sum(mf) {last(21)} / nullif(sum(volume) {last(21)}, 0) END"})
series("w34_bar_structure", ["body", "upper", "lower"], {"body": "(close - open) / nullif(high - low, 0)", "upper": "(high - greatest(open, close)) / nullif(high - low, 0)", "lower": "(least(open, close) - low) / nullif(high - low, 0)"})
series("w35_gap", ["gap"], {"before": lag("close")}, {"ratio": over("open", "before")}, {"gap": f"CASE WHEN ts - {lag('ts')} > INTERVAL 1 HOUR THEN {natural_log('ratio')} ELSE 0.0 END"}, duck=[{"gap": f"CASE WHEN ts - {lag('ts')} > INTERVAL 1 HOUR THEN ln(open / {lag('close')}) ELSE 0.0 END"}])
series("w36_efficiency_ratio", ["er"], {"d": f"abs(close - {lag('close')})", "move": f"abs(close - {lag('close', 10)})"}, {"er": f"move / nullif({rolling('sum', 'd', 10)}, 0)"})
series("w37_internal_bar_strength", ["ibs"], {"ibs": "(close - low) / nullif(high - low, 0)"})
series("w38_williams_r", ["wr"], {"hh": rolling("max", "high", 14), "ll": rolling("min", "low", 14)}, {"wr": "-100 * (hh - close) / nullif(hh - ll, 0)"})
series("w39_bollinger", ["lo", "mid", "hi"], {"mid": sma("close", 20), "sd": rolling("stddev_samp", "close", 20)}, {"lo": "mid - 2 * sd", "hi": "mid + 2 * sd"})
_MID = {f"m{n}": f"(({rolling('max', 'high', n)}) + ({rolling('min', 'low', n)})) / 2" for n in (9, 26, 52)}
series("w40_ichimoku", ["tenkan", "kijun", "senkou_a", "senkou_b"], _MID, {"tenkan": "m9", "kijun": "m26", "senkou_a": lag("(m9 + m26) / 2", 26), "senkou_b": lag("m52", 26)})
series("w41_heikin_ashi", ["ha_open", "ha_close"], {"ha_close": "(open + high + low + close) / 4", "ha_open": f"({lag('open')} + {lag('close')}) / 2"})
_ALL_DAY = "OVER (PARTITION BY symbol, day)"
series("w43_opening_range", ["hi", "lo"], DAY, {"pos": "row_number() OVER (PARTITION BY symbol, day ORDER BY ts) - 1"}, {"h": f"max(CASE WHEN pos < 3 THEN high END) {_ALL_DAY}", "l": f"min(CASE WHEN pos < 3 THEN low END) {_ALL_DAY}"}, {"hi": "CASE WHEN pos >= 3 THEN h END", "lo": "CASE WHEN pos >= 3 THEN l END"})
series("w44_cumulative_drawdown", ["dd"], {"r": f"coalesce({log_return()}, 0)"}, {"eq": f"sum(r) {SO_FAR}"}, {"dd": drawdown("eq")})
series("w45_structural_stop", ["dist"], TR, {"atr": rolling("avg", "tr", 14), "ll": f"min(low) {last(10)}", "hh": f"max(high) {last(10)}"}, {"dist": "CASE WHEN atr IS NOT NULL THEN greatest(close - ll, hh - close, 0.25 * atr) END"})
_VOL = {"vol": rolling("stddev_pop", "r1", 20)}
series("w46_percent_change", ["chg", "vol"], {"c1": lag("close"), "c20": lag("close", 20)}, {"r1": f"{over('close', 'c1')} - 1", "chg": f"{over('close', 'c20')} - 1"}, _VOL, duck=[{"r1": f"close / {lag('close')} - 1", "chg": f"close / {lag('close', 20)} - 1"}, _VOL])
series("w30_momentum_block", ["cum20", "slope", "roc"], {**R, "n": f"CAST(row_number() {ORDERED} AS DOUBLE)", "lc": "ln(close)", "roc": f"100 * (close / {lag('close', 12)} - 1)"}, {"cum20": rolling("sum", "r", 20), "slope": f"CASE WHEN n >= 20 THEN regr_slope(lc, n) {last(20)} END"})
series("w47_momentum_features", ["mom12", "rev5", "hi52"], {"mom12": f"ln({lag('close', 21)}) - ln({lag('close', 252)})", "rev5": f"-(ln(close) - ln({lag('close', 5)}))", "hi52": f"close / ({rolling('max', 'close', 252)}) - 1"}, daily=True)
series("w50_index_momentum", ["m1", "m3", "m6", "r5"], {f"m{k}": f"ln(close) - ln({lag('close', 21 * k)})" for k in (1, 3, 6)} | {"r5": f"-(ln(close) - ln({lag('close', 5)}))"}, daily=True)
series("y24_bar_anatomy", ["rng", "body", "pos"], {"rng": "high - low", "body": "CASE WHEN high > low THEN abs(close - open) / (high - low) ELSE 0.0 END", "pos": "CASE WHEN high > low THEN (close - low) / (high - low) ELSE 0.5 END"})
series("y25_strong_bar", {"bull": "CAST(bull AS INT)", "bear": "CAST(bear AS INT)"}, {"pos": "CASE WHEN high > low THEN (close - low) / (high - low) ELSE 0.5 END"}, {"bull": "CASE WHEN close > open AND pos >= 2.0 / 3 THEN 1 ELSE 0 END", "bear": "CASE WHEN close < open AND pos <= 1.0 / 3 THEN 1 ELSE 0 END"})
series("b10_forward_volatility", ["target"], R, {"r2": "r * r"}, {"k": f"count(r2) {following(12)}", "s": f"sum(r2) {following(12)}"}, {"target": "CASE WHEN k = 12 THEN ln(sqrt(nullif(s, 0))) END"})
series("p05_spike_filter", ["close"], {"step": f"ts - {lag('ts')}", "r": log_return()}, {"plain": "CASE WHEN step > INTERVAL 1 HOUR THEN NULL ELSE r END"}, {"sd": f"stddev_pop(plain) {WHOLE}"}, where="plain IS NULL OR abs(r) <= 2 * sd")
series("p06_gap_mask", {"gap": "CAST(gap AS INT)"}, {"gap": f"CASE WHEN coalesce(ts - {lag('ts')} > INTERVAL 1 HOUR, false) THEN 1 ELSE 0 END"})
series("p04_price_repair", ["hi", "lo"], {"hi": "greatest(high, open, close)", "lo": "least(low, open, close)"})
series("p03_price_filter", ["close"], {"ok": "least(open, high, low, close) > 1"}, where="ok AND volume >= 0")
series("p11_safe_division", ["x"], {"d": "close - open"}, {"x": "CASE WHEN abs(d) >= 1e-12 THEN (high - low) / nullif(d, 0) END"})
series("r18_running_window_range", ["hi", "lo"], {"day": "date_trunc('day', ts)", "h": "hour(ts)"}, {"a": "max(CASE WHEN h >= 14 AND h < 16 THEN high END) OVER (PARTITION BY symbol, day)", "b": "min(CASE WHEN h >= 14 AND h < 16 THEN low END) OVER (PARTITION BY symbol, day)"}, {"hi": "CASE WHEN h >= 16 THEN a END", "lo": "CASE WHEN h >= 16 THEN b END"})
