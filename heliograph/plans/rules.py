"""Rule signals that need exponential means, local sessions or another symbol's bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.functions.linear import GAIN, LOSS, directional_index, ema, fading, relative_strength, seeded, wilder
from heliograph.functions.series import ORDERED, crossed_down, crossed_up, lag, last, log_return, over, prior, rolling, sma, true_range, wma
from heliograph.operators.asof import as_of
from heliograph.plans.registry import series
from heliograph.plans.signals import SIDE, side
from heliograph.sources.tables import EVENT_BARS_SQL, event_bars

TR = {"tr": f"coalesce({true_range()}, high - low)", "r": log_return()}
ATR = [TR, *fading({"atr": wilder("tr", 14, 14)})]
CHANGE = {"d": f"close - {lag('close')}"}
LONDON, NEW_YORK, TOKYO = {"l": "Europe/London"}, {"n": "America/New_York"}, {"a": "Asia/Tokyo"}
#: Local sessions by minutes of the day: first included, last excluded.
IN_LONDON, IN_NEW_YORK, IN_TOKYO = "l_m >= 480 AND l_m < 990", "n_m >= 570 AND n_m < 960", "a_m >= 540 AND a_m < 900"


def of_day(d: str) -> str:
    return f"OVER (PARTITION BY symbol, {d})"


def so_far(d: str) -> str:
    return f"OVER (PARTITION BY symbol, {d} ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def first_and_last(where: str, d: str) -> dict[str, str]:
    """``op`` and ``cl``: the session's first open and last close, on all rows of the day."""
    return {"op": f"min_by(CASE WHEN {where} THEN open END, CASE WHEN {where} THEN ts END) {of_day(d)}", "cl": f"max_by(CASE WHEN {where} THEN close END, CASE WHEN {where} THEN ts END) {of_day(d)}"}


def of_day_before(d: str, **values: str) -> list[dict[str, str]]:
    """Stages that put a value that all rows of a day share on the rows of the symbol's next day."""
    first = {f"{k}_f": f"CASE WHEN row_number() OVER (PARTITION BY symbol, {d} ORDER BY ts) = 1 THEN lag({v}) {ORDERED} END" for k, v in values.items()}
    return [first, {k: f"max({k}_f) {of_day(d)}" for k in values}]


# --- scaled distances and session statistics
series("g10_vwap_distance", ["x"], *ATR, {"pv": f"sum(CASE WHEN {IN_LONDON} THEN (high + low + close) / 3 * greatest(volume, 1) ELSE 0 END) {so_far('l_d')}", "v": f"sum(CASE WHEN {IN_LONDON} THEN greatest(volume, 1) ELSE 0 END) {so_far('l_d')}"}, {"x": f"CASE WHEN {IN_LONDON} THEN -(close - pv / nullif(v, 0)) / nullif(atr, 0) END"}, places=LONDON)
series("g11_band_z", ["x"], *fading({"m": ema("close", 20, 20)}), {"x": f"-(close - m) / nullif({rolling('stddev_samp', 'close', 20)}, 0)"})
series("g12_range_band_z", ["x"], *ATR, *fading({"m": ema("close", 20, 20)}), {"x": "-(close - m) / nullif(atr, 0)"})
series("g14_strength_deviation", ["x"], {"d": f"coalesce(close - {lag('close')}, 0)"}, *fading({"g": wilder(GAIN, 14, 14), "l": wilder(LOSS, 14, 14)}), {"x": f"-(({relative_strength('g', 'l')}) - 50) / 50"})
series("g16_prior_session_return", ["x"], *ATR, first_and_last(IN_LONDON, "l_d") | {"al": f"max_by(atr, ts) {of_day('l_d')}"}, *of_day_before("l_d", x0="(cl - op) / nullif(al, 0)"), {"x": f"CASE WHEN {IN_LONDON} THEN x0 END"}, places=LONDON)
series("g17_opening_gap", ["x"], *ATR, first_and_last(IN_NEW_YORK, "n_d"), *of_day_before("n_d", cp="cl"), {"x": f"CASE WHEN {IN_NEW_YORK} THEN (op - cp) / nullif(atr, 0) END"}, places=NEW_YORK)
_SLOT = "OVER (PARTITION BY symbol, slot ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
series("g19_slot_volume_z", ["x"], {"slot": "hour(ts) * 60 + minute(ts)", "vv": "greatest(volume, 1)"}, {"k": f"count(vv) {_SLOT}", "mu": f"avg(vv) {_SLOT}", "sd": f"stddev_samp(vv) {_SLOT}"}, {"x": "CASE WHEN k >= 20 THEN (vv - mu) / nullif(sd, 0) END"})
#: The Tokyo session lies in one date of London's clock, the same as its own.
series("g20_morning_range_position", ["x"], {"hi": f"max(CASE WHEN {IN_TOKYO} THEN high END) {of_day('a_d')}", "lo": f"min(CASE WHEN {IN_TOKYO} THEN low END) {of_day('a_d')}"}, {"h": f"max(CASE WHEN a_d = l_d THEN hi END) {of_day('l_d')}", "l": f"min(CASE WHEN a_d = l_d THEN lo END) {of_day('l_d')}"}, {"x": f"CASE WHEN {IN_LONDON} THEN (close - (h + l) / 2) / nullif((h - l) / 2, 0) END"}, places=LONDON | TOKYO)
_SKEW = {f"m{k}": f"avg(pow(r, {k})) {last(60)}" for k in (1, 2, 3)}
series("g26_return_skew", ["x"], TR, {"k": f"count(r) {last(60)}", **_SKEW}, {"x": "CASE WHEN k = 60 THEN (m3 - 3 * m1 * m2 + 2 * pow(m1, 3)) / nullif(pow(greatest(m2 - m1 * m1, 0), 1.5), 0) * sqrt(60.0 * 59.0) / 58.0 END"})
series("g28_session_volatility_ratio", ["x"], {"r2": f"pow(coalesce({log_return()}, 0), 2)"}, {"a": f"avg(CASE WHEN {IN_NEW_YORK} THEN r2 END) {of_day('n_d')}", "b": f"avg(CASE WHEN NOT ({IN_NEW_YORK}) THEN r2 END) {of_day('n_d')}"}, *of_day_before("n_d", ap="a", bp="b"), {"x": f"CASE WHEN {IN_NEW_YORK} THEN ln((ap + 1e-18) / (bp + 1e-18)) END"}, places=NEW_YORK)
series("w42_floor_pivots", ["p", "r1", "s1"], {"dh": f"max(high) {of_day('l_d')}", "dl": f"min(low) {of_day('l_d')}", "dc": f"max_by(close, ts) {of_day('l_d')}"}, *of_day_before("l_d", ph="dh", pl="dl", pc="dc"), {"p": "(ph + pl + pc) / 3"}, {"r1": "2 * p - pl", "s1": "2 * p - ph"}, places=LONDON)
series("w48_panel_features", ["mom60", "mom20", "rev5", "vol20", "range_pos"], TR, {"mom60": f"ln({lag('close', 5)}) - ln({lag('close', 60)})", "mom20": f"ln({lag('close')}) - ln({lag('close', 20)})", "rev5": f"-(ln(close) - ln({lag('close', 5)}))", "vol20": rolling("stddev_samp", "r", 20), "hh": rolling("max", "high", 60), "ll": rolling("min", "low", 60)}, {"range_pos": "(close - ll) / nullif(hh - ll, 0) - 0.5"}, daily=True)
_SESSIONS = [{f"{x}{n}": f"{how}(CASE WHEN {w} THEN {c} END) {of_day('l_d')}" for n, w in (("l", IN_LONDON), ("n", IN_NEW_YORK)) for x, how, c in (("h", "max", "high"), ("l", "min", "low"))}, *of_day_before("l_d", p1="hl", p2="ll", p3="hn", p4="ln")]
_TO_EXTREMES = [{n: f"100 * ({f('close', f'p{i}')} - 1)" for i, n in enumerate(("london_high", "london_low", "newyork_high", "newyork_low"), 1)} for f in (over, "{} / {}".format)]
series("j12_prior_session_extremes", list(_TO_EXTREMES[0]), *_SESSIONS, _TO_EXTREMES[0], duck=[*_SESSIONS, _TO_EXTREMES[1]], places=LONDON | NEW_YORK)

# --- another symbol's bars, as of each bar
DRIVER = "purchase"
DRIVEN_SQL = f"SELECT b.*, d.close AS driver FROM ({EVENT_BARS_SQL}) AS b ASOF LEFT JOIN (SELECT ts, close FROM ({EVENT_BARS_SQL}) AS x WHERE symbol = '{DRIVER}') AS d ON b.ts >= d.ts"


def driven_bars(spark: SparkSession, folder: str) -> DataFrame:
    """Bars of all symbols with the driver's last close at or before each."""
    bars = event_bars(spark, folder)
    driver = bars.where(F.col("symbol") == DRIVER).select("ts", F.col("close").alias("driver"))
    return as_of(bars, driver, "ts", [], ["driver"])


DRIVEN = (driven_bars, DRIVEN_SQL)
_BOTH = {"ry": f"coalesce({log_return()}, 0)", "dr": f"ln(driver) - ln({lag('driver')})"}
series("j07_driver_fill", ["driver"], base=DRIVEN)
series("g22_lead_momentum", ["x"], _BOTH, {"s": rolling("sum", "coalesce(dr, 0)", 12), "sd": rolling("stddev_samp", "dr", 120, 25), "k": f"row_number() {ORDERED}"}, {"x": "CASE WHEN k > 12 THEN s / nullif(sd * sqrt(12.0), 0) END"}, base=DRIVEN)
_RX = {"rx": "coalesce(dr, 0)"}
series("g23_residual_reversion", ["x"], _BOTH, _RX, {"k": f"count(rx) {prior(60)}", "beta": f"covar_samp(ry, rx) {prior(60)} / nullif(var_samp(rx) {prior(60)}, 0)", "cy": rolling("sum", "ry", 3), "cx": rolling("sum", "rx", 3)}, {"res": "CASE WHEN k = 60 THEN cy - beta * cx END"}, {"sd": rolling("stddev_samp", "res", 60, 25)}, {"x": "CASE WHEN abs(sd) >= 1e-9 THEN -res / sd END"}, base=DRIVEN)

# --- crosses, bands and breakouts
DI = [TR, {"up": f"coalesce(high - {lag('high')}, 0)", "dn": f"coalesce({lag('low')} - low, 0)"}, {"pdm": "CASE WHEN up > dn AND up > 0 THEN up ELSE CAST(0 AS DOUBLE) END", "mdm": "CASE WHEN dn > up AND dn > 0 THEN dn ELSE CAST(0 AS DOUBLE) END"}]
series("g36_directional_cross", SIDE, *DI, *directional_index(14), {"ap": lag("adx"), "pp": lag("pdi"), "mp": lag("mdi")}, {"signal": side("ap < adx AND pp < ap AND pdi > adx", "ap < adx AND mp < ap AND mdi > adx")})
series("g37_range_band_breakout", SIDE, TR, *fading({"mid": ema("close", 20), "band": wilder("tr", 10)}), {"signal": side("close > mid + 1.5 * band", "close < mid - 1.5 * band")})

_RANKED = ({"step": f"abs(close - {lag('close')})"}, {"er": f"abs(close - {lag('close', 10)}) / nullif({rolling('sum', 'step', 10)}, 0)", "hi": f"CASE WHEN count(high) {prior(20)} = 20 THEN max(high) {prior(20)} END", "lo": f"CASE WHEN count(low) {prior(20)} = 20 THEN min(low) {prior(20)} END"})
_PCT = ({"l": f"collect_list(er) {last(60)}"}, {"rank": "CASE WHEN er IS NOT NULL AND size(l) >= 25 THEN (size(filter(l, v -> v < er)) + (size(filter(l, v -> v = er)) + 1) / 2) / size(l) END"})
_PCT_DUCK = ({"l": f"list(er) FILTER (er IS NOT NULL) {last(60)}"}, {"rank": "CASE WHEN er IS NOT NULL AND len(l) >= 25 THEN (len(list_filter(l, lambda v: v < er)) + (len(list_filter(l, lambda v: v = er)) + 1) / 2) / len(l) END"})
_GATED = {"signal": f"CASE WHEN NOT (l_m >= 480 AND l_m <= 900) THEN 0 WHEN rank >= 0.7 AND close > hi THEN 1 WHEN rank >= 0.7 AND close < lo THEN -1 ELSE 0 END"}
series("g38_efficient_breakout", SIDE, *_RANKED, *_PCT, _GATED, duck=(*_RANKED, *_PCT_DUCK, _GATED), places=LONDON)
_HULL = [{"w8": wma("close", 8), "w16": wma("close", 16)}, {"dd": "2 * w8 - w16", **CHANGE}, {"hma": wma("dd", 4)}, *fading({"e": ema("close", 21), "g": seeded(GAIN, 14), "l": seeded(LOSS, 14)})]
_STOCH = [{f"h{n}": rolling("max", "high", n) for n in (21, 8)} | {f"l{n}": rolling("min", "low", n) for n in (21, 8)}, {f"k{n}": f"100 * (close - l{n}) / nullif(h{n} - l{n}, 0)" for n in (21, 8)}, {"s1": sma("k21", 3), "s2": sma("k8", 3), "es": lag("e"), "rsi": relative_strength("g", "l")}]
series("g39_hull_cross", SIDE, *_HULL, *_STOCH, {"signal": side(f"l_m >= 480 AND l_m <= 900 AND close > hma AND close > es AND rsi > 50 AND s1 > 50 AND s2 > 50 AND {crossed_up('hma', 'es')}", f"l_m >= 480 AND l_m <= 900 AND close < hma AND close < es AND rsi < 50 AND s1 < 50 AND s2 < 50 AND {crossed_down('hma', 'es')}")}, places=LONDON)

# --- fixed-level rules; prices here move by some hundredths of themselves, P is their unit
P = 0.01
series("g49_strength_level_cross", SIDE, {"d": f"open - {lag('open')}"}, *fading({"g": seeded(GAIN, 14), "l": seeded(LOSS, 14)}), {"rsi": relative_strength("g", "l")}, {"rp": lag("rsi")}, {"signal": side("rsi > 30 AND rp < 30", "rsi < 70 AND rp > 70")})
series("g50_mean_cross", SIDE, *fading({"f": ema("close", 5), "s": ema("close", 60)}), {"signal": side(crossed_up("f", "s"), crossed_down("f", "s"))})
series("g51_band_break", SIDE, {"mid": sma("close", 20), "sd": rolling("stddev_pop", "close", 20)}, {"hi": "mid + 2 * sd", "lo": "mid - 2 * sd"}, {"signal": side(crossed_up("close", "hi"), crossed_down("close", "lo"))})
series("g52_range_straddle", ["up", "down", "risk"], {"day": "date_trunc('day', ts)", "h": "hour(ts)"}, {"a": f"max(CASE WHEN h >= 14 AND h < 16 THEN high END) {so_far('day')}", "b": f"min(CASE WHEN h >= 14 AND h < 16 THEN low END) {so_far('day')}"}, {"armed": f"h >= 16 AND a - b < 5000 * {P} AND a - close > 20 * {P} AND close - b > 20 * {P}"}, {"up": "CASE WHEN armed THEN a END", "down": "CASE WHEN armed THEN b END", "risk": "CASE WHEN armed THEN a - b END"})
series("g53_directional_expert", SIDE, *DI, *directional_index(14), {"a1": lag("adx"), "p1": lag("pdi"), "p2": lag("pdi", 2), "m2": lag("mdi", 2)}, {"signal": side("p1 > m2 AND p2 < m2 AND a1 < 20", "p1 < m2 AND p2 > m2 AND a1 < 20")})
_MACD = [*fading({"f": ema("close", 12), "w": ema("close", 26)}), {"m": "f - w"}, *fading({"c": ema("m", 9)})]
series("g56_macd_cross", SIDE, *_MACD, {"m1": lag("m"), "c1": lag("c"), "m2": lag("m", 2), "c2": lag("c", 2), "h": "hour(ts)"}, {"signal": side("h > 5 AND h < 15 AND m2 < c2 AND m1 > c1", "h > 5 AND h < 15 AND m2 > c2 AND m1 < c1")})
series("g62_three_means", SIDE, {"med": "(high + low) / 2"}, *fading({"a": ema("med", 10), "b": ema("med", 25), "c": ema("med", 50)}), {"a1": lag("a"), "b1": lag("b"), "c1": lag("c"), "a2": lag("a", 2)}, {"signal": side("a1 > b1 AND a1 > c1 AND a2 <= c1", "a1 < b1 AND a1 < c1 AND a2 >= c1")})
series("g63_spread_and_strength", SIDE, CHANGE, *fading({"f": ema("close", 23), "s": ema("close", 62), "g1": seeded(GAIN, 67), "l1": seeded(LOSS, 67), "g2": seeded(GAIN, 97), "l2": seeded(LOSS, 97)}), {"sp": f"({lag('f')} - {lag('s')}) / {P}", "r1": relative_strength("g1", "l1"), "r2": relative_strength("g2", "l2")}, {"x1": lag("r1"), "x2": lag("r2")}, {"signal": side("sp < 63 AND x1 < 59", "sp > -57 AND x2 > 60")})
series("g65_directional_system", SIDE, *DI, *directional_index(14), {f"{n}{k}": lag(c, k) for n, c in (("a", "adx"), ("p", "pdi"), ("m", "mdi")) for k in (1, 2)}, {"signal": side("a2 < a1 AND p2 < a2 AND p1 > a1", "a2 < a1 AND m2 < a2 AND m1 > a1")})
series("g66_directional_and_means", SIDE, *DI, *directional_index(6), *fading({"f": ema("close", 5), "s": ema("close", 12)}), {"f1": lag("f"), "s1": lag("s"), "p1": lag("pdi"), "m1": lag("mdi")}, {"signal": side(f"abs(f1 - s1) > 10 * {P} AND f1 > s1 AND p1 < m1 AND pdi > mdi", f"abs(f1 - s1) > 10 * {P} AND f1 < s1 AND p1 > m1 AND pdi < mdi")})
series("g67_smoothed_mean_cross", SIDE, *DI, {"med": "(high + low) / 2"}, *fading({"sm": seeded("med", 21)}), *directional_index(14), {"m1": lag("sm"), "a1": lag("adx"), "c1": lag("close"), "c2": lag("close", 2)}, {"signal": side("c1 > m1 AND c2 < m1 AND a1 > 16", "c1 < m1 AND c2 > m1 AND a1 > 16")})
_FADE = [{"mid": sma("close", 50), "sd": rolling("stddev_pop", "close", 50), **CHANGE, "hh": rolling("max", "high", 14), "ll": rolling("min", "low", 14)}, *fading({"g": seeded(GAIN, 6), "l": seeded(LOSS, 6)}), {"rsi": relative_strength("g", "l"), "num": "close - ll", "den": "hh - ll"}, {"k": f"100 * ({rolling('sum', 'num', 3)}) / nullif({rolling('sum', 'den', 3)}, 0)"}, {"u1": lag("mid + 1.5 * sd"), "b1": lag("mid - 1.5 * sd"), "c1": lag("close"), "x1": lag("rsi"), "k1": lag("k"), "h": "hour(ts)"}]
series("g68_extension_fade", SIDE, *_FADE, {"signal": side("h > 12 AND h < 19 AND c1 < b1 AND x1 < 25", "h > 12 AND h < 19 AND c1 > u1 AND x1 > 75 AND k1 > 85")})

series("y41_seeded_range", ["atr"], TR, *fading({"atr": seeded("tr", 14)}))
series("y42_band_range", ["band"], TR, *fading({"band": wilder("tr", 10)}))
series("b09_structural_stop", ["dist"], TR, *fading({"atr": seeded("tr", 14)}), {"lo": rolling("min", "low", 10), "hi": rolling("max", "high", 10)}, {"dist": "CASE WHEN atr IS NOT NULL AND lo IS NOT NULL THEN greatest(close - lo, hi - close, 0.25 * atr, 3 * 0.02) END"})
_LAG_SET = {"tr": TR["tr"]}
series("y33_regime_gate", {"quiet": "CAST(CASE WHEN a3 < a20 * 0.95 THEN 1 ELSE 0 END AS INT)"}, _LAG_SET, *fading({"a3": wilder("tr", 3, 3), "a20": wilder("tr", 20, 20)}), daily=True)
