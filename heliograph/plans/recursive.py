"""Recursive indicators and one-position walks over bars, and labels over the bars ahead.

Linear recursions run as windows (``heliograph.functions.linear``), the others as
scans. DuckDB's side of either is a recursive query over row numbers.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.functions.linear import GAIN, LOSS, directional_index, ema, fading, relative_strength, seeded, wilder
from heliograph.functions.recursive import adaptive, parabolic, reversal_literal, rule_walk, rule_walk_sides, trend_bands
from heliograph.functions.series import following, lag, lead, prior, rolling, true_range
from heliograph.operators.scan import Recursion, scan
from heliograph.operators.staged import Stage, staged_sql, with_stages
from heliograph.plans.registry import ORACLES, QUERIES, query, rounded, series
from heliograph.sources.tables import DAILY_BARS_SQL, EVENT_BARS_SQL, daily_bars, event_bars

#: True range of the first row too.
TR = {"tr": "coalesce(greatest(high - low, abs(high - {c}), abs(low - {c})), high - low)".format(c=lag("close"))}
CHANGE = {"d": f"close - {lag('close')}"}


def recursion(name: str, stages: Sequence[Stage], inputs: Sequence[str], outputs: str, how: Recursion | Sequence[Stage], first: Mapping[str, str], then: Mapping[str, str], out: Mapping[str, str], daily: bool = False) -> None:
    """Register a scan or windows (stages); ``first`` and ``then``: state columns of the first and of every later row in SQL (``s``: before, ``b``: this row)."""
    kinds = dict(x.split() for x in outputs.split(", "))
    shown = {n: rounded(n) if k == "double" else n for n, k in kinds.items()}

    def run(spark: SparkSession, folder: str) -> DataFrame:
        bars = with_stages(daily_bars(spark, folder) if daily else event_bars(spark, folder), stages)
        found = scan(bars, list(inputs), outputs, how) if isinstance(how, Recursion) else with_stages(bars, how)
        return found.select("symbol", "ts", *(F.expr(e).alias(n) for n, e in shown.items()))

    rows = f"SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS i FROM ({staged_sql(DAILY_BARS_SQL if daily else EVENT_BARS_SQL, stages)}) AS x"
    begin, go = (", ".join(f"{e} AS {n}" for n, e in x.items()) for x in (first, then))
    last = ", ".join(f"{rounded(f'({out[n]})') if k == 'double' else f'CAST({out[n]} AS INTEGER)'} AS {n}" for n, k in kinds.items())
    QUERIES[name] = run
    ORACLES[name] = f"WITH RECURSIVE r AS MATERIALIZED ({rows}), w AS (SELECT symbol, ts, i, {begin} FROM r AS b WHERE i = 1 UNION ALL SELECT b.symbol, b.ts, b.i, {go} FROM w AS s JOIN r AS b ON b.symbol = s.symbol AND b.i = s.i + 1) SELECT symbol, ts, {last} FROM w"


def _ewm(alpha: str, x: str, y: str) -> str:
    return f"s.{y} + {alpha} * ({x} - s.{y})"


def _seed(n: int, x: str, y: str, k: str) -> str:
    """Wilder's mean at the k-th value."""
    return f"CASE WHEN {k} <= {n} THEN s.{y} + ({x}) / {n} ELSE (s.{y} * {n - 1} + ({x})) / {n} END"


D13 = "CAST(2 AS DOUBLE) / 13"
recursion("r01_ewm", [], ["close"], "y double", fading({"y": ema("close", 12)}), {"y": "b.close"}, {"y": _ewm(D13, "b.close", "y")}, {"y": "y"})
_UP, _DOWN, _A = "greatest(b.d, 0)", "greatest(-b.d, 0)", "CAST(1 AS DOUBLE) / 14"
_ZERO = "CAST(0 AS DOUBLE)"
recursion(
    "r02_rsi", [CHANGE], ["d"], "rsi double", [*fading({"g": wilder(GAIN, 14, 14), "l": wilder(LOSS, 14, 14)}), {"rsi": relative_strength("g", "l")}], {"g": _ZERO, "l": _ZERO},
    {"g": f"CASE WHEN b.i = 2 THEN {_UP} ELSE {_ewm(_A, _UP, 'g')} END", "l": f"CASE WHEN b.i = 2 THEN {_DOWN} ELSE {_ewm(_A, _DOWN, 'l')} END"},
    {"rsi": "CASE WHEN i <= 14 THEN NULL WHEN l = 0 THEN 100 ELSE 100 - 100 / (1 + g / l) END"},
)
recursion("r03_rsi_seeded", [CHANGE], ["d"], "rsi double", [*fading({"g": seeded(GAIN, 14), "l": seeded(LOSS, 14)}), {"rsi": relative_strength("g", "l")}], {"g": _ZERO, "l": _ZERO}, {"g": _seed(14, _UP, "g", "b.i - 1"), "l": _seed(14, _DOWN, "l", "b.i - 1")}, {"rsi": "CASE WHEN i <= 14 THEN NULL WHEN l = 0 THEN 100 ELSE 100 - 100 / (1 + g / l) END"})
recursion("r04_atr_wilder", [TR], ["tr"], "atr double", fading({"atr": wilder("tr", 14, 14)}), {"y": "b.tr"}, {"y": _ewm(_A, "b.tr", "y")}, {"atr": "CASE WHEN i >= 14 THEN y END"})
recursion("r05_atr_from_start", [TR], ["tr"], "atr double", fading({"atr": wilder("tr", 14)}), {"y": "b.tr"}, {"y": _ewm(_A, "b.tr", "y")}, {"atr": "y"})
recursion("r06_atr_seeded", [TR], ["tr"], "atr double", fading({"atr": seeded("tr", 14)}), {"y": "b.tr / 14"}, {"y": _seed(14, "b.tr", "y", "b.i")}, {"atr": "CASE WHEN i >= 14 THEN y END"})
recursion("r07_wilder_mean", [], ["volume"], "y double", fading({"y": seeded("volume", 10)}), {"y": "b.volume / 10"}, {"y": _seed(10, "b.volume", "y", "b.i")}, {"y": "CASE WHEN i >= 10 THEN y END"})
_MOVES = {"up": f"coalesce(high - {lag('high')}, 0)", "dn": f"coalesce({lag('low')} - low, 0)"}
_DM = {"pdm": "CASE WHEN up > dn AND up > 0 THEN up ELSE CAST(0 AS DOUBLE) END", "mdm": "CASE WHEN dn > up AND dn > 0 THEN dn ELSE CAST(0 AS DOUBLE) END"}
_R, _P, _M = (_seed(14, f"b.{x}", y, "b.i") for x, y in (("tr", "r"), ("pdm", "p"), ("mdm", "m")))
_DX = f"coalesce(100 * abs(({_P}) - ({_M})) / nullif(({_P}) + ({_M}), 0), 0)"
recursion(
    "r08_directional_index", [{**TR, **_MOVES}, _DM], ["tr", "pdm", "mdm"], "adx double, pdi double, mdi double", directional_index(14),
    {"r": "b.tr / 14", "p": "b.pdm / 14", "m": "b.mdm / 14", "x": _ZERO}, {"r": _R, "p": _P, "m": _M, "x": f"CASE WHEN b.i <= 14 THEN {_DX} ELSE (s.x * 13 + {_DX}) / 14 END"},
    {"adx": "CASE WHEN i >= 14 THEN x END", "pdi": "CASE WHEN i >= 14 THEN 100 * p / r END", "mdi": "CASE WHEN i >= 14 THEN 100 * m / r END"},
)
_F, _S = (_ewm(f"CAST(2 AS DOUBLE) / {n}", "b.close", y) for n, y in ((13, "f"), (27, "w")))
recursion(
    "r09_macd_position", [CHANGE], ["close", "d"], "side int",
    [*fading({"f": ema("close", 12), "w": ema("close", 26), "g": wilder(GAIN, 14), "l": wilder(LOSS, 14)}), {"m": "f - w"}, *fading({"c": ema("m", 9)}), {"side": "CASE WHEN m > c AND g > l THEN 1 WHEN m < c AND g < l THEN -1 ELSE 0 END"}],
    {"f": "b.close", "w": "b.close", "g": _ZERO, "l": _ZERO, "c": _ZERO},
    {"f": _F, "w": _S, "g": f"CASE WHEN b.i = 2 THEN {_UP} ELSE {_ewm(_A, _UP, 'g')} END", "l": f"CASE WHEN b.i = 2 THEN {_DOWN} ELSE {_ewm(_A, _DOWN, 'l')} END", "c": f"s.c + CAST(2 AS DOUBLE) / 10 * (({_F}) - ({_S}) - s.c)"},
    {"side": "CASE WHEN f - w > c AND g > l THEN 1 WHEN f - w < c AND g < l THEN -1 ELSE 0 END"},
)
_ER = ({"step": f"abs(close - {lag('close')})", "move": f"abs(close - {lag('close', 10)})"}, {"er": f"move / nullif({rolling('sum', 'step', 10)}, 0)"})
_SC = "pow(coalesce(b.er, 0) * (CAST(2 AS DOUBLE) / 3 - CAST(2 AS DOUBLE) / 31) + CAST(2 AS DOUBLE) / 31, 2)"
recursion("r10_adaptive_mean", _ER, ["close", "er"], "y double", adaptive(), {"y": "CASE WHEN b.er IS NOT NULL THEN b.close END"}, {"y": f"CASE WHEN s.y IS NULL THEN CASE WHEN b.er IS NOT NULL THEN b.close END ELSE s.y + {_SC} * (b.close - s.y) END"}, {"y": "y"})
_ATR3 = ({"tr3": "high - low"}, {"atr": "avg(tr3) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)"})
_U, _L = "(b.high + b.low) / 2 + 3 * b.atr", "(b.high + b.low) / 2 - 3 * b.atr"
recursion(
    "r11_supertrend", _ATR3, ["high", "low", "close", "atr"], "side int", trend_bands(3.0), {"u": _U, "l": _L, "c": "b.close", "d": "1"},
    {"u": f"CASE WHEN s.c <= s.u THEN least({_U}, s.u) ELSE {_U} END", "l": f"CASE WHEN s.c >= s.l THEN greatest({_L}, s.l) ELSE {_L} END", "c": "b.close", "d": "CASE WHEN b.close > s.u THEN 1 WHEN b.close < s.l THEN -1 ELSE s.d END"},
    {"side": "d"},
)
_V = "(s.v + s.a * (s.e - s.v))"
_CROSS = f"(CASE WHEN s.d > 0 THEN b.low < {_V} ELSE b.high > {_V} END)"
_NEW = "(CASE WHEN s.d > 0 THEN b.high > s.e ELSE b.low < s.e END)"
recursion(
    "r12_parabolic", [], ["high", "low"], "side int, level double", parabolic(), {"v": "b.low", "e": "b.high", "a": "CAST(0.02 AS DOUBLE)", "d": "1"},
    {"v": f"CASE WHEN {_CROSS} THEN s.e ELSE {_V} END", "e": f"CASE WHEN {_CROSS} THEN CASE WHEN s.d > 0 THEN b.low ELSE b.high END WHEN {_NEW} THEN CASE WHEN s.d > 0 THEN b.high ELSE b.low END ELSE s.e END",
     "a": f"CASE WHEN {_CROSS} THEN CAST(0.02 AS DOUBLE) WHEN {_NEW} THEN least(s.a + CAST(0.02 AS DOUBLE), CAST(0.2 AS DOUBLE)) ELSE s.a END", "d": f"CASE WHEN {_CROSS} THEN -s.d ELSE s.d END"},
    {"side": "d", "level": "v"},
)
_HA = "(b.open + b.high + b.low + b.close) / 4"
recursion("r13_heikin_ashi", [], ["open", "high", "low", "close"], "ha_open double, ha_close double", [{"ha_close": "(open + high + low + close) / 4"}, {"ha_x": f"coalesce({lag('ha_close')}, (open + close) / 2)"}, *fading({"ha_open": ("ha_x", 0.5)})], {"o": "(b.open + b.close) / 2", "c": _HA}, {"o": "(s.o + s.c) / 2", "c": _HA}, {"ha_open": "o", "ha_close": "c"})

# --- labels and walks
_ENTRY = {"entry": f"coalesce(close > max(high) {prior(10)}, false)", "leave": f"coalesce(close < min(low) {prior(5)}, false)"}
_WALK = ({**TR, **_ENTRY}, {"atr14": rolling("avg", "tr", 14)}, {"en": lag("entry"), "ex": lag("leave"), "a": lag("atr14", 2)})


def walk(name: str, stages: Sequence[Stage], width: float, most: int, daily: bool = False) -> None:
    """Register the long walk on ``en`` and ``ex`` (in and out at this open) and ``a`` (the range that sets the risk)."""
    out = f"(s.p IS NOT NULL AND (coalesce(b.ex, false) OR b.i - 1 - s.p >= {most}))"
    into = f"((s.p IS NULL OR {out}) AND coalesce(b.en, false) AND coalesce(b.a, 0) > 0)"
    price, risk = f"(CASE WHEN {into} THEN b.open ELSE s.q END)", f"(CASE WHEN {into} THEN {width} * b.a ELSE s.k END)"
    stop = f"(({into} OR (s.p IS NOT NULL AND NOT {out})) AND b.low <= {price} - {risk})"
    recursion(
        name, stages, ["open", "low", "en", "ex", "a"], "at_open double, in_bar double", rule_walk(width, most), {"p": "CAST(NULL AS BIGINT)", "q": _ZERO, "k": _ZERO, "x": "CAST(NULL AS DOUBLE)", "y": "CAST(NULL AS DOUBLE)"},
        {"p": f"CASE WHEN {stop} THEN NULL WHEN {into} THEN b.i WHEN {out} THEN NULL ELSE s.p END", "q": price, "k": risk, "x": f"CASE WHEN {out} THEN (b.open - s.q) / s.k END", "y": f"CASE WHEN {stop} THEN (least(b.open, {price} - {risk}) - {price}) / {risk} END"},
        {"at_open": "x", "in_bar": "y"}, daily,
    )


walk("x03_rule_walk", _WALK, 2.5, 30)
#: In after a close low in the day's range, out after one high in it, decided at the next open.
_REVERSAL = ({**TR, "ibs": "(close - low) / nullif(high - low, 0)"}, *fading({"atr_w": wilder("tr", 14)}), {"en": f"coalesce({lag('ibs')} < 0.2, false)", "ex": f"coalesce({lag('ibs')} > 0.8, false)", "a": lag("atr_w", 2)})
walk("g33_reversal_walk", _REVERSAL, 2.5, 30, daily=True)
_LITERAL = (*_REVERSAL, {"after": lead("open")})
_IN = "(s.p IS NOT NULL)"
_STOPPED, _LEFT = f"({_IN} AND b.low <= s.q - s.k)", f"({_IN} AND (b.low <= s.q - s.k OR coalesce(b.ibs > 0.8, false) OR b.i - s.p >= 30))"
_INTO = f"(({_IN} IS FALSE OR {_LEFT}) AND coalesce(b.en, false) AND coalesce(b.a, 0) > 0)"
_ATONCE = f"({_INTO} AND b.low <= b.open - 2.5 * b.a)"
recursion(
    "g33_reversal_literal", _LITERAL, ["open", "low", "close", "ibs", "en", "a", "after"], "closed double, same_bar double", reversal_literal(), {"p": "CAST(NULL AS BIGINT)", "q": _ZERO, "k": _ZERO, "x": "CAST(NULL AS DOUBLE)", "y": "CAST(NULL AS DOUBLE)"},
    {"p": f"CASE WHEN {_ATONCE} THEN NULL WHEN {_INTO} THEN b.i WHEN {_LEFT} THEN NULL ELSE s.p END", "q": f"CASE WHEN {_INTO} THEN b.open ELSE s.q END", "k": f"CASE WHEN {_INTO} THEN 2.5 * b.a ELSE s.k END",
     "x": f"CASE WHEN {_STOPPED} THEN (least(b.open, s.q - s.k) - s.q) / s.k WHEN {_LEFT} THEN (coalesce(b.after, b.close) - s.q) / s.k END", "y": f"CASE WHEN {_ATONCE} THEN CAST(-1 AS DOUBLE) END"},
    {"closed": "x", "same_bar": "y"}, daily=True,
)
walk("x02_daily_walk", ({**TR, "low5": f"min(low) {prior(5)}", "top": f"max(close) {prior(5)}"}, *fading({"atr_w": wilder("tr", 10)}), {"en": lag("coalesce(close < low5, false)"), "ex": lag("coalesce(close > top, false)"), "a": lag("atr_w", 2)}), 3.0, 20, daily=True)


@query("x03_rule_walk_sides")
def rule_walk_of_both_sides(spark: SparkSession, folder: str) -> DataFrame:
    """The walk long and short, with a target of three ranges and a cost of 0.01; the short side enters and leaves where prices break the other way."""
    down = {"en": "lag(coalesce(close < min(low) {p10}, false)) {w}", "ex": "lag(coalesce(close > max(high) {p5}, false)) {w}"}
    down = {k: v.format(p10=prior(10), p5=prior(5), w="OVER (PARTITION BY symbol ORDER BY ts)") for k, v in down.items()}
    bars, found = with_stages(event_bars(spark, folder), _WALK), []
    for side, rows in ((1, bars), (-1, bars.withColumns({k: F.expr(v) for k, v in down.items()}))):
        walked = scan(rows, ["open", "high", "low", "en", "ex", "a"], "at_open double, in_bar double", rule_walk_sides(2.5, 30, side, 3.0, 0.01))
        found.append(walked.select("symbol", "ts", F.lit(side).alias("side"), *(F.expr(rounded(n)).alias(n) for n in ("at_open", "in_bar"))))
    return found[0].unionByName(found[1])


_RISK = ({"tr": true_range()}, {"r": f"1.5 * ({rolling('avg', 'tr', 14)})"})


def ahead(n: int, duck: bool) -> Stage:
    """The next n bars as one array."""
    return {"f": f"{'list' if duck else 'collect_list'}({'{' + chr(39) + 'o' + chr(39) + ': open, ' + chr(39) + 'h' + chr(39) + ': high, ' + chr(39) + 'l' + chr(39) + ': low, ' + chr(39) + 'c' + chr(39) + ': close}' if duck else 'struct(open AS o, high AS h, low AS l, close AS c)'}) {following(n)}", "later": lead("open", n + 1)}


_TOUCH = ({k: f"coalesce(array_position(transform(f, x -> {c}), true), 0)" for k, c in (("tp_at", "x.h >= close + 2 * r"), ("sl_at", "x.l <= close - r"))}, {k: f"coalesce(list_position(list_transform(f, lambda x: {c}), true), 0)" for k, c in (("tp_at", "x.h >= close + 2 * r"), ("sl_at", "x.l <= close - r"))})
_LABEL = "CASE WHEN r IS NULL OR r <= 0 THEN NULL WHEN sl_at > 0 AND (tp_at = 0 OR sl_at <= tp_at) THEN 'sl' WHEN tp_at > 0 THEN 'tp' WHEN {size}(f) = 12 THEN 'timeout' END"
_REALIZED = "CASE label WHEN 'tp' THEN CAST(2 AS DOUBLE) WHEN 'sl' THEN CAST(-1 AS DOUBLE) WHEN 'timeout' THEN ({last}.c - close) / r END"
_BARS = "CASE label WHEN 'tp' THEN tp_at WHEN 'sl' THEN sl_at WHEN 'timeout' THEN 12 END"
series(
    "b01_triple_barrier", {"label": "label", "n_bars": "CAST(n_bars AS BIGINT)", "realized": rounded("realized")}, *_RISK, ahead(12, False), _TOUCH[0], {"label": _LABEL.format(size="size")}, {"n_bars": _BARS, "realized": _REALIZED.format(last="get(f, 11)")},
    duck=(*_RISK, ahead(12, True), _TOUCH[1], {"label": _LABEL.format(size="len")}, {"n_bars": _BARS, "realized": _REALIZED.format(last="f[12]")}),
)
_EXIT = "CASE WHEN x.o <= entry - r THEN x.o WHEN x.l <= entry - r THEN entry - r WHEN x.o >= entry + 2 * r THEN x.o WHEN x.h >= entry + 2 * r THEN entry + 2 * r END"
series(
    "b05_trade_result", ["result"], *_RISK, {**ahead(6, False), "entry": lead("open")}, {"px": f"coalesce(get(filter(transform(f, x -> {_EXIT}), p -> p IS NOT NULL), 0), later)"}, {"result": "CASE WHEN r > 0 THEN (px - entry) / r END"},
    duck=(*_RISK, {**ahead(6, True), "entry": lead("open")}, {"px": f"coalesce(list_filter(list_transform(f, lambda x: {_EXIT}), lambda p: p IS NOT NULL)[1], later)"}, {"result": "CASE WHEN r > 0 THEN (px - entry) / r END"}),
)
