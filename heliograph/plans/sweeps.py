"""Grids of rules and brackets, trailing stops, matched chance, and walks whose length varies."""

from __future__ import annotations

from heliograph.functions.linear import fading, wilder
from heliograph.functions.series import lag, prior, true_range
from heliograph.operators.staged import staged_sql
from heliograph.plans.registry import NUMBER, rounded, series, table_query
from heliograph.plans.statistics import _MID, _PNL
from heliograph.plans.trades import BARS, BOTH, OPENING, Arrays, level_trades, range_trades, resolved

#: Rules by bar: 1, -1 or 0, decided at the close before the entry.
RULES = {"break": ("close > hi", "close < lo"), "fade": ("close < lo", "close > hi"), "body": ("close > open", "close < open")}
_BASE = ({"tr": f"coalesce({true_range()}, high - low)", "hi": f"max(high) {prior(12)}", "lo": f"min(low) {prior(12)}", "n": "row_number() OVER (PARTITION BY symbol ORDER BY ts)"}, *fading({"atr": wilder("tr", 14, 14)}), {"unit": lag("atr"), "cost": "CAST(0.02 AS DOUBLE)", "entry": "open"} | {f"r_{k}": lag(f"CASE WHEN {u} THEN 1 WHEN {d} THEN -1 ELSE 0 END") for k, (u, d) in RULES.items()})


def grid(a: Arrays, brackets: str, rules: list[str], bars: int = 8, turned: int = 1) -> str:
    """All trades of all rules and brackets (stop and target in ranges). ``turned``: -1 takes the other side."""
    base = staged_sql(f"SELECT * FROM {BARS} AS s", [*_BASE, {"rest": a.ahead(bars)}])
    many = " UNION ALL ".join(f"SELECT symbol, ts, n, '{r}' AS rule, {turned} * r_{r} AS side, entry, unit, cost, rest FROM ({base}) AS b WHERE unit > 0 AND r_{r} <> 0" for r in rules)
    placed = staged_sql(f"SELECT m.*, v.sl, v.tp FROM ({many}) AS m CROSS JOIN (VALUES {brackets}) AS v(sl, tp)", [{"risk": "CAST(sl AS DOUBLE) * unit"}, {"stop": "entry - side * risk", "take": "entry + side * CAST(tp AS DOUBLE) * unit"}])
    return resolved(a, placed, gaps=True)


_STATS = f"count(*) AS n, {rounded('avg(r)')} AS er, round(avg(r) / nullif(stddev_samp(r), 0) * sqrt(count(*)), 5) + 0.0 AS t, round(avg(CASE WHEN r > 0 THEN 1 ELSE 0 END), 6) AS win"
_FOUR = "(1.0, 1.5), (1.0, 2.0), (1.5, 2.0), (2.0, 3.0)"
table_query("y02_rule_bracket_sweep", *(f"SELECT rule, CAST(sl AS DOUBLE) AS sl, CAST(tp AS DOUBLE) AS tp, {_STATS} FROM ({grid(a, _FOUR, list(RULES))}) AS g GROUP BY rule, sl, tp" for a in BOTH), ["bars"])
table_query("y15_asymmetric_brackets", *(f"SELECT CAST(sl AS DOUBLE) AS sl, CAST(tp AS DOUBLE) AS tp, side, {_STATS} FROM ({grid(a, '(0.5, 3.0), (3.0, 0.5), (1.0, 1.0)', ['break'])}) AS g GROUP BY sl, tp, side" for a in BOTH), ["bars"])
table_query("y10_symbol_bracket_grid", *(f"SELECT symbol, rule, CAST(sl AS DOUBLE) AS sl, {_STATS} FROM ({grid(a, '(1.0, 2.0), (2.0, 4.0)', ['break', 'body'])}) AS g GROUP BY symbol, rule, sl" for a in BOTH), ["bars"])
table_query("x16_stop_geometries", *(f"SELECT CAST(sl AS DOUBLE) AS sl, round(avg(CASE WHEN reason = 'stop' THEN 1 ELSE 0 END), 6) AS stop_rate, {_STATS} FROM ({grid(a, '(1.0, 99.0), (1.5, 99.0), (2.0, 99.0), (3.0, 99.0), (4.0, 99.0)', ['break'])}) AS g GROUP BY sl" for a in BOTH), ["bars"])
table_query("x17_candidate_trades", *(f"SELECT symbol, ts, side, reason, {rounded('r')} AS r FROM ({grid(a, '(2.0, 3.0)', ['fade'])}) AS g" for a in BOTH), ["bars"])
table_query("u13_trades_of_bars", *(f"SELECT symbol, CAST(ts AS DATE) AS day, count(*) AS n, {rounded('sum(r)')} AS r FROM ({grid(a, '(1.0, 2.0)', ['body'])}) AS g GROUP BY symbol, CAST(ts AS DATE)" for a in BOTH), ["bars"])

# --- trailing stops of a trade that begins at every bar
_TRAIL = ({"tr": f"coalesce({true_range()}, high - low)"}, *fading({"atr": wilder("tr", 14, 14)}), {"unit": lag("atr")})


def trailing(a: Arrays, arm: float | None, width: float = 2.0, bars: int = 10) -> str:
    """Out where the low falls to the highest high so far less ``width`` ranges; ``arm``: only once the trade was ahead by so many ranges, with a fixed stop until then."""
    top = f"greatest(open, coalesce({a.high(a.head('rest', 'x.i - 1'))}, open))"
    level = f"{top} - {width} * unit" if arm is None else f"CASE WHEN {top} >= open + {arm} * unit THEN {top} - {width} * unit ELSE open - {width} * unit END"
    numbered = "list_transform(rest, lambda x, i: {'i': i, 'o': x.o, 'l': x.l, 'c': x.c, 'h': x.h})" if a.duck else "transform(rest, (x, i) -> struct(i + 1 AS i, x.o AS o, x.l AS l, x.c AS c, x.h AS h))"
    level_at = a.each("bars_n", "x", f"CASE WHEN x.l <= {level} THEN least({level}, x.o) END")
    rows = staged_sql(f"SELECT * FROM {BARS} AS s", [*_TRAIL, {"rest": a.ahead(bars)}, {"bars_n": numbered}, {"outs": level_at}, {"k": a.place("outs", "p", "p IS NOT NULL")}, {"leave": f"CASE WHEN k > 0 THEN {a.at('outs', 'k')} ELSE {a.at('rest', a.size('rest'))}.c END"}])
    return f"SELECT symbol, ts, CAST(k AS INT) AS held, round((leave - open) / ({width} * unit), 6) + 0.0 AS r FROM ({rows}) AS t WHERE unit > 0"


table_query("r15_trailing_stop", *(trailing(a, None) for a in BOTH), ["bars"])
table_query("r16_delayed_trailing_stop", *(trailing(a, 1.0) for a in BOTH), ["bars"])

# --- exits chosen on the first half, judged on the second
_WIDTHS = (1.0, 1.5, 2.0, 3.0)
_EXITS = tuple(" UNION ALL ".join(f"SELECT CAST({w} AS DOUBLE) AS width, symbol, day, r FROM ({range_trades(a, BARS, 2, w)}) AS t" for w in _WIDTHS) for a in BOTH)
table_query("y17_exit_sweep", *(f"SELECT width, {_STATS} FROM ({e}) AS e GROUP BY width" for e in _EXITS), ["bars"])
table_query("m08_target_chosen_on_train", *(f"WITH e AS ({e}), b AS (SELECT symbol, max_by(width, er * 1000 - width) AS width FROM (SELECT symbol, width, avg(r) AS er FROM e WHERE day < DATE '2024-01-16' GROUP BY symbol, width) AS t GROUP BY symbol) SELECT e.symbol AS symbol, e.width AS width, {_STATS} FROM e JOIN b ON e.symbol = b.symbol AND e.width = b.width WHERE day >= DATE '2024-01-16' GROUP BY e.symbol, e.width" for e in _EXITS), ["bars"])
table_query("y01_open_band_breakout", *(f"SELECT symbol, day, CAST(side AS INT) AS side, reason, {rounded('r')} AS r FROM ({level_trades(a, BARS, BARS, 0.35, 0.35, 3.0, False)}) AS t" for a in BOTH), ["bars"])

# --- grids of signal statistics
_K = (1, 3, 12)
_SIG = {"reversal": "-(close - open)", "drift": "close - lag(close, 5) OVER (PARTITION BY symbol ORDER BY ts)", "range": "(close - low) / nullif(high - low, 0) - 0.5"}
PLACEBOS, PER_BLOCK, LEAST_PAIRS, LEAST_BLOCKS = 5, 20, 15, 8


def ic_rows(duck: bool) -> str:
    """Block ICs by signal, horizon, symbol and turn; turn -1 is the real future, the others the future rotated by a random part of the series.

    Futures are in units of the bar's volatility over the root of the horizon.
    Ranks are taken over the whole series, so a block's IC is a slice of the mean
    product of ranks, and blocks of the total are not centred on themselves.
    """
    number = NUMBER[duck].format(f"concat(symbol, ':', CAST(k AS {'VARCHAR' if duck else 'STRING'}), ':', CAST(turn AS {'VARCHAR' if duck else 'STRING'}))")
    base = f"SELECT symbol, ts, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS n, count(*) OVER (PARTITION BY symbol) AS m, stddev_pop(r) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS vol, {', '.join(f'lead(close, {k}) OVER (PARTITION BY symbol ORDER BY ts) / close - 1 AS f{k}' for k in _K)}, {', '.join(f'{e} AS s_{s}' for s, e in _SIG.items())} FROM (SELECT *, close / lag(close) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS r FROM {BARS} AS a) AS b"
    futures = " UNION ALL ".join(f"SELECT symbol, n, m, {k} AS k, f{k} / (nullif(vol, 0) * sqrt(CAST({k} AS DOUBLE))) AS f FROM base" for k in _K)
    signals = " UNION ALL ".join(f"SELECT symbol, n, '{s}' AS signal, s_{s} AS s FROM base" for s in _SIG)
    turns = "SELECT unnest(range(-1, {n})) AS turn" if duck else "SELECT explode(sequence(-1, {n} - 1)) AS turn"
    shifts = f"SELECT symbol, k, turn, m, CASE WHEN turn < 0 THEN 0 ELSE CAST(floor(m / 8) AS BIGINT) + {number} % greatest(CAST(floor(7 * m / 8) AS BIGINT) - CAST(floor(m / 8) AS BIGINT), 1) END AS shift FROM (SELECT symbol, k, max(m) AS m FROM futures GROUP BY symbol, k) AS g CROSS JOIN ({turns.format(n=PLACEBOS)}) AS t"
    rolled = "SELECT f.symbol, f.k, turn, (f.n + shift) % f.m AS n, f FROM futures AS f JOIN shifts AS h ON f.symbol = h.symbol AND f.k = h.k"
    pairs = "SELECT signal, k, r.symbol, turn, r.n, s, f FROM rolled AS r JOIN signals AS s ON r.symbol = s.symbol AND r.n = s.n WHERE s IS NOT NULL AND f IS NOT NULL"
    key = "signal, k, symbol, turn"
    ranked = f"SELECT {key}, n, {_MID.format(p=key, x='s')} AS rs, {_MID.format(p=key, x='f')} AS rf FROM pairs"
    scaled = f"SELECT {key}, n, (rs - avg(rs) OVER p) / nullif(stddev_pop(rs) OVER p, 0) * ((rf - avg(rf) OVER p) / nullif(stddev_pop(rf) OVER p, 0)) AS prod, count(*) OVER p AS n_pairs FROM ranked WINDOW p AS (PARTITION BY {key})"
    blocks = f"SELECT {key}, n_pairs, CAST(floor(n / {PER_BLOCK}) AS BIGINT) AS b, avg(prod) AS ic FROM scaled GROUP BY {key}, n_pairs, CAST(floor(n / {PER_BLOCK}) AS BIGINT) HAVING count(*) >= {LEAST_PAIRS}"
    dev = f"SELECT *, ic - avg(ic) OVER (PARTITION BY {key}) AS d FROM blocks"
    cells = f"SELECT {key}, max(n_pairs) AS n, count(*) AS n_blocks, avg(ic) AS ic, CASE WHEN sum(d * d) + sum(d * coalesce(d0, 0)) > 0 THEN avg(ic) / sqrt((sum(d * d) + sum(d * coalesce(d0, 0))) / count(*) / count(*)) END AS t FROM (SELECT *, lag(d) OVER (PARTITION BY {key} ORDER BY b) AS d0 FROM dev) AS x GROUP BY {key} HAVING count(*) >= {LEAST_BLOCKS}"
    return f"WITH base AS ({base}), futures AS ({futures}), signals AS ({signals}), shifts AS ({shifts}), rolled AS ({rolled}), pairs AS ({pairs}), ranked AS ({ranked}), scaled AS ({scaled}), blocks AS ({blocks}), dev AS ({dev}), cells AS ({cells}) "


#: Newey-West t at lag 1; beside each cell the mean absolute IC and t of its rotated futures.
table_query("i06_ic_grid", *(ic_rows(d) + "SELECT signal, k, symbol, max(CASE WHEN turn < 0 THEN n END) AS n, max(CASE WHEN turn < 0 THEN n_blocks END) AS n_blocks, round(max(CASE WHEN turn < 0 THEN ic END), 6) + 0.0 AS ic, round(max(CASE WHEN turn < 0 THEN t END), 5) + 0.0 AS t, round(avg(CASE WHEN turn >= 0 THEN abs(ic) END), 6) AS placebo_abs_ic, round(avg(CASE WHEN turn >= 0 THEN abs(t) END), 5) AS placebo_abs_t FROM cells GROUP BY signal, k, symbol HAVING count(CASE WHEN turn < 0 THEN 1 END) > 0" for d in (False, True)), ["bars"])
table_query("i07_rotated_placebo", *(ic_rows(d) + "SELECT signal, k, symbol, turn, round(ic, 6) + 0.0 AS ic, round(t, 5) + 0.0 AS t FROM cells WHERE turn >= 0" for d in (False, True)), ["bars"])
table_query("i19_rank_gain", *(f"SELECT symbol, round(covar_pop(ra, rb) / nullif(sqrt(var_pop(ra) * var_pop(rb)), 0), 6) + 0.0 AS rho, count(*) AS n FROM (SELECT symbol, {_MID.format(p='symbol', x='risk')} AS ra, {_MID.format(p='symbol', x='r')} AS rb FROM ({t}) AS t) AS x GROUP BY symbol" for t in OPENING), ["bars"])
table_query("i21_breadth_ratio", f"WITH p AS (SELECT symbol, ts, r FROM {_PNL} AS q WHERE r IS NOT NULL), c AS (SELECT a.symbol AS x, b.symbol AS y, corr(a.r, b.r) AS rho FROM p AS a JOIN p AS b ON a.ts = b.ts GROUP BY a.symbol, b.symbol HAVING count(*) > 30) SELECT CAST(ic AS DOUBLE) AS ic, round(CAST(ic AS DOUBLE) * sqrt(n_eff * 52), 6) AS ratio FROM (SELECT pow(count(DISTINCT x), 2) / sum(rho * rho) AS n_eff FROM c) AS e CROSS JOIN (VALUES (0.01), (0.02), (0.05)) AS v(ic)", None, ["days"])

# --- catalogues of rules
_RULES = {
    "a2": "close < c1 AND c1 < c2 AND c2 < c3", "a3": "open <= low5 AND close > open", "a4": "close > m200", "b1": "high < h1 AND low > l1", "b2": "dow = 0 AND close <= 0.99 * c1",
    "b3": "close > m200 AND close < m5 AND high < h1 AND h1 < h2 AND low < l1 AND l1 < l2", "b4": "close < low20", "b5": "close > m200 AND pb < 0.2", "b6": "close < e20 - 2 * atr20", "b7": "ibs < 0.2",
    "c1": "close > e9", "c2": "close > e20", "c3": "macd > sig", "c4": "m50 > m200", "c5": "close > m200", "c6": "close > m250", "c7": "close > high20", "c8": "pb > 1", "c9": "close > c12", "d1": "dom = n_days - 4", "d2": "dow = 4 AND day(ts) BETWEEN 15 AND 21",
}
_EXITS_OF = {"b1": "close > h1", "b3": "close > m5", "b4": "close > h1", "b5": "pb > 0.8", "b6": "close > e20", "b7": "ibs > 0.8", "c1": "close < e9", "c2": "close < e20", "c3": "macd < sig", "c4": "m50 < m200", "c5": "close < m200", "c6": "close < m250", "c8": "close < m20", "c9": "close < c12"}
_MEANS = {f"m{n}": f"CASE WHEN count(close) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) = {n} THEN avg(close) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) END" for n in (5, 20, 50, 200, 250)}
_PREP = [
    _MEANS | {f"{c}{k}": lag(n, k) for c, n, ks in (("c", "close", (1, 2, 3, 12)), ("h", "high", (1, 2)), ("l", "low", (1, 2))) for k in ks} | {"sd": "stddev_samp(close) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)", "low5": "min(low) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)", "low20": f"min(low) {prior(20)}", "high20": f"max(high) {prior(20)}", "tr": f"coalesce({true_range()}, high - low)", "ibs": "(close - low) / nullif(high - low, 0)", "dom": "row_number() OVER (PARTITION BY symbol, date_trunc('month', ts) ORDER BY ts)", "n_days": "count(*) OVER (PARTITION BY symbol, date_trunc('month', ts))"},
    *fading({"e9": ("close", 0.2), "e20": ("close", 2 / 21), "fast": ("close", 2 / 13), "slow": ("close", 2 / 27), "atr20": wilder("tr", 20)}), {"macd": "fast - slow", "pb": "(close - m20 + 2 * sd) / nullif(4 * sd, 0)"}, *fading({"sig": ("macd", 0.2)}),
]
series("g47_daily_rules", {f"in_{k}": f"CAST(CASE WHEN {v} THEN 1 ELSE 0 END AS INT)" for k, v in _RULES.items()} | {f"out_{k}": f"CAST(CASE WHEN {v} THEN 1 ELSE 0 END AS INT)" for k, v in _EXITS_OF.items()}, {"dow": "weekday(ts)"}, *_PREP, duck=({"dow": "isodow(ts) - 1"}, *_PREP), daily=True)
_D = "OVER (PARTITION BY symbol, day)"
_SO = "OVER (PARTITION BY symbol, day ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_LEVELS = [
    {"day": "CAST(ts AS DATE)", "tr": f"coalesce({true_range()}, high - low)"}, *fading({"atr": wilder("tr", 14, 14)}),
    {"pos": "row_number() OVER (PARTITION BY symbol, day ORDER BY ts) - 1", "dh": f"max(high) {_D}", "dl": f"min(low) {_D}", "dc": f"max_by(close, ts) {_D}", "so": f"min_by(open, ts) {_D}", "up1": f"min_by(CASE WHEN close > open THEN 1 ELSE 0 END, ts) {_D}", "pv": f"sum((high + low + close) / 3 * volume) {_SO}", "vv": f"sum(volume) {_SO}"},
    {f"q_{k}": f"CASE WHEN pos = 0 THEN {lag(k)} END" for k in ("dh", "dl", "dc")} | {f"{x}{k}": f"{how}(CASE WHEN pos < {k} THEN {c} END) {_D}" for k in (1, 3, 8) for x, how, c in (("orh", "max", "high"), ("orl", "min", "low"))},
    {k: f"max({j}) {_D}" for k, j in (("pdh", "q_dh"), ("pdl", "q_dl"), ("pdc", "q_dc"))} | {"vwap": "pv / nullif(vv, 0)", "rs": "(close - so) / nullif(atr, 0)"},
    {"dev": "(close - vwap) / nullif(atr, 0)", "gap": "(so - pdc) / nullif(abs(pdc), 0)", "p": "(pdh + pdl + pdc) / 3", "mr": "orh8 - orl8"},
]
_CATALOGUE = {f"orb_break_{k}": (f"pos >= {k} AND close > orh{k}", f"pos >= {k} AND close < orl{k}") for k in (1, 3)} | {f"orb_fade_{k}": (f"pos >= {k} AND close < orl{k}", f"pos >= {k} AND close > orh{k}") for k in (1, 3)} | {
    "level_break": ("close > pdh", "close < pdl"), "level_fade": ("close < pdl", "close > pdh"), "close_side": ("close > pdc", "close < pdc"), "gap_fade": ("abs(gap) > 0.1 AND gap > 0 AND pos > 0 AND close < so", "abs(gap) > 0.1 AND gap < 0 AND pos > 0 AND close > so"), "gap_follow": ("abs(gap) > 0.1 AND gap > 0 AND pos > 0 AND close > so", "abs(gap) > 0.1 AND gap < 0 AND pos > 0 AND close < so"),
    "vwap_side": ("pos > 2 AND close > vwap", "pos > 2 AND close < vwap"), "vwap_revert": ("pos > 2 AND dev < -1", "pos > 2 AND dev > 1"), "vwap_follow": ("pos > 2 AND dev > 1", "pos > 2 AND dev < -1"), "midday_levels": ("pos >= 8 AND close <= orl8 + 0.25 * mr", "pos >= 8 AND close >= orh8 - 0.25 * mr"), "midday_break": ("pos >= 8 AND close > orh8", "pos >= 8 AND close < orl8"),
    "drift_follow": ("pos > 2 AND rs > 0.5", "pos > 2 AND rs < -0.5"), "drift_fade": ("pos > 2 AND rs < -0.5", "pos > 2 AND rs > 0.5"), "first_follow": ("pos = 1 AND up1 = 1", "pos = 1 AND up1 = 0"), "first_fade": ("pos = 1 AND up1 = 0", "pos = 1 AND up1 = 1"), "pivot_side": ("close > p", "close < p"), "pivot_break": ("close > 2 * p - pdl", "close < 2 * p - pdh"), "pivot_fade": ("close < 2 * p - pdh", "close > 2 * p - pdl"),
}
series("g42_session_rules", {k: f"CAST(CASE WHEN {u} THEN 1 WHEN {d} THEN -1 ELSE 0 END AS INT)" for k, (u, d) in _CATALOGUE.items()}, *_LEVELS, where="hour(ts) BETWEEN 0 AND 23")
SESSIONS, LEAST_SESSIONS, COIL, ER_ROWS, ER_LEAST = 60, 5, 0.5, 100, 0.3


def coiled(duck: bool) -> list[dict[str, str]]:
    """The day's first close beyond its opening range, if that range, in ranges of a bar, ranks low among the last sessions' and the way to that bar was straight."""
    lst, size = ("list", "len") if duck else ("collect_list", "size")
    only = (lambda l, e: f"len(list_filter({l}, lambda v: {e}))") if duck else (lambda l, e: f"size(filter({l}, v -> {e}))")
    last = f"ws[-{SESSIONS}:]" if duck else f"slice(ws, greatest(size(ws) - {SESSIONS - 1}, 1), {SESSIONS})"
    values = f"{lst}(w) {'FILTER (w IS NOT NULL) ' if duck else ''}OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {24 * 100 - 1} PRECEDING AND CURRENT ROW)"
    rank = lambda l, x: f"({only(l, f'v < {x}')} + ({only(l, f'v = {x}')} + 1) / CAST(2 AS DOUBLE)) / {size}({l})"
    return [
        *_LEVELS[:-2], {"w": "CASE WHEN pos = 3 THEN (orh3 - orl3) / nullif(atr, 0) END", "way": f"abs(close - {lag('close')})", "net": f"abs(close - {lag('close', 10)})"},
        {"ws": f"CASE WHEN w IS NOT NULL THEN {values} END", "er": f"net / nullif(sum(way) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 0)"},
        {"l60": last, "ers": f"{lst}(er) {'FILTER (er IS NOT NULL) ' if duck else ''}OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {ER_ROWS - 1} PRECEDING AND CURRENT ROW)"},
        {"own_rank": f"CASE WHEN w IS NOT NULL AND {size}(l60) >= {LEAST_SESSIONS} THEN {rank('l60', 'w')} END", "er_rank": f"CASE WHEN er IS NOT NULL THEN {rank('ers', 'er')} END"},
        {"rank_of": f"max(own_rank) {_D}"}, {"s": f"CASE WHEN pos >= 3 AND rank_of <= {COIL} AND er_rank >= {ER_LEAST} AND close > orh3 THEN 1 WHEN pos >= 3 AND rank_of <= {COIL} AND er_rank >= {ER_LEAST} AND close < orl3 THEN -1 ELSE 0 END"}, {"first": f"min(CASE WHEN s <> 0 THEN pos END) {_D}"},
    ]


series("g43_coiled_range_breakout", {"signal": "CAST(CASE WHEN pos = first THEN s ELSE 0 END AS INT)"}, *coiled(False), duck=coiled(True))
