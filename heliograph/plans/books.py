"""Net books, replication over symbols, yearly figures, anchor errors, fold bounds, and settings kept as maps."""

from __future__ import annotations

from heliograph.functions.linear import fading, wilder
from heliograph.functions.series import lead, prior, true_range
from heliograph.operators.staged import staged_sql
from heliograph.plans.registry import rounded, table_query
from heliograph.plans.statistics import _CANDIDATES, _OUT, _PNL, _UNITS, COMMISSION, RT_BPS
from heliograph.plans.sweeps import RULES, grid
from heliograph.plans.trades import BOTH, month_turn_trades

#: Spreads are paid so many times over; nights cost so many times their price.
SPREADS, SWAPS = (0, 1, 2, 3), (0, 1, 2)
_ROWS = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"


def net_days(units: str, out: str) -> str:
    """Results in units of risk by symbol and exit day, in parts: before costs, the spread's cost, the nights' and the commission."""
    priced = f"SELECT symbol, {out} AS day, gross, ({units}) AS nights, entry / stop AS px, side FROM ({_CANDIDATES}) AS t WHERE stop > 0"
    return f"SELECT symbol, day, sum(gross) AS gross, sum({RT_BPS!r} / 10000 * px) AS spread, sum(nights * (CASE WHEN side > 0 THEN CAST(6.5 AS DOUBLE) ELSE CAST(3.5 AS DOUBLE) END / 100 / 360) * px) AS swap, sum(2 * CAST({COMMISSION:.5f} AS DOUBLE) * px) AS commission FROM ({priced}) AS p GROUP BY symbol, day"


NET_DAYS = tuple(net_days(u, o) for u, o in zip(_UNITS, _OUT, strict=True))
table_query("f14_net_series", *(f"SELECT symbol, CAST(mult AS INT) AS mult, day, round(gross - mult * spread - swap - commission, 6) + 0.0 AS net FROM ({d}) AS n CROSS JOIN (VALUES {', '.join(f'({m})' for m in SPREADS)}) AS v(mult)" for d in NET_DAYS), ["lineitem"])


def swap_test(days: str) -> str:
    """The book of all symbols, without each symbol, and with it at each price of nights."""
    own = f"SELECT symbol, day, gross - spread - commission AS r, swap FROM ({days}) AS n"
    books = f"SELECT c.symbol AS candidate, -1 AS mult, n.day AS day, n.r - n.swap AS r FROM ({own}) AS n CROSS JOIN (SELECT DISTINCT symbol FROM ({own}) AS s) AS c WHERE n.symbol <> c.symbol UNION ALL SELECT c.symbol, mult, n.day, n.r - CASE WHEN n.symbol = c.symbol THEN mult * n.swap ELSE n.swap END FROM ({own}) AS n CROSS JOIN (SELECT DISTINCT symbol FROM ({own}) AS s) AS c CROSS JOIN (VALUES {', '.join(f'({m})' for m in SWAPS)}) AS v(mult)"
    daily = f"SELECT candidate, mult, day, sum(r) AS r FROM ({books}) AS b GROUP BY candidate, mult, day"
    falls = f"SELECT *, max(cum) OVER (PARTITION BY candidate, mult ORDER BY day {_ROWS}) - cum AS fall FROM (SELECT *, sum(r) OVER (PARTITION BY candidate, mult ORDER BY day {_ROWS}) AS cum FROM ({daily}) AS d) AS e"
    return f"SELECT candidate, CAST(mult AS INT) AS mult, round(sum(r), 4) + 0.0 AS total, round(max(fall), 4) + 0.0 AS max_dd, round(avg(r) / nullif(stddev_samp(r), 0) * sqrt(CAST(252 AS DOUBLE)), 5) + 0.0 AS sharpe FROM ({falls}) AS f GROUP BY candidate, mult"


table_query("f15_swap_test", *(swap_test(d) for d in NET_DAYS), ["lineitem"])

_BOOK = f"SELECT CAST(ts AS DATE) AS day, sum(coalesce(r, 0)) / 6 AS r FROM {_PNL} AS p GROUP BY CAST(ts AS DATE)"
_LOW = "SELECT min(s) AS low FROM (SELECT sum(r) AS s FROM ({b}) AS b GROUP BY date_trunc('{u}', day)) AS w"
table_query("a23_book_stats", f"SELECT count(*) AS days, {rounded('sum(r)', 5)} AS total, {rounded('avg(r) / nullif(stddev_samp(r), 0) * sqrt(CAST(252 AS DOUBLE))', 5)} AS sharpe, {rounded('max(dd)', 5)} AS max_dd, round(avg(CASE WHEN r > 0 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END), 6) AS up_days, {rounded('avg(CASE WHEN r <> 0 THEN r END)', 8)} AS active_day, {rounded('min(r)')} AS worst_day, {rounded('min(wk.low)')} AS worst_week, {rounded('min(mo.low)')} AS worst_month FROM (SELECT r, max(cum) OVER (ORDER BY day {_ROWS}) - cum AS dd FROM (SELECT day, r, sum(r) OVER (ORDER BY day {_ROWS}) AS cum FROM ({_BOOK}) AS b) AS c) AS d CROSS JOIN ({_LOW.format(b=_BOOK, u='week')}) AS wk CROSS JOIN ({_LOW.format(b=_BOOK, u='month')}) AS mo", None, ["days"])

#: A signal is a rule with a bracket; it passes on a symbol whose t is above zero.
_PASSES = tuple(f"SELECT rule, sl, sum(passed) AS passes FROM (SELECT rule, sl, symbol, CASE WHEN avg(r) / nullif(stddev_samp(r), 0) > 0 THEN 1 ELSE 0 END AS passed FROM ({grid(a, '(1.0, 1.5), (1.0, 2.0), (1.5, 2.0), (2.0, 3.0)', list(RULES))}) AS g GROUP BY rule, sl, symbol) AS c GROUP BY rule, sl" for a in BOTH)
table_query("a26_replication_counts", *(f"SELECT CAST(k AS INT) AS at_least, count(CASE WHEN passes >= k THEN 1 END) AS signals, count(*) AS tried FROM ({p}) AS p CROSS JOIN (VALUES (1), (2), (3), (4)) AS v(k) GROUP BY k" for p in _PASSES), ["bars"])

#: The cohort of all rules: signals by symbol with any bracket whose t is above two, and their best.
_T = "avg(r) / nullif(stddev_samp(r), 0) * sqrt(count(*))"
table_query("y04_cohort_union", *(f"SELECT rule, symbol, {rounded('max(t)', 5)} AS best_t, count(*) AS brackets, max(CASE WHEN t > 2 THEN 1 ELSE 0 END) AS any_above FROM (SELECT rule, symbol, sl, tp, {_T} AS t FROM ({grid(a, '(1.0, 1.5), (1.0, 2.0), (1.5, 2.0), (2.0, 3.0)', list(RULES))}) AS g GROUP BY rule, symbol, sl, tp) AS c GROUP BY rule, symbol" for a in BOTH), ["bars"])

_TURN = tuple(f"SELECT symbol, day, r, year(day) AS y FROM ({month_turn_trades(a, '{days}')}) AS t" for a in BOTH)


def yearly(trades: str, span: str) -> str:
    falls = f"SELECT *, max(cum) OVER (PARTITION BY symbol ORDER BY day {_ROWS}) - cum AS fall FROM (SELECT *, sum(r) OVER (PARTITION BY symbol ORDER BY day {_ROWS}) AS cum FROM ({trades}) AS t) AS c"
    years = f"SELECT symbol, count(*) AS years, sum(CASE WHEN s > 0 THEN 1 ELSE 0 END) AS up_years FROM (SELECT symbol, y, sum(r) AS s FROM ({trades}) AS t GROUP BY symbol, y) AS g GROUP BY symbol"
    whole = f"SELECT symbol, count(*) AS n, avg(r) / nullif(stddev_samp(r), 0) * sqrt(count(*)) AS t, avg(r) AS er, sum(r) / greatest(CAST({span} AS DOUBLE) / 365.25, 1e-9) AS per_year, max(fall) AS fall, sum(CASE WHEN r > 0 THEN r ELSE 0 END) / nullif(-sum(CASE WHEN r <= 0 THEN r ELSE 0 END), 0) AS pf FROM ({falls}) AS f GROUP BY symbol"
    return f"SELECT w.symbol AS symbol, n, {rounded('t', 5)} AS t, {rounded('er')} AS er, {rounded('per_year', 5)} AS r_per_year, {rounded('fall')} AS max_dd, {rounded('per_year / nullif(fall, 0)', 5)} AS romad, {rounded('pf', 5)} AS pf, CAST(up_years AS BIGINT) AS up_years, years FROM ({whole}) AS w JOIN ({years}) AS y ON w.symbol = y.symbol"


table_query("y16_yearly_figures", *(yearly(t, s) for t, s in zip(_TURN, ("datediff(max(day), min(day))", "datediff('day', min(day), max(day))"), strict=True)), ["days"])

#: Each brick's results by day over one calendar, days without a trade at zero, and beside them the book's.
_CAL = ("explode(sequence(lo, hi, INTERVAL 1 DAY))", "CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE)")
table_query("f16_brick_days", *(f"SELECT b.symbol AS brick, c.day AS day, round(coalesce(r, 0), 6) + 0.0 AS r, round(sum(coalesce(r, 0)) OVER (PARTITION BY c.day), 6) + 0.0 AS book FROM (SELECT {s} AS day FROM (SELECT min(day) AS lo, max(day) AS hi FROM ({t}) AS t) AS x) AS c CROSS JOIN (SELECT DISTINCT symbol FROM ({t}) AS t) AS b LEFT JOIN (SELECT symbol, day, sum(r) AS r FROM ({t}) AS t GROUP BY symbol, day) AS d ON b.symbol = d.symbol AND c.day = d.day" for t, s in zip(_TURN, _CAL, strict=True)), ["days"])

#: How far the next open lies from the close that a signal was decided at, in stop distances.
_ANCHOR = [{"tr": f"coalesce({true_range()}, high - low)", "hi": f"max(high) {prior(12)}", "lo": f"min(low) {prior(12)}", "next_open": lead("open")}, *fading({"atr": wilder("tr", 14, 14)}), {"sig": "CASE WHEN close > hi THEN 1 WHEN close < lo THEN -1 ELSE 0 END"}]
_ERRORS = staged_sql("SELECT * FROM {bars} AS b", _ANCHOR)
table_query("y14_anchor_errors", *(f"SELECT symbol, count(*) AS n, {rounded(f'{q}(e, 0.5)')} AS median, {rounded(f'{q}(abs(e), 0.9)')} AS p90, {rounded(f'{q}(abs(e), 0.99)')} AS p99, {rounded('avg(e)')} AS mean, {rounded('max(abs(e))')} AS worst FROM (SELECT symbol, sig * (next_open - close) / (1.5 * atr) AS e FROM ({_ERRORS}) AS x WHERE sig <> 0 AND atr > 0 AND next_open IS NOT NULL) AS z GROUP BY symbol" for q in ("percentile", "quantile_cont")), ["bars"])

#: Bounds of folds as row numbers: expanding or rolling windows, their last quarter out of sample, ten rows between.
N_FOLDS, EMBARGO = 4, 10
_WINDOWS = f"SELECT symbol, scheme, k, CASE WHEN scheme = 'expanding' THEN 0 ELSE greatest(CASE WHEN k < {N_FOLDS} THEN size * k ELSE n END - size, 0) END AS first, CASE WHEN k < {N_FOLDS} THEN size * k ELSE n END AS stop FROM (SELECT symbol, count(*) AS n, CAST(floor(count(*) / {N_FOLDS}) AS BIGINT) AS size FROM {{days}} GROUP BY symbol) AS s CROSS JOIN (VALUES {', '.join(f'({k})' for k in range(1, N_FOLDS + 1))}) AS v(k) CROSS JOIN (VALUES ('expanding'), ('rolling')) AS w(scheme)"
table_query("n08_fold_bounds", f"SELECT symbol, scheme, CAST(k AS INT) AS fold, CAST(first AS BIGINT) AS in_first, greatest(CAST(first AS BIGINT), stop - oos - {EMBARGO}) AS in_stop, stop - oos AS out_first, stop AS out_stop FROM (SELECT *, CAST(floor((stop - first) * 0.25) AS BIGINT) AS oos FROM ({_WINDOWS}) AS w) AS x WHERE oos > 0", None, ["days"])

# --- settings as maps
#: One map of spreads for all symbols, written as JSON and read back; a symbol that is not in it has NaN.
_SPREADS = "SELECT event_type AS symbol, round(max(value) - min(value), 4) AS s FROM {events} WHERE value IS NOT NULL AND event_type <> 'error' GROUP BY event_type"
table_query("s13_spread_map", f"SELECT symbol, coalesce(element_at(from_json(j, 'map<string,double>'), symbol), CAST('NaN' AS DOUBLE)) AS spread FROM (SELECT DISTINCT event_type AS symbol FROM {{events}}) AS e CROSS JOIN (SELECT to_json(map_from_entries(collect_list(struct(symbol, s)))) AS j FROM ({_SPREADS}) AS m) AS t", f"SELECT e.symbol, coalesce(s, CAST('NaN' AS DOUBLE)) AS spread FROM (SELECT DISTINCT event_type AS symbol FROM events) AS e LEFT JOIN ({_SPREADS}) AS m ON e.symbol = m.symbol", ["events"])
#: Defaults overlaid by what a part sets itself; a nested setting keeps its other fields.
_DEFAULTS = "map('risk', 1.0D, 'k', -1.0D, 'hold', 12.0D)"
table_query(
    "s38_overlaid_settings",
    f"SELECT event_type, setting, round(v.value, 6) AS value, v.own AS own, count(*) AS n FROM (SELECT event_type, explode(map_zip_with({_DEFAULTS}, from_json(props, 'map<string,double>'), (k, d, o) -> struct(coalesce(o, d) AS value, o IS NOT NULL AS own))) AS (setting, v) FROM {{events}}) AS x GROUP BY event_type, setting, round(v.value, 6), v.own",
    "SELECT event_type, setting, round(coalesce(o, d), 6) AS value, o IS NOT NULL AS own, count(*) AS n FROM (SELECT event_type, setting, d, CAST(json_extract_string(props, '$.' || setting) AS DOUBLE) AS o FROM events CROSS JOIN (VALUES ('risk', CAST(1 AS DOUBLE)), ('k', CAST(-1 AS DOUBLE)), ('hold', CAST(12 AS DOUBLE))) AS v(setting, d)) AS x GROUP BY event_type, setting, round(coalesce(o, d), 6), o IS NOT NULL",
    ["events"],
)
