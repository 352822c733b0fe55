"""Trade tables by day and by bar, and what they come to.

A day's bars of a symbol are one array (at most a day of bars), so a rule with
one trade a day needs one grouping and no walk. Results are in units of risk.
"""

from __future__ import annotations

from dataclasses import dataclass

from heliograph.functions.linear import fading, wilder
from heliograph.functions.series import lag, rolling, true_range
from heliograph.operators.staged import staged_sql
from heliograph.plans.registry import rounded, series, table_query



@dataclass(frozen=True)
class Arrays:
    """The few array functions whose names differ."""

    duck: bool

    def each(self, l: str, x: str, e: str) -> str:  # noqa: E741
        return f"list_transform({l}, lambda {x}: {e})" if self.duck else f"transform({l}, {x} -> {e})"

    def only(self, l: str, x: str, e: str) -> str:  # noqa: E741
        return f"list_filter({l}, lambda {x}: {e})" if self.duck else f"filter({l}, {x} -> {e})"

    def at(self, l: str, i: str) -> str:  # noqa: E741
        """The i-th, from 1 on; null beyond."""
        return f"{l}[{i}]" if self.duck else f"get({l}, CAST({i} AS INT) - 1)"

    def size(self, l: str) -> str:  # noqa: E741
        return f"len({l})" if self.duck else f"size({l})"

    def beyond(self, l: str, k: str) -> str:  # noqa: E741
        """All but the first k."""
        return f"{l}[CAST({k} AS BIGINT) + 1:]" if self.duck else f"slice({l}, CAST({k} AS INT) + 1, size({l}))"

    def head(self, l: str, k: str) -> str:  # noqa: E741
        return f"{l}[:CAST({k} AS BIGINT)]" if self.duck else f"slice({l}, 1, CAST({k} AS INT))"

    def place(self, l: str, x: str, e: str) -> str:  # noqa: E741
        """Place of the first element that fits, from 1 on; 0 for none."""
        found = f"list_position({self.each(l, x, e)}, true)" if self.duck else f"array_position({self.each(l, x, e)}, true)"
        return f"coalesce({found}, 0)"

    def high(self, l: str) -> str:  # noqa: E741
        return f"{'list_max' if self.duck else 'array_max'}({self.each(l, 'x', 'x.h')})"

    def low(self, l: str) -> str:  # noqa: E741
        return f"{'list_min' if self.duck else 'array_min'}({self.each(l, 'x', 'x.l')})"

    def gathered(self, where: str) -> str:
        """Bars in order of time."""
        return f"list({{'ts': ts, 'o': open, 'h': high, 'l': low, 'c': close}} ORDER BY ts) FILTER ({where})" if self.duck else f"array_sort(collect_list(CASE WHEN {where} THEN struct(ts, open AS o, high AS h, low AS l, close AS c) END))"

    def ahead(self, n: int) -> str:
        """This bar and the n - 1 after it."""
        one = "list({'o': open, 'h': high, 'l': low, 'c': close})" if self.duck else "collect_list(struct(open AS o, high AS h, low AS l, close AS c))"
        return f"{one} OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING)"


BOTH = Arrays(False), Arrays(True)
HIT_STOP = "(CASE WHEN side > 0 THEN x.l <= stop ELSE x.h >= stop END)"
HIT_TAKE = "(take IS NOT NULL AND CASE WHEN side > 0 THEN x.h >= take ELSE x.l <= take END)"


def resolved(a: Arrays, inner: str, gaps: bool = False) -> str:
    """Trades from rows with ``rest`` (bars from the entry on), ``side``, ``entry``, ``stop``, ``take``, ``risk`` and ``cost``.

    The first bar that touches a barrier ends a trade, the stop first; else the
    last bar's close does. ``gaps``: an open beyond a barrier is the price.
    """
    reached = staged_sql(inner, [{"k": a.place("rest", "x", f"({HIT_STOP} OR {HIT_TAKE})")}, {"x": f"CASE WHEN k > 0 THEN {a.at('rest', 'k')} ELSE {a.at('rest', a.size('rest'))} END"}])
    stop, take = ("CASE WHEN side > 0 THEN least(stop, x.o) ELSE greatest(stop, x.o) END", "CASE WHEN side > 0 THEN greatest(take, x.o) ELSE least(take, x.o) END") if gaps else ("stop", "take")
    return staged_sql(reached, [{"reason": f"CASE WHEN k = 0 THEN 'time_exit' WHEN {HIT_STOP} THEN 'stop' ELSE 'take' END"}, {"leave": f"CASE reason WHEN 'time_exit' THEN x.c WHEN 'stop' THEN {stop} ELSE {take} END", "held": f"CASE WHEN k > 0 THEN k ELSE {a.size('rest')} END"}, {"r": "(side * (leave - entry) - cost) / risk"}])


def day_bars(a: Arrays, source: str, **sessions: str) -> str:
    """One row a symbol and day, with the bars of each session as an array."""
    return f"SELECT symbol, day, {', '.join(f'{a.gathered(w)} AS {n}' for n, w in sessions.items())} FROM (SELECT *, CAST(ts AS DATE) AS day, hour(ts) AS hh FROM {source} AS s) AS d GROUP BY symbol, day"


def range_trades(a: Arrays, source: str, first: int = 2, width: float = 2.0, cost: float = 0.02) -> str:
    """Breakouts of each day's first bars: in at the open after the first close beyond, stop at the other side."""
    days = f"SELECT * FROM ({day_bars(a, source, bars='hh BETWEEN 8 AND 20')}) AS b WHERE {a.size('bars')} >= 6"
    ranged = staged_sql(days, [{"hi": a.high(a.head("bars", str(first))), "lo": a.low(a.head("bars", str(first))), "post": a.beyond("bars", str(first))}, {"i": a.place("post", "x", "(x.c > hi OR x.c < lo)")}])
    taken = f"SELECT * FROM ({ranged}) AS t WHERE hi > lo AND i > 0 AND i < {a.size('post')}"
    entered = staged_sql(taken, [{"side": f"CASE WHEN {a.at('post', 'i')}.c > hi THEN 1 ELSE -1 END", "rest": a.beyond("post", "i")}, {"entry": f"{a.at('rest', '1')}.o", "stop": "CASE WHEN side > 0 THEN lo ELSE hi END"}, {"risk": "abs(entry - stop)", "cost": f"CAST({cost} AS DOUBLE)"}, {"take": f"entry + side * {width} * risk"}])
    return resolved(a, f"SELECT * FROM ({entered}) AS e WHERE risk > 0")


def level_trades(a: Arrays, source: str, days: str, k_break: float, k_stop: float, reward: float, at_or_beyond: bool, fade: bool = False, regime: float | None = None, cost: float = 0.02) -> str:
    """Breakouts of levels around each day's first open, by the range of the days before; in at the open after a close beyond."""
    above, below = (">=", "<=") if at_or_beyond else (">", "<")
    ranges = staged_sql(f"SELECT symbol, CAST(ts AS DATE) AS day, max(high) AS high, min(low) AS low, max_by(close, ts) AS close FROM {days} AS x GROUP BY symbol, CAST(ts AS DATE)", [{"ts": "day"}, {"tr": f"coalesce({true_range()}, high - low)"}, *fading({"w7": wilder("tr", 7, 3), "w2": wilder("tr", 2, 2), "w5": wilder("tr", 5, 3)}), {"range": lag("w7"), "quick": lag("w2"), "slow": lag("w5")}])
    bars = f"SELECT b.*, range, quick, slow FROM ({day_bars(a, source, bars='hh BETWEEN 8 AND 20')}) AS b JOIN ({ranges}) AS r ON b.symbol = r.symbol AND b.day = r.day WHERE range > 0 AND {a.size('bars')} >= 6" + (f" AND quick < slow * {regime}" if regime else "")
    placed = staged_sql(bars, [{"hi": f"{a.at('bars', '1')}.o + {k_break} * range", "lo": f"{a.at('bars', '1')}.o - {k_break} * range"}, {"i": a.place("bars", "x", f"(x.c {above} hi OR x.c {below} lo)")}])
    taken = f"SELECT * FROM ({placed}) AS t WHERE i > 0 AND i < {a.size('bars')} AND hour({a.at('bars', 'i')}.ts) < 17"
    flip = "-1" if fade else "1"
    entered = staged_sql(taken, [{"side": f"CASE WHEN {a.at('bars', 'i')}.c {above} hi THEN {flip} ELSE -({flip}) END", "rest": a.beyond("bars", "i"), "risk": f"{k_stop} * range", "cost": f"CAST({cost} AS DOUBLE)"}, {"entry": f"{a.at('rest', '1')}.o"}, {"stop": "entry - side * risk", "take": f"entry + side * {reward} * risk"}])
    return resolved(a, entered)


def morning_trades(a: Arrays, source: str, cost: float = 0.02) -> str:
    """Breakouts of the night's range between 7 and 12, out at the first open from 16 on or at the range's other side."""
    days = day_bars(a, source, night="hh < 7", morning="hh BETWEEN 7 AND 12", rest_of_day="hh BETWEEN 13 AND 15", late="hh >= 16")
    ranged = staged_sql(days, [{"hi": a.high("night"), "lo": a.low("night"), "n_late": a.size("late")}, {"i": a.place("morning", "x", "(x.c > hi OR x.c < lo)")}])
    taken = f"SELECT * FROM ({ranged}) AS t WHERE {a.size('night')} >= 3 AND n_late > 0 AND hi > lo AND i > 0 AND i < {a.size('morning')}"
    both = "list_concat" if a.duck else "concat"
    entered = staged_sql(taken, [{"side": f"CASE WHEN {a.at('morning', 'i')}.c > hi THEN 1 ELSE -1 END", "held_bars": f"{both}({a.beyond('morning', 'i')}, rest_of_day)", "out": f"{a.at('late', '1')}.o"}, {"entry": f"{a.at('held_bars', '1')}.o", "stop": "CASE WHEN side > 0 THEN lo ELSE hi END"}, {"risk": "abs(entry - stop)", "k": a.place("held_bars", "x", HIT_STOP)}, {"x": f"CASE WHEN k > 0 THEN {a.at('held_bars', 'k')} END"}, {"leave": "CASE WHEN k = 0 THEN out WHEN side > 0 THEN least(stop, x.o) ELSE greatest(stop, x.o) END", "reason": "CASE WHEN k = 0 THEN 'time_exit' ELSE 'stop' END"}, {"r": f"(side * (leave - entry) - 2 * {cost}) / nullif(risk, 0)"}])
    return f"SELECT * FROM ({entered}) AS m WHERE risk > 0"


def window_trades(a: Arrays, source: str, buy: int = 9, sell: int = 15, width: float = 2.5, cost: float = 0.02) -> str:
    """In at the open of one hour of the day, out at that of a later one; risk from the range before the entry."""
    ranged = staged_sql(f"SELECT * FROM {source} AS s", [{"tr": f"coalesce({true_range()}, high - low)"}, {"atr": rolling("avg", "tr", 14)}, {"ap": lag("atr"), "day": "CAST(ts AS DATE)", "hh": "hour(ts)"}])
    return f"SELECT symbol, day, entry, leave, {width} * ap AS risk, 1 AS side, 'time_exit' AS reason, (leave - entry - {cost}) / ({width} * ap) AS r FROM (SELECT symbol, day, max(CASE WHEN hh = {buy} THEN open END) AS entry, max(CASE WHEN hh = {sell} THEN open END) AS leave, max(CASE WHEN hh = {buy} THEN ap END) AS ap FROM ({ranged}) AS x GROUP BY symbol, day) AS y WHERE entry IS NOT NULL AND leave IS NOT NULL AND ap > 0"


def month_turn_trades(a: Arrays, source: str, first_days: int = 3, width: float = 2.0) -> str:
    """Each month's last trading day's open to the close of the next month's first days, with a stop by the range of the day before."""
    numbered = staged_sql(f"SELECT * FROM {source} AS s", [{"tr": f"coalesce({true_range()}, high - low)", "mon": "date_trunc('month', ts)"}, *fading({"atr": wilder("tr", 14)}), {"ap": lag("atr"), "dom": "row_number() OVER (PARTITION BY symbol, mon ORDER BY ts)", "left_over": "row_number() OVER (PARTITION BY symbol, mon ORDER BY ts DESC)"}, {"rest": a.ahead(first_days + 1), "next_dom": f"lead(dom, 1) OVER (PARTITION BY symbol ORDER BY ts)"}])
    entered = staged_sql(f"SELECT * FROM ({numbered}) AS n WHERE left_over = 1 AND next_dom = 1 AND ap > 0", [{"side": "1", "entry": "open", "risk": f"{width} * ap", "cost": "0.0005 * 2 * open", "take": "CAST(NULL AS DOUBLE)", "day": "CAST(ts AS DATE)"}, {"stop": "entry - risk"}])
    return resolved(a, entered)


def trades(name: str, spark_sql: str, duck_sql: str, tables: list[str]) -> None:
    shown = f"SELECT symbol, day, CAST(side AS INT) AS side, reason, {', '.join(f'{rounded(x)} AS {x}' for x in ('entry', 'leave', 'risk', 'r'))} FROM ({{}}) AS t"
    table_query(name, shown.format(spark_sql), shown.format(duck_sql), tables)


BARS = "{bars}"
OPENING = tuple(range_trades(a, BARS) for a in BOTH)
trades("g31_opening_range_trades", *OPENING, ["bars"])
trades("g32_range_level_trades", *(level_trades(a, BARS, BARS, 0.25, 0.5, 2.0, False, regime=1.1) for a in BOTH), ["bars"])
trades("g71_fixed_cost_breakout", *(level_trades(a, BARS, BARS, 0.15, 0.4, 1.5, True, fade=True, cost=0.05) for a in BOTH), ["bars"])
trades("g45_morning_breakout", *(morning_trades(a, BARS) for a in BOTH), ["bars"])
trades("g46_hourly_window", *(window_trades(a, BARS) for a in BOTH), ["bars"])
trades("g34_month_turn_trades", *(month_turn_trades(a, "{days}") for a in BOTH), ["days"])
trades("x01_one_trade_a_day", *(range_trades(a, BARS, 1, 1.5, 0.0) for a in BOTH), ["bars"])
trades("y38_opening_range_wide", *(range_trades(a, BARS, 3, 3.0, 0.02) for a in BOTH), ["bars"])

# --- the month's turn as daily results and as bets
_TURN = "(SELECT symbol, ts, mon, r, n_open, dom, CASE WHEN dom >= n_days - 1 OR dom <= 3 THEN 1 ELSE 0 END AS w FROM (SELECT symbol, ts, date_trunc('month', ts) AS mon, close / lag(close) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS r, lag(open) OVER (PARTITION BY symbol ORDER BY ts) AS n_open, row_number() OVER (PARTITION BY symbol, date_trunc('month', ts) ORDER BY ts) AS dom, count(*) OVER (PARTITION BY symbol, date_trunc('month', ts)) AS n_days FROM {days}) AS t)"
table_query("g35_month_turn_bets", f"SELECT symbol, CAST(mon AS DATE) AS m, round(sum(greatest(r, -0.02)) - 0.001, 6) + 0.0 AS bet FROM {_TURN} AS x WHERE w = 1 AND r IS NOT NULL GROUP BY symbol, mon", None, ["days"])
table_query("g34_month_turn_daily", f"SELECT symbol, ts, round(CASE WHEN w = 1 THEN greatest(r, -0.02) ELSE 0 END - CASE WHEN w = 1 AND wp = 0 THEN 0.001 ELSE 0 END, 6) + 0.0 AS r FROM (SELECT *, coalesce(lag(w) OVER (PARTITION BY symbol ORDER BY ts), 0) AS wp FROM {_TURN} AS x) AS y WHERE r IS NOT NULL", None, ["days"])

# --- every bar's outcome for one bracket, either side
_BRACKET = ({"tr": f"coalesce({true_range()}, high - low)"}, *fading({"atr": wilder("tr", 14, 14)}), {"risk": f"1.5 * {lag('atr')}", "entry": "open", "cost": "CAST(0.02 AS DOUBLE)"})


def outcomes(a: Arrays, side: int, n: int = 8) -> str:
    """The trade that would begin at the open of every bar."""
    inner = staged_sql(f"SELECT * FROM {BARS} AS s", [*_BRACKET, {"rest": a.ahead(n), "side": str(side), "stop": f"entry - ({side}) * risk", "take": f"entry + ({side}) * 2 * risk"}])
    return resolved(a, f"SELECT * FROM ({inner}) AS q WHERE risk > 0", gaps=True)


for _side, _name in ((1, "b04_long_outcomes"), (-1, "b04_short_outcomes")):
    table_query(_name, *(f"SELECT symbol, ts, reason, CAST(held AS INT) AS held, {rounded('r')} AS r FROM ({outcomes(a, _side)}) AS t" for a in BOTH), ["bars"])
table_query("x10_both_sides", *(f"SELECT l.symbol, l.ts, {rounded('l.r')} AS long_r, {rounded('s.r')} AS short_r FROM ({outcomes(a, 1)}) AS l JOIN ({outcomes(a, -1)}) AS s ON l.symbol = s.symbol AND l.ts = s.ts" for a in BOTH), ["bars"])
#: One bar against fixed barriers, as many rows as bars; ``held`` counts bars since each day's first.
table_query("b02_bar_resolution", *[f"SELECT symbol, ts, CASE WHEN low <= stop THEN 'stop_loss' WHEN high >= take THEN 'take_profit' WHEN held >= 5 THEN 'time_exit' ELSE 'none' END AS reason, round(CASE WHEN low <= stop THEN stop WHEN high >= take THEN take WHEN held >= 5 THEN close END, 6) + 0.0 AS price FROM (SELECT symbol, ts, high, low, close, first_open - 2 * span AS stop, first_open + 3 * span AS take, held FROM (SELECT symbol, ts, high, low, close, min_by(open, ts) OVER w AS first_open, avg(high - low) OVER w AS span, row_number() OVER (PARTITION BY symbol, CAST(ts AS DATE) ORDER BY ts) AS held FROM {BARS} AS b WINDOW w AS (PARTITION BY symbol, CAST(ts AS DATE))) AS c WHERE span > 0) AS d"], None, ["bars"])
table_query("b06_intrabar_order", "SELECT symbol, ts, CASE WHEN hit_up AND hit_down THEN CASE WHEN close >= open THEN 'down' ELSE 'up' END WHEN hit_up THEN 'up' WHEN hit_down THEN 'down' ELSE 'none' END AS first_touch FROM (SELECT symbol, ts, open, close, high >= open + 0.5 * m AS hit_up, low <= open - 0.5 * m AS hit_down FROM (SELECT *, avg(high - low) OVER (PARTITION BY symbol) AS m FROM {bars}) AS b) AS c", None, ["bars"])
table_query("x08_fill_cost", "SELECT symbol, ts, round(abs(chg) * (0.5 * 0.02 + 0.01 + 0.0001 * close), 6) + 0.0 AS cost FROM (SELECT symbol, ts, close, sign(close - open) - coalesce(lag(sign(close - open)) OVER (PARTITION BY symbol ORDER BY ts), 0) AS chg FROM {bars}) AS b", None, ["bars"])
table_query("y26_round_trip_cost", "SELECT symbol, ts, round(2 * (0.5 * greatest(high - low, 0.02) * 0.1 + 0.01), 6) + 0.0 AS cost FROM {bars}", None, ["bars"])

# --- what trades come to; the trades are those of the opening range
_SPAN = "greatest(datediff(max(day), min(day)) / CAST(365.25 AS DOUBLE), CAST(1e-9 AS DOUBLE))", "greatest(datediff('day', min(day), max(day)) / CAST(365.25 AS DOUBLE), CAST(1e-9 AS DOUBLE))"
_ORDER = "PARTITION BY symbol ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"


def summary(name: str, columns: str, group: str = "symbol", having: str = "") -> None:
    """``columns`` over trades with ``r``, ``cum`` (running sum), ``dd`` (fall from its maximum, from the first trade on) and ``reason``; {span}: years."""
    texts = []
    for opened, span in zip(OPENING, _SPAN, strict=True):
        run = f"SELECT *, max(cum) OVER ({_ORDER}) - cum AS dd FROM (SELECT symbol, day, r, reason, cost, risk, sum(r) OVER ({_ORDER}) AS cum FROM ({opened}) AS t) AS u"
        texts.append(f"SELECT {group}, {columns.replace('{span}', span)} FROM ({run}) AS v GROUP BY {group}{having}")
    table_query(name, *texts, ["bars"])


_WIN, _LOSS = "CASE WHEN r > 0 THEN r ELSE 0 END", "CASE WHEN r <= 0 THEN -r ELSE 0 END"
_CORE = f"count(*) AS n_trades, round(avg(CASE WHEN r > 0 THEN 1 ELSE 0 END), 6) AS win_rate, round(avg(r), 6) + 0.0 AS expectancy_r, round(sum(r), 6) + 0.0 AS total_r, round(sum({_WIN}) / nullif(sum({_LOSS}), 0), 6) AS profit_factor, round(max(dd), 6) + 0.0 AS max_dd_r"
_SHARES = ", ".join(f"round(avg(CASE WHEN reason = '{x}' THEN 1 ELSE 0 END), 6) AS pct_{x}" for x in ("stop", "take", "time_exit"))
summary("a13_risk_metrics", f"{_CORE}, round(sum(r) / ({{span}}), 5) + 0.0 AS r_per_year, round(avg(CASE WHEN r > 0 THEN r END), 6) AS avg_win_r, round(avg(CASE WHEN r <= 0 THEN r END), 6) + 0.0 AS avg_loss_r, round(stddev_pop(r), 6) AS r_std, round(avg(r) / nullif(stddev_pop(r), 0), 6) + 0.0 AS sharpe_per_trade, {_SHARES}, round(avg(cost / risk), 6) AS avg_cost_r, min(day) AS first_date, max(day) AS last_date")
summary("a14_breakout_metrics", f"{_CORE}, round(sum(r) / ({{span}}), 5) + 0.0 AS r_per_year, round(avg(r) / nullif(stddev_pop(r), 0), 6) + 0.0 AS sharpe_per_trade, {_SHARES}")
summary("a16_trade_stats", f"count(*) AS n_trades, round(avg(CASE WHEN r > 0 THEN 1 ELSE 0 END), 6) AS win_rate, round(avg(r), 6) + 0.0 AS expectancy_r, round(sum(r), 6) + 0.0 AS total_r, round(sum({_WIN}) / nullif(sum(CASE WHEN r < 0 THEN -r ELSE 0 END), 0), 6) AS profit_factor, round(-max(dd), 6) + 0.0 AS max_dd_r")
summary("a19_cell_stats", f"count(*) AS n, round(avg(r), 6) + 0.0 AS er, round(sum(r) / ({{span}}), 5) + 0.0 AS r_per_year, round(avg(r) / nullif(stddev_samp(r), 0) * sqrt(count(*)), 6) + 0.0 AS t, round(sum({_WIN}) / nullif(sum({_LOSS}), 0), 6) AS pf, round(max(dd), 6) + 0.0 AS max_dd, round(sum(r) / ({{span}}) / nullif(max(dd), 0), 5) + 0.0 AS romad", having=" HAVING count(*) >= 5")
summary("a17_clone_stats", "count(*) AS n, round(avg(CASE WHEN r > 0 THEN 1 ELSE 0 END), 6) AS win, round(avg(r), 6) + 0.0 AS er, round(avg(r) / nullif(stddev_samp(r), 0) * sqrt(count(*) / ({span})), 4) + 0.0 AS sharpe")
table_query("a03_daily_sums", *(f"SELECT day, round(sum(r), 6) + 0.0 AS r, count(*) AS n FROM ({t}) AS t GROUP BY day" for t in OPENING), ["bars"])
_GRID = ("SELECT explode(sequence(min(day), max(day), INTERVAL 1 DAY)) AS day FROM ({t}) AS g", "SELECT CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM ({t}) AS g")
_FILLED = tuple(f"SELECT g.day, coalesce(s.r, 0) AS r FROM ({g.format(t=t)}) AS g LEFT JOIN (SELECT day, sum(r) AS r FROM ({t}) AS t GROUP BY day) AS s ON g.day = s.day" for g, t in zip(_GRID, OPENING, strict=True))
table_query("a04_calendar_sums", *(f"SELECT day, round(r, 6) + 0.0 AS r FROM ({f}) AS f" for f in _FILLED), ["bars"])
table_query("a21_daily_filled_sharpe", *(f"SELECT count(*) AS days, round(avg(r) / nullif(stddev_samp(r), 0) * sqrt(365.0), 6) + 0.0 AS sharpe FROM ({f}) AS f" for f in _FILLED), ["bars"])
#: Lengths of runs of days without a gain.
table_query("y13_idle_runs", *(f"SELECT run, count(*) AS n FROM (SELECT island, count(*) AS run FROM (SELECT r, sum(CASE WHEN r > 0 THEN 1 ELSE 0 END) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM ({f}) AS f) AS i WHERE r <= 0 GROUP BY island) AS j GROUP BY run" for f in _FILLED), ["bars"])
_PNL = "(SELECT symbol, ts, close / lag(close) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS r FROM {days})"
table_query("a10_sortino", f"SELECT symbol, round(CASE WHEN count(r) < 2 OR coalesce(stddev_pop(CASE WHEN r < 0 THEN r END), 0) = 0 THEN 0 ELSE avg(r) / stddev_pop(CASE WHEN r < 0 THEN r END) * sqrt(252.0) END, 6) + 0.0 AS sortino FROM {_PNL} AS p GROUP BY symbol", None, ["days"])
table_query("a06_whole_months", f"SELECT symbol, CAST(m AS DATE) AS m, round(s, 6) + 0.0 AS r FROM (SELECT symbol, date_trunc('month', ts) AS m, sum(r) AS s, max(max(ts)) OVER (PARTITION BY symbol) AS top FROM {_PNL} AS p GROUP BY symbol, date_trunc('month', ts)) AS q WHERE m < date_trunc('month', top)", None, ["days"])
table_query("y20_monthly_distribution", f"SELECT symbol, count(*) AS months, round(avg(s), 6) + 0.0 AS mean_r, round(median(s), 6) + 0.0 AS median_r, round(min(s), 6) + 0.0 AS worst, round(max(s), 6) + 0.0 AS best, round(avg(CASE WHEN s > 0 THEN 1 ELSE 0 END), 6) AS positive FROM (SELECT symbol, date_trunc('month', ts) AS m, sum(r) AS s FROM {_PNL} AS p GROUP BY symbol, date_trunc('month', ts)) AS q GROUP BY symbol", None, ["days"])
series("x02_daily_reversal_entries", {"entry": "CAST(CASE WHEN ibs < 0.2 AND ap > 0 THEN 1 ELSE 0 END AS INT)", "leave": "CAST(CASE WHEN ibs > 0.8 THEN 1 ELSE 0 END AS INT)", "risk": rounded("2 * ap")}, {"tr": f"coalesce({true_range()}, high - low)", "ibs": "(close - low) / nullif(high - low, 0)"}, *fading({"atr": wilder("tr", 14)}), {"ap": lag("atr")}, daily=True)
