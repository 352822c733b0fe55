"""Market calendar: holidays, short days, sessions and windows by local clocks."""

from __future__ import annotations

from heliograph.plans.registry import series, table_query
from heliograph.plans.rules import LONDON, NEW_YORK, TOKYO
from heliograph.plans.tables import _EASTER

#: Weekday from 0 (Monday) in either engine.
DOW = "weekday({})", "(isodow({}) - 1)"
PLUS = "date_add({d}, CAST({n} AS INT))", "CAST({d} + CAST({n} AS INT) AS DATE)"


def nth(year: str, month: int, dow: int, n: int, e: int) -> str:
    """The n-th weekday of a month; n = -1: the last."""
    if n > 0:
        first = f"make_date({year}, {month}, 1)"
        return PLUS[e].format(d=first, n=f"(({dow} - {DOW[e].format(first)} + 7) % 7 + {7 * (n - 1)})")
    last = PLUS[e].format(d=f"make_date({year} + {int(month == 12)}, {month % 12 + 1}, 1)", n="-1")
    return PLUS[e].format(d=last, n=f"(-(({DOW[e].format(last)} - {dow} + 7) % 7))")


def observed(day: str, e: int) -> str:
    """Saturdays are kept on Friday, Sundays on Monday."""
    return PLUS[e].format(d=day, n=f"CASE {DOW[e].format(day)} WHEN 5 THEN -1 WHEN 6 THEN 1 ELSE 0 END")


def holidays(e: int) -> str:
    """Year, name and day of each holiday of the years of orders."""
    fixed = {"new_year": (1, 1), "independence": (7, 4), "christmas": (12, 25)}
    moving = {"king": (1, 0, 3), "presidents": (2, 0, 3), "memorial": (5, 0, -1), "labor": (9, 0, 1), "thanksgiving": (11, 3, 4)}
    rows = [f"SELECT y, '{n}' AS name, {observed(f'make_date(y, {m}, {d})', e)} AS day FROM ({_EASTER}) AS x" for n, (m, d) in fixed.items()]
    rows += [f"SELECT y, '{n}', {nth('y', m, dow, k, e)} FROM ({_EASTER}) AS x" for n, (m, dow, k) in moving.items()]
    rows += [f"SELECT y, 'good_friday', {PLUS[e].format(d='easter', n='-2')} FROM ({_EASTER}) AS x", f"SELECT y, 'juneteenth', {observed('make_date(y, 6, 19)', e)} FROM ({_EASTER}) AS x WHERE y >= 2022"]
    return " UNION ALL ".join(rows)


def short_days(e: int) -> str:
    """Early closes: the day before a weekday 4 July, the day after Thanksgiving, a weekday 24 December."""
    dow = DOW[e].format
    return (
        f"SELECT y, {PLUS[e].format(d='make_date(y, 7, 4)', n='-1')} AS day FROM ({_EASTER}) AS x WHERE {dow('make_date(y, 7, 4)')} BETWEEN 1 AND 4"
        f" UNION ALL SELECT y, {PLUS[e].format(d=nth('y', 11, 3, 4, e), n='1')} FROM ({_EASTER}) AS x UNION ALL SELECT y, make_date(y, 12, 24) FROM ({_EASTER}) AS x WHERE {dow('make_date(y, 12, 24)')} < 5"
    )


table_query("t17_us_holidays", *(f"SELECT CAST(y AS INT) AS y, name, day FROM ({holidays(e)}) AS h" for e in (0, 1)), ["orders"])
table_query("t20_early_closes", *(f"SELECT CAST(y AS INT) AS y, day FROM ({short_days(e)}) AS s" for e in (0, 1)), ["orders"])
_FLAT = "SELECT d, CASE WHEN {dow} >= 5 THEN 955 WHEN h.day IS NOT NULL OR s.day IS NOT NULL THEN least(955, 770) WHEN month(d) = 12 AND day(d) = 31 THEN least(955, 945) ELSE 955 END AS flat_minute FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM {{orders}}) AS o LEFT JOIN (SELECT DISTINCT day FROM ({h}) AS a) AS h ON d = h.day LEFT JOIN (SELECT DISTINCT day FROM ({s}) AS b) AS s ON d = s.day"
table_query("t21_effective_flat_minute", *(_FLAT.format(dow=DOW[e].format("d"), h=holidays(e), s=short_days(e)).replace("{{", "{").replace("}}", "}") for e in (0, 1)), ["orders"])
#: Weekdays of the feed's range by whether the calendar is closed and the feed silent: both (ok), only the feed (missed), only the calendar (spurious).
_FEED = ("explode(sequence(lo, hi, INTERVAL 1 DAY))", "CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE)")
table_query("y11_calendar_against_feed", *(f"SELECT CAST(year(d) AS INT) AS y, class, count(*) AS days, min(d) AS first FROM (SELECT c.d AS d, CASE WHEN h.day IS NOT NULL AND n IS NULL THEN 'ok' WHEN n IS NULL THEN 'missed' WHEN h.day IS NOT NULL THEN 'spurious' ELSE 'open' END AS class FROM (SELECT {s} AS d FROM (SELECT min(CAST(o_orderdate AS DATE)) AS lo, max(CAST(o_orderdate AS DATE)) AS hi FROM {{orders}}) AS r) AS c LEFT JOIN (SELECT DISTINCT day FROM ({holidays(e)}) AS a) AS h ON c.d = h.day LEFT JOIN (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM {{orders}} WHERE o_orderpriority LIKE '1%' GROUP BY CAST(o_orderdate AS DATE)) AS o ON c.d = o.day WHERE {DOW[e].format('c.d')} < 5) AS x GROUP BY year(d), class" for e, s in enumerate(_FEED)), ["orders"])
table_query("t23_us_session_minutes", *(f"SELECT d, CASE WHEN {DOW[e].format('d')} >= 5 THEN 0 WHEN EXISTS_H THEN 0 ELSE 390 END AS minutes FROM (SELECT d, h.day IS NOT NULL AS EXISTS_H FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM {{orders}}) AS o LEFT JOIN (SELECT DISTINCT day FROM ({holidays(e)}) AS a) AS h ON d = h.day) AS j" for e in (0, 1)), ["orders"])
#: The first session that is open, in the order Tokyo, London, New York.
series("t07_primary_session", {"session": "session"}, {"session": "CASE WHEN a_m >= 540 AND a_m < 1020 THEN 'asia' WHEN l_m >= 480 AND l_m < 960 THEN 'london' WHEN n_m >= 480 AND n_m < 1020 THEN 'newyork' ELSE 'closed' END"}, places=LONDON | NEW_YORK | TOKYO)
series("t09_place_sessions", {f"in_{x}": f"CAST(CASE WHEN {x}_m >= {lo} AND {x}_m < {hi} THEN 1 ELSE 0 END AS INT)" for x, lo, hi in (("a", 540, 900), ("l", 480, 990), ("n", 570, 960))}, places=LONDON | NEW_YORK | TOKYO)
_DOW = {"dow": "weekday(n_t)"}, {"dow": "isodow(n_t) - 1"}
_WINDOW = {"w": "CAST(CASE WHEN n_m >= 570 AND n_m <= 900 AND dow < 5 THEN 1 ELSE 0 END AS INT)"}
series("t10_entry_window", {"in_window": "w"}, _DOW[0], _WINDOW, duck=(_DOW[1], _WINDOW), places=NEW_YORK)
_NEXT = {"nm": "(n_m + 60) % 1440", "ndow": "CASE WHEN n_m + 60 >= 1440 THEN (dow + 1) % 7 ELSE dow END"}
_NEXT_IN = {"w": "CAST(CASE WHEN nm >= 570 AND nm <= 900 AND ndow < 5 THEN 1 ELSE 0 END AS INT)"}
series("t11_next_bar_in_window", {"next_in_window": "w"}, _DOW[0], _NEXT, _NEXT_IN, duck=(_DOW[1], _NEXT, _NEXT_IN), places=NEW_YORK)
#: The last bar of a local day that may still be held; bars after it keep themselves.
series("t12_session_deadline", {"deadline": "deadline"}, {"last_hold": "max(CASE WHEN l_m <= 960 THEN ts END) OVER (PARTITION BY symbol, l_d)"}, {"deadline": "CASE WHEN last_hold IS NULL OR last_hold < ts THEN ts ELSE last_hold END"}, places=LONDON)
_SLOT = "OVER (PARTITION BY symbol, h ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_SEASON = ({"h": "hour(ts)", "ar": "abs(ln(close) - ln(lag(close) OVER (PARTITION BY symbol ORDER BY ts)))"}, {"hv": f"CASE WHEN count(ar) {_SLOT} >= 5 THEN avg(ar) {_SLOT} END"}, {"rel": "ar / nullif(hv, 0)", "month_sin": "sin(2 * pi() * (month(ts) - 1) / 12)", "dom_cos": "cos(2 * pi() * (day(ts) - 1) / 31)", "how_sin": "sin(2 * pi() * (least(dow, 4) * 24 + hour(ts)) / 120)", "month_end": "CAST(CASE WHEN day(ts) >= 28 THEN 1 ELSE 0 END AS INT)"})
series("t14_seasonality", {"hv": "round(hv, 6)", "rel": "round(rel, 5)", "month_sin": "round(month_sin, 9) + 0.0", "dom_cos": "round(dom_cos, 9) + 0.0", "how_sin": "round(how_sin, 9) + 0.0", "month_end": "month_end"}, {"dow": "weekday(ts)"}, *_SEASON, duck=({"dow": "isodow(ts) - 1"}, *_SEASON))
series("t25_seasonal_entries", {"fifth_last": "CAST(CASE WHEN dom = n_days - 4 THEN 1 ELSE 0 END AS INT)", "expiry": "CAST(CASE WHEN dow = 4 AND day(ts) BETWEEN 15 AND 21 THEN 1 ELSE 0 END AS INT)"}, {"dow": "weekday(ts)", "dom": "row_number() OVER (PARTITION BY symbol, date_trunc('month', ts) ORDER BY ts)", "n_days": "count(*) OVER (PARTITION BY symbol, date_trunc('month', ts))"}, duck=({"dow": "isodow(ts) - 1", "dom": "row_number() OVER (PARTITION BY symbol, date_trunc('month', ts) ORDER BY ts)", "n_days": "count(*) OVER (PARTITION BY symbol, date_trunc('month', ts))"},), daily=True)
#: A server whose clock is New York's plus seven hours, so its day ends with New York's session.
table_query("t06_server_clock_by_new_york", "SELECT event_id, convert_timezone('America/New_York', 'UTC', ts - INTERVAL 7 HOURS) AS utc FROM {events}", "SELECT event_id, timezone('UTC', timezone('America/New_York', ts - INTERVAL 7 HOURS)) AS utc FROM events", ["events"])
table_query("t26_server_epoch", "SELECT event_id, CAST(timestamp_seconds(e - 7200) AS timestamp_ntz) AS utc FROM (SELECT event_id, unix_seconds(CAST(ts AS TIMESTAMP)) AS e FROM {events}) AS x", "SELECT event_id, make_timestamp((CAST(epoch(ts) - 0.5 AS BIGINT) * 0 + CAST(floor(epoch(ts)) AS BIGINT) - 7200) * 1000000) AS utc FROM events", ["events"])
table_query("a38_session_bar_counts", "SELECT symbol, median(n) AS median_bars FROM (SELECT symbol, CAST(ts AS DATE) AS d, count(*) AS n FROM {bars} WHERE hour(ts) BETWEEN 8 AND 15 GROUP BY symbol, CAST(ts AS DATE)) AS c GROUP BY symbol", None, ["bars"])
