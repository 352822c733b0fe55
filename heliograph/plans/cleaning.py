"""Raw ticks to clean bars, the whole way."""

from __future__ import annotations

from heliograph.plans.registry import table_query

#: Symbols that are let in, and how many deviations a step may be.
WHITELIST = ("click", "error", "purchase", "signup", "view")
SIGMAS = 3.0
#: Closed from Friday 22:00 to Sunday 22:00.
_CLOSED = "({w}(t) = {sat} OR ({w}(t) = {fri} AND hour(t) >= 22) OR ({w}(t) = {sun} AND hour(t) < 22))"
OPEN = tuple("NOT " + _CLOSED.format(w=w, fri=f, sat=f + 1, sun=f + 2) for w, f in (("weekday", 4), ("isodow", 5)))


def clean_sql(duck: bool, ticks: str = "{events}") -> str:
    """Bars of an hour from ticks.

    Of ticks of one symbol and time the first by number counts; symbols that are not on
    the list go. Bins become bars; bars outside the market's hours go, and hours without
    a bar are filled with the prices before, of no volume; what lies before a symbol's first
    bar goes. Then prices at or below zero go, highs and lows are set to hold open and
    close, and steps of more than ``SIGMAS`` deviations go, but for steps over a gap,
    which neither count for the deviation.
    """
    w = "OVER (PARTITION BY symbol ORDER BY ts"
    ffill = (lambda c: f"last_value({c} IGNORE NULLS) {w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)") if duck else (lambda c: f"last_value({c}) IGNORE NULLS {w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
    series = "unnest(generate_series(lo, hi, INTERVAL 1 HOUR))" if duck else "explode(sequence(lo, hi, INTERVAL 1 HOUR))"
    names = ", ".join(f"'{s}'" for s in WHITELIST)
    return f"""WITH first AS (SELECT event_type AS symbol, ts, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type, ts ORDER BY event_id) AS k FROM {ticks} AS e WHERE value IS NOT NULL AND event_type IN ({names})) AS d WHERE k = 1),
bars AS (SELECT symbol, date_trunc('hour', ts) AS ts, min_by(value, ts) AS open, max(value) AS high, min(value) AS low, max_by(value, ts) AS close, CAST(count(*) AS DOUBLE) AS volume FROM first GROUP BY symbol, date_trunc('hour', ts)),
grid AS (SELECT symbol, t AS ts FROM (SELECT symbol, {series} AS t FROM (SELECT symbol, min(ts) AS lo, max(ts) AS hi FROM bars GROUP BY symbol) AS r) AS g WHERE {OPEN[duck]}),
filled AS (SELECT symbol, ts, {', '.join(f'{ffill(c)} AS {c}' for c in ('open', 'high', 'low', 'close'))}, coalesce(volume, 0) AS volume FROM (SELECT g.symbol AS symbol, g.ts AS ts, open, high, low, close, volume FROM grid AS g LEFT JOIN bars AS b ON g.symbol = b.symbol AND g.ts = b.ts) AS j),
sound AS (SELECT symbol, ts, open, greatest(high, open, close) AS high, least(low, open, close) AS low, close, volume FROM filled WHERE close IS NOT NULL AND least(open, high, low, close) > 0 AND volume >= 0),
stepped AS (SELECT *, ln(close) - ln(lag(close) {w})) AS r, coalesce(ts - lag(ts) {w}) > INTERVAL 1 HOUR, true) AS gap FROM sound),
judged AS (SELECT *, stddev_pop(CASE WHEN NOT gap THEN r END) OVER (PARTITION BY symbol) AS sd FROM stepped)
SELECT symbol, ts, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, volume FROM judged WHERE gap OR coalesce(sd, 0) = 0 OR abs(r) <= {SIGMAS} * sd"""


table_query("p01_clean_pipeline", clean_sql(False), clean_sql(True), ["events"])
