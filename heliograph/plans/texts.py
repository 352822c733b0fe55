"""Keyword triage, sentences, records and reports over text columns; sources of bars and of panels."""

from __future__ import annotations

from heliograph.plans.registry import NUMBER, table_query
from heliograph.plans.tables import _PNL
from heliograph.plans.trades import BOTH, OPENING
from heliograph.plans.triage import PAPERS

FREQUENCIES = {"intraday": ["intraday", "minute", "hourly"], "daily": ["daily", "day of"], "weekly": ["weekly"], "monthly": ["monthly", "month"]}
#: A document's text alone.
ABSTRACTS = (PAPERS, PAPERS)
_FREQ = " ".join(f"WHEN {' OR '.join(f'contains(t, {chr(39)}{w}{chr(39)})' for w in ws)} THEN '{n}'" for n, ws in FREQUENCIES.items())
table_query("z09_frequency_guess", *(f"SELECT doc_id, CASE {_FREQ} ELSE 'unknown' END AS frequency FROM ({a}) AS a" for a in ABSTRACTS), ["documents"])
_SENTENCES = tuple(f"SELECT doc_id, {f} AS s FROM ({a}) AS a" for f, a in zip((r"filter(split(regexp_replace(t, '([.!?])\\s+', '$1\n'), '\n'), x -> trim(x) <> '')", r"list_filter(string_split(regexp_replace(t, '([.!?])\s+', '\1' || chr(10), 'g'), chr(10)), lambda x: trim(x) <> '')"), ABSTRACTS, strict=True))
#: Words that mark a claim.
CUES = ["find", "show", "document", "predict", "outperform", "profit", "return", "evidence"]
_CLAIM = " OR ".join(f"contains(x, '{w}')" for w in CUES)
table_query("z11_claim_snippets", *(f"SELECT doc_id, {a.size('c')} AS n, md5({a.at('c', '1')}) AS first_claim FROM (SELECT doc_id, {a.head(a.only('s', 'x', _CLAIM), '4')} AS c FROM ({s}) AS s) AS y" for a, s in zip(BOTH, _SENTENCES, strict=True)), ["documents"])
#: Sentences of 8 to 60 words with a number, by whether they speak of entering, leaving or neither.
_RULED = ("SELECT doc_id, CASE WHEN x RLIKE 'buy|long|enter' THEN 'entry' WHEN x RLIKE 'sell|short|exit|stop' THEN 'exit' ELSE 'other' END AS class, size(split(trim(x), '\\\\s+')) AS words FROM (SELECT doc_id, explode(s) AS x FROM ({s}) AS s) AS e WHERE x RLIKE '[0-9]'", "SELECT doc_id, CASE WHEN regexp_matches(x, 'buy|long|enter') THEN 'entry' WHEN regexp_matches(x, 'sell|short|exit|stop') THEN 'exit' ELSE 'other' END AS class, len(regexp_split_to_array(trim(x), '\\s+')) AS words FROM (SELECT doc_id, unnest(s) AS x FROM ({s}) AS s) AS e WHERE regexp_matches(x, '[0-9]')")
table_query("z19_rule_sentences", *(f"SELECT doc_id, class, count(*) AS n, CAST(max(words) AS INT) AS longest FROM ({r.replace('{s}', s)}) AS r WHERE words BETWEEN 8 AND 60 GROUP BY doc_id, class" for r, s in zip(_RULED, _SENTENCES, strict=True)), ["documents"])
table_query("z05_first_over_pages", "SELECT sig, page, doc_id FROM (SELECT md5(lower(text)) AS sig, CAST(floor(doc_id / 100) AS BIGINT) AS page, doc_id, row_number() OVER (PARTITION BY md5(lower(text)) ORDER BY doc_id) AS n FROM {documents} WHERE text IS NOT NULL) AS d WHERE n = 1", None, ["documents"])
_XML = "concat('<feed><entry><id>', CAST(p_partkey AS STRING), '</id><title>', p_name, '</title><category term=\"', p_brand, '\"/></entry></feed>')"
table_query("z01_feed_entries", f"SELECT CAST(xpath_string(x, 'feed/entry/id') AS BIGINT) AS id, xpath_string(x, 'feed/entry/title') AS title, xpath_string(x, 'feed/entry/category/@term') AS term FROM (SELECT {_XML} AS x FROM {{part}}) AS p", "SELECT p_partkey AS id, p_name AS title, p_brand AS term FROM part", ["part"])
table_query("z23_leading_fields", "SELECT doc_id, lower(regexp_extract(text, '^([A-Za-z]+)', 1)) AS first_word, length(split_part(text, '\n', 1)) AS first_line FROM {documents} WHERE text IS NOT NULL", "SELECT doc_id, lower(regexp_extract(text, '^([A-Za-z]+)', 1)) AS first_word, CAST(length(split_part(text, chr(10), 1)) AS INT) AS first_line FROM documents WHERE text IS NOT NULL", ["documents"])
table_query("a39_verdict_tally", "SELECT CASE WHEN k % 3 = 0 THEN 'positive' WHEN k % 3 = 1 THEN 'negative' ELSE 'open' END AS verdict, count(*) AS n, min(event_id) AS first FROM (SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k FROM {events}) AS e WHERE k IS NOT NULL GROUP BY CASE WHEN k % 3 = 0 THEN 'positive' WHEN k % 3 = 1 THEN 'negative' ELSE 'open' END", "SELECT CASE WHEN k % 3 = 0 THEN 'positive' WHEN k % 3 = 1 THEN 'negative' ELSE 'open' END AS verdict, count(*) AS n, min(event_id) AS first FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) AS e WHERE k IS NOT NULL GROUP BY 1", ["events"])
table_query("a34_report_lines", *(f"SELECT symbol, concat(symbol, ': ', CAST(count(*) AS {t}), ' trades, ', CAST(CAST(round(100 * avg(CASE WHEN r > 0 THEN 1 ELSE 0 END)) AS INT) AS {t}), ' % won, last ', CAST(max(day) AS {t})) AS line FROM ({o}) AS t GROUP BY symbol" for t, o in zip(("STRING", "VARCHAR"), OPENING, strict=True)), ["bars"])
table_query("a35_report_fields", *(f"SELECT day, count(*) AS opened, sum(CASE WHEN reason = 'stop' THEN 1 ELSE 0 END) AS stopped, sum(CASE WHEN reason = 'take' THEN 1 ELSE 0 END) AS taken, round(sum(r), 6) + 0.0 AS r, {b} AS best FROM ({o}) AS t GROUP BY day" for o, b in zip(OPENING, ("max_by(symbol, struct(r, symbol))", "max_by(symbol, row(r, symbol))"), strict=True)), ["bars"])
table_query("a22_report_cube", f"SELECT symbol, CAST(y AS INT) AS y, count(*) AS n, round(sum(r), 5) + 0.0 AS total, round(avg(r), 7) + 0.0 AS mean_r FROM (SELECT symbol, year(ts) AS y, r FROM {_PNL} AS p WHERE r IS NOT NULL) AS q GROUP BY CUBE(symbol, y)", None, ["days"])
#: The best of what may be kept without two alike: one after the other by strength, each against all kept before.
table_query("s22_availability", "SELECT s.symbol, f.minutes, coalesce(n, 0) AS bars, CASE WHEN coalesce(n, 0) >= 60 THEN 1 ELSE 0 END AS usable FROM (SELECT DISTINCT event_type AS symbol FROM {events}) AS s CROSS JOIN (VALUES (60), (240), (1440)) AS f(minutes) LEFT JOIN (SELECT event_type, m, count(*) AS n FROM (SELECT DISTINCT event_type, m, floor(unix_seconds(CAST(ts AS TIMESTAMP)) / (m * 60)) AS bin FROM {events} CROSS JOIN (VALUES (60), (240), (1440)) AS v(m)) AS b GROUP BY event_type, m) AS c ON s.symbol = c.event_type AND f.minutes = c.m", "SELECT s.symbol, f.minutes, coalesce(n, 0) AS bars, CASE WHEN coalesce(n, 0) >= 60 THEN 1 ELSE 0 END AS usable FROM (SELECT DISTINCT event_type AS symbol FROM events) AS s CROSS JOIN (VALUES (60), (240), (1440)) AS f(minutes) LEFT JOIN (SELECT event_type, m, count(*) AS n FROM (SELECT DISTINCT event_type, m, floor(floor(epoch(ts)) / (m * 60)) AS bin FROM events CROSS JOIN (VALUES (60), (240), (1440)) AS v(m)) AS b GROUP BY event_type, m) AS c ON s.symbol = c.event_type AND f.minutes = c.m", ["events"])
table_query("s17_wide_panel", "SELECT CAST(ts AS DATE) AS day, " + ", ".join(f"max_by(CASE WHEN symbol = '{s}' THEN close END, CASE WHEN symbol = '{s}' THEN ts END) AS {s}" for s in ("click", "purchase", "signup")) + " FROM {bars} GROUP BY CAST(ts AS DATE)", None, ["bars"])
table_query("s18_spreads_in_bps", "SELECT symbol, round(10000 * median(high - low) / avg(close), 4) AS bps FROM {bars} WHERE high > low GROUP BY symbol", None, ["bars"])
table_query("s20_tick_bars_by_side", "SELECT event_type AS symbol, date_trunc('hour', ts) AS h, count(*) AS ticks, round(avg(spread), 6) AS spread_mean, round(max(spread), 6) AS spread_max, round(sqrt(sum(r * r)), 5) AS volatility FROM (SELECT *, ln(mid) - ln(lag(mid) OVER (PARTITION BY event_type ORDER BY ts, event_id)) AS r FROM (SELECT event_type, event_id, ts, value AS mid, CAST(0.0137217 AS DOUBLE) * value + CAST(0.00113171 AS DOUBLE) * (event_id % 7) AS spread FROM {events} WHERE value > 0) AS q) AS t GROUP BY event_type, date_trunc('hour', ts)", None, ["events"])
table_query("s23_source_priority", "SELECT symbol, ts, close, src FROM (SELECT symbol, ts, close, src, row_number() OVER (PARTITION BY symbol, ts ORDER BY src) AS n FROM (SELECT symbol, ts, close, 1 AS src FROM {bars} WHERE volume >= 2 UNION ALL SELECT symbol, ts, close, 2 FROM {bars} UNION ALL SELECT event_type, date_trunc('hour', ts), max(value), 3 FROM {events} GROUP BY event_type, date_trunc('hour', ts)) AS u) AS v WHERE n = 1", None, ["bars", "events"])
table_query("s24_finer_bars", "SELECT symbol, m, bin, min_by(value, struct(ts, event_id)) AS open, max(value) AS high, min(value) AS low, max_by(value, struct(ts, event_id)) AS close FROM (SELECT event_type AS symbol, m, event_id, ts, value, CAST(floor(unix_seconds(CAST(ts AS TIMESTAMP)) / (m * 60)) AS BIGINT) AS bin FROM {events} CROSS JOIN (VALUES (5), (15), (30)) AS v(m) WHERE value IS NOT NULL) AS e GROUP BY symbol, m, bin", "SELECT symbol, m, bin, min_by(value, row(ts, event_id)) AS open, max(value) AS high, min(value) AS low, max_by(value, row(ts, event_id)) AS close FROM (SELECT event_type AS symbol, m, event_id, ts, value, CAST(floor(floor(epoch(ts)) / (m * 60)) AS BIGINT) AS bin FROM events CROSS JOIN (VALUES (5), (15), (30)) AS v(m) WHERE value IS NOT NULL) AS e GROUP BY symbol, m, bin", ["events"])
table_query("s25_finer_else_coarser", "SELECT d.symbol, d.day, CASE WHEN n >= 6 THEN 'fine' ELSE 'coarse' END AS source, CASE WHEN n >= 6 THEN fine ELSE coarse END AS close FROM (SELECT symbol, CAST(ts AS DATE) AS day, count(*) AS n, max_by(close, ts) AS fine FROM {bars} GROUP BY symbol, CAST(ts AS DATE)) AS d JOIN (SELECT event_type, CAST(ts AS DATE) AS day, round(avg(value), 6) AS coarse FROM {events} GROUP BY event_type, CAST(ts AS DATE)) AS c ON d.symbol = c.event_type AND d.day = c.day", None, ["bars", "events"])
table_query("s27_true_utc_bars", "SELECT symbol, convert_timezone('Europe/Athens', 'UTC', ts) AS utc, close FROM {bars}", "SELECT symbol, timezone('UTC', timezone('Europe/Athens', ts)) AS utc, close FROM {bars}", ["bars"])

#: A synthetic market beside each symbol: a walk of drawn steps over the hours of its events, weekends left out.
_STEP = tuple(f"({NUMBER[d].format(f'concat(symbol, chr(58), CAST(i AS {t}))')} % 2001 - 1000) / CAST(1000 AS DOUBLE) * 0.0006" for d, t in ((False, "STRING"), (True, "VARCHAR")))
_HOURS = ("explode(sequence(lo, hi, INTERVAL 1 HOUR))", "unnest(generate_series(lo, hi, INTERVAL 1 HOUR))")
_SHUT = ("weekday(t) = 5 OR (weekday(t) = 4 AND hour(t) >= 22) OR (weekday(t) = 6 AND hour(t) < 22)", "isodow(t) = 6 OR (isodow(t) = 5 AND hour(t) >= 22) OR (isodow(t) = 7 AND hour(t) < 22)")
table_query("s39_synthetic_series", *(f"SELECT symbol, t AS ts, round(exp(sum({s}) OVER (PARTITION BY symbol ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 9) AS close FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY t) AS i FROM (SELECT symbol, {h} AS t FROM (SELECT event_type AS symbol, date_trunc('hour', min(ts)) AS lo, date_trunc('hour', max(ts)) AS hi FROM {{events}} GROUP BY event_type) AS r) AS g WHERE NOT ({c})) AS n" for s, h, c in zip(_STEP, _HOURS, _SHUT, strict=True)), ["events"])
