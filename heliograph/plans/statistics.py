"""Signal statistics, tests against chance, portfolios and costs.

Where one window over all rows would be one task, rows are dealt into bins by
value first: a bin's rank begins where the bins below end, and only one count a
bin is gathered. DuckDB's side keeps the plain window.
"""

from __future__ import annotations

from heliograph.plans.registry import table_query
from heliograph.plans.tables import _PNL
from heliograph.plans.trades import OPENING

#: Pairs a block needs, and blocks a symbol needs.
PAIRS, LEAST_BLOCKS, BLOCK = 20, 8, 50
_S = "SELECT symbol, ts, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS rn, -(close - open) AS s, lead(close) OVER (PARTITION BY symbol ORDER BY ts) / close - 1 AS f FROM {bars}"
_MID = "rank() OVER (PARTITION BY {p} ORDER BY {x}) + (count(*) OVER (PARTITION BY {p}, {x}) - 1) / CAST(2 AS DOUBLE)"


def block_ic(rows: str) -> str:
    """Mean product of standardised ranks (of the whole series) in blocks of rows."""
    ranked = f"SELECT symbol, CAST(floor(rn / {BLOCK}) AS BIGINT) AS blk, {_MID.format(p='symbol', x='s')} AS rs, {_MID.format(p='symbol', x='f')} AS rf, count(*) OVER (PARTITION BY symbol) AS n FROM ({rows}) AS a WHERE s IS NOT NULL AND f IS NOT NULL"
    product = f"SELECT symbol, blk, (rs - avg(rs) OVER (PARTITION BY symbol)) / nullif(stddev_pop(rs) OVER (PARTITION BY symbol), 0) * (rf - avg(rf) OVER (PARTITION BY symbol)) / nullif(stddev_pop(rf) OVER (PARTITION BY symbol), 0) AS z, n FROM ({ranked}) AS b WHERE n >= {PAIRS * LEAST_BLOCKS}"
    return f"SELECT symbol, blk, avg(z) AS ic, max(n) AS n_obs FROM ({product}) AS c GROUP BY symbol, blk HAVING count(*) >= {PAIRS}"


def newey_west(blocks: str, lag: int) -> str:
    """t of the blocks' mean, with weights falling to 0 beyond ``lag``."""
    d = f"SELECT symbol, blk, ic, avg(ic) OVER (PARTITION BY symbol) AS mu, ic - avg(ic) OVER (PARTITION BY symbol) AS d, count(*) OVER (PARTITION BY symbol) AS n FROM ({blocks}) AS q"
    lags = ", ".join(f"lag(d, {k}) OVER (PARTITION BY symbol ORDER BY blk) AS d{k}" for k in range(1, lag + 1))
    var = " + ".join(["sum(d * d) / max(n)", *(f"2 * CAST({1 - k / (lag + 1)} AS DOUBLE) * sum(d * coalesce(d{k}, 0)) / max(n)" for k in range(1, lag + 1))])
    return f"SELECT symbol, max(mu) AS mu, max(n) AS n, {var} AS var FROM (SELECT *, {lags} FROM ({d}) AS r) AS s GROUP BY symbol HAVING max(n) >= {LEAST_BLOCKS}"


BLOCKS = block_ic(_S)
table_query("i01_block_ic_guarded", f"SELECT symbol, blk, round(ic, 6) + 0.0 AS ic, n_obs FROM ({BLOCKS}) AS q", None, ["bars"])
table_query("i02_block_ic_naive", f"SELECT symbol, blk, round(covar_pop(rs, rf) / nullif(sqrt(var_pop(rs) * var_pop(rf)), 0), 6) + 0.0 AS ic FROM (SELECT symbol, blk, {_MID.format(p='symbol, blk', x='s')} AS rs, {_MID.format(p='symbol, blk', x='f')} AS rf FROM (SELECT symbol, CAST(floor(rn / {BLOCK}) AS BIGINT) AS blk, s, f FROM ({_S}) AS a WHERE s IS NOT NULL AND f IS NOT NULL) AS b) AS c GROUP BY symbol, blk HAVING count(*) >= {PAIRS}", None, ["bars"])
table_query("i03_newey_west_lag3", f"SELECT symbol, CASE WHEN var > 0 THEN round(mu / sqrt(var / n), 6) + 0.0 END AS t FROM ({newey_west(BLOCKS, 3)}) AS w", None, ["bars"])
_QUARTERS = f"SELECT symbol, q, avg(ic) AS part, max(mu) AS mu FROM (SELECT symbol, ic, avg(ic) OVER (PARTITION BY symbol) AS mu, ntile(4) OVER (PARTITION BY symbol ORDER BY blk) AS q FROM ({BLOCKS}) AS b) AS c GROUP BY symbol, q"
_IC = f"SELECT a.symbol AS symbol, n_obs, n_blocks, ic_mean, ic_std, ic_mean / nullif(ic_std, 0) AS ir, ic_mean / nullif(ic_std, 0) * sqrt(n_blocks) AS t_stat, mu / sqrt(nullif(var, 0) / n) AS t_nw, stability, same_sign FROM (SELECT symbol, max(n_obs) AS n_obs, count(*) AS n_blocks, avg(ic) AS ic_mean, stddev_samp(ic) AS ic_std, avg(CASE WHEN sign(ic) = sign(mu) THEN 1 ELSE 0 END) AS stability FROM (SELECT *, avg(ic) OVER (PARTITION BY symbol) AS mu FROM ({BLOCKS}) AS b) AS m GROUP BY symbol HAVING count(*) >= {LEAST_BLOCKS}) AS a JOIN ({newey_west(BLOCKS, 1)}) AS w ON a.symbol = w.symbol JOIN (SELECT symbol, sum(CASE WHEN sign(part) = sign(mu) AND part <> 0 THEN 1 ELSE 0 END) AS same_sign FROM ({_QUARTERS}) AS q GROUP BY symbol) AS s ON a.symbol = s.symbol"
table_query("i04_ic_summary_quarters", f"SELECT symbol, n_obs, n_blocks, round(ic_mean, 6) + 0.0 AS ic_mean, round(ir, 6) + 0.0 AS ir, round(t_stat, 6) + 0.0 AS t_stat, round(t_nw, 6) + 0.0 AS t_nw, round(least(abs(t_stat), abs(t_nw)) * sign(t_stat), 6) + 0.0 AS t_gate, round(stability, 6) AS stability, CAST(same_sign AS BIGINT) AS same_sign FROM ({_IC}) AS i", None, ["bars"])
table_query("i05_lag_choice", f"SELECT DISTINCT p_size AS k, CAST(least(4, greatest(1, ceil(p_size / CAST({BLOCK} AS DOUBLE)))) AS INT) AS nw_lag FROM {{part}}", None, ["part"])
table_query("p18_ic_gate", f"SELECT symbol, CASE WHEN abs(ic_mean) >= 0.01 AND abs(t_stat) >= 0.5 AND same_sign >= 2 AND n_obs >= 160 THEN 1 ELSE 0 END AS passed FROM ({_IC}) AS i", None, ["bars"])
#: A round trip costs the median spread, and with slippage half as much again.
_RT = "SELECT symbol, 10000 * median(high - low) / avg(close) AS bps FROM {bars} WHERE high > low GROUP BY symbol"
table_query("p17_edge_to_cost", f"SELECT i.symbol AS symbol, round(abs(ic_mean) * sigma, 6) AS edge_bps, round(abs(ic_mean) * sigma / (1.5 * bps), 6) AS edge_to_cost, round(abs(ic_mean) * sigma / bps, 6) AS edge_to_cost_no_slip FROM ({_IC}) AS i JOIN (SELECT symbol, 10000 * stddev_pop(f) AS sigma FROM ({_S}) AS a GROUP BY symbol) AS d ON i.symbol = d.symbol JOIN ({_RT}) AS c ON i.symbol = c.symbol", None, ["bars"])

# --- p-values: Student's distribution by its finite series for whole degrees of freedom
_T = "SELECT l_partkey, count(*) - 1 AS df, avg(l_discount - 0.05) / nullif(stddev_samp(l_discount), 0) * sqrt(count(*)) AS t FROM {lineitem} GROUP BY l_partkey HAVING count(*) >= 3 AND stddev_samp(l_discount) > 0"
_ANGLE = f"SELECT l_partkey, df, t, atan(abs(t) / sqrt(df)) AS th, df / (df + t * t) AS c2 FROM ({_T}) AS x"
_ODD = "aggregate(sequence(1, greatest(CAST((df - 3) / 2 AS INT), 1)), struct(CAST(1 AS DOUBLE) AS a, CAST(1 AS DOUBLE) AS s), (acc, k) -> struct(acc.a * c2 * 2 * k / (2 * k + 1) AS a, acc.s + CASE WHEN k <= (df - 3) / 2 THEN acc.a * c2 * 2 * k / (2 * k + 1) ELSE 0 END AS s), acc -> acc.s)"
_EVEN = "aggregate(sequence(1, greatest(CAST((df - 2) / 2 AS INT), 1)), struct(CAST(1 AS DOUBLE) AS a, CAST(1 AS DOUBLE) AS s), (acc, k) -> struct(acc.a * c2 * (2 * k - 1) / (2 * k) AS a, acc.s + CASE WHEN k <= (df - 2) / 2 THEN acc.a * c2 * (2 * k - 1) / (2 * k) ELSE 0 END AS s), acc -> acc.s)"
P_SPARK = f"SELECT l_partkey, df, t, greatest(1 - CASE WHEN df % 2 = 1 THEN 2 / pi() * (th + CASE WHEN df > 1 THEN sin(th) * cos(th) * {_ODD} ELSE 0 END) ELSE sin(th) * {_EVEN} END, CAST(0 AS DOUBLE)) AS p FROM ({_ANGLE}) AS y"
P_DUCK = f"SELECT l_partkey, df, t, greatest(1 - CASE WHEN df % 2 = 1 THEN 2 / pi() * (th + coalesce(sin(th) * cos(th) * list_sum(list_transform(range(0, CAST((df - 3) // 2 AS BIGINT) + 1), lambda k: exp(lgamma(k + 1) - lgamma(k + 1.5) + ln(pi()) / 2 - ln(2)) * pow(c2, k))), 0)) ELSE sin(th) * list_sum(list_transform(range(0, CAST((df - 2) // 2 AS BIGINT) + 1), lambda k: exp(lgamma(k + 0.5) - lgamma(k + 1) - ln(pi()) / 2) * pow(c2, k))) END, CAST(0 AS DOUBLE)) AS p FROM ({_ANGLE}) AS y"
table_query("i08_two_sided_p", f"SELECT l_partkey, df, round(t, 6) + 0.0 AS t, round(p, 9) AS p FROM ({P_SPARK}) AS z", f"SELECT l_partkey, df, round(t, 6) + 0.0 AS t, round(p, 9) AS p FROM ({P_DUCK}) AS z", ["lineitem"])


def binned_rank(rows: str, value: str, key: str, bins: int = 1024) -> str:
    """``rows`` (with ``value``) with ``rk``, the row number in the order of value and key, and ``m``, the count of all rows."""
    low = f"SELECT min({value}) AS lo, max({value}) AS hi FROM ({rows}) AS x"
    dealt = f"SELECT x.*, CAST(CASE WHEN hi > lo THEN least(floor(({value} - lo) / (hi - lo) * {bins}), {bins - 1}) ELSE 0 END AS INT) AS bin FROM ({rows}) AS x CROSS JOIN ({low}) AS b"
    counts = f"SELECT bin, sum(n) OVER (ORDER BY bin) - n AS below, sum(n) OVER () AS m FROM (SELECT bin, count(*) AS n FROM ({dealt}) AS d GROUP BY bin) AS c"
    return f"SELECT d.*, c.below + row_number() OVER (PARTITION BY d.bin ORDER BY {value}, {key}) AS rk, c.m FROM ({dealt}) AS d JOIN ({counts}) AS c ON d.bin = c.bin"


_Q = f"SELECT l_partkey, bin, rk, least(CAST(1 AS DOUBLE), p * m / rk) AS q FROM ({binned_rank(f'SELECT l_partkey, p FROM ({P_SPARK}) AS z', 'p', 'l_partkey')}) AS r"
table_query(
    "i09_q_values",
    f"WITH q AS ({_Q}), later AS (SELECT bin, min(lowest) OVER (ORDER BY bin ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after FROM (SELECT bin, min(q) AS lowest FROM q GROUP BY bin) AS b) SELECT l_partkey, round(least(min(q) OVER (PARTITION BY q.bin ORDER BY rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), coalesce(after, 1)), 8) AS q FROM q JOIN later ON q.bin = later.bin",
    f"SELECT l_partkey, round(min(least(1.0, p * m / rk)) OVER (ORDER BY rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 8) AS q FROM (SELECT l_partkey, p, row_number() OVER (ORDER BY p, l_partkey) AS rk, count(*) OVER () AS m FROM ({P_DUCK}) AS z) AS r",
    ["lineitem"],
)

# --- gates and exact tests
_YEARS = f"SELECT symbol, count(*) AS years, sum(CASE WHEN s > 0 THEN 1 ELSE 0 END) AS up FROM (SELECT symbol, year(ts) AS y, sum(r) AS s FROM {_PNL} AS p GROUP BY symbol, year(ts)) AS q GROUP BY symbol"
_CORR = f"SELECT a.symbol AS symbol, corr(a.r, b.r) AS rho FROM (SELECT d.symbol, d.ts, coalesce(r, 0) AS r FROM (SELECT s.symbol, t.ts FROM (SELECT DISTINCT symbol FROM {{days}}) AS s CROSS JOIN (SELECT DISTINCT ts FROM {{days}}) AS t) AS d LEFT JOIN {_PNL} AS p ON p.symbol = d.symbol AND p.ts = d.ts) AS a JOIN (SELECT t.ts, coalesce(r, 0) AS r FROM (SELECT DISTINCT ts FROM {{days}}) AS t LEFT JOIN (SELECT * FROM {_PNL} AS p WHERE symbol = 'AF') AS f ON t.ts = f.ts) AS b ON a.ts = b.ts GROUP BY a.symbol"
table_query("i10_edge_gate", f"SELECT symbol, n, round(t, 6) + 0.0 AS t, round(rho, 6) + 0.0 AS rho, up, years, CASE WHEN n >= 30 AND t > 0.5 AND mean > 0 AND up >= 0.5 * years AND (symbol = 'AF' OR abs(rho) < 0.3) THEN 1 ELSE 0 END AS passed FROM (SELECT s.symbol AS symbol, n, mean, t, rho, CAST(up AS BIGINT) AS up, years FROM (SELECT symbol, count(r) AS n, avg(r) AS mean, avg(r) / nullif(stddev_samp(r), 0) * sqrt(count(r)) AS t FROM {_PNL} AS p GROUP BY symbol) AS s JOIN ({_YEARS}) AS y ON s.symbol = y.symbol JOIN ({_CORR}) AS c ON s.symbol = c.symbol) AS g", None, ["days"])
_CELLS = "SELECT lang, CAST(count_if(quality = 1 AND n_chars > 900) AS BIGINT) AS a, CAST(count_if(quality = 1) AS BIGINT) AS row1, CAST(count_if(n_chars > 900) AS BIGINT) AS col1, count(*) AS n FROM {labels} AS l JOIN {documents} AS d ON l.doc_id = d.doc_id GROUP BY lang"
_LF = "aggregate(sequence(1, greatest(CAST({} AS INT), 1)), CAST(0 AS DOUBLE), (s, i) -> s + ln(i))"
_HYPER = "{f1} + {f2} + {f3} + {f4} - {n} - {x1} - {x2} - {x3} - {x4}"
_ARGS = {"f1": "row1", "f2": "col1", "f3": "n - row1", "f4": "n - col1", "n": "n", "x1": "{x}", "x2": "row1 - {x}", "x3": "col1 - {x}", "x4": "n - row1 - col1 + {x}"}
_FIRST = "exp(" + _HYPER.format(**{k: _LF.format(v.format(x="a")) for k, v in _ARGS.items()}) + ")"
_TAIL = "aggregate(sequence(a, greatest(least(row1, col1), a)), struct({first} AS t, CAST(0 AS DOUBLE) AS s), (acc, x) -> struct(acc.t * (row1 - x) * (col1 - x) / ((x + 1) * CAST(n - row1 - col1 + x + 1 AS DOUBLE)) AS t, acc.s + acc.t AS s), acc -> acc.s)"
table_query("i12_fisher_exact", f"SELECT lang, a, row1, col1, n, round({_TAIL.format(first='first')}, 8) AS p_greater FROM (SELECT *, {_FIRST} AS first FROM ({_CELLS}) AS c) AS f", "SELECT lang, a, row1, col1, n, round(list_sum(list_transform(range(a, least(row1, col1) + 1), lambda x: exp(" + _HYPER.format(**{k: f"lgamma({v.format(x='x')} + 1)" for k, v in _ARGS.items()}) + f"))), 8) AS p_greater FROM ({_CELLS}) AS c", ["labels", "documents"])

# --- for resampling (``heliograph.plans.nulls``)
#: The book's result by day.
_BOOK = f"SELECT day, r, row_number() OVER (ORDER BY day) - 1 AS i, count(*) OVER () AS n FROM (SELECT CAST(ts AS DATE) AS day, sum(coalesce(r, 0)) AS r FROM {_PNL} AS p GROUP BY CAST(ts AS DATE)) AS b"


# --- windows that were one task
_TILE = "CASE WHEN rk <= (m % 4) * (floor(m / 4) + 1) THEN ceil(rk / (floor(m / 4) + 1)) ELSE m % 4 + ceil((rk - (m % 4) * (floor(m / 4) + 1)) / floor(m / 4)) END"
table_query("a28_quartile_bins", f"SELECT CAST(q AS INT) AS q, count(*) AS n, round(avg(o_totalprice), 4) AS mean_price FROM (SELECT o_totalprice, {_TILE} AS q FROM ({binned_rank('SELECT o_orderkey, o_totalprice FROM {orders}', 'o_totalprice', 'o_orderkey')}) AS r) AS t GROUP BY q", "SELECT q, count(*) AS n, round(avg(o_totalprice), 4) AS mean_price FROM (SELECT o_totalprice, ntile(4) OVER (ORDER BY o_totalprice, o_orderkey) AS q FROM orders) AS o GROUP BY q", ["orders"])
table_query("m07_auc", "SELECT round(CAST((sum(pos * (below + (pos + neg + 1) / 2.0)) - np * (np + 1) / 2.0) / (np * nn) AS DOUBLE), 6) AS auc FROM (SELECT n_chars, pos, neg, sum(pos + neg) OVER (ORDER BY n_chars) - pos - neg AS below, sum(pos) OVER () AS np, sum(neg) OVER () AS nn FROM (SELECT n_chars, count_if(quality = 1) AS pos, count_if(quality = 0) AS neg FROM {labels} AS l JOIN {documents} AS d ON l.doc_id = d.doc_id GROUP BY n_chars) AS v) AS s GROUP BY np, nn", "SELECT round(CAST((sum(CASE WHEN quality = 1 THEN rk END) - np * (np + 1) / 2.0) / (np * nn) AS DOUBLE), 6) AS auc FROM (SELECT quality, rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2.0 AS rk, count_if(quality = 1) OVER () AS np, count_if(quality = 0) OVER () AS nn FROM labels AS l JOIN documents AS d ON l.doc_id = d.doc_id) AS s GROUP BY np, nn", ["labels", "documents"])
#: Users' events in slices of an hour, each with what lies within 180 seconds of it: the last and the next event of another type.
_NEAR = "SELECT event_id, user_id, event_type, s, floor(s / 3600) AS own, explode(array_distinct(array(floor(s / 3600), floor((s - 180) / 3600), floor((s + 180) / 3600)))) AS cell FROM (SELECT *, unix_micros(CAST(ts AS TIMESTAMP)) / 1e6 AS s FROM {events}) AS e"
_ISLES = f"SELECT *, sum(new) OVER (PARTITION BY user_id, cell ORDER BY s, event_type, event_id) AS isle FROM (SELECT *, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id, cell ORDER BY s, event_type, event_id) THEN 0 ELSE 1 END AS new FROM ({_NEAR}) AS n) AS m"
_ENDS = f"SELECT *, lag(last_s) OVER (PARTITION BY user_id, cell ORDER BY isle) AS before, lead(first_s) OVER (PARTITION BY user_id, cell ORDER BY isle) AS after FROM (SELECT user_id, cell, isle, min(s) AS first_s, max(s) AS last_s FROM ({_ISLES}) AS i GROUP BY user_id, cell, isle) AS j"
table_query("j17_time_tolerance", f"SELECT event_id FROM ({_ISLES}) AS i JOIN ({_ENDS}) AS e ON i.user_id = e.user_id AND i.cell = e.cell AND i.isle = e.isle WHERE own = i.cell AND (s - before <= 180 OR after - s <= 180)", "SELECT DISTINCT a.event_id FROM events AS a JOIN events AS b ON a.user_id = b.user_id AND b.event_type <> a.event_type AND b.ts BETWEEN a.ts - INTERVAL 180 SECONDS AND a.ts + INTERVAL 180 SECONDS", ["events"])
_ROW = "concat(CAST(event_id AS {t}), ':', CAST(CAST(round(value * 100) AS BIGINT) AS {t}))"
table_query("p10_dataset_hash", f"SELECT event_type, sha2(array_join(transform(array_sort(collect_list(struct(part, digest))), x -> x.digest), ','), 256) AS digest FROM (SELECT event_type, floor(event_id / 10000) AS part, sha2(array_join(transform(array_sort(collect_list(struct(event_id, {_ROW.format(t='STRING')} AS line))), x -> x.line), ','), 256) AS digest FROM {{events}} GROUP BY event_type, floor(event_id / 10000)) AS p GROUP BY event_type", f"SELECT event_type, sha256(string_agg(digest, ',' ORDER BY part)) AS digest FROM (SELECT event_type, event_id // 10000 AS part, sha256(string_agg({_ROW.format(t='VARCHAR')}, ',' ORDER BY event_id)) AS digest FROM events GROUP BY event_type, event_id // 10000) AS p GROUP BY event_type", ["events"])

# --- costs, weights and sizes
#: Swap units from entry to exit: weekday nights, three on the triple day; then two commissions. In units of the stop.
_UNITS = ("aggregate(sequence(0, held), 0, (u, i) -> u + CASE WHEN i >= held THEN 0 ELSE CASE weekday(date_add(day, i)) WHEN 2 THEN 3 WHEN 5 THEN 0 WHEN 6 THEN 0 ELSE 1 END END)", "coalesce(list_sum(list_transform(range(0, CAST(held AS BIGINT)), lambda i: CASE isodow(day + CAST(i AS INT)) WHEN 3 THEN 3 WHEN 6 THEN 0 WHEN 7 THEN 0 ELSE 1 END)), 0)")
_TRADES = "SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS day, CAST(l_linenumber AS INT) + 2 AS held, CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS side, l_extendedprice / l_quantity AS entry, 0.02 * l_extendedprice / l_quantity AS stop FROM {lineitem}"
_COST = "({u}) * (CASE WHEN side > 0 THEN CAST(6.5 AS DOUBLE) ELSE CAST(3.5 AS DOUBLE) END / 100 / 360) / (stop / entry) + 2 * CAST(0.0007 AS DOUBLE) / (stop / entry)"
table_query("f08_trade_cost", *(f"SELECT l_orderkey, l_linenumber, round(coalesce({_COST.format(u=u)}, 0), 9) AS cost FROM ({_TRADES}) AS t" for u in _UNITS), ["lineitem"])
_OUT = "date_add(day, held)", "CAST(day + CAST(held AS INT) AS DATE)"
_DAYS_OUT = tuple(f"SELECT {o} AS day, sum(coalesce({_COST.format(u=u)}, 0)) AS cost FROM ({_TRADES}) AS t GROUP BY {o}" for u, o in zip(_UNITS, _OUT, strict=True))
table_query("f09_daily_cost", *(f"SELECT g.day, round(coalesce(c.cost, 0), 5) AS cost FROM ({g}) AS g LEFT JOIN ({d}) AS c ON g.day = c.day" for g, d in zip((f"SELECT explode(sequence(min(day), max(day), INTERVAL 1 DAY)) AS day FROM ({_DAYS_OUT[0]}) AS a", f"SELECT CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM ({_DAYS_OUT[1]}) AS a"), _DAYS_OUT, strict=True)), ["lineitem"])
_LOTS = "SELECT o_orderkey, o_totalprice / 200 AS per_lot, greatest(CAST(0.1 AS DOUBLE), floor(500 / (o_totalprice / 200) / CAST(0.1 AS DOUBLE) + 0.5) * CAST(0.1 AS DOUBLE)) AS lots FROM {orders} WHERE o_totalprice > 0"
table_query("f07_lot_sizing_nearest", f"SELECT o_orderkey, round(CASE WHEN lots * per_lot > 1.25 * 500 THEN 0 ELSE lots END, 6) AS lots FROM ({_LOTS}) AS l", None, ["orders"])
_VOL = f"SELECT symbol, CASE WHEN v > 0 THEN 1 / v ELSE 0 END AS i FROM (SELECT symbol, stddev_pop(r) AS v FROM {_PNL} AS a GROUP BY symbol) AS b"
_PARITY = f"SELECT symbol, CASE WHEN sum(i) OVER () = 0 THEN 1.0 / count(*) OVER () ELSE i / nullif(sum(i) OVER (), 0) END AS w FROM ({_VOL}) AS v"
table_query("y36_parity_weights", f"SELECT symbol, round(CAST(w AS DOUBLE), 6) AS w FROM ({_PARITY}) AS p", None, ["days"])
table_query("f02_combined_equity", f"SELECT ts, round(r, 6) + 0.0 AS r, round(ln(100000) + sum(ln(1 + r)) OVER (ORDER BY ts), 5) AS log_equity FROM (SELECT ts, sum(w * coalesce(r, 0)) AS r FROM {_PNL} AS p JOIN ({_PARITY}) AS w ON p.symbol = w.symbol GROUP BY ts) AS b", None, ["days"])
_RUN = "OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_FALL = f"SELECT symbol, ts, r, max(cum) {_RUN} - cum AS dd FROM (SELECT symbol, ts, r, sum(r) {_RUN} AS cum FROM {_PNL} AS p WHERE r IS NOT NULL) AS c"
_YEAR = "(datediff(CAST(max(ts) AS DATE), CAST(min(ts) AS DATE)) / CAST(365.25 AS DOUBLE))", "(datediff('day', CAST(min(ts) AS DATE), CAST(max(ts) AS DATE)) / CAST(365.25 AS DOUBLE))"
table_query("f12_equal_risk", *(f"SELECT symbol, round(sum(r) / {y}, 5) + 0.0 AS r_per_year, round(max(dd), 6) AS max_dd, round(sum(r) / {y} / nullif(max(dd), 0), 5) + 0.0 AS romad, round(100 * (0.10 / (2 * max(dd))) * sum(r) / {y}, 4) + 0.0 AS percent, round(min(r), 6) + 0.0 AS worst FROM ({_FALL}) AS f GROUP BY symbol" for y in _YEAR), ["days"])
_LEGS = ("AF", "AO", "NF", "NO", "RF", "RO")
_MATRIX = "SELECT ts, " + ", ".join(f"coalesce(sum(CASE WHEN symbol = '{s}' THEN r END), 0) AS {s.lower()}" for s in _LEGS) + f" FROM {_PNL} AS p GROUP BY ts"
table_query("f13_daily_matrix", "SELECT ts, " + ", ".join(f"round({s.lower()}, 6) + 0.0 AS {s.lower()}" for s in _LEGS) + f" FROM ({_MATRIX}) AS m", None, ["days"])
table_query("y23_book_mixes", f"SELECT mix, round(sum(r), 5) + 0.0 AS total, round(avg(r) / nullif(stddev_samp(r), 0) * sqrt(252.0), 5) + 0.0 AS sharpe, round(min(r), 6) + 0.0 AS worst FROM (SELECT 'all' AS mix, (af + ao + nf + no + rf + ro) / 6 AS r FROM ({_MATRIX}) AS a UNION ALL SELECT 'without_ao', (af + nf + no + rf + ro) / 5 FROM ({_MATRIX}) AS b UNION ALL SELECT 'filled', (af + nf + rf) / 3 FROM ({_MATRIX}) AS c) AS m GROUP BY mix", None, ["days"])
_ACTIVE = "avg(CASE WHEN r <> 0 THEN r END) / nullif(stddev_samp(CASE WHEN r <> 0 THEN r END), 0) * sqrt(CAST(252 AS DOUBLE))"
#: A year's result at the most risk that neither a day's loss of 5 % nor a fall of 10 % forbids.
table_query("y18_scaled_returns", *(f"SELECT symbol, round(sum(r) / {y}, 5) + 0.0 AS r_per_year, round(max(dd), 6) AS max_dd, round(sum(r) / {y} / nullif(max(dd), 0), 5) + 0.0 AS romad, round({_ACTIVE}, 5) + 0.0 AS sharpe, round(100 * (sum(r) / {y}) * least(0.05 / nullif(abs(min(r)), 0), 0.10 / nullif(max(dd), 0)), 4) + 0.0 AS percent FROM ({_FALL}) AS f GROUP BY symbol" for y in _YEAR), ["days"])
#: Trades of a candidate with what they gain before costs, and prices of spread and slippage (basis points), nights and commission.
_CANDIDATES = _TRADES.replace("SELECT l_orderkey", "SELECT concat(l_returnflag, l_linestatus) AS symbol, (l_tax - l_discount) / 0.02 AS gross, l_orderkey")
RT_BPS, COMMISSION = 1.5 + 0.2, 0.00002


def net_of_cost(units: str, out: str, days: str, duck: bool) -> str:
    """Per symbol: nights, swap and expectancy in units of risk, a year's result, largest fall by exit day, and what gains are to losses."""
    priced = f"SELECT symbol, day, {out} AS out_day, gross, ({units}) AS nights, entry / stop AS px, side FROM ({_CANDIDATES}) AS t WHERE stop > 0"
    net = f"SELECT *, nights * (CASE WHEN side > 0 THEN CAST(6.5 AS DOUBLE) ELSE CAST(3.5 AS DOUBLE) END / 100 / 360) * px AS swap FROM ({priced}) AS p"
    costed = f"SELECT *, gross - {RT_BPS!r} / 10000 * px - swap - 2 * CAST({COMMISSION:.5f} AS DOUBLE) * px AS net FROM ({net}) AS n"
    falls = f"SELECT symbol, max(top - cum) AS fall FROM (SELECT symbol, cum, max(cum) OVER (PARTITION BY symbol ORDER BY out_day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS top FROM (SELECT symbol, out_day, sum(net) OVER (PARTITION BY symbol ORDER BY out_day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum FROM (SELECT symbol, out_day, sum(net) AS net FROM ({costed}) AS c GROUP BY symbol, out_day) AS d) AS e) AS f GROUP BY symbol"
    median = "median(swap)" if duck else "percentile(swap, 0.5)"
    whole = f"SELECT symbol, count(*) AS n, avg(nights) AS nights, {median} AS swap, avg(net) AS er, sum(net) / greatest(CAST({days} AS DOUBLE) / 365.25, 1e-9) AS per_year, sum(CASE WHEN net > 0 THEN net ELSE 0 END) / nullif(-sum(CASE WHEN net < 0 THEN net ELSE 0 END), 0) AS pf FROM ({costed}) AS c GROUP BY symbol"
    return f"SELECT w.symbol AS symbol, n, round(nights, 6) AS nights, round(swap, 8) AS swap_r, round(er, 6) + 0.0 AS er_net, round(per_year, 3) + 0.0 AS r_per_year, round(fall, 5) + 0.0 AS max_dd, round(per_year / nullif(fall, 0), 5) + 0.0 AS romad, round(pf, 5) AS pf FROM ({whole}) AS w JOIN ({falls}) AS f ON w.symbol = f.symbol"


table_query("y22_net_of_cost", *(net_of_cost(u, o, d, k) for u, o, d, k in zip(_UNITS, _OUT, ("datediff(max(out_day), min(day))", "datediff('day', min(day), max(out_day))"), (False, True), strict=True)), ["lineitem"])
_C05 = "SELECT m, k, CASE WHEN hi <= q THEN CAST(0.5 AS DOUBLE) / q WHEN lo <= q THEN CAST(-0.5 AS DOUBLE) / q ELSE 0 END AS w, v FROM (SELECT *, greatest(CAST(floor(n * CAST(0.2 AS DOUBLE) + 0.5) AS INT), 2) AS q FROM (SELECT m, k, v, count(*) OVER (PARTITION BY m) AS n, row_number() OVER (PARTITION BY m ORDER BY v DESC, k) AS hi, row_number() OVER (PARTITION BY m ORDER BY v, k) AS lo FROM {p} AS p) AS r) AS s"
_PANEL = "(SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS m, c_nationkey AS k, sum(o_totalprice) AS v FROM {orders} AS o JOIN {customer} AS c ON o_custkey = c_custkey GROUP BY CAST(date_trunc('month', o_orderdate) AS DATE), c_nationkey)"
_QW = _C05.replace("{p}", _PANEL)
table_query("c05_quantile_weights", f"SELECT m, k, round(w, 9) + 0.0 AS w FROM ({_QW}) AS w", None, ["orders", "customer"])
_NEXT = "SELECT m, k, w, lead(v) OVER (PARTITION BY k ORDER BY m) / v - 1 AS f, lag(w) OVER (PARTITION BY k ORDER BY m) AS wp, v FROM (" + _QW + ") AS w"
table_query("c09_single_factor", f"SELECT m, round(sum(w * coalesce(f, 0)), 6) + 0.0 AS gross, round(sum(w * coalesce(f, 0)) - sum(abs(w - coalesce(wp, 0))) * 0.001, 6) + 0.0 AS net FROM ({_NEXT}) AS n GROUP BY m", None, ["orders", "customer"])
table_query("j16_turnover", f"SELECT m, round(sum(abs(w - coalesce(wp, 0))), 6) AS turnover FROM ({_NEXT}) AS n GROUP BY m", None, ["orders", "customer"])
_XS = "SELECT day, symbol, o10 / o9 - 1 AS sig, o11 / o10 - 1 AS fwd FROM (SELECT CAST(ts AS DATE) AS day, symbol, max(CASE WHEN hour(ts) = 9 THEN open END) AS o9, max(CASE WHEN hour(ts) = 10 THEN open END) AS o10, max(CASE WHEN hour(ts) = 11 THEN open END) AS o11 FROM {bars} GROUP BY CAST(ts AS DATE), symbol) AS d WHERE o9 IS NOT NULL AND o10 IS NOT NULL AND o11 IS NOT NULL"
table_query("g44_morning_drive", f"SELECT day, symbol, round(sig - avg(sig) OVER (PARTITION BY day), 6) + 0.0 AS drive FROM ({_XS}) AS x", None, ["bars"])
table_query("c10_morning_long_short", f"SELECT day, count(*) AS names, round(avg(CASE WHEN hi <= 2 THEN fwd END) - avg(CASE WHEN lo <= 2 THEN fwd END), 6) + 0.0 AS gross FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY sig DESC, symbol) AS hi, row_number() OVER (PARTITION BY day ORDER BY sig, symbol) AS lo FROM ({_XS}) AS x) AS r GROUP BY day HAVING count(*) >= 4", None, ["bars"])
_IDX = "SELECT symbol, ts, ln(lag(close, 5) OVER w) - ln(lag(close, 63) OVER w) AS sig, ln(lead(close, 5) OVER w) - ln(close) AS fwd, row_number() OVER w AS n FROM {days} WINDOW w AS (PARTITION BY symbol ORDER BY ts)"
table_query("c11_rotation", f"SELECT ts, count(*) AS names, round(avg(CASE WHEN hi <= 2 THEN fwd END) - avg(CASE WHEN lo <= 2 THEN fwd END), 6) + 0.0 AS r FROM (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY sig DESC, symbol) AS hi, row_number() OVER (PARTITION BY ts ORDER BY sig, symbol) AS lo FROM ({_IDX}) AS i WHERE sig IS NOT NULL AND fwd IS NOT NULL AND n % 5 = 1) AS r GROUP BY ts HAVING count(*) >= 4", None, ["days"])
_W = "WINDOW w AS (PARTITION BY symbol ORDER BY ts), w200 AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 199 PRECEDING AND CURRENT ROW), w252 AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)"
_BREADTH = f"SELECT ts, close, CASE WHEN count(close) OVER w200 = 200 THEN avg(close) OVER w200 END AS ma, CASE WHEN count(close) OVER w252 = 252 THEN max(close) OVER w252 END AS top, ln(close) - ln(lag(close, 5) OVER w) AS r5, ln(close) - ln(lag(close) OVER w) AS r1, ln(lag(close, 21) OVER w) - ln(lag(close, 252) OVER w) AS mom FROM {{days}} {_W}"
_MARKET = f"SELECT ts, avg(CASE WHEN close > ma THEN 1 ELSE 0 END) AS above, avg(CASE WHEN r5 > 0 THEN 1 ELSE 0 END) AS adv, stddev_samp(r5) AS disp, median(mom) AS med, avg(CASE WHEN close >= top THEN 1 ELSE 0 END) AS new_high, avg(r1) AS mr FROM ({_BREADTH}) AS b GROUP BY ts"
_ROLL = "OVER (ORDER BY ts ROWS BETWEEN {} PRECEDING AND CURRENT ROW)"
table_query("w49_breadth_block", f"SELECT ts, round(above, 6) AS above, round(adv, 6) AS adv, round(disp, 6) AS dispersion, round(med, 6) + 0.0 AS median_momentum, round(new_high, 6) AS new_high, round(m5, 6) + 0.0 AS market_5, round(v20, 6) AS volatility_20, round(v20 / nullif(disp, 0), 5) AS corr_proxy FROM (SELECT *, CASE WHEN count(mr) {_ROLL.format(4)} = 5 THEN sum(mr) {_ROLL.format(4)} END AS m5, CASE WHEN count(mr) {_ROLL.format(19)} = 20 THEN stddev_samp(mr) {_ROLL.format(19)} END AS v20 FROM ({_MARKET}) AS m) AS n", None, ["days"])
#: Streaks and extremes of the opening range's trades.
_STREAKS = tuple(f"SELECT symbol, max(CASE WHEN w = 1 THEN len END) AS longest_win, max(CASE WHEN w = 0 THEN len END) AS longest_loss FROM (SELECT symbol, w, isle, count(*) AS len FROM (SELECT symbol, w, sum(chg) OVER (PARTITION BY symbol ORDER BY day) AS isle FROM (SELECT symbol, day, w, CASE WHEN w = lag(w) OVER (PARTITION BY symbol ORDER BY day) THEN 0 ELSE 1 END AS chg FROM (SELECT symbol, day, CASE WHEN r > 0 THEN 1 ELSE 0 END AS w FROM ({t}) AS t) AS a) AS b) AS c GROUP BY symbol, w, isle) AS d GROUP BY symbol" for t in OPENING)
_TRIM = tuple(f"SELECT symbol, count(*) AS n, round(avg(r), 6) + 0.0 AS er, round(avg(r) / nullif(stddev_samp(r), 0) * sqrt(count(*)), 6) + 0.0 AS t, round(max(dd), 6) + 0.0 AS max_dd, round(max(r), 6) + 0.0 AS best, round(min(r), 6) + 0.0 AS worst FROM (SELECT *, max(cum) OVER (PARTITION BY symbol ORDER BY day) - cum AS dd FROM (SELECT *, sum(r) OVER (PARTITION BY symbol ORDER BY day) AS cum FROM ({t}) AS t) AS u) AS v GROUP BY symbol" for t in OPENING)
table_query("a15_risk_metrics_with_streaks", *(f"SELECT m.*, longest_win, longest_loss FROM ({m}) AS m JOIN ({s}) AS s ON m.symbol = s.symbol" for m, s in zip(_TRIM, _STREAKS, strict=True)), ["bars"])
table_query("p19_result_gate", *(f"SELECT symbol, CASE WHEN avg(r) >= 0.05 AND count(*) >= 10 AND sum(CASE WHEN r > 0 THEN r ELSE 0 END) >= 1.05 * sum(CASE WHEN r <= 0 THEN -r ELSE 0 END) THEN 1 ELSE 0 END AS passed FROM ({t}) AS t GROUP BY symbol" for t in OPENING), ["bars"])
table_query("n09_walk_forward_report", f"SELECT symbol, fold, count_if(rn >= fold * fs AND rn < (fold + 1) * fs) AS n_test, round(avg(CASE WHEN rn < fold * fs THEN r END) / nullif(stddev_pop(CASE WHEN rn < fold * fs THEN r END), 0) * sqrt(252.0), 5) + 0.0 AS train_sharpe, round(avg(CASE WHEN rn >= fold * fs AND rn < (fold + 1) * fs THEN r END) / nullif(stddev_pop(CASE WHEN rn >= fold * fs AND rn < (fold + 1) * fs THEN r END), 0) * sqrt(252.0), 5) + 0.0 AS test_sharpe FROM (SELECT symbol, r, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS rn, floor(count(*) OVER (PARTITION BY symbol) / 5) AS fs FROM {_PNL} AS p WHERE r IS NOT NULL) AS q CROSS JOIN (VALUES (1), (2), (3), (4)) AS f(fold) GROUP BY symbol, fold", None, ["days"])
