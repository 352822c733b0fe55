"""Coarser bars on finer ones: what was known at each bar, and joins of panels. DuckDB's side uses its own as-of join."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.functions.linear import ema, fading
from heliograph.functions.series import lag, last, log_return, over, rolling, sma
from heliograph.operators.asof import as_of
from heliograph.operators.resample import resample
from heliograph.operators.staged import Stage, staged_sql, with_stages
from heliograph.plans.registry import query, rounded, table_query, without_decimals
from heliograph.plans.sweeps import RULES, grid
from heliograph.plans.trades import BOTH, OPENING
from heliograph.sources.tables import EVENT_BARS_SQL, event_bars

FEATURES: tuple[Stage, ...] = ({"r": log_return()}, {"mom": rolling("sum", "r", 5), "vol": rolling("stddev_pop", "r", 5), "pos": f"(close - min(low) {last(5)}) / nullif(max(high) {last(5)} - min(low) {last(5)}, 0)"})


def _coarse_sql(hours: int) -> str:
    return f"SELECT symbol, time_bucket(INTERVAL {hours} HOUR, ts) AS ts, min_by(open, ts) AS open, max(high) AS high, min(low) AS low, max_by(close, ts) AS close, sum(volume) AS volume FROM ({EVENT_BARS_SQL}) AS b GROUP BY symbol, time_bucket(INTERVAL {hours} HOUR, ts)"


def aligned(name: str, hours: int, stages: tuple[Stage, ...], values: list[str], delay: int, prefix: str) -> None:
    """Register: each bar with the ``values`` of the last coarse bar that was known ``delay`` hours after its start."""
    sql = f"SELECT symbol, ts + INTERVAL {delay} HOUR AS ts, {', '.join(values)} FROM ({staged_sql(_coarse_sql(hours), stages)}) AS c"
    shown = ", ".join(f"{rounded('k.' + v)} AS {prefix}{v}" for v in values)

    @query(name, f"SELECT b.symbol, b.ts, {shown} FROM ({EVENT_BARS_SQL}) AS b ASOF LEFT JOIN ({sql}) AS k ON b.symbol = k.symbol AND b.ts >= k.ts")
    def run(spark: SparkSession, folder: str) -> DataFrame:
        bars = event_bars(spark, folder)
        known = with_stages(resample(bars, hours * 60), stages).select("symbol", (F.col("ts") + F.expr(f"INTERVAL {delay} HOUR")).alias("ts"), *values)
        found = as_of(bars.select("symbol", "ts"), known, "ts", ["symbol"], values)
        return without_decimals(found.select("symbol", "ts", *(F.expr(rounded(v)).alias(f"{prefix}{v}") for v in values)))


aligned("j03_multi_frame_features", 4, FEATURES, ["mom", "vol", "pos"], 4, "h4_")
aligned("p14_prefixed_daily_features", 24, FEATURES, ["mom", "pos"], 24, "d1_")
aligned("j04_align_by_step", 6, ({"m": sma("close", 3)},), ["m"], 6, "")
aligned("j05_align_closed_bars", 2, (), ["close", "high"], 2, "h2_")
aligned("j06_shifted_then_aligned", 4, ({"before": "lag(close) OVER (PARTITION BY symbol ORDER BY ts)"},), ["before"], 4, "")
aligned("j13_daily_by_date", 24, ({"rng": "high - low"}, {"atr3": rolling("avg", "rng", 3)}), ["atr3"], 24, "")


@query("j05_two_hour_bars", _coarse_sql(2))
def two_hour_bars(spark: SparkSession, folder: str) -> DataFrame:
    """Bars of two hours from those of one."""
    return resample(event_bars(spark, folder), 120)


table_query("j10_outer_align", "SELECT coalesce(a.ts, b.ts) AS ts, round(a.close, 6) AS one, round(b.close, 6) AS other FROM (SELECT ts, close FROM {bars} WHERE symbol = 'purchase') AS a FULL OUTER JOIN (SELECT ts, close FROM {bars} WHERE symbol = 'signup') AS b ON a.ts = b.ts", None, ["bars"])
_FORWARD = "SELECT symbol, ts, round({best} - 1, 6) + 0.0 AS best, round({worst} - 1, 6) + 0.0 AS worst, count(*) OVER w AS n FROM {{bars}} WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 12 FOLLOWING)"
table_query("j19_forward_extremes", *(_FORWARD.format(best=f("max(high) OVER w", "close"), worst=f("min(low) OVER w", "close")) for f in (over, "{} / {}".format)), ["bars"])
#: The next entry that a trade from this bar leaves free: the first entry at or after the bar where it ends.
_ENTRIES = "SELECT symbol, ts, n, CASE WHEN close > open THEN n END AS entry FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS n FROM {bars}) AS b"
table_query("j20_next_free_entry", f"SELECT symbol, ts, min(entry) OVER (PARTITION BY symbol ORDER BY n ROWS BETWEEN 6 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_entry FROM ({_ENTRIES}) AS e", None, ["bars"])
table_query("p08_warm_up_rows", "SELECT symbol, count(*) AS n, min(ts) AS first FROM (SELECT symbol, ts, avg(close) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS m, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS n FROM {bars}) AS b WHERE n >= 20 AND m IS NOT NULL GROUP BY symbol", None, ["bars"])
table_query("p15_column_bind", "SELECT a.symbol, a.ts, round(a.x, 6) + 0.0 AS body, round(b.y, 6) AS span FROM (SELECT symbol, ts, close - open AS x FROM {bars}) AS a JOIN (SELECT symbol, ts, high - low AS y FROM {bars}) AS b ON a.symbol = b.symbol AND a.ts = b.ts", None, ["bars"])
table_query("p20_result_in_price", *(f"SELECT symbol, day, round(r * risk, 6) + 0.0 AS points, round(r * risk / entry * 10000, 4) + 0.0 AS bps FROM ({t}) AS t" for t in OPENING), ["bars"])
table_query("p21_nested_records", *(f"SELECT symbol, count(*) AS n, {a.size('recs')} AS kept, round({a.at('recs', '1')}.r, 6) + 0.0 AS best FROM (SELECT symbol, {g} AS recs FROM ({t}) AS t GROUP BY symbol) AS g GROUP BY symbol, recs" for a, t, g in zip(BOTH, OPENING, ("slice(reverse(array_sort(collect_list(struct(r, day)))), 1, 3)", "list({'r': r, 'day': day} ORDER BY r DESC, day DESC)[:3]"), strict=True)), ["bars"])
table_query("k03_top_by_strength", "SELECT l_partkey, round(t, 6) + 0.0 AS t FROM (SELECT l_partkey, avg(l_discount - 0.05) / nullif(stddev_samp(l_discount), 0) * sqrt(count(*)) AS t FROM {lineitem} GROUP BY l_partkey HAVING count(*) >= 3) AS x WHERE t IS NOT NULL ORDER BY abs(t) DESC, l_partkey LIMIT 25", None, ["lineitem"])
#: A rule's behaviour: its trades and mean result on every symbol, joined in order; rules of one fingerprint behave alike.
_ACTS = tuple(f"SELECT rule, symbol, count(*) AS n, CAST(round(1000 * avg(r)) AS BIGINT) AS er, sum(CASE WHEN side > 0 THEN 1 ELSE 0 END) AS longs FROM ({grid(a, '(1.5, 3.0)', list(RULES))}) AS g GROUP BY rule, symbol" for a in BOTH)
table_query("k09_behaviour_fingerprint", *(f"SELECT rule, count(*) AS symbols, md5({j}) AS fingerprint FROM (SELECT rule, symbol, concat(symbol, ':', CAST(n AS {t}), ':', CAST(er AS {t}), ':', CAST(longs AS {t})) AS piece FROM ({s}) AS s) AS p GROUP BY rule" for s, t, j in zip(_ACTS, ("STRING", "VARCHAR"), ("array_join(transform(array_sort(collect_list(struct(symbol, piece))), x -> x.piece), '|')", "string_agg(piece, '|' ORDER BY symbol)"), strict=True)), ["bars"])
table_query("a24_any_and_best", *(f"SELECT symbol, CASE WHEN max(r) > 1.5 THEN 1 ELSE 0 END AS any_big, round(max(r), 6) + 0.0 AS best FROM ({t}) AS t GROUP BY symbol" for t in OPENING), ["bars"])
table_query("a36_account_scaling", *(f"SELECT symbol, day, round(r * 500 / 100000, 8) + 0.0 AS share FROM ({t}) AS t" for t in OPENING), ["bars"])
table_query("y03_nearest_bucket", "SELECT event_id, b AS bucket FROM (SELECT event_id, b, row_number() OVER (PARTITION BY event_id ORDER BY abs(value - b), b) AS n FROM {events} CROSS JOIN (VALUES (1), (5), (10), (25), (50), (100)) AS v(b) WHERE value IS NOT NULL) AS x WHERE n = 1", None, ["events"])
table_query("y19_stats_from_date", *(f"SELECT symbol, count(*) AS n, round(avg(r), 6) + 0.0 AS er, round(avg(r) / nullif(stddev_samp(r), 0) * sqrt(count(*)), 5) + 0.0 AS t FROM ({t}) AS t WHERE day >= DATE '2024-01-10' GROUP BY symbol" for t in OPENING), ["bars"])
table_query("y29_asset_class", "SELECT symbol, CASE WHEN symbol IN ('purchase', 'signup') THEN 'conversion' WHEN symbol LIKE '%view%' THEN 'traffic' ELSE 'other' END AS asset_class, count(*) AS n FROM {bars} GROUP BY symbol", None, ["bars"])
#: Median of spreads that there are, in session and in the last half year; symbols with more than a hundred.
table_query("y30_spread_floor", "SELECT symbol, round(median(s), 6) AS floor_spread, round(avg(CASE WHEN high = low THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END), 6) AS zero_share, count(s) AS n FROM (SELECT symbol, high, low, CASE WHEN high > low AND hour(ts) BETWEEN 7 AND 17 THEN high - low END AS s FROM {bars} WHERE ts >= (SELECT max(ts) - INTERVAL 182 DAY FROM {bars})) AS b GROUP BY symbol HAVING count(s) > 100", None, ["bars"])
#: What is already known: tickets, and the minutes of symbols for lines without one.
table_query("y34_journal_keys", *(f"SELECT DISTINCT kind, key FROM (SELECT 'ticket' AS kind, CAST(event_id AS {t}) AS key FROM {{events}} WHERE event_type IN ('purchase', 'signup') UNION ALL SELECT 'minute', concat(event_type, ' ', CAST(user_id AS {t}), ' ', {f}) FROM {{events}} WHERE event_type IN ('purchase', 'signup')) AS k" for t, f in (("STRING", "date_format(ts, 'yyyy-MM-dd HH:mm')"), ("VARCHAR", "strftime(ts, '%Y-%m-%d %H:%M')"))), ["events"])
table_query("l18_glitch_filter", "SELECT event_id, CASE WHEN p IS NOT NULL AND abs(value / nullif(p, 0) - 1) > 5 THEN 1 ELSE 0 END AS glitch FROM (SELECT event_id, value, lag(value) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS p FROM {events}) AS e", None, ["events"])
table_query("l11_bars_held", "SELECT symbol, ts, count(*) OVER (PARTITION BY symbol, isle ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS held FROM (SELECT symbol, ts, sum(CASE WHEN close > open THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS isle FROM {bars}) AS b WHERE isle > 0", None, ["bars"])


def agreeing(name: str, own: tuple[Stage, ...], coarse: tuple[Stage, ...], frames: tuple[int, ...]) -> None:
    """Register a rule that trades where the bar's own state ``s`` and the last closed state of every coarser frame agree."""
    known = {h: f"SELECT symbol, ts + INTERVAL {h} HOUR AS ts, s AS s{h} FROM ({staged_sql(_coarse_sql(h), coarse)}) AS c{h}" for h in frames}
    sql = staged_sql(EVENT_BARS_SQL, own)
    for h, text in known.items():
        sql = f"SELECT b.*, k.s{h} FROM ({sql}) AS b ASOF LEFT JOIN ({text}) AS k ON b.symbol = k.symbol AND b.ts >= k.ts"
    signal = " ".join(f"WHEN {' AND '.join(f'{x} = {v}' for x in ('s', *(f's{h}' for h in frames)))} THEN {v}" for v in (1, -1))

    @query(name, f"SELECT symbol, ts, CAST(CASE {signal} ELSE 0 END AS INT) AS signal FROM ({sql}) AS x")
    def run(spark: SparkSession, folder: str) -> DataFrame:
        bars = event_bars(spark, folder)
        out = with_stages(bars, own).select("symbol", "ts", "s")
        for h in frames:
            state = with_stages(resample(bars, h * 60), coarse).select("symbol", (F.col("ts") + F.expr(f"INTERVAL {h} HOUR")).alias("ts"), F.col("s").alias(f"s{h}"))
            out = as_of(out, state, "ts", ["symbol"], [f"s{h}"])
        return out.select("symbol", "ts", F.expr(f"CAST(CASE {signal} ELSE 0 END AS INT)").alias("signal"))


_MACD = (*fading({"f": ema("close", 12), "w": ema("close", 26)}), {"m": "f - w"}, *fading({"c": ema("m", 9)}), {"m1": lag("m"), "c1": lag("c")}, {"s": "CASE WHEN c1 > m1 THEN 1 WHEN c1 < m1 THEN -1 ELSE 0 END"})
agreeing("g55_macd_of_all_frames", _MACD, _MACD, (2, 4))
_STOCHASTIC = ({"hh": rolling("max", "high", 5), "ll": rolling("min", "low", 5)}, {"num": "close - ll", "den": "hh - ll"}, {"k": f"({rolling('sum', 'num', 3)}) / nullif({rolling('sum', 'den', 3)}, 0)"}, {"d": sma("k", 3)})
agreeing("g64_stochastic_of_all_frames", (*_STOCHASTIC, {"k3": lag("k", 3), "d3": lag("d", 3)}, {"s": "CASE WHEN k > d AND k3 < d3 THEN 1 WHEN k < d AND k3 > d3 THEN -1 ELSE 0 END"}), (*_STOCHASTIC, {"s": "CASE WHEN k > d THEN 1 WHEN k < d THEN -1 ELSE 0 END"}), (2, 4))


def without_empty_columns(df: DataFrame) -> DataFrame:
    """``df`` without the columns that hold nothing but nulls; one count a column comes to the driver."""
    counts = df.agg(*(F.count(F.col(c)).alias(c) for c in df.columns)).first()
    return df.select(*(c for c in df.columns if counts[c]))


@query("p07_empty_columns", f"SELECT symbol, ts, round(close - open, 6) + 0.0 AS body FROM ({EVENT_BARS_SQL}) AS b")
def empty_columns(spark: SparkSession, folder: str) -> DataFrame:
    """Features of which some never have a value."""
    made = event_bars(spark, folder).selectExpr("symbol", "ts", "round(close - open, 6) + 0.0D AS body", "CASE WHEN close < low THEN close END AS below", "lag(close, 1000000) OVER (PARTITION BY symbol ORDER BY ts) AS far")
    return without_empty_columns(made)
