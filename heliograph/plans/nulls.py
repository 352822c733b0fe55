"""What chance alone gives: nulls of a rule's t, one position at a time, and resampling at full size.

Draws cost what they draw, not rows times draws: a draw's entries are the first
so many places of a keyed permutation of the pool (``heliograph.functions.permutation``),
found by arithmetic and joined. All draws of all symbols are walked at once by
pointer doubling (``heliograph.operators.occupancy``). Random numbers come from MD5 of their
names, so that every engine draws alike.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.functions.permutation import duck_permuted, permuted_column
from heliograph.operators.chunks import written
from heliograph.operators.occupancy import taken
from heliograph.plans.registry import NUMBER, query, rounded
from heliograph.plans.statistics import _BOOK, _PNL
from heliograph.plans.walks import _DUCK, SIGNAL_R, chosen, outcome_frame, walked
from heliograph.sources.tables import DAILY_BARS_SQL, daily_bars

DRAWS = 400
T = "avg(r) / nullif(stddev_samp(r), 0) * sqrt(count(*))"


def number(duck: bool, *parts: str) -> str:
    text = "VARCHAR" if duck else "STRING"
    return NUMBER[duck].format("concat(" + ", ':', ".join(f"CAST({p} AS {text})" for p in parts) + ")")


def bare(e: str) -> str:
    return e.replace("b.", "")


#: The rule's own walk: signals of the close before, entered at the open, free again after the exit's row.
RULE_ON = f"coalesce(b.signal <> 0 AND {SIGNAL_R} IS NOT NULL, false)"
SIGNAL_FREE = "b.n + greatest(CASE WHEN b.signal > 0 THEN b.h_l ELSE b.h_s END, 1)"
COST_STRESS = 0.1
_OWN_DUCK = walked(_DUCK, SIGNAL_FREE, f"SELECT b.symbol, b.ts, b.n, CAST(b.signal AS INTEGER) AS side, {SIGNAL_R} AS r FROM w AS b WHERE t = 1", RULE_ON)
#: What a rule's trades come to: t of all, of either half, and after a further tenth of a risk unit for costs.
OWN = f"SELECT symbol, count(*) AS k, avg(CASE WHEN side > 0 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS long_share, {T} AS t, avg(CASE WHEN i <= floor(m / 2) THEN r END) / nullif(stddev_samp(CASE WHEN i <= floor(m / 2) THEN r END), 0) * sqrt(count(CASE WHEN i <= floor(m / 2) THEN r END)) AS t_first, avg(CASE WHEN i > floor(m / 2) THEN r END) / nullif(stddev_samp(CASE WHEN i > floor(m / 2) THEN r END), 0) * sqrt(count(CASE WHEN i > floor(m / 2) THEN r END)) AS t_second, avg(r - {COST_STRESS}) / nullif(stddev_samp(r), 0) * sqrt(count(*)) AS t_dear FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY n) AS i, count(*) OVER (PARTITION BY symbol) AS m FROM {{own}}) AS k GROUP BY symbol"
POOL = "SELECT symbol, ts, n, hour(ts) AS h, r_l, h_l, r_s, h_s, row_number() OVER (PARTITION BY symbol ORDER BY n) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS m, row_number() OVER (PARTITION BY symbol, hour(ts) ORDER BY n) - 1 AS i_h, count(*) OVER (PARTITION BY symbol, hour(ts)) AS m_h FROM {rows} WHERE r_l IS NOT NULL AND r_s IS NOT NULL"


class Market:
    """The outcome table of a folder, the rule's own trades and their figures, in the shared folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.rows = written(outcome_frame(spark, folder), "outcomes")
        picked = chosen(self.rows, bare(RULE_ON), bare(SIGNAL_FREE))
        self.own = written(picked.select("symbol", "ts", "n", F.expr("CAST(signal AS INT)").alias("side"), F.expr(bare(SIGNAL_R)).alias("r")), "own")
        self.pool = spark.sql(POOL, rows=self.rows)
        stats = spark.sql(OWN, own=self.own)
        self.stats = stats.select("symbol", "k", *(F.col(c).cast("double").alias(c) for c in stats.columns[2:]))

    def trades(self, entries: DataFrame) -> DataFrame:
        """``symbol``, ``draw``, ``n`` and ``r`` of the trades taken, one at a time in each draw; ``entries``: symbol, draw, n, side."""
        sides = entries.join(self.rows.select("symbol", "n", "r_l", "h_l", "r_s", "h_s"), ["symbol", "n"])
        known = written(sides.selectExpr("concat(symbol, '|', CAST(draw AS STRING)) AS key", "symbol", "draw", "n", "CASE WHEN side > 0 THEN r_l ELSE r_s END AS r", "n + greatest(CASE WHEN side > 0 THEN h_l ELSE h_s END, 1) AS free").where("r IS NOT NULL"), "entries")
        return known.join(taken(known, "key"), ["key", "n"]).select("symbol", "draw", "n", "r")

    def walked(self, entries: DataFrame) -> DataFrame:
        """``symbol``, ``draw``, ``n`` trades taken and their ``t``."""
        return self.trades(entries).groupBy("symbol", "draw").agg(F.count("*").alias("n"), F.expr(T).alias("t"))

    def anywhere(self) -> DataFrame:
        """As many entries as the rule took, of its long share, at random rows of the pool."""
        sizes = self.pool.groupBy("symbol").agg(F.max("m").alias("m")).join(self.stats.select("symbol", "k", "long_share"), "symbol")
        draws = sizes.select("*", F.explode(F.sequence(F.lit(0), F.lit(DRAWS - 1))).alias("draw")).where("k > 0")
        each = draws.select("*", F.explode(F.expr("sequence(0L, least(k, m) - 1)")).alias("x"), F.expr(number(False, "symbol", "draw")).alias("key"))
        placed = each.select("symbol", "draw", permuted_column("x", "m", "key").alias("i"), F.expr(f"CASE WHEN {number(False, 'symbol', 'draw', 'x')} < 4294967296D * long_share THEN 1 ELSE -1 END").alias("side"))
        return placed.join(self.pool.select("symbol", "i", "n"), ["symbol", "i"]).select("symbol", "draw", "n", "side")

    def same_hours(self) -> DataFrame:
        """As ``anywhere``, but each entry's hour is drawn from the hours of the rule's own trades."""
        hours = self.spark.sql("SELECT symbol, h, c, sum(c) OVER (PARTITION BY symbol ORDER BY h) AS upto, sum(c) OVER (PARTITION BY symbol) AS k FROM (SELECT symbol, hour(ts) AS h, count(*) AS c FROM {own} GROUP BY symbol, hour(ts)) AS x", own=self.own)
        draws = self.stats.select("symbol", "k", "long_share", F.explode(F.sequence(F.lit(0), F.lit(DRAWS - 1))).alias("draw")).where("k > 0")
        each = draws.select("symbol", "draw", "long_share", F.explode(F.expr("sequence(0L, k - 1)")).alias("x"), F.expr("k").alias("k")).withColumn("u", F.expr(f"floor({number(False, 'symbol', 'draw', 'x', repr('hour'))} * CAST(k AS DOUBLE) / 4294967296D)"))
        slots = each.join(hours.select("symbol", "h", "c", "upto"), "symbol").where("u < upto AND u >= upto - c")
        numbered = slots.selectExpr("symbol", "draw", "long_share", "x AS j", "h", "row_number() OVER (PARTITION BY symbol, draw, h ORDER BY x) - 1 AS x")
        inside = numbered.join(self.pool.groupBy("symbol", "h").agg(F.max("m_h").alias("m")), ["symbol", "h"]).where("x < m").withColumn("key", F.expr(number(False, "symbol", "draw", "h")))
        placed = inside.select("symbol", "draw", "h", permuted_column(F.col("x").cast("bigint"), "m", "key").alias("i_h"), F.expr(f"CASE WHEN {number(False, 'symbol', 'draw', 'j')} < 4294967296D * long_share THEN 1 ELSE -1 END").alias("side"))
        return placed.join(self.pool.select("symbol", "h", "i_h", "n"), ["symbol", "h", "i_h"]).select("symbol", "draw", "n", "side")

    def turned(self) -> DataFrame:
        """The rule's signals with their sides dealt anew among them."""
        signals = self.spark.sql("SELECT symbol, n, CAST(signal AS INT) AS side, row_number() OVER (PARTITION BY symbol ORDER BY n) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS m FROM {rows} WHERE signal <> 0", rows=self.rows)
        draws = signals.select("*", F.explode(F.sequence(F.lit(0), F.lit(DRAWS - 1))).alias("draw")).withColumn("key", F.expr(number(False, "symbol", "draw", repr("side"))))
        dealt = draws.select("symbol", "draw", "n", permuted_column(F.col("i").cast("bigint"), "m", "key").alias("j"))
        return dealt.join(signals.selectExpr("symbol", "i AS j", "side"), ["symbol", "j"]).select("symbol", "draw", "n", "side")


# --- the same in DuckDB, walked entry by entry
_D_POOL = POOL.replace("{rows}", f"({_DUCK}) AS q")
_RANGE = f"unnest(range(0, {DRAWS}))"


def _duck_trades(entries: str) -> str:
    """The trades taken of ``entries`` (symbol, draw, n, side)."""
    rows = f"SELECT *, row_number() OVER (PARTITION BY symbol, draw ORDER BY n) AS m FROM (SELECT e.symbol, e.draw, e.n, CASE WHEN e.side > 0 THEN r_l ELSE r_s END AS r, e.n + greatest(CASE WHEN e.side > 0 THEN h_l ELSE h_s END, 1) AS free FROM ({entries}) AS e JOIN o ON e.symbol = o.symbol AND e.n = o.n) AS x WHERE r IS NOT NULL"
    return f"WITH RECURSIVE e AS MATERIALIZED ({rows}), w AS (SELECT symbol, draw, m, n, r, free AS f, 1 AS t FROM e WHERE m = 1 UNION ALL SELECT e.symbol, e.draw, e.m, e.n, e.r, CASE WHEN e.n >= w.f THEN e.free ELSE w.f END, CASE WHEN e.n >= w.f THEN 1 ELSE 0 END FROM w JOIN e ON e.symbol = w.symbol AND e.draw = w.draw AND e.m = w.m + 1) SELECT symbol, draw, n, r FROM w WHERE t = 1"


def _duck_walk(entries: str, least: int = 0) -> str:
    """Their t by symbol and draw."""
    return f"SELECT symbol, draw, count(*) AS n, {T} AS t FROM ({_duck_trades(entries)}) AS z GROUP BY symbol, draw HAVING count(*) >= {least}"


_WITH = f"WITH o AS MATERIALIZED ({_DUCK}), pool AS MATERIALIZED ({_D_POOL}), own AS MATERIALIZED ({_OWN_DUCK}), st AS MATERIALIZED ({OWN.replace('{{own}}', 'own').replace('{own}', 'own')})"
_D_EACH = f"SELECT symbol, draw, m AS n, {number(True, 'symbol', 'draw')} AS key, long_share, unnest(range(0, CAST(least(k, m) AS BIGINT))) AS x FROM (SELECT s.symbol, k, long_share, p.m, {_RANGE} AS draw FROM st AS s JOIN (SELECT symbol, max(m) AS m FROM pool GROUP BY symbol) AS p ON s.symbol = p.symbol) AS d"
_D_ANYWHERE = f"SELECT y.symbol, y.draw, p.n, CASE WHEN {number(True, 'y.symbol', 'y.draw', 'y.x')} < 4294967296.0 * long_share THEN 1 ELSE -1 END AS side FROM {duck_permuted(_D_EACH, 'symbol, draw, x, long_share')} AS y JOIN pool AS p ON y.symbol = p.symbol AND y.y = p.i"
_D_HOURS = "SELECT symbol, h, c, sum(c) OVER (PARTITION BY symbol ORDER BY h) AS upto FROM (SELECT symbol, hour(ts) AS h, count(*) AS c FROM own GROUP BY symbol, hour(ts)) AS x"
_D_SLOTS = f"SELECT e.symbol, draw, long_share, j, q.h, row_number() OVER (PARTITION BY e.symbol, draw, q.h ORDER BY j) - 1 AS x FROM (SELECT *, floor({number(True, 'symbol', 'draw', 'j', repr('hour'))} * CAST(k AS DOUBLE) / 4294967296.0) AS u FROM (SELECT *, unnest(range(0, k)) AS j FROM (SELECT symbol, k, long_share, {_RANGE} AS draw FROM st) AS d) AS d2) AS e JOIN ({_D_HOURS}) AS q ON e.symbol = q.symbol AND u < upto AND u >= upto - c"
_D_INSIDE = f"SELECT s.symbol, draw, s.h AS slot, j, long_share, x, m AS n, {number(True, 's.symbol', 'draw', 's.h')} AS key FROM ({_D_SLOTS}) AS s JOIN (SELECT symbol, h, max(m_h) AS m FROM pool GROUP BY symbol, h) AS p ON s.symbol = p.symbol AND s.h = p.h WHERE x < m"
_D_SAME_HOURS = f"SELECT y.symbol, y.draw, p.n, CASE WHEN {number(True, 'y.symbol', 'y.draw', 'y.j')} < 4294967296.0 * long_share THEN 1 ELSE -1 END AS side FROM {duck_permuted(_D_INSIDE, 'symbol, draw, slot, j, long_share')} AS y JOIN pool AS p ON y.symbol = p.symbol AND y.slot = p.h AND y.y = p.i_h"
_D_SIGNALS = "SELECT symbol, n, CAST(signal AS INTEGER) AS side, row_number() OVER (PARTITION BY symbol ORDER BY n) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS m FROM o WHERE signal <> 0"
_D_TURNS = f"SELECT symbol, draw, bar, x, m AS n, {number(True, 'symbol', 'draw', repr('side'))} AS key FROM (SELECT symbol, n AS bar, i AS x, m, {_RANGE} AS draw FROM ({_D_SIGNALS}) AS s) AS d"
_D_TURNED = f"SELECT y.symbol, y.draw, y.bar AS n, s.side FROM {duck_permuted(_D_TURNS, 'symbol, draw, bar')} AS y JOIN ({_D_SIGNALS}) AS s ON y.symbol = s.symbol AND y.y = s.i"
_SHOWN = "symbol, draw, n, round(t, 5) + 0.0 AS t"
LEAST_TRADES = 5


@query("i11_random_entry_null", f"{_WITH} SELECT {_SHOWN} FROM ({_duck_walk(_D_ANYWHERE, LEAST_TRADES)}) AS f")
def random_entries(spark: SparkSession, folder: str) -> DataFrame:
    """t of as many entries as the rule's, of its long share, at random rows; one position at a time, per draw."""
    m = Market(spark, folder)
    return m.walked(m.anywhere()).where(f"n >= {LEAST_TRADES}").selectExpr("symbol", "draw", "n", "round(t, 5) + 0.0D AS t")


@query("i14_hour_matched_null", f"{_WITH} SELECT {_SHOWN} FROM ({_duck_walk(_D_SAME_HOURS, LEAST_TRADES)}) AS f")
def same_hour_entries(spark: SparkSession, folder: str) -> DataFrame:
    """As ``i11_random_entry_null``, with hours drawn from those of the rule's trades."""
    m = Market(spark, folder)
    return m.walked(m.same_hours()).where(f"n >= {LEAST_TRADES}").selectExpr("symbol", "draw", "n", "round(t, 5) + 0.0D AS t")


def _against(median: str) -> str:
    """The rule's t against both nulls."""
    own = lambda w: f"CASE WHEN which = '{w}' THEN d.t END"
    above = lambda w: f"CASE WHEN which = '{w}' THEN CASE WHEN d.t >= s.t THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END END"
    both = ", ".join(f"{rounded(f'avg({above(w)})')} AS p_{w}, {rounded(f'{median}({own(w)})', 5)} AS median_{w}" for w in "ab")
    return f"SELECT s.symbol AS symbol, s.k AS n, {rounded('long_share')} AS long_share, {rounded('s.t', 5)} AS t, count(CASE WHEN which = 'a' THEN 1 END) AS draws_a, {both} FROM {{st}} AS s LEFT JOIN {{d}} AS d ON s.symbol = d.symbol GROUP BY s.symbol, s.k, long_share, s.t"


def _both(m: Market, first: DataFrame) -> DataFrame:
    a = m.walked(first).where(f"n >= {LEAST_TRADES}").withColumn("which", F.lit("a"))
    return a.unionByName(m.walked(m.turned()).where("n > 20").withColumn("which", F.lit("b"))).where("t IS NOT NULL")


def _duck_both(first: str) -> str:
    return f"(SELECT *, 'a' AS which FROM ({_duck_walk(first, LEAST_TRADES)}) AS a WHERE t IS NOT NULL UNION ALL SELECT *, 'b' FROM ({_duck_walk(_D_TURNED, 21)}) AS b WHERE t IS NOT NULL)"


def doubles(df: DataFrame) -> DataFrame:
    return df.select(*(F.col(n).cast("double").alias(n) if t.startswith("decimal") else n for n, t in df.dtypes))


@query("y07_null_battery", f"{_WITH} {_against('median').replace('{st}', 'st').replace('{d}', _duck_both(_D_ANYWHERE))}")
def null_battery(spark: SparkSession, folder: str) -> DataFrame:
    """The rule's t beside 400 draws of random entries (a) and 400 with its sides dealt anew (b): share at or above it, and medians."""
    m = Market(spark, folder)
    return doubles(spark.sql(_against("median"), st=m.stats, d=written(_both(m, m.anywhere()), "draws")))


#: The first stage: t of all trades, of either half, and after dearer costs.
GATE = "s.t > 2 AND t_first > 0 AND t_second > 0 AND t_dear > 1"
_CELL = f"SELECT c.*, {rounded('t_first', 5)} AS t_first, {rounded('t_second', 5)} AS t_second, {rounded('t_dear', 5)} AS t_dear, coalesce({GATE}, false) AS gate, coalesce({GATE} AND p_a < 0.05 AND (p_b IS NULL OR p_b < 0.05), false) AS passed FROM {{c}} AS c JOIN {{st}} AS s ON c.symbol = s.symbol"


def _duck_cell(first: str) -> str:
    return f"{_WITH} {_CELL.replace('{c}', '(' + _against('median').replace('{st}', 'st').replace('{d}', _duck_both(first)) + ')').replace('{st}', 'st')}"


def cell(m: Market, first: DataFrame) -> DataFrame:
    cells = m.spark.sql(_against("median"), st=m.stats, d=written(_both(m, first), "draws"))
    return doubles(m.spark.sql(_CELL, c=cells, st=m.stats))


@query("i16_battery_cell", _duck_cell(_D_ANYWHERE))
def battery_cell(spark: SparkSession, folder: str) -> DataFrame:
    """Two stages: t of all trades, of both halves and after dearer costs; then against random entries and against dealt sides."""
    m = Market(spark, folder)
    return cell(m, m.anywhere())


@query("y09_matched_cell", _duck_cell(_D_SAME_HOURS))
def matched_cell(spark: SparkSession, folder: str) -> DataFrame:
    """The same, the first null drawn at the hours of the rule's own trades."""
    m = Market(spark, folder)
    return cell(m, m.same_hours())


SAMPLED = 5


@query("i15_matched_entries", f"{_WITH} SELECT symbol, draw, n, side FROM ({_D_SAME_HOURS}) AS d WHERE draw < {SAMPLED}")
def matched_entries(spark: SparkSession, folder: str) -> DataFrame:
    """The first five draws of entries at matched hours."""
    return Market(spark, folder).same_hours().where(f"draw < {SAMPLED}")


@query("y06_dealt_sides", f"{_WITH} SELECT symbol, draw, n, side FROM ({_D_TURNED}) AS d WHERE draw < {SAMPLED}")
def dealt_sides(spark: SparkSession, folder: str) -> DataFrame:
    """The rule's signals with their sides dealt anew, as arrays of signals: the first five draws."""
    return Market(spark, folder).turned().where(f"draw < {SAMPLED}")


# --- placebo signals beside the rule
PLACEBO_SIGNALS = 40
_HALVES = f"SELECT symbol, draw, count(*) AS k, {T} AS t, avg(CASE WHEN i <= floor(m / 2) THEN r END) AS er_first, avg(CASE WHEN i > floor(m / 2) THEN r END) AS er_second, avg(r - {COST_STRESS}) / nullif(stddev_samp(r), 0) * sqrt(count(*)) AS t_dear FROM (SELECT *, row_number() OVER (PARTITION BY symbol, draw ORDER BY n) AS i, count(*) OVER (PARTITION BY symbol, draw) AS m FROM {{trades}}) AS k GROUP BY symbol, draw"
_D_PLACEBO = f"SELECT * FROM ({_D_ANYWHERE}) AS y0 WHERE draw < {PLACEBO_SIGNALS}"
_D_OWN_AS_TRADES = "SELECT symbol, -1 AS draw, n, r FROM own"
_D_ALL_TRADES = f"(SELECT * FROM ({_D_OWN_AS_TRADES}) AS a UNION ALL SELECT symbol, draw, n, r FROM ({_duck_trades(_D_PLACEBO)}) AS b) AS u"


def all_trades(m: Market) -> DataFrame:
    """The rule's own trades (draw -1) and those of the placebo signals."""
    own = m.own.select("symbol", F.lit(-1).alias("draw"), "n", "r")
    return own.unionByName(m.trades(m.anywhere().where(F.col("draw") < PLACEBO_SIGNALS)))


_SHOW_CELLS = f"SELECT symbol, draw, k, {rounded('t', 5)} AS t, {rounded('er_first')} AS er_first, {rounded('er_second')} AS er_second, {rounded('t_dear', 5)} AS t_dear FROM {{cells}}"


@query("i17_placebo_cells", f"{_WITH} {_SHOW_CELLS.replace('{cells}', '(' + _HALVES.replace('{trades}', _D_ALL_TRADES) + ') AS c')} WHERE draw >= 0")
def placebo_cells(spark: SparkSession, folder: str) -> DataFrame:
    """Signals without meaning: as many entries as the rule's, of its long share; with the first stage's figures."""
    return doubles(spark.sql(_SHOW_CELLS + " WHERE draw >= 0", cells=spark.sql(_HALVES, trades=all_trades(Market(spark, folder)))))


#: Of cells whose t is above zero (selected), those that also gain in both halves and after dearer costs (passed).
_KINDS = "SELECT CASE WHEN draw < 0 THEN 'real' ELSE 'placebo' END AS kind, CASE WHEN t > 0 THEN 1 ELSE 0 END AS selected, CASE WHEN t > 0 AND er_first > 0 AND er_second > 0 AND t_dear > 0 THEN 1 ELSE 0 END AS passed FROM {cells}"
_SURVIVED = f"SELECT kind, count(*) AS cells, CAST(sum(selected) AS BIGINT) AS selected, CAST(sum(passed) AS BIGINT) AS passed, {rounded('sum(passed) / nullif(CAST(sum(selected) AS DOUBLE), 0)')} AS pass_share FROM ({_KINDS}) AS k GROUP BY kind"


@query("a25_survival_counts", f"{_WITH} {_SURVIVED.replace('{cells}', '(' + _HALVES.replace('{trades}', _D_ALL_TRADES) + ') AS c')}")
def survival_counts(spark: SparkSession, folder: str) -> DataFrame:
    """At equal selection, how often the rule and placebo signals pass the rest."""
    return doubles(spark.sql(_SURVIVED, cells=spark.sql(_HALVES, trades=all_trades(Market(spark, folder)))))


# --- the rule, its inverse, and chance
PLACEBOS = 20
_THREE = f"SELECT o.symbol AS symbol, n, {rounded('er')} AS er, {rounded('er_first')} AS er_first, {rounded('er_second')} AS er_second, n_inverse, {rounded('er_inverse')} AS er_inverse, {rounded('er_placebo')} AS er_placebo, {rounded('beaten')} AS beaten FROM (SELECT symbol, count(*) AS n, avg(r) AS er, avg(CASE WHEN i <= floor(m / 2) THEN r END) AS er_first, avg(CASE WHEN i > floor(m / 2) THEN r END) AS er_second FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY n) AS i, count(*) OVER (PARTITION BY symbol) AS m FROM {{own}}) AS k GROUP BY symbol) AS o LEFT JOIN (SELECT symbol, count(*) AS n_inverse, avg(r) AS er_inverse FROM {{inverse}} GROUP BY symbol) AS v ON o.symbol = v.symbol LEFT JOIN (SELECT d.symbol AS symbol, avg(d.e) AS er_placebo, avg(CASE WHEN d.e >= w.e THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS beaten FROM (SELECT symbol, draw, avg(r) AS e FROM {{chance}} GROUP BY symbol, draw) AS d JOIN (SELECT symbol, avg(r) AS e FROM {{own}} GROUP BY symbol) AS w ON d.symbol = w.symbol GROUP BY d.symbol) AS c ON o.symbol = c.symbol"
_D_INVERSE = "SELECT symbol, 0 AS draw, n, -CAST(signal AS INTEGER) AS side FROM o WHERE signal <> 0"


@query("x15_real_inverse_placebo", f"{_WITH} {_THREE.replace('{own}', 'own').replace('{inverse}', '(' + _duck_trades(_D_INVERSE) + ') AS iv').replace('{chance}', '(' + _duck_trades(f'SELECT * FROM ({_D_ANYWHERE}) AS y0 WHERE draw < {PLACEBOS}') + ') AS ch')}")
def real_inverse_placebo(spark: SparkSession, folder: str) -> DataFrame:
    """The rule's mean result, in both halves, that of the other side, and that of 20 draws of random entries; each one position at a time."""
    m = Market(spark, folder)
    inverse = m.trades(m.rows.where("signal <> 0").selectExpr("symbol", "0 AS draw", "n", "-CAST(signal AS INT) AS side"))
    return doubles(spark.sql(_THREE, own=m.own, inverse=inverse, chance=m.trades(m.anywhere().where(F.col("draw") < PLACEBOS))))


# --- block bootstrap: a block of days is a sum, its highest and lowest running sum, and its largest fall
PATHS, LENGTH, BLOCK = 40_000, 365, 14
_BLOCKS = "SELECT i AS first, aggregate(days, struct(0D AS s, CAST(NULL AS DOUBLE) AS hi, CAST(NULL AS DOUBLE) AS lo, 0D AS fall), (a, x) -> struct(a.s + x AS s, greatest(a.hi, a.s + x) AS hi, least(a.lo, a.s + x) AS lo, greatest(a.fall, coalesce(greatest(a.hi, a.s + x), a.s + x) - (a.s + x)) AS fall)) AS b FROM {days}"
_JOIN = "struct(a.s + x.b.s AS s, greatest(a.hi, a.s + x.b.hi) AS hi, least(a.lo, a.s + x.b.lo) AS lo, greatest(a.fall, x.b.fall, coalesce(a.hi - (a.s + x.b.lo), 0D)) AS fall)"
_PATH_STATS = f"count(*) AS paths, {rounded('{median}(annual)')} AS median_year, {rounded('avg(annual)')} AS mean_year, {rounded('avg(CASE WHEN annual > 0 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END)')} AS p_gain, {rounded('{q}(fall, 0.5)')} AS fall_50, {rounded('{q}(fall, 0.95)')} AS fall_95, {rounded('{q}(fall, 0.99)')} AS fall_99"
_D_BOOK = _BOOK.replace("{days}", f"({DAILY_BARS_SQL})")
_D_PIECES = f"SELECT path, piece, {number(True, 'path', 'piece')} % (n - {BLOCK}) AS first FROM (SELECT unnest(range(0, {PATHS})) AS path, n FROM (SELECT max(n) AS n FROM book) AS c) AS d, (SELECT unnest(range(0, {-(-LENGTH // BLOCK)})) AS piece) AS e"
_D_CUM = f"SELECT path, r, sum(r) OVER (PARTITION BY path ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum, t FROM (SELECT path, piece * {BLOCK} + o AS t, r FROM ({_D_PIECES}) AS p, (SELECT unnest(range(0, {BLOCK})) AS o) AS q JOIN book ON book.i = first + o WHERE piece * {BLOCK} + o < {LENGTH}) AS x"


@query("n01_block_bootstrap", f"WITH book AS MATERIALIZED ({_D_BOOK}) SELECT {_PATH_STATS.format(median='median', q='quantile_cont')} FROM (SELECT path, sum(r) AS annual, max(top - cum) AS fall FROM (SELECT *, max(cum) OVER (PARTITION BY path ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS top FROM ({_D_CUM}) AS c) AS d GROUP BY path) AS z")
def block_bootstrap(spark: SparkSession, folder: str) -> DataFrame:
    """40,000 years made of blocks of 14 days: the year's sum and its largest fall.

    Each block is made once for every first day; a path joins 27 of them,
    the last cut to the day that is left, instead of 365 days.
    """
    book = written(spark.sql(_BOOK, days=daily_bars(spark, folder)), "book")
    made = []
    for size in (BLOCK, LENGTH % BLOCK):
        days = book.selectExpr("i", f"collect_list(r) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND {size - 1} FOLLOWING) AS days", "n").where(f"i < n - {BLOCK}")
        made.append(spark.sql(_BLOCKS, days=days).withColumn("size", F.lit(size)))
    blocks = made[0].unionByName(made[1])
    n, pieces = book.count(), -(-LENGTH // BLOCK)
    draws = spark.range(PATHS).select(F.col("id").alias("path"), F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))).alias("piece")).withColumns({"first": F.expr(f"{number(False, 'path', 'piece')} % ({n} - {BLOCK})"), "size": F.expr(f"CASE WHEN piece = {pieces - 1} THEN {LENGTH % BLOCK} ELSE {BLOCK} END")})
    paths = draws.join(blocks, ["first", "size"]).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("piece", "b"))).alias("parts"))
    done = paths.select(F.expr(f"aggregate(parts, struct(0D AS s, CAST(NULL AS DOUBLE) AS hi, CAST(NULL AS DOUBLE) AS lo, 0D AS fall), (a, x) -> {_JOIN})").alias("p")).selectExpr("p.s AS annual", "p.fall AS fall")
    return doubles(spark.sql(f"SELECT {_PATH_STATS.format(median='median', q='percentile')} FROM {{p}}", p=done))


# --- ratio of two shares, resampled
RESAMPLES, TOGETHER = 20_000, 1_000
_SAMPLES = "SELECT symbol, CASE WHEN dom <= 3 THEN 'turn' ELSE 'rest' END AS sample, count(*) AS n, CAST(sum(CASE WHEN r > 0 THEN 1 ELSE 0 END) AS BIGINT) AS k FROM (SELECT symbol, r, row_number() OVER (PARTITION BY symbol, date_trunc('month', ts) ORDER BY ts) AS dom FROM " + _PNL + " AS p WHERE r IS NOT NULL) AS d GROUP BY symbol, CASE WHEN dom <= 3 THEN 'turn' ELSE 'rest' END"
_D_CDF = f"SELECT symbol, sample, n, x, sum(exp(lgamma(n + 1) - lgamma(x + 1) - lgamma(n - x + 1) + x * ln(k / CAST(n AS DOUBLE)) + (n - x) * ln(1 - k / CAST(n AS DOUBLE)))) OVER (PARTITION BY symbol, sample ORDER BY x) AS c FROM (SELECT *, unnest(range(0, n + 1)) AS x FROM ({_SAMPLES.replace('{days}', f'({DAILY_BARS_SQL})')}) AS s WHERE k > 0 AND k < n) AS t"
_D_DRAWN = f"SELECT u.symbol, u.sample, u.draw, min(c.x) / CAST(any_value(c.n) AS DOUBLE) AS share FROM (SELECT symbol, sample, draw, ({number(True, 'symbol', 'sample', 'draw')} + 0.5) / 4294967296.0 AS u FROM (SELECT DISTINCT symbol, sample, unnest(range(0, {RESAMPLES})) AS draw FROM (SELECT DISTINCT symbol, sample FROM cdf) AS q) AS v) AS u ASOF JOIN cdf AS c ON u.symbol = c.symbol AND u.sample = c.sample AND u.u <= c.c GROUP BY u.symbol, u.sample, u.draw"


@query("i13_bootstrap_interval", f"WITH cdf AS MATERIALIZED ({_D_CDF}), drawn AS MATERIALIZED ({_D_DRAWN}) SELECT a.symbol AS symbol, count(*) AS draws, {rounded('quantile_cont(a.share / b.share, 0.025)')} AS low, {rounded('quantile_cont(a.share / b.share, 0.975)')} AS high FROM drawn AS a JOIN drawn AS b ON a.symbol = b.symbol AND a.draw = b.draw AND a.sample = 'turn' AND b.sample = 'rest' WHERE b.share > 0 GROUP BY a.symbol")
def bootstrap_interval(spark: SparkSession, folder: str) -> DataFrame:
    """95 % of the ratio of two shares of gains (first days of a month, other days) over 20,000 resamples.

    A resample of n outcomes of which k are gains has Binomial(n, k / n) gains,
    whichever rows it drew. So no row is copied: each sample is reduced to n and k, and
    each resample to one binomial number by inversion, which is the exact bootstrap.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from math import lgamma, log

        tables: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for symbol, sample, n, k, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (symbol, sample) not in tables:
                    p = k / n
                    tables[symbol, sample] = np.cumsum([np.exp(lgamma(n + 1) - lgamma(x + 1) - lgamma(n - x + 1) + x * log(p) + (n - x) * log(1 - p)) for x in range(n + 1)])
                draws = np.arange(first, min(first + TOGETHER, RESAMPLES))
                u = np.array([(int(hashlib.md5(f"{symbol}:{sample}:{d}".encode()).hexdigest()[:8], 16) + 0.5) / 4294967296 for d in draws.tolist()])
                share = np.searchsorted(tables[symbol, sample], u, "left") / n
                yield pa.RecordBatch.from_arrays([pa.array([symbol] * len(draws)), pa.array([sample] * len(draws)), pa.array(draws), pa.array(share)], names=["symbol", "sample", "draw", "share"])

    samples = spark.sql(_SAMPLES, days=daily_bars(spark, folder)).where("k > 0 AND k < n")
    blocks = samples.select("*", F.explode(F.sequence(F.lit(0), F.lit(RESAMPLES - 1), F.lit(TOGETHER))).alias("first"))
    drawn = blocks.repartition("symbol", "sample", "first").mapInArrow(kernel, "symbol string, sample string, draw bigint, share double")
    pairs = drawn.groupBy("symbol", "draw").agg(F.max(F.expr("CASE WHEN sample = 'turn' THEN share END")).alias("a"), F.max(F.expr("CASE WHEN sample = 'rest' THEN share END")).alias("b")).where("b > 0 AND a IS NOT NULL")
    return pairs.groupBy("symbol").agg(F.count("*").alias("draws"), F.expr(rounded("percentile(a / b, 0.025)")).cast("double").alias("low"), F.expr(rounded("percentile(a / b, 0.975)")).cast("double").alias("high"))
