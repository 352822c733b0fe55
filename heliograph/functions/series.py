"""SQL expressions for time series.

Every function returns the text of a Spark SQL expression over the columns of a
bar table (symbol, ts, open, high, low, close, volume). Windows are partitioned
by symbol and ordered by time; nothing but labels looks ahead. Use them with
``F.expr`` or in SQL. Expressions that need a window over a window are split
into stages: see ``heliograph.operators.staged``.
"""

from __future__ import annotations

KEY = "PARTITION BY symbol ORDER BY ts"
#: For lag and lead.
ORDERED = f"OVER ({KEY})"
#: From the first row to this one.
SO_FAR = f"OVER ({KEY} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
#: All rows before this one.
BEFORE = f"OVER ({KEY} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
#: All rows of the symbol.
WHOLE = "OVER (PARTITION BY symbol)"


def last(n: int) -> str:
    """The last n rows, this one included."""
    return f"OVER ({KEY} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def prior(n: int) -> str:
    """The n rows before this one."""
    return f"OVER ({KEY} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"


def following(n: int) -> str:
    """The n rows after this one."""
    return f"OVER ({KEY} ROWS BETWEEN 1 FOLLOWING AND {n} FOLLOWING)"


def lag(x: str, n: int = 1) -> str:
    return f"lag({x}, {n}) {ORDERED}"


def lead(x: str, n: int = 1) -> str:
    return f"lead({x}, {n}) {ORDERED}"


def rolling(how: str, x: str, n: int, least: int | None = None) -> str:
    """An aggregate of the last n rows, null until ``least`` (n by default) values are there."""
    return f"CASE WHEN count({x}) {last(n)} >= {n if least is None else least} THEN {how}({x}) {last(n)} END"


def sma(x: str, n: int) -> str:
    return rolling("avg", x, n)


def ratio(a: str, b: str) -> str:
    """a / b, null where b is 0."""
    return f"({a}) / nullif({b}, 0)"


def over(a: str, b: str) -> str:
    """a / b for Spark as in DuckDB and IEEE 754: infinite or NaN where b is 0, which in Spark alone is an error."""
    return f"(CASE WHEN {b} = 0 THEN ({a}) * pow({b}, -1) ELSE ({a}) / {b} END)"


def natural_log(x: str) -> str:
    """ln(x) for Spark as in DuckDB and IEEE 754: -Infinity at 0 and NaN below, where Spark's own is null."""
    return f"(CASE WHEN {x} = 0 THEN CAST('-Infinity' AS DOUBLE) WHEN {x} < 0 THEN CAST('NaN' AS DOUBLE) ELSE ln({x}) END)"


def log_return(x: str = "close", n: int = 1) -> str:
    return f"ln({x}) - ln({lag(x, n)})"


def true_range() -> str:
    """High less low, or the distance from the close before; the first row has no close before."""
    return f"greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')}))"


def wma(x: str, n: int) -> str:
    """Weighted mean with weights 1 to n, oldest first."""
    terms = " + ".join(f"{n - k} * {lag(x, k) if k else x}" for k in range(n))
    return f"({terms}) / {n * (n + 1) / 2}"


def ordered_sma(x: str, n: int) -> str:
    """Mean summed from the oldest value to the newest, so ties come out alike everywhere."""
    return f"({' + '.join(lag(x, k) if k else x for k in range(n - 1, -1, -1))}) / {n}"


def crossed_up(a: str, b: str) -> str:
    return f"coalesce({lag(a)} <= {lag(b)} AND {a} > {b}, false)"


def crossed_down(a: str, b: str) -> str:
    return f"coalesce({lag(a)} >= {lag(b)} AND {a} < {b}, false)"


def drawdown(x: str) -> str:
    """Distance below the running maximum."""
    return f"{x} - max({x}) {SO_FAR}"
