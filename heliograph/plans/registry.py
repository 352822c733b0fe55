"""Named queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.operators.staged import Stage, staged_sql, with_stages
from heliograph.sources.tables import DAILY_BARS_SQL, EVENT_BARS_SQL, daily_bars, event_bars

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
#: A 32-bit number from a text, for Spark and for DuckDB: every engine draws alike.
NUMBER = {False: "CAST(conv(substring(md5({}), 1, 8), 16, 10) AS BIGINT)", True: "CAST('0x' || substring(md5({}), 1, 8) AS BIGINT)"}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and the SQL that gives its rows."""

    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return put


def without_decimals(df: DataFrame) -> DataFrame:
    """Decimals, as SQL's literals make them, as doubles."""
    return df.select(*(F.col(n).cast("double").alias(n) if t.startswith("decimal") else n for n, t in df.dtypes))


def rounded(name: str, digits: int = 6) -> str:
    """Rounded, and without a negative zero."""
    return f"round({name}, {digits}) + 0.0"


def series(name: str, outputs: Mapping[str, str] | Sequence[str], *stages: Stage, duck: Sequence[Stage] | None = None, where: str | None = None, daily: bool = False, places: Mapping[str, str] | None = None, base: tuple[Query, str] | None = None) -> None:
    """Register a query over bars: stages of expressions, then ``outputs`` (name: expression, or names to round).

    ``duck``: stages for DuckDB where its functions have other names. ``places``:
    name to time zone; stages may use the local time ``{name}_t``, minute of the
    day ``{name}_m`` and date ``{name}_d``. ``base``: other bars than those of
    events or days, and their SQL.
    """
    bars = base or ((daily_bars, DAILY_BARS_SQL) if daily else (event_bars, EVENT_BARS_SQL))
    here, there = ([], []) if places is None else ([{f"{n}_t": how.format(z)} for n, z in places.items()] + [{f"{n}_m": f"hour({n}_t) * 60 + minute({n}_t)" for n in places} | {f"{n}_d": f"CAST({n}_t AS DATE)" for n in places}] for how in ("convert_timezone('UTC', '{}', ts)", "timezone('{}', timezone('UTC', ts))"))
    out = {n: rounded(n) for n in outputs} if not isinstance(outputs, Mapping) else dict(outputs)

    def run(spark: SparkSession, folder: str) -> DataFrame:
        df = with_stages(bars[0](spark, folder), [*here, *stages])
        df = df.where(where) if where else df
        return without_decimals(df.select("symbol", "ts", *(F.expr(e).alias(n) for n, e in out.items())))

    inner = staged_sql(bars[1], [*there, *(duck or stages)])
    columns = ", ".join(f"{e} AS {n}" for n, e in out.items())
    QUERIES[name] = run
    ORACLES[name] = f"SELECT symbol, ts, {columns} FROM ({inner}) AS s" + (f" WHERE {where}" if where else "")


def table_query(name: str, spark_sql: str, duck_sql: str | None = None, tables: Sequence[str] = ()) -> None:
    """Register a query in SQL over tables of the folder; ``{t}`` in the text stands for table t, ``{bars}`` and ``{days}`` for bars."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        from heliograph.sources.tables import table

        frames = {t: table(spark, folder, t) for t in tables if t not in ("bars", "days")}
        if "bars" in tables:
            frames["bars"] = event_bars(spark, folder)
        if "days" in tables:
            frames["days"] = daily_bars(spark, folder)
        return without_decimals(spark.sql(spark_sql, **frames))

    text = duck_sql or spark_sql
    for t in tables:
        text = text.replace("{" + t + "}", {"bars": f"({EVENT_BARS_SQL})", "days": f"({DAILY_BARS_SQL})"}.get(t, t))
    QUERIES[name] = run
    ORACLES[name] = text
