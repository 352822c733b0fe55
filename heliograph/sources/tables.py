"""Tables of a folder of Parquet files, and bars made from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from heliograph.operators.resample import tick_bars


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def event_bars(spark: SparkSession, folder: str, minutes: int = 60) -> DataFrame:
    """Bars of the values of each event type."""
    return tick_bars(table(spark, folder, "events"), minutes, symbol="event_type", price="value", key="event_id")


def daily_bars(spark: SparkSession, folder: str) -> DataFrame:
    """Daily bars of the unit prices of each return flag and line status. Order and line number are no key of the table: lines of equal numbers are ordered by price and size, so a day has one open and one close."""
    lines = table(spark, folder, "lineitem")
    lines = lines.selectExpr("concat(l_returnflag, l_linestatus) AS symbol", "CAST(date_trunc('day', l_shipdate) AS timestamp_ntz) AS ts", "floor(l_extendedprice / l_quantity * 10000 + 0.5) / 10000 AS price", "l_quantity AS size", "l_orderkey", "l_linenumber")
    lines = lines.selectExpr("symbol", "ts", "price", "size", "struct(l_orderkey, l_linenumber, price, size) AS line")
    return lines.groupBy("symbol", "ts").agg(*_ohlcv())


def _ohlcv() -> list:
    from pyspark.sql import functions as F

    return [F.min_by("price", "line").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "line").alias("close"), F.sum("size").alias("volume")]


#: The same bars in SQL.
EVENT_BARS_SQL = "SELECT event_type AS symbol, date_trunc('hour', ts) AS ts, min_by(value, row(ts, event_id)) AS open, max(value) AS high, min(value) AS low, max_by(value, row(ts, event_id)) AS close, CAST(count(*) AS DOUBLE) AS volume FROM events WHERE value IS NOT NULL GROUP BY event_type, date_trunc('hour', ts)"
DAILY_BARS_SQL = "SELECT symbol, ts, min_by(price, line) AS open, max(price) AS high, min(price) AS low, max_by(price, line) AS close, sum(size) AS volume FROM (SELECT concat(l_returnflag, l_linestatus) AS symbol, date_trunc('day', CAST(l_shipdate AS TIMESTAMP)) AS ts, floor(l_extendedprice / l_quantity * 10000 + 0.5) / 10000 AS price, l_quantity AS size, row(l_orderkey, l_linenumber, floor(l_extendedprice / l_quantity * 10000 + 0.5) / 10000, l_quantity) AS line FROM lineitem) AS l GROUP BY symbol, ts"
