"""Bars from ticks or finer bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bin_start(ts: Column, minutes: int) -> Column:
    """Start of the bin of ``minutes`` that holds ``ts``; bins begin at midnight when they divide a day."""
    seconds = F.unix_seconds(ts.cast("timestamp"))
    return F.timestamp_seconds(seconds - F.pmod(seconds, F.lit(minutes * 60))).cast("timestamp_ntz")


def tick_bars(ticks: DataFrame, minutes: int, symbol: str = "symbol", ts: str = "ts", price: str = "price", key: str | None = None) -> DataFrame:
    """OHLC bars and tick counts. First and last are by time, then by ``key`` (else by price), so partial aggregation works map-side and ties have one result."""
    at = F.struct(ts, key or price)
    return ticks.where(F.col(price).isNotNull()).groupBy(F.col(symbol).alias("symbol"), bin_start(F.col(ts), minutes).alias("bin")).agg(
        F.min_by(price, at).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, at).alias("close"), F.count("*").cast("double").alias("volume")
    ).withColumnRenamed("bin", "ts")


def resample(bars: DataFrame, minutes: int) -> DataFrame:
    """Coarser bars from finer ones; bins without an open price are left out."""
    return bars.where("open is not null").groupBy("symbol", bin_start(F.col("ts"), minutes).alias("bin")).agg(
        F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume")
    ).withColumnRenamed("bin", "ts")
