"""Bars from a stream of ticks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_bars(ticks: DataFrame, minutes: int, late: str = "1 hour", symbol: str = "symbol", ts: str = "ts", price: str = "price", key: str | None = None) -> DataFrame:
    """OHLC bars and tick counts by symbol and bin; a bin is given once the watermark has passed its end.

    ``late``: how long ticks may be late; later ones are dropped, by the
    watermark's rule. ``key``: ticks that come again within that time, with the
    same key, count once. Of ticks at one time the least key (else price) is the
    first. Ticks without a price or time are left out. A table
    that is no stream gives the same bars.
    """
    at = F.col(ts).cast("timestamp")
    kept = ticks.where(F.col(price).isNotNull() & F.col(ts).isNotNull()).withColumn("at", at).withWatermark("at", late)
    if key is not None:
        kept = kept.dropDuplicatesWithinWatermark([key]) if ticks.isStreaming else kept.dropDuplicates([key])
    at = F.struct("at", key or price)
    bars = kept.groupBy(F.col(symbol).alias("symbol"), F.window("at", f"{minutes} minutes").alias("bin")).agg(
        F.min_by(price, at).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, at).alias("close"), F.count("*").cast("double").alias("volume")
    )
    return bars.select("symbol", F.col("bin.start").cast("timestamp_ntz").alias("ts"), "open", "high", "low", "close", "volume")


def crossings_from(bars: DataFrame, level: float) -> DataFrame:
    """Bars whose close is over ``level`` while they opened at or under it: an alert that needs no state."""
    return bars.where((F.col("open") <= level) & (F.col("close") > level))
