"""Bars, reports and maps as files that Spark writes and reads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BAR_SCHEMA = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double"
#: Layouts of journal lines by their number of fields: where symbol, reason and result stand.
JOURNAL_LAYOUTS = {4: (0, 2, 3), 5: (0, 3, 4), 6: (1, 4, 5)}


def write_csv(df: DataFrame, path: str, parts: Sequence[str] = ()) -> None:
    """One header a file; ``parts``: columns that become folders."""
    df.write.partitionBy(*parts).option("header", True).option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss").csv(path)


def read_bars(spark: SparkSession, path: str) -> DataFrame:
    """Bars from CSV or Parquet folders. Lines that are no bars are left out; of rows with one symbol and time the last by price stays."""
    if "csv" in path.rsplit("/", 1)[-1]:
        df = spark.read.schema(BAR_SCHEMA).option("header", True).option("mode", "DROPMALFORMED").option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss").csv(path)
    else:
        df = spark.read.schema(BAR_SCHEMA).parquet(path)
    kept = df.where("symbol is not null and ts is not null")
    values = F.struct("close", "open", "high", "low", "volume")
    return kept.groupBy("symbol", "ts").agg(F.max(values).alias("v")).select("symbol", "ts", "v.open", "v.high", "v.low", "v.close", "v.volume")


def write_report(df: DataFrame, path: str) -> None:
    """A small table as JSON lines, nulls kept."""
    df.write.option("ignoreNullFields", False).json(path)


def upserted(held: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``held`` with the rows of ``new`` in place of those with equal keys. Null keys are equal."""
    ranked = held.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    rest = [c for c in held.columns if c != key]
    return ranked.groupBy(key).agg(F.max(F.struct("_new", *rest)).alias("v")).select(key, *(F.col("v")[c].alias(c) for c in rest)).select(held.columns)


def read_journal(spark: SparkSession, path: str) -> DataFrame:
    """``symbol``, ``reason`` and ``result`` of lines of different layouts, told apart by their number of fields; ``layout`` is null for unknown ones, which keep their ``line``."""
    fields = F.split("value", ",")
    n = F.size(fields)
    out = [F.lit(None).cast("string")] * 3
    for width, places in JOURNAL_LAYOUTS.items():
        out = [F.when(n == width, F.trim(fields[i])).otherwise(o) for i, o in zip(places, out, strict=True)]
    lines = spark.read.text(path).where("value is not null and trim(value) <> ''")
    return lines.select(F.when(n.isin(*JOURNAL_LAYOUTS), n).alias("layout"), out[0].alias("symbol"), out[1].alias("reason"), out[2].cast("double").alias("result"), F.col("value").alias("line"))
