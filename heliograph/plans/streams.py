"""Streams of the events table, run to their end and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.operators.storage import shared_path
from heliograph.plans.registry import query
from heliograph.sources.tables import table
from heliograph.streaming.accounts import Limits, followed, silences
from heliograph.streaming.bars import stream_bars


def replayed(spark: SparkSession, folder: str) -> DataFrame:
    """The events table as a stream of micro-batches."""
    return spark.readStream.schema(table(spark, folder, "events").schema).option("pathGlobFilter", "events*.parquet").parquet(folder)


def finished(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over all that there is; its rows are appended to a table in the shared folder, each once."""
    spark, path = stream.sparkSession, shared_path(stream.sparkSession, name)
    stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


#: Bars whose end the watermark, an hour behind the last event, has passed.
_CLOSED = "date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR"


@query("l03_closed_bars", f"SELECT event_type AS symbol, date_trunc('hour', ts) AS ts, max(value) AS high, min(value) AS low, CAST(count(*) AS DOUBLE) AS volume FROM events WHERE value IS NOT NULL AND {_CLOSED} GROUP BY event_type, date_trunc('hour', ts)")
def closed_bars(spark: SparkSession, folder: str) -> DataFrame:
    """Bars of a stream in append mode: a bar appears once and only when it can no longer change."""
    bars = stream_bars(replayed(spark, folder), 60, "1 hour", symbol="event_type", price="value", key="event_id")
    return finished(bars.select("symbol", "ts", "high", "low", "volume"), "closed")


@query("l16_idempotent_fills", "SELECT DISTINCT event_id, event_type, user_id FROM events WHERE event_type IN ('purchase', 'signup')")
def fills_once(spark: SparkSession, folder: str) -> DataFrame:
    """Fills that a broker reports twice, written once each."""
    fills = replayed(spark, folder).where("event_type IN ('purchase', 'signup')").withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", "1 hour")
    twice = fills.select("event_id", "event_type", "user_id", "at", F.explode(F.array(F.lit(0), F.lit(1))).alias("copy"))
    return finished(twice.dropDuplicatesWithinWatermark(["event_id"]).select("event_id", "event_type", "user_id"), "fills")


@query("l01_micro_batches", "SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY event_type")
def micro_batches(spark: SparkSession, folder: str) -> DataFrame:
    """Each micro-batch's sums, merged after the stream has ended."""
    path = shared_path(spark, "batches")
    merge = lambda df, n: df.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).write.mode("overwrite").parquet(f"{path}/batch={n}")
    replayed(spark, folder).writeStream.foreachBatch(merge).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("event_type string, n bigint, total double").parquet(path).groupBy("event_type").agg(F.sum("n").alias("n"), F.round(F.sum("total"), 2).alias("total"))


# --- what a stream must remember: accounts, and who was heard last
LIMITS = Limits()
#: Readings of accounts: the balance moved by the event's value, now and then beyond belief.
EQUITY = "60000 + (value - 10 * floor(value / 10) - 6) * 950"
_READINGS = f"SELECT CAST(user_id AS VARCHAR) AS account, ts AS at, event_id AS key, {EQUITY} AS equity, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events"


def _account_sql() -> str:
    """The same, reading by reading."""
    m = LIMITS
    fine = f"(b.equity IS NOT NULL AND b.equity > {m.half * m.balance} AND (w.last IS NULL OR b.equity >= w.last * {m.jump}))"
    new = f"({fine} AND (w.day IS NULL OR CAST(b.at AS DATE) <> w.day))"
    start, peak = f"(CASE WHEN {new} THEN b.equity ELSE w.day_start END)", f"(CASE WHEN {fine} THEN greatest(w.peak, b.equity) ELSE w.peak END)"
    hits = f"(CASE WHEN NOT {fine} THEN w.hits WHEN b.equity <= {m.balance - m.total * m.balance} THEN w.hits + 1 ELSE 0 END)"
    below = f"({fine} AND b.equity <= {start} - {m.daily * m.balance})"
    first = f"SELECT account, CAST(NULL AS TIMESTAMP) AS at, CAST(NULL AS BIGINT) AS key, CAST(NULL AS DOUBLE) AS equity, CAST(0 AS BIGINT) AS n, CAST(NULL AS DOUBLE) AS last, CAST(NULL AS DATE) AS day, CAST({m.balance} AS DOUBLE) AS day_start, CAST({m.balance} AS DOUBLE) AS peak, false AS locked, false AS failed, 0 AS hits, 0 AS days, false AS accepted FROM (SELECT DISTINCT account FROM r) AS a"
    then = f"SELECT b.account, b.at, b.key, b.equity, b.n, CASE WHEN {fine} THEN b.equity ELSE w.last END, CASE WHEN {fine} THEN CAST(b.at AS DATE) ELSE w.day END, {start}, {peak}, (CASE WHEN {new} THEN false ELSE w.locked END) OR {below}, w.failed OR {hits} >= {m.confirmations}, {hits}, w.days + CASE WHEN {new} THEN 1 ELSE 0 END, {fine} FROM w JOIN r AS b ON b.account = w.account AND b.n = w.n + 1"
    return f"WITH RECURSIVE r AS MATERIALIZED ({_READINGS}), w AS ({first} UNION ALL {then}) "


_VERDICT = f"CASE WHEN failed THEN 'FAILED' WHEN last / {LIMITS.balance} - 1 >= {LIMITS.target} AND days >= {LIMITS.least_days} THEN 'PASSED' ELSE 'IN_PROGRESS' END"


def readings(spark: SparkSession, folder: str) -> DataFrame:
    return replayed(spark, folder).selectExpr("CAST(user_id AS STRING) AS account", "CAST(ts AS TIMESTAMP) AS at", "event_id AS key", f"{EQUITY} AS equity")


@query("l18_accepted_readings", _account_sql() + "SELECT key AS event_id, account, accepted, round(peak, 4) AS peak, locked, failed FROM w WHERE n > 0")
def accepted_readings(spark: SparkSession, folder: str) -> DataFrame:
    """Every reading, whether it was believed against the last one that was, and the account after it."""
    return finished(followed(readings(spark, folder), LIMITS), "readings").select(F.col("key").alias("event_id"), "account", "accepted", F.round("peak", 4).alias("peak"), "locked", "failed")


@query("r17_account_verdicts", _account_sql() + f"SELECT account, count(*) AS readings, CAST(count_if(accepted) AS BIGINT) AS accepted, round(max_by(peak, n), 4) AS peak, round(max_by(day_start, n), 4) AS day_start, max_by(locked, n) AS locked, max_by(failed, n) AS failed, max_by({_VERDICT}, n) AS verdict FROM w WHERE n > 0 GROUP BY account")
def account_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    """Accounts at the end of the stream: days rolled, days locked, failed after two believed readings below the floor, or passed."""
    told = finished(followed(readings(spark, folder), LIMITS), "accounts").withColumn("o", F.struct("at", "key"))
    at_end = lambda c: F.max_by(c, "o")
    return told.groupBy("account").agg(F.count("*").alias("readings"), F.count_if("accepted").alias("accepted"), F.round(at_end("peak"), 4).alias("peak"), F.round(at_end("day_start"), 4).alias("day_start"), at_end("locked").alias("locked"), at_end("failed").alias("failed"), at_end("verdict").alias("verdict"))


SILENT_S = 172_800
RESTS = "event_type = 'purchase' OR hour(ts) >= 20"


@query("l12_silence_alerts", f"SELECT CAST(user_id AS VARCHAR) AS source, date_trunc('millisecond', ts) AS since FROM (SELECT user_id, ts, event_id, {RESTS} AS resting, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, max(ts) OVER () AS seen FROM events) AS e WHERE NOT resting AND epoch_ms(coalesce(n, seen - INTERVAL 1 HOUR)) - epoch_ms(ts) {{more}} {SILENT_S * 1000}".replace("{more}", ">"))
def silence_alerts(spark: SparkSession, folder: str) -> DataFrame:
    """Users who were silent for two days, told once the stream's watermark has passed, but for those whose last event means rest."""
    heard = replayed(spark, folder).selectExpr("CAST(user_id AS STRING) AS source", "CAST(ts AS TIMESTAMP) AS at", f"{RESTS} AS resting")
    return finished(silences(heard, SILENT_S), "silences").select("source", F.col("since").cast("timestamp_ntz").alias("since"))
