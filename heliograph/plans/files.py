"""Files written and read back; DuckDB's side has the rows without the files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.operators.resample import resample
from heliograph.operators.storage import shared_path
from heliograph.plans.registry import query
from heliograph.sources.files import read_bars, read_journal, upserted, write_csv, write_report
from heliograph.sources.tables import EVENT_BARS_SQL, event_bars, table

_ROUND = "symbol, ts, round(open, 6) AS open, round(close, 6) AS close, volume"


@query("s02_csv_bar_scan", f"SELECT {_ROUND} FROM ({EVENT_BARS_SQL}) AS b")
def csv_bars(spark: SparkSession, folder: str) -> DataFrame:
    path = shared_path(spark, "csv")
    write_csv(event_bars(spark, folder), path)
    return read_bars(spark, path).selectExpr("symbol", "ts", "round(open, 6) AS open", "round(close, 6) AS close", "volume")


@query("s21_research_bar_scan", f"SELECT {_ROUND} FROM ({EVENT_BARS_SQL}) AS b WHERE symbol IN ('click', 'purchase') AND ts >= TIMESTAMP '2024-01-05 00:00:00'")
def research_bars(spark: SparkSession, folder: str) -> DataFrame:
    """Partitioned Parquet, read by symbol and time: folders and row groups are pruned."""
    path = shared_path(spark, "bars")
    event_bars(spark, folder).write.partitionBy("symbol").parquet(path)
    return read_bars(spark, path).where("symbol IN ('click', 'purchase') AND ts >= TIMESTAMP_NTZ'2024-01-05 00:00:00'").selectExpr("symbol", "ts", "round(open, 6) AS open", "round(close, 6) AS close", "volume")


@query("s03_catalogue", f"SELECT symbol, count(*) AS n, min(ts) AS first, max(ts) AS last FROM ({EVENT_BARS_SQL}) AS b GROUP BY symbol")
def bar_catalogue(spark: SparkSession, folder: str) -> DataFrame:
    """What a folder of bars holds, by symbol."""
    path = shared_path(spark, "bars")
    event_bars(spark, folder).write.partitionBy("symbol").parquet(path)
    return spark.read.parquet(path).groupBy("symbol").agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))


@query("s28_json_report", f"SELECT symbol, count(*) AS n, round(max(high), 6) AS top FROM ({EVENT_BARS_SQL}) AS b GROUP BY symbol")
def json_report(spark: SparkSession, folder: str) -> DataFrame:
    path = shared_path(spark, "report")
    write_report(event_bars(spark, folder).groupBy("symbol").agg(F.count("*").alias("n"), F.round(F.max("high"), 6).alias("top")), path)
    return spark.read.schema("symbol string, n bigint, top double").json(path)


@query("s29_metrics_csv", f"SELECT symbol, CAST(count(*) AS BIGINT) AS n, round(avg(close), 4) AS mean_close FROM ({EVENT_BARS_SQL}) AS b GROUP BY symbol")
def metrics_csv(spark: SparkSession, folder: str) -> DataFrame:
    path = shared_path(spark, "metrics")
    write_csv(event_bars(spark, folder).groupBy("symbol").agg(F.count("*").alias("n"), F.round(F.avg("close"), 4).alias("mean_close")), path)
    return spark.read.schema("symbol string, n bigint, mean_close double").option("header", True).csv(path)


@query("s41_glob_union", f"SELECT symbol, count(*) AS n FROM ({EVENT_BARS_SQL}) AS b WHERE symbol LIKE '%i%' GROUP BY symbol")
def glob_union(spark: SparkSession, folder: str) -> DataFrame:
    """Of many folders of files, those whose name fits."""
    path = shared_path(spark, "many")
    write_csv(event_bars(spark, folder).withColumn("part", F.col("symbol")), path, ["part"])
    return spark.read.schema("symbol string, ts string").option("header", True).csv(f"{path}/part=*i*").groupBy("symbol").agg(F.count("*").alias("n"))


@query("s14_map_upsert", "SELECT c_nationkey AS k, CASE WHEN c_nationkey % 2 = 0 THEN round(max(c_acctbal) + 1, 2) ELSE round(max(c_acctbal), 2) END AS v FROM customer GROUP BY c_nationkey UNION ALL SELECT 1000, 0.5")
def map_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """A map of prices with some entries replaced and one added, written and read as JSON."""
    held = table(spark, folder, "customer").groupBy(F.col("c_nationkey").cast("int").alias("k")).agg(F.round(F.max("c_acctbal"), 2).alias("v"))
    new = held.where("k % 2 = 0").select("k", F.round(F.col("v") + 1, 2).alias("v")).unionByName(spark.createDataFrame([(1000, 0.5)], "k int, v double"))
    path = shared_path(spark, "map")
    write_report(upserted(held, new, "k"), path)
    return spark.read.schema("k int, v double").json(path)


@query("s36_journal_migration", "SELECT CAST(4 + event_id % 3 AS INT) AS layout, event_type AS symbol, count(*) AS n, round(sum(round(value, 2)), 2) AS result FROM events WHERE value IS NOT NULL GROUP BY 4 + event_id % 3, event_type")
def journal_migration(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of three layouts in one journal, brought into one table."""
    value = F.format_string("%.2f", F.round("value", 2))
    at = F.col("event_id") % 3
    layouts = [F.concat_ws(",", "event_type", F.lit("x"), F.lit("exit"), value), F.concat_ws(",", "event_type", F.lit("x"), F.lit("1"), F.lit("exit"), value), F.concat_ws(",", F.lit("t"), "event_type", F.lit("x"), F.lit("1"), F.lit("exit"), value)]
    path = shared_path(spark, "journal")
    table(spark, folder, "events").where("value is not null").select(F.when(at == 0, layouts[0]).when(at == 1, layouts[1]).otherwise(layouts[2]).alias("line")).write.text(path)
    return read_journal(spark, path).groupBy("layout", "symbol").agg(F.count("*").alias("n"), F.round(F.sum("result"), 2).alias("result"))


@query("s34_journal_append", "SELECT event_type AS symbol, CAST(count(*) AS BIGINT) AS n, CAST(2 AS BIGINT) AS batches FROM events GROUP BY event_type")
def journal_append(spark: SparkSession, folder: str) -> DataFrame:
    """Two appends to one journal; each row keeps the number of its batch."""
    path = shared_path(spark, "append")
    events = table(spark, folder, "events").select(F.col("event_type").alias("symbol"), "event_id")
    for batch in (0, 1):
        events.where(F.pmod("event_id", F.lit(2)) == batch).withColumn("batch", F.lit(batch)).write.mode("append").option("header", True).csv(path)
    return spark.read.schema("symbol string, event_id bigint, batch int").option("header", True).csv(path).groupBy("symbol").agg(F.count("*").alias("n"), F.countDistinct("batch").alias("batches"))


# --- loaders that choose, papers that are written and read
PREFER = 20
_FINE = "(SELECT event_type AS symbol FROM (SELECT event_type, count(DISTINCT date_trunc('minute', ts)) AS minutes FROM events WHERE value IS NOT NULL GROUP BY event_type) AS m WHERE minutes >= {n})"
_FIVE = "SELECT event_type AS symbol, time_bucket(INTERVAL 5 MINUTE, ts) AS ts, min_by(value, row(ts, event_id)) AS open, max(value) AS high, min(value) AS low, max_by(value, row(ts, event_id)) AS close FROM events WHERE value IS NOT NULL GROUP BY event_type, time_bucket(INTERVAL 5 MINUTE, ts)"


@query("s26_finer_cache_first", f"SELECT symbol, timezone('UTC', timezone('Europe/Athens', ts)) AS utc, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, CASE WHEN symbol IN {_FINE.format(n=PREFER)} THEN 'm1' ELSE 'm5' END AS source FROM ({_FIVE}) AS b WHERE timezone('UTC', timezone('Europe/Athens', ts)) IS NOT NULL")
def finer_cache_first(spark: SparkSession, folder: str) -> DataFrame:
    """Five-minute bars: made from the cached one-minute bars of symbols that have them, else read as they are; then from the server's clock to UTC."""
    minutes, path = event_bars(spark, folder, 1), shared_path(spark, "cache")
    counts = minutes.groupBy("symbol").agg(F.count("*").alias("minutes")).where(f"minutes >= {PREFER}").select("symbol")
    minutes.join(counts, "symbol", "left_semi").write.partitionBy("symbol").parquet(f"{path}/m1")
    event_bars(spark, folder, 5).join(counts, "symbol", "left_anti").write.parquet(f"{path}/m5")
    fine = resample(spark.read.schema(minutes.schema).parquet(f"{path}/m1"), 5).withColumn("source", F.lit("m1"))
    read = fine.unionByName(spark.read.schema(minutes.schema).parquet(f"{path}/m5").withColumn("source", F.lit("m5")), allowMissingColumns=True)
    return read.selectExpr("symbol", "convert_timezone('Europe/Athens', 'UTC', ts) AS utc", *(f"round({c}, 6) AS {c}" for c in ("open", "high", "low", "close")), "source").where("utc IS NOT NULL")


def load_true_utc(spark: SparkSession, path: str, server: str = "Europe/Athens") -> DataFrame:
    """Bars of a file with their time in UTC: a zoned time is taken as it is, a plain one is the server's clock."""
    bars = spark.read.parquet(path)
    zoned = dict(bars.dtypes)["ts"] == "timestamp"
    return bars.withColumn("ts", F.col("ts").cast("timestamp_ntz") if zoned else F.expr(f"convert_timezone('{server}', 'UTC', ts)"))


@query("y44_zone_by_type", f"SELECT symbol, CASE WHEN symbol < 'm' THEN ts ELSE timezone('UTC', timezone('Europe/Athens', ts)) END AS ts, round(close, 6) AS close FROM ({EVENT_BARS_SQL}) AS b")
def zone_by_type(spark: SparkSession, folder: str) -> DataFrame:
    path, bars = shared_path(spark, "zones"), event_bars(spark, folder).select("symbol", "ts", "close")
    bars.where("symbol < 'm'").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(f"{path}/zoned")
    bars.where("NOT symbol < 'm'").write.parquet(f"{path}/plain")
    both = load_true_utc(spark, f"{path}/zoned").unionByName(load_true_utc(spark, f"{path}/plain"))
    return both.select("symbol", "ts", F.round("close", 6).alias("close"))


_PAPER = "doc_id, lang AS category, source AS query, length(text) AS n_chars"


@query("s33_paper_sink", f"SELECT {_PAPER}, md5(text) AS abstract_md5 FROM documents WHERE text IS NOT NULL")
def paper_sink(spark: SparkSession, folder: str) -> DataFrame:
    """Papers as JSON lines and as Parquet; what the JSON keeps is joined to what the Parquet keeps."""
    path = shared_path(spark, "papers")
    papers = table(spark, folder, "documents").where("text IS NOT NULL").selectExpr("doc_id", "lang AS category", "source AS query", "text AS abstract")
    papers.select("doc_id", "abstract").write.option("compression", "gzip").json(f"{path}/json")
    papers.drop("abstract").write.parquet(f"{path}/parquet")
    told = spark.read.schema("doc_id bigint, abstract string").json(f"{path}/json")
    return spark.read.parquet(f"{path}/parquet").join(told, "doc_id").selectExpr("doc_id", "category", "query", "length(abstract) AS n_chars", "md5(abstract) AS abstract_md5")


@query("s37_paper_csv_scan", "SELECT doc_id, lang AS category, md5(regexp_replace(left(text, 200), '[\\r\\n]+', ' ', 'g')) AS title_md5 FROM documents WHERE text IS NOT NULL")
def paper_csv(spark: SparkSession, folder: str) -> DataFrame:
    """A CSV of papers, quotes and separators inside titles kept."""
    path = shared_path(spark, "papers-csv")
    table(spark, folder, "documents").where("text IS NOT NULL").selectExpr("doc_id", "lang AS category", r"regexp_replace(left(text, 200), '[\\r\\n]+', ' ') AS title").write.option("header", True).option("escape", '"').option("quoteAll", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    read = spark.read.schema("doc_id bigint, category string, title string").option("header", True).option("escape", '"').csv(path)
    return read.selectExpr("doc_id", "category", "md5(coalesce(title, '')) AS title_md5")


def csv_cache(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """Rows of ``symbol``, ``ts`` and ``value`` from the cache at ``path``, which is made first if it is not there.

    Of rows with one symbol and time the first by ``key`` is cached. Times are text: one with a zone is
    taken to UTC, one without is UTC already.
    """
    jvm = spark.sparkContext._jvm
    done = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        first = make().groupBy("symbol", "ts").agg(F.min_by("value", "key").alias("value"))
        first.selectExpr("symbol", "ts", "value").write.option("header", True).csv(path)
    read = spark.read.schema("symbol string, ts string, value double").option("header", True).csv(path)
    zoned = read.where("ts RLIKE '[+-][0-9]{2}:[0-9]{2}$'").withColumn("ts", F.expr("CAST(substring(ts, 1, 19) AS timestamp_ntz) - make_dt_interval(0, CAST(substring(ts, 20, 3) AS INT), CAST(concat(substring(ts, 20, 1), right(ts, 2)) AS INT), 0)"))
    plain = read.where("NOT ts RLIKE '[+-][0-9]{2}:[0-9]{2}$'").withColumn("ts", F.expr("CAST(ts AS timestamp_ntz)"))
    return zoned.unionByName(plain)


def _twice(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The cache's rows on its second use, when nothing is made any more."""
    path = shared_path(spark, name)
    csv_cache(spark, path, make)

    def never() -> DataFrame:
        raise ValueError(f"{path} should be there")

    return csv_cache(spark, path, never).selectExpr("symbol", "ts", "round(value, 6) AS value")


@query("s12_csv_cache", "SELECT event_type AS symbol, date_trunc('hour', ts) AS ts, round(min_by(value, row(ts, event_id)), 6) AS value FROM events WHERE value IS NOT NULL GROUP BY event_type, date_trunc('hour', ts)")
def cached_ticks(spark: SparkSession, folder: str) -> DataFrame:
    """The first tick of every hour; some symbols' times are cached with a zone, the others' without."""
    text = "CASE WHEN event_type < 'm' THEN concat(date_format(date_trunc('hour', ts) + INTERVAL 2 HOUR, 'yyyy-MM-dd HH:mm:ss'), '+02:00') ELSE date_format(date_trunc('hour', ts), 'yyyy-MM-dd HH:mm:ss') END"
    return _twice(spark, "ticks", lambda: table(spark, folder, "events").where("value IS NOT NULL").selectExpr("event_type AS symbol", f"{text} AS ts", "value", "struct(ts, event_id) AS key"))


@query("s19_macro_cache", "SELECT o_orderpriority AS symbol, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS ts, round(min_by(o_totalprice, row(o_orderdate, o_orderkey)), 6) AS value FROM orders GROUP BY o_orderpriority, date_trunc('month', o_orderdate)")
def cached_macro(spark: SparkSession, folder: str) -> DataFrame:
    """A sparse series for each order priority, one value a month."""
    return _twice(spark, "macro", lambda: table(spark, folder, "orders").selectExpr("o_orderpriority AS symbol", "date_format(date_trunc('month', o_orderdate), 'yyyy-MM-dd HH:mm:ss') AS ts", "o_totalprice AS value", "struct(o_orderdate, o_orderkey) AS key"))
