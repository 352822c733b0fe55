"""Models by Spark's own library, walked forward: fitted on the dates so far, judged on those after a gap.

Dates are cut into equal runs. Fold k is fitted on the first k runs and scores the next
one, but for its first dates (the embargo). The matrix is written once to the shared folder; the folds
are fitted side by side from it, and what they predict is put together. Library
fits have no SQL form; tests hold folds, books and walks against plain code, and
fits against planted signals.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heliograph.functions.series import last, lead, log_return, rolling
from heliograph.operators.asof import as_of
from heliograph.operators.chunks import written
from heliograph.operators.occupancy import taken
from heliograph.operators.resample import resample
from heliograph.operators.staged import staged_sql, with_stages
from heliograph.plans.registry import query, rounded, table_query
from heliograph.plans.statistics import _MARKET, _ROLL
from heliograph.plans.tables import _PANEL
from heliograph.plans.walks import outcome_frame
from heliograph.sources.tables import DAILY_BARS_SQL, daily_bars, event_bars, table

MOMENTUM, SHAPE, VOLUME = ["mom5", "mom20", "z20"], ["ibs", "rng"], ["vol_ratio"]
FEATURES = [*MOMENTUM, *SHAPE, *VOLUME]
_STAGES = (
    {"r": log_return(), "ibs": "coalesce((close - low) / nullif(high - low, 0), 0.5)", "rng": "(high - low) / close"},
    {"mom5": rolling("sum", "r", 5), "mom20": rolling("sum", "r", 20), "mu": rolling("avg", "close", 20), "sd": rolling("stddev_samp", "close", 20), "vol_ratio": f"volume / nullif(avg(volume) {last(20)}, 0)"},
    {"z20": "(close - mu) / nullif(sd, 0)", "fwd": f"ln({lead('close')}) - ln(close)"},
)


def dataset(bars: DataFrame) -> DataFrame:
    """``symbol``, ``ts``, the features and ``fwd``, the next bar's return; rows without one of them are left out."""
    return with_stages(bars, _STAGES).select("symbol", "ts", *FEATURES, "fwd", (F.col("fwd") > 0).cast("double").alias("up")).dropna()


FOLDS, EMBARGO = 4, 5
#: Dates (two numbers and a time each) that are broadcast to the matrix; more are joined.
MOST_DATES = 200_000


def folded(data: DataFrame, date: str = "ts") -> DataFrame:
    """``data`` with ``_no``, the number of its date from 0 on, and ``_all``, the number of dates, in the shared folder."""
    days = data.select(date).distinct()
    # One row a date, so one task numbers them.
    placed = days.select(date, (F.row_number().over(Window.orderBy(date)) - 1).cast("long").alias("_no"), F.count("*").over(Window.partitionBy()).alias("_all"))
    return written(data.join(F.broadcast(placed) if placed.count() <= MOST_DATES else placed, date), "matrix")


def fold_bounds(n: int, folds: int = FOLDS, embargo: int = EMBARGO) -> list[tuple[int, int, int]]:
    """For each fold: dates that it is fitted on, the first date that it scores, and the one after the last."""
    size = n // (folds + 1)
    return [(k * size, k * size + embargo, min((k + 1) * size, n)) for k in range(1, folds + 1) if k * size + embargo < min((k + 1) * size, n)]


def walk_forward(matrix: DataFrame, score: Callable[[DataFrame, DataFrame], DataFrame], folds: int = FOLDS, embargo: int = EMBARGO) -> DataFrame:
    """Out-of-fold rows of ``score(train, test)`` with their ``fold``; ``matrix``: from ``folded``."""
    first = matrix.select("_all").first()
    bounds = fold_bounds(first[0] if first else 0, folds, embargo)

    def one(k: int) -> DataFrame:
        end, begin, stop = bounds[k]
        return score(matrix.where(F.col("_no") < end), matrix.where((F.col("_no") >= begin) & (F.col("_no") < stop))).withColumn("fold", F.lit(k + 1))

    if not bounds:
        return score(matrix, matrix.limit(0)).withColumn("fold", F.lit(0)) if first else matrix.limit(0)
    with ThreadPoolExecutor(len(bounds)) as pool:
        return reduce(DataFrame.unionByName, list(pool.map(one, range(len(bounds)))))


def fitted(train: DataFrame, model, features: list[str]):  # noqa: ANN001, ANN201
    steps = [VectorAssembler(inputCols=features, outputCol="_raw"), StandardScaler(inputCol="_raw", outputCol="features", withMean=True), model]
    return Pipeline(stages=steps).fit(train)


def scored(model, rows: DataFrame) -> DataFrame:  # noqa: ANN001
    """``rows`` with ``p``: the probability of the label, or what a regression predicts."""
    found = model.transform(rows)
    value = vector_to_array("probability")[1] if "probability" in found.columns else F.col("prediction")
    return found.withColumn("p", value).drop("_raw", "features", "rawPrediction", "probability", "prediction")


def probabilities(train: DataFrame, test: DataFrame, model, features: list[str]) -> DataFrame:  # noqa: ANN001
    """``test`` with ``p``, the probability that the next bar rises."""
    return scored(fitted(train, model, features), test)


def auc(scored: DataFrame, label: str = "up", score: str = "p") -> DataFrame:
    """Area under the curve by symbol, from counts of every distinct score."""
    counts = scored.groupBy("symbol", score).agg(F.sum(label).alias("pos"), F.sum(1 - F.col(label)).alias("neg"))
    below = F.sum("neg").over(Window.partitionBy("symbol").orderBy(score)) - F.col("neg") / 2
    return counts.withColumn("wins", F.col("pos") * below).groupBy("symbol").agg((F.sum("wins") / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0.0))).alias("auc"), F.sum(F.col("pos") + F.col("neg")).cast("bigint").alias("n"))


def regression(label: str = "fwd") -> GBTRegressor:
    return GBTRegressor(featuresCol="features", labelCol=label, maxIter=10, maxDepth=3, stepSize=0.1, seed=42)


def logistic() -> LogisticRegression:
    return LogisticRegression(featuresCol="features", labelCol="up", maxIter=50, regParam=0.01)


def boosted(**more) -> GBTClassifier:  # noqa: ANN003
    return GBTClassifier(featuresCol="features", labelCol="up", maxIter=10, maxDepth=3, stepSize=0.1, seed=42, **more)


_SHOWN = ["symbol", "ts", *(f"{rounded(f)} AS {f}" for f in (*FEATURES, "fwd")), "CAST(up AS INT) AS up"]
_ROWS = f"SELECT *, CASE WHEN fwd > 0 THEN 1 ELSE 0 END AS up FROM ({staged_sql(DAILY_BARS_SQL, _STAGES)}) AS s WHERE {' AND '.join(f'{f} IS NOT NULL' for f in (*FEATURES, 'fwd'))}"


@query("m14_dataset", f"SELECT {', '.join(_SHOWN)} FROM ({_ROWS}) AS d")
def prepared(spark: SparkSession, folder: str) -> DataFrame:
    return dataset(daily_bars(spark, folder)).selectExpr(*_SHOWN)


def out_of_fold(data: DataFrame, model: Callable, features: list[str]) -> DataFrame:
    """Rows scored by the fold that had not seen them."""
    return walk_forward(folded(data), lambda train, test: probabilities(train, test, model(), features))


#: Blocks of features by name; a study names the blocks that it takes.
BLOCKS = {"momentum": MOMENTUM, "shape": SHAPE, "volume": VOLUME}


def block_columns(data: DataFrame, names: list[str]) -> DataFrame:
    """``symbol``, ``ts`` and the features of the blocks, in their order."""
    return data.select("symbol", "ts", *(f for n in names for f in BLOCKS[n]))


@query("p16_column_blocks", f"SELECT symbol, ts, {', '.join(f'{rounded(f)} AS {f}' for f in (*VOLUME, *SHAPE))} FROM ({_ROWS}) AS d")
def column_blocks(spark: SparkSession, folder: str) -> DataFrame:
    return block_columns(dataset(daily_bars(spark, folder)), ["volume", "shape"]).selectExpr("symbol", "ts", *(f"{rounded(f)} AS {f}" for f in (*VOLUME, *SHAPE)))


@query("m05_logistic_scaled")
def logistic_auc(spark: SparkSession, folder: str) -> DataFrame:
    return auc(out_of_fold(dataset(daily_bars(spark, folder)), logistic, FEATURES))


@query("m03_boosted_classifier")
def boosted_auc(spark: SparkSession, folder: str) -> DataFrame:
    return auc(out_of_fold(dataset(daily_bars(spark, folder)), boosted, FEATURES))


@query("m04_boosted_regressor")
def boosted_regression(spark: SparkSession, folder: str) -> DataFrame:
    """Correlation of predicted and later returns by symbol, out of fold."""
    rows = out_of_fold(dataset(daily_bars(spark, folder)), regression, FEATURES)
    return rows.groupBy("symbol").agg(F.corr("p", "fwd").alias("ic"), F.count("*").alias("n"))


# --- models that decide which trades to take, one position at a time
TAKE_SHARE, TRADE_COST = 0.6, 0.05
TRADED = ["trades", "win", "expectancy", "total", "profit_factor", "drawdown", "auc"]


def traded(matrix: DataFrame, model: Callable, features: list[str]) -> DataFrame:
    """Out-of-fold rows of ``symbol``, ``n``, ``r``, ``held``, ``up``, with ``p`` and ``take``: at or above the quantile of what the fold predicts for its own training rows."""

    def score(train: DataFrame, test: DataFrame) -> DataFrame:
        own = fitted(train, model(), features)
        limit = scored(own, train).agg(F.percentile("p", F.lit(TAKE_SHARE)).alias("v")).first()["v"]
        return scored(own, test).withColumn("take", F.col("p") >= F.lit(limit))

    return walk_forward(matrix, score)


def walked_trades(rows: DataFrame, cost: float = TRADE_COST) -> DataFrame:
    """Trades of rows with ``take``, in each fold and symbol one position at a time: ``fold``, ``symbol``, ``n``, ``r`` after costs."""
    entries = written(rows.where("take AND r IS NOT NULL").select("fold", "symbol", F.concat_ws("|", "symbol", "fold").alias("key"), "n", (F.col("r") - cost).alias("r"), (F.col("n") + F.greatest("held", F.lit(1))).alias("free")), "entries")
    return entries.join(taken(entries, "key"), ["key", "n"]).select("fold", "symbol", "n", "r")


def trade_figures(rows: DataFrame, trades: DataFrame) -> DataFrame:
    """By symbol: what the trades come to, and the area under the curve of all rows that were scored."""
    w = Window.partitionBy("symbol").orderBy("n")
    falls = trades.withColumn("eq", F.sum("r").over(w)).withColumn("fall", F.col("eq") - F.max("eq").over(w))
    gains, losses = F.sum(F.greatest("r", F.lit(0.0))), -F.sum(F.least("r", F.lit(0.0)))
    made = falls.groupBy("symbol").agg(F.count("*").alias("trades"), F.avg((F.col("r") > 0).cast("double")).alias("win"), F.avg("r").alias("expectancy"), F.sum("r").alias("total"), (gains / F.nullif(losses, F.lit(0.0))).alias("profit_factor"), F.min("fall").alias("drawdown"))
    return auc(rows).join(made, "symbol", "left").select("symbol", "n", *TRADED)


def trade_matrix(spark: SparkSession, folder: str) -> DataFrame:
    """Hourly features with the results of both sides entered at the next bar's open."""
    later = outcome_frame(spark, folder).select("symbol", "ts", "n", "r_l", "h_l", "r_s", "h_s")
    bars = event_bars(spark, folder)
    known, before = dataset(bars).drop("up", "fwd"), with_stages(bars, [{"entered": lead("ts")}]).select("symbol", "ts", "entered")
    return known.join(before, ["symbol", "ts"]).drop("ts").withColumnRenamed("entered", "ts").join(later, ["symbol", "ts"])


@query("m10_direct_model")
def direct_model(spark: SparkSession, folder: str) -> DataFrame:
    """Long trades that a model of their own results takes."""
    data = trade_matrix(spark, folder).where("r_l IS NOT NULL").selectExpr("symbol", "ts", "n", *FEATURES, "r_l AS r", "h_l AS held", "CAST(r_l > 0 AS DOUBLE) AS up")
    rows = written(traded(folded(data), boosted, FEATURES), "scored")
    return trade_figures(rows, walked_trades(rows))


@query("m09_meta_labels")
def meta_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Trades with the trend at every bar, of which a second model takes those that it expects to win."""
    data = trade_matrix(spark, folder).selectExpr("symbol", "ts", "n", *FEATURES, "CASE WHEN z20 > 0 THEN r_l ELSE r_s END AS r", "CASE WHEN z20 > 0 THEN h_l ELSE h_s END AS held").where("r IS NOT NULL").withColumn("up", F.expr("CAST(r > 0 AS DOUBLE)"))
    rows = written(traded(folded(data), logistic, FEATURES), "scored")
    return trade_figures(rows, walked_trades(rows))


# --- what each block of features is worth
def without_blocks(matrix: DataFrame, blocks: dict[str, list[str]], features: list[str]) -> DataFrame:
    """By the block that is ``without``: area under the curve of the direction, and R2 of the volatility ahead against the training mean, out of fold."""
    found = []
    for name, out in blocks.items():
        left = [f for f in features if f not in out]

        def score(train: DataFrame, test: DataFrame, left: list[str] = left) -> DataFrame:
            mean = train.agg(F.avg("vol_ahead")).first()[0]
            both = probabilities(train, test, logistic(), left)
            return scored(fitted(train, regression("vol_ahead"), left), both.withColumnRenamed("p", "p_up")).withColumn("mean", F.lit(mean))

        rows = written(walk_forward(matrix, score), "scored")
        fit = rows.agg((1 - F.sum(F.pow(F.col("vol_ahead") - F.col("p"), 2)) / F.nullif(F.sum(F.pow(F.col("vol_ahead") - F.col("mean"), 2)), F.lit(0.0))).alias("r2_volatility"))
        own = auc(rows.withColumn("symbol", F.lit("all")), score="p_up").select("auc", "n")
        found.append(own.crossJoin(fit).withColumn("without", F.lit(name)))
    return reduce(DataFrame.unionByName, found)


VOL_AHEAD = {"vol_ahead": "ln(1e-6 + stddev_samp(r) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING))"}


@query("m11_ablation")
def ablation(spark: SparkSession, folder: str) -> DataFrame:
    """Direction and volatility without each block of features, and with all."""
    rows = with_stages(daily_bars(spark, folder), [*_STAGES, VOL_AHEAD]).select("symbol", "ts", *FEATURES, "vol_ahead", (F.col("fwd") > 0).cast("double").alias("up")).dropna()
    return without_blocks(folded(rows), {"all": [], "momentum": MOMENTUM, "shape": SHAPE, "volume": VOLUME}, FEATURES)


FLOW = ["ticks", "imbalance", "tick_rv"]


@query("m12_flow_ablation")
def flow_ablation(spark: SparkSession, folder: str) -> DataFrame:
    """As ``m11_ablation``, for what the ticks inside an hourly bar add to the bars."""
    ticks = table(spark, folder, "events").where("value IS NOT NULL").withColumn("h", F.date_trunc("hour", F.col("ts").cast("timestamp")).cast("timestamp_ntz"))
    moves = ticks.withColumn("r", F.log("value") - F.log(F.lag("value").over(Window.partitionBy("event_type", "h").orderBy("ts", "event_id"))))
    flow = moves.groupBy(F.col("event_type").alias("symbol"), F.col("h").alias("ts")).agg(F.count("*").cast("double").alias("ticks"), F.coalesce((F.count_if(F.col("r") > 0) - F.count_if(F.col("r") < 0)) / F.nullif(F.count_if(F.col("r") != 0), F.lit(0)), F.lit(0.0)).alias("imbalance"), F.coalesce(F.sqrt(F.sum(F.col("r") * F.col("r"))), F.lit(0.0)).alias("tick_rv"))
    bars = with_stages(event_bars(spark, folder), [*_STAGES, VOL_AHEAD]).select("symbol", "ts", *FEATURES, "vol_ahead", (F.col("fwd") > 0).cast("double").alias("up"))
    return without_blocks(folded(bars.join(flow, ["symbol", "ts"]).dropna()), {"all": [], "flow": FLOW}, [*FEATURES, *FLOW])


COARSE = [f"c_{f}" for f in FEATURES]


@query("m13_frame_study")
def frame_study(spark: SparkSession, folder: str) -> DataFrame:
    """As ``m11_ablation``, for what bars of four hours, known only once they have closed, add to hourly ones."""
    bars = event_bars(spark, folder)
    coarse = with_stages(resample(bars, 240), _STAGES[:2] + ({"z20": _STAGES[2]["z20"]},)).select("symbol", (F.col("ts") + F.expr("INTERVAL 4 HOUR")).alias("ts"), *(F.col(f).alias(f"c_{f}") for f in FEATURES)).dropna()
    own = with_stages(bars, [*_STAGES, VOL_AHEAD]).select("symbol", "ts", *FEATURES, "vol_ahead", (F.col("fwd") > 0).cast("double").alias("up"))
    return without_blocks(folded(as_of(own, coarse, "ts", ["symbol"], COARSE).dropna()), {"all": [], "coarse": COARSE}, [*FEATURES, *COARSE])


# --- cross-sections of a monthly panel
XS = ["mom_12_1", "mom_6_1", "mom_3_1", "rev_1", "vol_6", "from_high"]
_LAGS = "SELECT m, k, ln(v) AS p, ln(lag(v, 1) OVER w) AS p1, ln(lag(v, 3) OVER w) AS p3, ln(lag(v, 6) OVER w) AS p6, ln(lag(v, 12) OVER w) AS p12, ln(lead(v, 1) OVER w) AS next, max(ln(v)) OVER (PARTITION BY k ORDER BY m ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS top FROM " + _PANEL + " AS x WHERE v > 0 WINDOW w AS (PARTITION BY k ORDER BY m)"
_RAW = f"SELECT m, k, p1 - p12 AS mom_12_1, p1 - p6 AS mom_6_1, p1 - p3 AS mom_3_1, p - p1 AS rev_1, stddev_samp(p - p1) OVER (PARTITION BY k ORDER BY m ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS vol_6, p - top AS from_high, next - p AS f FROM ({_LAGS}) AS l"
_PCT = "(rank() OVER (PARTITION BY m ORDER BY {x}) + (count(*) OVER (PARTITION BY m, {x}) - 1) / CAST(2 AS DOUBLE)) / count(*) OVER (PARTITION BY m) - CAST(0.5 AS DOUBLE)"
XS_PANEL = f"SELECT m, k, {', '.join(f'{_PCT.format(x=x)} AS {x}' for x in XS)}, f - avg(f) OVER (PARTITION BY m) AS y FROM ({_RAW}) AS r WHERE {' AND '.join(f'{x} IS NOT NULL' for x in (*XS, 'f'))}"
table_query("c04_dated_panel", f"SELECT m, k, {', '.join(f'{rounded(x)} AS {x}' for x in (*XS, 'y'))} FROM ({XS_PANEL}) AS p", None, ["orders", "customer"])
DECILE, SIDE_COST = 0.10, 0.0005


def decile_book(rows: DataFrame) -> DataFrame:
    """By date: names, rank correlation of ``p`` and ``y``, and the results before and after costs of the book that is long the highest tenth and short the lowest."""
    w = Window.partitionBy("m")
    mid = lambda c: F.rank().over(w.orderBy(c)) + (F.count("*").over(Window.partitionBy("m", c)) - 1) / 2
    placed = rows.select("m", "k", "y", "p", mid("p").alias("rp"), mid("y").alias("ry"), F.row_number().over(w.orderBy(F.desc("p"), "k")).alias("hi"), F.row_number().over(w.orderBy("p", "k")).alias("lo"), F.greatest(F.floor(F.count("*").over(w) * DECILE), F.lit(1)).alias("q"))
    weighed = placed.withColumn("w", (F.col("hi") <= F.col("q")).cast("int") * 0.5 / F.col("q") - (F.col("lo") <= F.col("q")).cast("int") * 0.5 / F.col("q"))
    # A book's turnover is against the book of the date scored before; one row a date numbers them.
    dates = weighed.select("m").distinct().withColumn("t", F.row_number().over(Window.orderBy("m")))
    at = weighed.join(dates, "m")
    before = at.select("k", (F.col("t") + 1).alias("t"), F.col("w").alias("w0"))
    turned = at.join(before, ["k", "t"], "left").withColumn("turn", F.abs(F.col("w") - F.coalesce("w0", F.lit(0.0))))
    out = turned.groupBy("m", "t").agg(F.count("*").alias("names"), F.corr("rp", "ry").alias("ic"), F.sum(F.col("w") * F.col("y")).alias("gross"), F.sum("turn").alias("turnover"))
    return out.select("m", "names", "ic", "gross", (F.col("gross") - SIDE_COST * F.when(F.col("t") == 1, 1.0).otherwise(F.col("turnover"))).alias("net"))


@query("c12_cross_section_book")
def cross_section_book(spark: SparkSession, folder: str) -> DataFrame:
    """Ranked features of a panel, a model walked forward over its dates, and the decile book of what it predicts."""
    panel = spark.sql(XS_PANEL, **{t: table(spark, folder, t) for t in ("orders", "customer")})
    return decile_book(walk_forward(folded(panel, "m"), lambda train, test: probabilities(train, test, regression("y"), XS), embargo=1))


BREADTH = ["above", "adv", "disp", "med", "new_high", "m5", "v20", "corr_proxy"]
_WIDE = f"SELECT *, v20 / nullif(disp, 0) AS corr_proxy, sum(mr) OVER (ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS fwd, count(mr) OVER (ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS later, row_number() OVER (ORDER BY ts) AS i FROM (SELECT *, CASE WHEN count(mr) {_ROLL.format(4)} = 5 THEN sum(mr) {_ROLL.format(4)} END AS m5, CASE WHEN count(mr) {_ROLL.format(19)} = 20 THEN stddev_samp(mr) {_ROLL.format(19)} END AS v20 FROM ({_MARKET}) AS m) AS n"


@query("c13_breadth_to_index")
def breadth_to_index(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the breadth of all symbols tells the market's next five days: by fold, area under the curve and rank correlation, on every fifth day."""
    rows = spark.sql(f"SELECT ts, {', '.join(BREADTH)}, fwd, CAST(fwd > 0 AS DOUBLE) AS up FROM ({_WIDE}) AS w WHERE later = 5 AND i % 5 = 1", days=daily_bars(spark, folder)).dropna()
    both = walk_forward(folded(rows), lambda train, test: scored(fitted(train, regression("fwd"), BREADTH), probabilities(train, test, boosted(), BREADTH).withColumnRenamed("p", "p_up")), embargo=1)
    named = written(both.withColumn("symbol", F.col("fold").cast("string")), "scored")
    w = Window.partitionBy("symbol")
    ranks = named.select("symbol", F.rank().over(w.orderBy("p")).alias("a"), F.rank().over(w.orderBy("fwd")).alias("b")).groupBy("symbol").agg(F.corr("a", "b").alias("ic"))
    return auc(named, score="p_up").join(ranks, "symbol").select(F.col("symbol").cast("int").alias("fold"), "n", "auc", "ic")


_SELECTED = """WITH RECURSIVE p AS (SELECT symbol, ts, r FROM (SELECT symbol, ts, close / lag(close) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS r FROM ({days}) AS d) AS x WHERE r IS NOT NULL),
k AS (SELECT symbol, row_number() OVER (ORDER BY avg(r) / stddev_pop(r) DESC, symbol) AS i FROM p GROUP BY symbol),
f AS (SELECT t.ts, s.symbol, coalesce(p.r, 0) AS r FROM (SELECT DISTINCT ts FROM p) AS t CROSS JOIN (SELECT DISTINCT symbol FROM p) AS s LEFT JOIN p ON p.ts = t.ts AND p.symbol = s.symbol),
c AS (SELECT a.symbol AS x, b.symbol AS y, abs(corr(a.r, b.r)) AS rho FROM f AS a JOIN f AS b ON a.ts = b.ts GROUP BY a.symbol, b.symbol),
g AS (SELECT CAST(1 AS BIGINT) AS i, [symbol] AS kept FROM k WHERE i = 1 UNION ALL SELECT k.i, CASE WHEN (SELECT max(rho) FROM c WHERE x = k.symbol AND list_contains(g.kept, y)) < 0.9 THEN list_append(g.kept, k.symbol) ELSE g.kept END FROM g JOIN k ON k.i = g.i + 1)
SELECT CAST(generate_subscripts(kept, 1) - 1 AS INT) AS place, unnest(kept) AS symbol FROM (SELECT kept FROM g ORDER BY i DESC LIMIT 1) AS z"""


@query("f01_decorrelated_selection", _SELECTED.replace("{days}", DAILY_BARS_SQL))
def decorrelated(spark: SparkSession, folder: str, most: float = 0.9, least_sharpe: float = -10.0) -> DataFrame:
    """Symbols by Sharpe ratio, each kept if it is little correlated with all that were kept before.

    Ratios and correlations are aggregated by Spark; only one number a symbol
    and one a pair of symbols come to the driver, whose choice is sequential.
    """
    w = Window.partitionBy("symbol").orderBy("ts")
    r = daily_bars(spark, folder).select("symbol", "ts", (F.col("close") / F.lag("close").over(w) - 1).alias("r")).dropna()
    ranked = r.groupBy("symbol").agg((F.avg("r") / F.stddev_pop("r") * 252**0.5).alias("sharpe")).where(F.col("sharpe") >= least_sharpe).orderBy(F.desc("sharpe"), "symbol").collect()
    days = r.select("ts").distinct()
    full = days.crossJoin(r.select("symbol").distinct()).join(r, ["ts", "symbol"], "left").fillna(0.0)
    a, b = full.alias("a"), full.alias("b")
    rho = {(x[0], x[1]): x[2] for x in a.join(b, "ts").groupBy(F.col("a.symbol"), F.col("b.symbol")).agg(F.corr("a.r", "b.r")).collect()}
    kept: list[str] = []
    for row in ranked:
        if all(abs(rho[row.symbol, k]) < most for k in kept):
            kept.append(row.symbol)
    return spark.createDataFrame([(i, s) for i, s in enumerate(kept)], "place int, symbol string")
