"""Sorting of papers by keywords: families, what rules them out, and the catalogue of hypotheses that they support.

A paper is one text, lower-cased; nothing else is read.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, SparkSession

from heliograph.operators.storage import shared_path
from heliograph.plans.registry import query, table_query, without_decimals
from heliograph.plans.trades import BOTH
from heliograph.sources.tables import table

#: Keywords of the families that papers are sorted into, of what rules them out, and of tests on prices.
FAMILIES = {
    "momentum": ["momentum", "trend follow", "time series momentum", "moving average", "trend-following", "continuation", "drift"],
    "reversal": ["mean reversion", "reversal", "contrarian", "overreaction", "mean-reverting"],
    "breakout": ["breakout", "opening range", "range expansion", "channel"],
    "seasonality": ["seasonal", "calendar", "day-of-week", "day of the week", "turn-of-month", "turn of the month", "month-of-year", "holiday", "time-of-day", "intraday pattern", "overnight return", "weekend"],
    "volatility": ["volatility timing", "volatility risk premium", "realized volatility", "variance risk", "vol target", "garch", "volatility forecast", "vix"],
    "pairs_statarb": ["pairs trading", "statistical arbitrage", "cointegration", "cointegrated", "spread trading", "relative value"],
    "lead_lag": ["lead-lag", "lead lag", "cross-asset predictab", "spillover", "granger"],
    "carry": ["carry", "term structure", "roll yield", "futures curve", "contango", "backwardation"],
    "regime": ["regime", "hidden markov", "markov switching", "regime-switching"],
    "cross_sectional": ["cross-section", "cross section", "factor", "ranking", "long-short portfolio"],
}
EXCLUDED = {
    "order_book": ["limit order book", "order book", "order flow", "market microstructure", "bid-ask", "depth", "queue", "high-frequency quotes", "tick-by-tick order"],
    "options": ["option pricing", "implied volatility surface", "greeks", "american option", "european option", "call option", "put option", "derivative pricing", "hedging"],
    "fundamentals": ["earnings", "balance sheet", "fundamental", "accounting", "book-to-market", "dividend", "analyst", "10-k", "financial statement"],
    "textnlp": ["sentiment", "news", "text", "nlp", "language model", "llm", "twitter", "social media", "tweet"],
    "crypto": ["cryptocurrency", "bitcoin", "crypto", "blockchain", "defi", "token"],
    "theory": ["stochastic control", "hamilton-jacobi", "partial differential equation", "utility maximization", "no-arbitrage bound", "viscosity solution", "mean field game", "optimal execution", "market making"],
}
EMPIRICAL = ["return predictab", "trading strategy", "backtest", "sharpe", "excess return", "abnormal return", "price", "futures", "index", "commodity", "forex", "exchange rate", "profitable"]
#: Markers of the families that hypotheses belong to.
MARKERS = {
    "intraday_momentum_breakout": ["intraday momentum", "opening range", "time series momentum", "breakout", "trend following", "momentum strategy", "last half-hour", "first half-hour", "range breakout", "continuation"],
    "mean_reversion_extreme": ["mean reversion", "reversal", "contrarian", "overreaction", "vwap", "bollinger", "oversold", "overbought", "short-term reversal", "price reversal", "reverting"],
    "microstructure_session_seasonality": ["order flow", "order imbalance", "toxicity", "vpin", "microstructure", "market open", "market close", "closing auction", "calendar anomaly", "day of the week", "turn of the month", "seasonality", "intraday pattern", "london fix", "fixing", "overnight return", "night effect"],
    "cross_asset_lead_lag": ["lead lag", "lead-lag", "spillover", "cross-asset", "cross asset", "information transmission", "pairs trading", "cointegration", "cross-sectional momentum", "relative strength", "contagion"],
    "volatility_skew_dynamics": ["realized volatility", "volatility spillover", "variance risk", "skewness", "volatility of volatility", "volatility clustering", "realized skewness", "vol-of-vol", "volatility timing", "volatility managed", "garch"],
}
ABBREVIATIONS = {"intraday_momentum_breakout": "MOM", "mean_reversion_extreme": "REV", "microstructure_session_seasonality": "SES", "cross_asset_lead_lag": "XAS", "volatility_skew_dynamics": "VOL"}
PAPERS = "SELECT doc_id, lower(coalesce(text, '')) AS t FROM {documents}"


def hits(words: list[str], t: str = "t") -> str:
    """How often the words stand in a text, without overlap of one with itself."""
    return " + ".join(f"(length({t}) - length(replace({t}, '{w}', ''))) / {len(w)}" for w in words)


def markers(words: list[str], t: str = "t") -> str:
    """How many of the words stand in a text."""
    return " + ".join(f"CAST(contains({t}, '{w}') AS INT)" for w in words)


def ordered(counts: dict[str, str], duck: bool) -> str:
    """Names with a count above zero, comma-joined, the highest first and ties in the order of ``counts``."""
    if duck:
        items = ", ".join(f"{{'n': -({c}), 'i': {i}, 'name': '{name}'}}" for i, (name, c) in enumerate(counts.items()))
        return f"array_to_string(list_transform(list_sort(list_filter([{items}], lambda x: x.n < 0)), lambda x: x.name), ',')"
    items = ", ".join(f"struct(-({c}) AS n, {i} AS i, '{name}' AS name)" for i, (name, c) in enumerate(counts.items()))
    return f"array_join(transform(array_sort(filter(array({items}), x -> x.n < 0)), x -> x.name), ',')"


COUNTED = "SELECT doc_id, t, " + ", ".join(f"CAST({hits(w)} AS INT) AS {n}" for n, w in (FAMILIES | {f"no_{k}": v for k, v in EXCLUDED.items()} | {"empirical": EMPIRICAL}).items()) + f" FROM ({PAPERS}) AS p"
_SUM, _NO = " + ".join(FAMILIES), " + ".join(f"no_{k}" for k in EXCLUDED)


def triage(a, papers: str = COUNTED) -> str:  # noqa: ANN001
    families, reasons = ordered({f: f for f in FAMILIES}, a.duck), ordered({f: f"no_{f}" for f in EXCLUDED}, a.duck)
    return f"SELECT doc_id, {families} AS families, {_SUM} AS family_score, {reasons} AS exclude_reasons, ({_SUM}) > 0 AND empirical > 0 AND ({_NO}) <= ({_SUM}) AS backtestable FROM ({papers}) AS s"


table_query("z06_family_triage", *(triage(a) for a in BOTH), ["documents"])
table_query("z07_hit_counts", f"SELECT doc_id, {', '.join(FAMILIES)} FROM ({COUNTED}) AS s", None, ["documents"])
WEIGHTS = {"momentum": 2.0, "volatility": 1.5, "price": 1.0, "index": 1.0, "text": -0.5, "the": 0.25}
table_query("z03_abstract_score", f"SELECT doc_id, {' + '.join(f'CAST({w} AS DOUBLE) * least({hits([term])}, 3)' for term, w in WEIGHTS.items())} AS score FROM ({PAPERS}) AS a", None, ["documents"])
MARKED = "SELECT doc_id, " + ", ".join(f"{markers(w)} AS {n}" for n, w in MARKERS.items()) + f" FROM ({PAPERS}) AS p"
table_query("z16_all_labels", *(f"SELECT doc_id, {ordered({f: f for f in MARKERS}, a.duck)} AS labels, {' + '.join(MARKERS)} AS n_markers FROM ({MARKED}) AS m" for a in BOTH), ["documents"])

#: Kinds of signals with their family; each symbol has every kind.
KINDS = {"tsmom_12": "intraday_momentum_breakout", "donchian_20": "intraday_momentum_breakout", "orb_2": "intraday_momentum_breakout", "boll_20": "mean_reversion_extreme", "rsi_14": "mean_reversion_extreme", "tod_volume": "microstructure_session_seasonality", "turn_of_month": "microstructure_session_seasonality", "leadlag_5": "cross_asset_lead_lag", "rv_ratio": "volatility_skew_dynamics", "skew_60": "volatility_skew_dynamics"}


def catalogue(symbols: str, marked: str = MARKED, first: int | None = None) -> str:
    """Every kind of signal of every symbol, each with the next paper of its family in turn; papers by markers, then number. ``first``: rank only so many papers of a family."""
    kinds = ", ".join(f"({i}, '{k}', '{f}', '{ABBREVIATIONS[f]}')" for i, (k, f) in enumerate(KINDS.items()))
    papers = " UNION ALL ".join(f"SELECT '{f}' AS family, doc_id, {f} AS n FROM ({marked}) AS m{i} WHERE {f} > 0" for i, f in enumerate(MARKERS))
    refs = f"SELECT family, doc_id, row_number() OVER (PARTITION BY family ORDER BY n DESC, doc_id) - 1 AS place FROM ({papers}) AS p"
    if first is not None:
        refs = f"SELECT family, doc_id, rn - 1 AS place FROM (SELECT family, doc_id, row_number() OVER (PARTITION BY family ORDER BY n DESC, doc_id NULLS LAST) AS rn FROM ({papers}) AS p) AS r WHERE rn <= {first}"
    counts = f"SELECT family, count(*) AS n_papers FROM ({papers}) AS p GROUP BY family"
    specs = f"SELECT symbol, kind, family, concat(abbr, '_', kind, '_', symbol) AS signal_id, row_number() OVER (PARTITION BY family ORDER BY symbol, i) - 1 AS turn FROM ({symbols}) AS s CROSS JOIN (VALUES {kinds}) AS v(i, kind, family, abbr)"
    return f"SELECT signal_id, s.family AS family, kind, coalesce(n_papers, 0) AS n_papers, doc_id AS paper FROM ({specs}) AS s LEFT JOIN ({counts}) AS c ON s.family = c.family LEFT JOIN ({refs}) AS r ON s.family = r.family AND r.place = s.turn % n_papers"


@query("z17_hypothesis_catalogue", catalogue("SELECT DISTINCT event_type AS symbol FROM {events}").format(events="events", documents="documents"))
def hypothesis_catalogue(spark: SparkSession, folder: str) -> DataFrame:
    """The texts are read once: their counts of markers are written, and papers ranked from those. No turn goes beyond the number of a family's signals, so only so many papers of it are ranked."""
    symbols = table(spark, folder, "events").selectExpr("event_type AS symbol").distinct()
    path = shared_path(spark, "papers")
    spark.sql(MARKED, documents=table(spark, folder, "documents")).write.parquet(path)
    signals = symbols.count() * max(Counter(KINDS.values()).values())
    text = catalogue("SELECT symbol FROM {symbols}", "SELECT * FROM {marked}", signals)
    return without_decimals(spark.sql(text, symbols=symbols, marked=spark.read.parquet(path)))
