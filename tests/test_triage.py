"""Papers with known answers."""

from __future__ import annotations

from heliograph.plans import triage
from heliograph.plans.trades import BOTH

PAPERS = [
    (1, "Intraday Momentum and the opening range: a trading strategy in index futures. Momentum, breakout and price continuation."),
    (2, "Order flow, the limit order book and queue depth in market microstructure. Momentum of price."),
    (3, "Cointegration and pairs trading; spillover across assets. Excess return, backtest."),
    (4, "Nothing of the kind."),
    (5, None),
    (6, "Reversal reversal reversal. Breakout breakout breakout. Sharpe."),
]


def test_families_scores_and_reasons(spark):
    docs = spark.createDataFrame(PAPERS, "doc_id bigint, text string")
    got = {r.doc_id: tuple(r)[1:] for r in spark.sql(triage.triage(BOTH[0]), documents=docs).collect()}
    assert got[1] == ("momentum,breakout", 5, "", True)
    # "limit order book" counts for itself and for "order book"; "text" stands in no word here
    assert got[2] == ("momentum", 1, "order_book", False)
    assert got[3] == ("pairs_statarb,lead_lag", 3, "", True)
    assert got[4] == got[5] == ("", 0, "", False)
    assert got[6] == ("reversal,breakout", 6, "", True)


def test_markers_are_counted_once_each(spark):
    docs = spark.createDataFrame([*PAPERS, (7, "GARCH garch garch and the London fix fixing")], "doc_id bigint, text string")
    sql = f"SELECT doc_id, {triage.ordered({f: f for f in triage.MARKERS}, False)} AS labels, {' + '.join(triage.MARKERS)} AS n FROM ({triage.MARKED}) AS m"
    got = {r.doc_id: (r.labels, r.n) for r in spark.sql(sql, documents=docs).collect()}
    assert got[1] == ("intraday_momentum_breakout", 4)
    assert got[6] == ("intraday_momentum_breakout,mean_reversion_extreme", 2)
    assert got[7] == ("microstructure_session_seasonality,volatility_skew_dynamics", 3)
    assert got[3] == ("cross_asset_lead_lag", 4) and got[5] == ("", 0)


def test_papers_of_a_family_take_turns(spark):
    docs = spark.createDataFrame([(k, "breakout " + ("opening range" if k == 3 else "")) for k in (5, 3, 4)], "doc_id bigint, text string")
    events = spark.createDataFrame([("a",), ("b",)], "event_type string")
    rows = spark.sql(triage.catalogue("SELECT DISTINCT event_type AS symbol FROM {events}"), documents=docs, events=events).collect()
    found = {r.signal_id: (r.paper, r.n_papers) for r in rows}
    assert len(rows) == 2 * len(triage.KINDS)
    turns = ["MOM_tsmom_12_a", "MOM_donchian_20_a", "MOM_orb_2_a", "MOM_tsmom_12_b", "MOM_donchian_20_b", "MOM_orb_2_b"]
    assert [found[t] for t in turns] == [(3, 3), (4, 3), (5, 3)] * 2
    assert found["VOL_rv_ratio_a"] == (None, 0)
