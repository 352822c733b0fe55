from __future__ import annotations

from datetime import datetime, timedelta

from heliograph.plans.tables import trim_sql


def test_only_the_sparse_start_is_cut(spark):
    counts = {"sparse start": [2] * 5 + [20] * 14, "one sparse month": [20] * 8 + [2] + [20] * 8, "short": [2] * 8 + [20] * 3, "uneven": [15, 20] * 8, "all sparse": [2] * 40 + [20] * 15 + [20] * 3 + [1] * 2 + [20] * 18}
    rows = [(s, datetime(2015 + i // 12, i % 12 + 1, 1) + timedelta(hours=j)) for s, x in counts.items() for i, n in enumerate(x) for j in range(n)]
    days = spark.createDataFrame(rows, "symbol string, ts timestamp")
    got = {}
    for r in spark.sql(trim_sql("{days}"), days=days).collect():
        got[r.symbol] = got.get(r.symbol, 0) + 1
    want = {}
    for s, x in counts.items():  # the reference's rule in plain Python
        last = sorted(x[-36:])
        ref = (last[(len(last) - 1) // 2] + last[len(last) // 2]) / 2
        bad = [n < 0.5 * ref for n in x]
        cut = max((i for i in range(len(x)) if bad[i] and sum(bad[: i + 1]) / (i + 1) >= 0.5), default=-1) if len(x) >= 12 else -1
        want[s] = sum(x[cut + 1 :])
    assert got == want and got["sparse start"] == 280 and got["uneven"] == sum(counts["uneven"])
