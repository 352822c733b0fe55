from __future__ import annotations

import random
from datetime import datetime, timedelta

import numpy as np

from heliograph.plans import models


def test_planted_signal_is_found_and_noise_is_not(spark):
    rng, begin = random.Random(3), datetime(2020, 1, 1)
    rows = [("s", begin + timedelta(days=i), *(rng.gauss(0, 1) for _ in models.FEATURES)) for i in range(800)]
    rows = [(*r, (r[2] + rng.gauss(0, 0.5)) / 100) for r in rows]
    data = spark.createDataFrame([(*r, float(r[-1] > 0)) for r in rows], ["symbol", "ts", *models.FEATURES, "fwd", "up"])
    matrix = models.folded(data)
    for model in (models.logistic, models.boosted):
        of = lambda features, model=model: models.auc(models.walk_forward(matrix, lambda a, b: models.probabilities(a, b, model(), features))).first()
        found = of(models.FEATURES)
        assert found.auc > 0.85 and found.n == 4 * 155
        assert 0.35 < of(models.FEATURES[1:]).auc < 0.65


def test_folds_never_look_ahead(spark):
    begin = datetime(2020, 1, 1)
    data = spark.createDataFrame([(s, begin + timedelta(days=i), float(i)) for i in range(203) for s in "ab"], "symbol string, ts timestamp, x double")
    seen = {}

    def score(train, test):
        ends = train.agg({"x": "max"}).first()[0]
        return test.withColumn("last_seen", test["x"] * 0 + ends)

    for r in models.walk_forward(models.folded(data), score).collect():
        seen.setdefault(r.fold, []).append((r.x, r.last_seen))
    assert {k: (min(v)[0], max(v)[0], v[0][1], len(v)) for k, v in seen.items()} == {k: (40.0 * k + 5, 40.0 * k + 39, 40.0 * k - 1, 70) for k in (1, 2, 3, 4)}
    assert models.fold_bounds(203) == [(40, 45, 80), (80, 85, 120), (120, 125, 160), (160, 165, 200)] and models.fold_bounds(20) == []


def test_decile_book_equals_plain_code(spark):
    rng, rows = random.Random(5), []
    for m in range(4):
        for k in range(25 if m != 2 else 23):
            rows.append((datetime(2020, m + 1, 1).date(), k, rng.choice([0.1, 0.2, rng.random()]), rng.gauss(0, 1)))
    got = {r.m: r for r in models.decile_book(spark.createDataFrame(rows, "m date, k int, p double, y double")).collect()}

    def ranks(x):
        return [sum(b < a for b in x) + (sum(b == a for b in x) + 1) / 2 for a in x]

    before = None
    for m in sorted(got):
        own = [r for r in rows if r[0] == m]
        q = max(int(len(own) * 0.1), 1)
        high, low = sorted(own, key=lambda r: (-r[2], r[1]))[:q], sorted(own, key=lambda r: (r[2], r[1]))[:q]
        w = {r[1]: 0.5 / q * ((r in high) - (r in low)) for r in own}
        gross = sum(w[r[1]] * r[3] for r in own)
        turn = 1.0 if before is None else sum(abs(w[k] - before.get(k, 0)) for k in w)
        ic = np.corrcoef(ranks([r[2] for r in own]), ranks([r[3] for r in own]))[0, 1]
        assert np.allclose([got[m].gross, got[m].net, got[m].ic], [gross, gross - 0.0005 * turn, ic]) and got[m].names == len(own)
        before = w


def test_trades_of_a_model_are_one_at_a_time(spark):
    rows = [("s", 1, n, 1.0 if n % 3 else -0.5, 4, n % 2 == 0) for n in range(1, 30)] + [("s", 2, 3, 2.0, 1, True), ("s", 2, 4, None, 1, True)]
    got = models.walked_trades(spark.createDataFrame(rows, "symbol string, fold int, n bigint, r double, held bigint, take boolean"), 0.1)
    assert sorted((r.fold, r.n, round(r.r, 6)) for r in got.collect()) == sorted([(1, n, round((1.0 if n % 3 else -0.5) - 0.1, 6)) for n in range(2, 30, 4)] + [(2, 3, 1.9)])


def test_model_queries_give_rows(spark):
    from heliograph.plans.catalog import queries

    folder = "/root/testdata/sf0.01"
    found = {n: queries()[n](spark, folder).collect() for n in ("m10_direct_model", "m12_flow_ablation", "c12_cross_section_book", "c13_breadth_to_index")}
    assert all(found.values())
    assert all(-1 <= r.ic <= 1 and r.names >= 10 for r in found["c12_cross_section_book"])
    assert {r.fold for r in found["c13_breadth_to_index"]} == {1, 2, 3, 4}
    assert {r.without for r in found["m12_flow_ablation"]} == {"all", "flow"}
    assert all(r.trades > 0 and 0.2 < r.auc < 0.8 for r in found["m10_direct_model"])


def test_area_under_the_curve_with_ties(spark):
    rows = [("s", 0.1, 0.0), ("s", 0.4, 0.0), ("s", 0.4, 1.0), ("s", 0.8, 1.0), ("t", 0.5, 1.0)]
    got = {r.symbol: (r.auc, r.n) for r in models.auc(spark.createDataFrame(rows, "symbol string, p double, up double")).collect()}
    assert got == {"s": (0.875, 4), "t": (None, 1)}
