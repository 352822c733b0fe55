"""Account state and liveness over streams: known cases, restarts, timers without input."""

from __future__ import annotations

from datetime import datetime, timedelta

from heliograph.streaming.accounts import Limits, after, followed, fresh, silences, verdict

DAY = datetime(2024, 5, 6)
READINGS = "account string, at timestamp, key bigint, equity double"


def states(readings, limits=Limits()):
    state, out = fresh(limits), []
    for day, equity in readings:
        out.append((after(state, equity, day, limits), state["day_start"], state["locked"], state["failed"], verdict(state, limits)))
    return out


def test_known_readings():
    fell = states([(1, x) for x in (59_000, 57_000, 55_500, 54_500, 53_900, 53_800)])
    assert [s[3] for s in fell] == [False] * 5 + [True] and fell[-1][4] == "FAILED"
    day = states([(1, 60_000), (1, 58_500), (1, 57_500), (1, 56_900), (2, 58_000)])
    assert [s[2] for s in day] == [False, False, False, True, False] and [s[1] for s in day] == [60_000] * 4 + [58_000]
    glitch = states([(1, 60_000), (1, 0.0), (1, None), (1, float("nan")), (1, 40_000), (1, 53_000), (1, 54_000), (1, 59_000)])
    assert [s[0] for s in glitch] == [True, False, False, False, False, False, True, True] and not glitch[-1][3]
    once = states([(1, 58_000), (1, 53_900), (1, 54_100), (1, 53_900)])
    assert not once[-1][3]
    trailing = states([(1, 60_000), (2, 65_000), (2, 70_000), (3, 63_900), (3, 63_800)], Limits(peak=True))
    assert [s[3] for s in trailing] == [False] * 4 + [True]
    won = states([(d, 60_000 + 1_100 * d) for d in (1, 2, 3)])
    assert [s[4] for s in won] == ["IN_PROGRESS", "IN_PROGRESS", "PASSED"]


def table(n=240):
    rows = []
    for k in range(n):
        equity = 60_000 + ((k * 37) % 101 - 50) * (60 if k % 11 else 400)
        rows.append((f"a{k % 3}", DAY + timedelta(hours=k), k, None if k % 29 == 5 else float(equity)))
    return rows


def run(stream, folder, name):
    stream.writeStream.format("parquet").option("path", f"{folder}/{name}").option("checkpointLocation", f"{folder}/{name}-state").trigger(availableNow=True).start().awaitTermination()


def test_state_survives_a_restart_in_the_middle(spark, tmp_path):
    rows, there = table(), str(tmp_path / "in")
    stream = lambda: followed(spark.readStream.schema(READINGS).option("maxFilesPerTrigger", 1).parquet(there))
    for k in range(4):  # the query ends after each two files, and a new one goes on
        spark.createDataFrame(rows[k * 60 : (k + 1) * 60], READINGS).coalesce(1).write.mode("append").parquet(there)
        if k % 2:
            run(stream(), str(tmp_path), "out")
    got = {(r.account, r.key): (r.accepted, r.day_start, r.locked, r.failed, r.verdict) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {}
    for a in ("a0", "a1", "a2"):
        own = [r for r in rows if r[0] == a]
        want |= {(a, r[2]): s for r, s in zip(own, states([((r[1] - datetime(1970, 1, 1)).days, r[3]) for r in own]), strict=True)}
    assert got == want and len({s[0] for s in want.values()}) == 2 and any(s[2] for s in want.values())


def test_silence_is_told_once_without_rows_of_the_source(spark, tmp_path):
    schema, there = "source string, at timestamp, resting boolean", str(tmp_path / "in")
    hour = lambda h: DAY + timedelta(hours=h)
    files = [
        [("quiet", hour(0), False), ("resting", hour(0), True), ("steady", hour(0), False), ("late", hour(0), False)],
        [("steady", hour(4), False), ("late", hour(4), False)],
        [("steady", hour(8), False)],
        [("steady", hour(12), False)],
        [("steady", hour(16), False), ("quiet", hour(16), False)],
        [("steady", hour(19), False)],
    ]
    stream = lambda: silences(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(there), 5 * 3600)
    for rows in files:  # a query for each file: timers outlive it
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(there)
        run(stream(), str(tmp_path), "out")
    got = sorted((r.source, r.since, r.at) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("late", hour(4), hour(9)), ("quiet", hour(0), hour(5))]


def test_cooldown_of_alerts(spark, tmp_path):
    schema, there = "source string, at timestamp, resting boolean", str(tmp_path / "in")
    rows = [("x", DAY + timedelta(hours=h), False) for h in (0, 10, 20, 60, 61)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(there)
    run(silences(spark.readStream.schema(schema).parquet(there), 5 * 3600, 18 * 3600), str(tmp_path), "out")
    got = sorted(r.since for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [DAY, DAY + timedelta(hours=20)]
