"""Account state and liveness over streams of readings, kept by Spark from batch to batch.

State lives in the query's checkpoint: a stream that stops and starts again
goes on where it was. Of one account's readings in one micro-batch those of earlier
time, then lesser key, come first; readings that a later batch brings are later.
Size micro-batches (``maxFilesPerTrigger``) so that an account's share of one fits into a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keeping_state(spark: SparkSession) -> None:
    """Streams with state of their own need this store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


@dataclass(frozen=True)
class Limits:
    """Shares of the first balance; ``peak``: the floor of the whole fall trails the highest reading. ``plausible``: least share of the reading before, and of the balance."""

    balance: float = 60_000.0
    daily: float = 0.05
    total: float = 0.10
    target: float = 0.05
    least_days: int = 3
    peak: bool = False
    jump: float = 0.90
    half: float = 0.5
    confirmations: int = 2


#: What is known of an account. Days are numbers of days since 1970; ``hits``: valid readings in a row at or below the floor.
STATE = "last double, day bigint, day_start double, peak double, locked boolean, failed boolean, hits bigint, days bigint, accepted bigint, ignored bigint, locks bigint"
READING = "account string, at timestamp, key bigint, equity double, accepted boolean, day_start double, peak double, locked boolean, failed boolean, verdict string"


def fresh(limits: Limits) -> dict:
    return {"last": None, "day": None, "day_start": limits.balance, "peak": limits.balance, "locked": False, "failed": False, "hits": 0, "days": 0, "accepted": 0, "ignored": 0, "locks": 0}


def after(state: dict, equity: float | None, day: int, limits: Limits) -> bool:
    """Take one reading into the state; whether it was plausible. An implausible one changes nothing but its count."""
    b = limits.balance
    if equity is None or equity != equity or equity <= limits.half * b or state["last"] is not None and equity < state["last"] * limits.jump:
        state["ignored"] += 1
        return False
    state["last"], state["accepted"] = equity, state["accepted"] + 1
    if day != state["day"]:
        state |= {"day": day, "day_start": equity, "locked": False, "days": state["days"] + 1}
    state["peak"] = max(state["peak"], equity)
    floor = (state["peak"] if limits.peak else b) - limits.total * b
    state["hits"] = state["hits"] + 1 if equity <= floor else 0
    state["failed"] = state["failed"] or state["hits"] >= limits.confirmations
    if equity <= state["day_start"] - limits.daily * b and not state["locked"]:
        state |= {"locked": True, "locks": state["locks"] + 1}
    return True


def verdict(state: dict, limits: Limits) -> str:
    if state["failed"]:
        return "FAILED"
    won = state["last"] is not None and state["last"] / limits.balance - 1 >= limits.target
    return "PASSED" if won and state["days"] >= limits.least_days else "IN_PROGRESS"


class Account(StatefulProcessor):
    """Every reading with the account's state after it."""

    def __init__(self, limits: Limits) -> None:
        self.limits = limits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getValueState("account", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        names = [x.split()[0] for x in STATE.split(", ")]
        state = dict(zip(names, self.known.get(), strict=True)) if self.known.exists() else fresh(self.limits)
        batch = pd.concat(list(rows)).sort_values(["at", "key"], kind="stable")
        out = []
        for at, reading, equity in zip(batch["at"], batch["key"], batch["equity"], strict=True):
            equity = None if pd.isna(equity) else float(equity)
            fine = after(state, equity, pd.Timestamp(at).value // 86_400_000_000_000, self.limits)
            out.append((key[0], at, reading, equity, fine, state["day_start"], state["peak"], state["locked"], state["failed"], verdict(state, self.limits)))
        self.known.update(tuple(state[n] for n in names))
        yield pd.DataFrame(out, columns=[x.split()[0] for x in READING.split(", ")])

    def close(self) -> None:
        pass


def followed(readings: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """A stream of ``account``, ``at``, ``key``, ``equity`` with each reading's plausibility and the state after it."""
    keeping_state(readings.sparkSession)
    return readings.groupBy("account").transformWithStateInPandas(Account(limits), outputStructType=READING, outputMode="Append", timeMode="None")


ALERT = "source string, since timestamp, at timestamp"


class Liveness(StatefulProcessor):
    """One alert where a source that should be heard is silent: a timer of event time fires without a row of the source itself."""

    def __init__(self, seconds: int, cooldown: int) -> None:
        self.limit, self.cooldown = seconds * 1000, cooldown * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("heard", "last bigint, silent boolean, alerted bigint")

    def alert(self, key, last: int, alerted: int) -> tuple[list[tuple], int]:  # noqa: ANN001
        due = last + self.limit
        if due - alerted < self.cooldown:
            return [], alerted
        stamp = lambda ms: pd.Timestamp(ms, unit="ms")
        return [(key[0], stamp(last), stamp(due))], due

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        last, silent, alerted = self.known.get() if self.known.exists() else (None, False, -(1 << 62))
        if last is not None and not silent:
            self.handle.deleteTimer(last + self.limit)
        batch, out = pd.concat(list(rows)).sort_values("at", kind="stable"), []
        for at, resting in zip(batch["at"], batch["resting"], strict=True):
            ms = pd.Timestamp(at).value // 1_000_000
            if last is not None and ms < last:
                continue
            if last is not None and not silent and ms > last + self.limit:
                found, alerted = self.alert(key, last, alerted)
                out += found
            last, silent = ms, bool(resting)
        if not silent:
            self.handle.registerTimer(last + self.limit)
        self.known.update((last, silent, alerted))
        yield pd.DataFrame(out, columns=["source", "since", "at"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        last, silent, alerted = self.known.get()
        out: list[tuple] = []
        if not silent and expiredTimerInfo.getExpiryTimeInMs() == last + self.limit:
            out, alerted = self.alert(key, last, alerted)
            self.known.update((last, True, alerted))  # said once; the next row wakes the source
        yield pd.DataFrame(out, columns=["source", "since", "at"])

    def close(self) -> None:
        pass


def silences(heard: DataFrame, seconds: int, cooldown: int = 0, late: str = "1 hour") -> DataFrame:
    """A stream of alerts: ``source``, ``since`` (its last row) and ``at``, ``seconds`` later.

    ``heard``: ``source``, ``at`` and ``resting``, true on rows after which silence is meant
    (a position is held, the session is over). Silence is known when the watermark,
    which all sources move, has passed. A source is told of once for each silence, and not within ``cooldown`` seconds of its last alert.
    """
    keeping_state(heard.sparkSession)
    marked = heard.withWatermark("at", late)
    return marked.groupBy("source").transformWithStateInPandas(Liveness(seconds, cooldown), outputStructType=ALERT, outputMode="Append", timeMode="EventTime")
