"""Ranks and quantiles of a sliding window, in time that does not grow with rows times window.

A symbol's rows are numbered over the cluster and cut into blocks of at least a
window's rows. A block is worked on with the rows of the block before that its first
windows still hold. Inside a block the window's values stay sorted: each row finds by
bisection where one value enters and another leaves. No symbol is one task, and a row
is sent to two blocks at most.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heliograph.operators.chunks import runs, written

#: Rows of a block, if the window is not longer.
BLOCK = 4096
#: ``monotonically_increasing_id`` counts a partition's rows in so many bits.
PARTITION_BITS = 33
#: Windows that a function gets together.
STEP = 8192


def slide(values: Sequence[float | None], window: int, least: int, fractions: Sequence[float]) -> list[tuple]:
    """For each value its percent rank in the last ``window`` values (ties: the mean rank) and the window's quantiles; null with fewer than ``least`` values there."""
    held: list[float] = []
    out = []
    for i, x in enumerate(values):
        if i >= window and values[i - window] is not None:
            del held[bisect_left(held, values[i - window])]
        if x is not None:
            insort(held, x)
        n = len(held)
        if n < max(least, 1):
            out.append((None,) * (1 + len(fractions)))
            continue
        rank = None if x is None else (bisect_left(held, x) + bisect_right(held, x) + 1) / 2 / n
        found = []
        for q in fractions:
            at = q * (n - 1)
            k = min(int(at), n - 1)
            found.append(held[k] + (held[min(k + 1, n - 1)] - held[k]) * (at - k))
        out.append((rank, *found))
    return out


def dealt(df: DataFrame, value: str, window: int, block: int = BLOCK) -> DataFrame:
    """``symbol`` and ``rows``: blocks of (n, own, ts, x), with the rows before that a block's first windows hold (not ``own``)."""
    size = max(block, window)
    rows = df.select("symbol", "ts", F.expr(value).cast("double").alias("x")).withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    rows = written(rows.orderBy(F.asc_nulls_first("symbol"), "ts", "x").withColumn("_pos", F.monotonically_increasing_id()), "numbered")
    # One row a symbol and sorted partition says how many of the symbol's rows lie before it.
    part = F.shiftright("_pos", PARTITION_BITS).alias("_part")
    parts = rows.groupBy("symbol", part).agg(F.count("*").alias("_n"), F.min("_pos").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("symbol").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = parts.select(F.col("symbol").alias("_symbol"), "_part", (before - F.col("_first")).alias("_shift"))
    placed = rows.withColumn("_p", part).join(starts, F.col("symbol").eqNullSafe(F.col("_symbol")) & (F.col("_p") == F.col("_part"))).withColumn("n", F.col("_pos") + F.col("_shift"))
    own = F.floor(F.col("n") / size)
    both = F.filter(F.array(F.struct(own.alias("block"), F.lit(True).alias("own")), F.when(F.col("n") % size > size - window, F.struct((own + 1).alias("block"), F.lit(False).alias("own")))), lambda b: b.isNotNull())
    each = placed.select("symbol", "ts", "x", "n", F.explode(both).alias("b"))
    return each.groupBy("symbol", "b.block").agg(F.array_sort(F.collect_list(F.struct("n", "b.own", "ts", "x"))).alias("rows")).select("symbol", "rows")


def over_blocks(lists: DataFrame, names: Sequence[str], how: Callable[[pa.Array], Sequence[Sequence[float | None]]]) -> DataFrame:
    """``symbol``, ``ts`` and the columns ``names``, doubles, that ``how`` makes of a block's values."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs(batches, 1):
            for k in range(batch.num_rows):
                flat = batch.column(1).slice(k, 1).flatten()
                mine = flat.field("own")
                columns = [pa.array(c, pa.float64()).filter(mine) for c in how(flat.field("x"))]
                times = flat.field("ts").filter(mine)
                yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[k].as_py()] * len(times), pa.string()), times, *columns], names=["symbol", "ts", *names])

    return lists.mapInArrow(kernel, "symbol string, ts timestamp_ntz, " + ", ".join(f"{n} double" for n in names))


def sliding(df: DataFrame, value: str, window: int, least: int, fractions: Sequence[float] = (), block: int = BLOCK) -> DataFrame:
    """``symbol``, ``ts``, ``rank`` and ``q0``, ``q1``, ... (the ``fractions``) of every row over its last ``window`` rows.

    Nulls and NaN are rows of the window but no values. Rows of equal symbol and time are ordered by the
    value; rows with a null symbol are one series. An empty table gives an empty result.
    """
    names = ["rank", *(f"q{k}" for k in range(len(fractions)))]
    return over_blocks(dealt(df, value, window, block), names, lambda x: list(zip(*slide(x.to_pylist(), window, least, fractions), strict=True)) or [()] * len(names))


def windowed(df: DataFrame, value: str, window: int, function: Callable[[np.ndarray], np.ndarray], block: int = BLOCK) -> DataFrame:
    """``symbol``, ``ts`` and ``y``: ``function`` of the last ``window`` values of every row, null where there are fewer or one is null.

    The function takes many windows at once, as rows of a matrix, and returns a number for each.
    """

    def how(x: pa.Array) -> list[list[float | None]]:
        values = x.to_numpy(zero_copy_only=False).astype(float)
        out: list[float | None] = [None] * len(values)
        if len(values) >= window:
            views = np.lib.stride_tricks.sliding_window_view(values, window)
            whole = np.flatnonzero(~np.isnan(views).any(1))
            for at in range(0, len(whole), STEP):
                part = whole[at : at + STEP]
                for i, y in zip(part.tolist(), np.asarray(function(views[part]), float).tolist(), strict=True):
                    out[i + window - 1] = None if y != y else y
        return [out]

    return over_blocks(dealt(df, value, window, block), ["y"], how)
