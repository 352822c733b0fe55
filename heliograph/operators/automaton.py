"""Finite automata over each key's rows, as maps that compose.

A row is a function from the state before it to the state after it, a list of
as many entries as there are states. Functions compose in any grouping, so each chunk
of a key's rows (``heliograph.operators.chunks``) is composed by itself into
one function; per key these, one a chunk, give the state that every chunk begins
in, and a second pass over chunks fills in the states of rows. Inside a
chunk all prefixes are composed by doubling: log(rows) array steps in numpy.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliograph.operators.chunks import packed, runs, written

#: From the inputs' columns (numpy arrays, null: NaN; lists as objects) to a map a row: an array of rows by states.
Maps = Callable[..., np.ndarray]


def prefixes(maps: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Composition of every row's map with all maps before it in its chunk; ``first``: the row that a row's chunk begins with."""
    out, step, place = maps.astype(np.int64), 1, np.arange(len(maps)) - first
    while (place >= step).any():
        late = np.flatnonzero(place >= step)
        out[late] = np.take_along_axis(out[late], out[late - step], 1)
        step *= 2
    return out


def automaton(df: DataFrame, inputs: Sequence[str], keep: Sequence[str], states: int, maps: Maps, start: int = 0, bits: int | None = None) -> DataFrame:
    """``symbol``, ``ts``, the columns ``keep``, and ``before`` and ``state``, the state before and after every row.

    Rows with equal ``symbol`` and ``ts`` are ordered by the other columns; rows with a
    null symbol are one series. An empty table gives an empty result.
    """
    chunks = packed(df, "symbol", ["ts"], list(dict.fromkeys(["ts", *inputs, *keep])), bits)

    def composed(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.StructArray]:
        flat = lists.flatten()
        sizes = np.array([len(x) for x in lists], np.int64)
        at = np.concatenate([[0], np.cumsum(sizes)])
        columns = [c.to_numpy(zero_copy_only=False) for c in (flat.field(n) for n in inputs)]
        return prefixes(maps(*columns), np.repeat(at[:-1], sizes)), at, flat

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs(batches, 2):
            done, at, _ = composed(batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(done[at[1:] - 1].tolist(), pa.list_(pa.int32()))], names=["symbol", "at", "map"])

    def begun(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, state = [], []
            for chunks in batch.column(0).to_pylist():
                now = start
                for c in chunks:
                    at.append(c["at"])
                    state.append(now)
                    now = c["map"][now]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(state, pa.int32())], names=["at", "begin"])

    fields = {f.name: f.dataType for f in df.schema}
    shown = ["symbol", "ts", *keep]

    def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs(batches, 1):
            done, at, flat = composed(batch.column(1))
            begin = np.repeat(batch.column(2).to_numpy().astype(np.int64), np.diff(at))
            after = done[np.arange(len(done)), begin]
            before = np.empty_like(after)
            before[1:], before[at[:-1]] = after[:-1], batch.column(2).to_numpy()
            symbol = batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), np.diff(at))))
            yield pa.RecordBatch.from_arrays([symbol, *(flat.field(n) for n in shown[1:]), pa.array(before.astype(np.int32)), pa.array(after.astype(np.int32))], names=[*shown, "before", "state"])

    functions = written(chunks.select("symbol", "at", "rows").mapInArrow(whole, "symbol string, at bigint, map array<int>"), "maps")
    lists = functions.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("at", "map"))).alias("chunks"))
    begins = lists.select("chunks").mapInArrow(begun, "at bigint, begin int")
    schema = ", ".join(f"{n} {fields[n].simpleString()}" for n in shown) + ", before int, state int"
    return chunks.join(begins, "at").select("symbol", "rows", "begin").mapInArrow(filled, schema)
