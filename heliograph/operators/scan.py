"""Recursive scans: a small state carried over each symbol's rows in time order.

A symbol's rows are cut into chunks (``heliograph.operators.chunks``). Every chunk
is first run from the state of a fresh series. Where the state at the end of
the chunk before is another, the chunk is run again from that one, and so on until
no chunk's first state changes. Recursions that start anew now and then (positions that
close, bands that flip, stops that turn) forget their first state inside a
chunk, so the second round settles nearly all of them, and means that fade settle
once they have faded. Chunks that ``ROUNDS`` rounds leave open are run one
after another, symbol by symbol, which is right for any recursion. Only states and
ends of chunks pass between rounds; rows are read once more for the result.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.types import _parse_datatype_string as parsed_schema

from heliograph.operators.chunks import packed, passed_on, written

#: Rounds in which all open chunks run side by side.
ROUNDS = 6


@dataclass(frozen=True)
class Recursion:
    """The state of a fresh series, and a step from a state and a row's inputs to the next state and the row's outputs. States are tuples of plain values."""

    start: tuple
    step: Callable[..., tuple[tuple, tuple]]

    def run(self, rows: list[tuple]) -> list[tuple]:
        """Outputs of all rows of one series."""
        state, out = self.start, []
        for row in rows:
            state, found = self.step(state, *row)
            out.append(found)
        return out


def scan(df: DataFrame, inputs: list[str], outputs: str, how: Recursion) -> DataFrame:
    """``symbol``, ``ts`` and the ``outputs`` (DDL) of every row.

    Rows with equal ``symbol`` and ``ts`` are ordered by the inputs; rows with a null
    symbol are one series. Null inputs are passed as None. An empty table gives
    an empty result.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    schema = parsed_schema(outputs)
    assert isinstance(schema, StructType)
    types = [(f.name, to_arrow_type(f.dataType)) for f in schema]
    chunks = packed(df, "symbol", ["ts"], ["ts", *inputs])
    fresh, step = pickle.dumps(how.start), how.step

    def passed(rows: list[dict], state: tuple) -> tuple:
        for row in rows:
            state, _ = step(state, *(row[c] for c in inputs))
        return state

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                end = pickle.dumps(passed(batch.column(2)[k].as_py(), pickle.loads(batch.column(3)[k].as_py())))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), batch.column(1).slice(k, 1), pa.array([end], pa.binary())], names=["symbol", "at", "state"])

    def one_after_another(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbol, state = object(), None
        for batch in batches:
            for k in range(batch.num_rows):
                if batch.column(0)[k].as_py() != symbol:
                    symbol, state = batch.column(0)[k].as_py(), pickle.loads(batch.column(3)[k].as_py())
                begin = pickle.dumps(state)
                state = passed(batch.column(2)[k].as_py(), state)
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(k, 1), pa.array([begin], pa.binary())], names=["at", "state"])

    def result(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                rows, state, found = batch.column(1)[k].as_py(), pickle.loads(batch.column(2)[k].as_py()), []
                for row in rows:
                    state, out = step(state, *(row[c] for c in inputs))
                    found.append(out)
                columns = list(zip(*found, strict=True)) or [()] * len(types)
                symbol = pa.array([batch.column(0)[k].as_py()] * len(rows), pa.string())
                yield pa.RecordBatch.from_arrays([symbol, pa.array([r["ts"] for r in rows], pa.timestamp("us")), *(pa.array(c, t) for c, (_, t) in zip(columns, types, strict=True))], names=["symbol", "ts", *(n for n, _ in types)])

    begin = written(chunks.select("symbol", "at", "leads", F.lit(fresh).alias("state")), "begin")
    known = None  # ends of the chunks that a round did not run again
    todo = begin
    for _ in range(ROUNDS):
        ran = chunks.join(todo.select("at", "state"), "at").select("symbol", "at", "rows", "state").mapInArrow(ends, "symbol string, at bigint, state binary")
        ended = written(ran if known is None else ran.unionByName(known.join(todo.select("at"), "at", "left_anti")), "ends")
        expected = passed_on(ended, "symbol", "state").withColumnRenamed("state", "given")
        nxt = written(begin.join(expected, "at").select("symbol", "at", "leads", F.coalesce("given", "state").alias("state"), (~F.col("given").eqNullSafe(F.col("state")) & ~F.col("leads")).alias("changed")), "begin")
        known, begin, todo = ended, nxt.drop("changed"), nxt.where("changed")
        if todo.isEmpty():
            break
    else:
        first = todo.groupBy(F.col("symbol").alias("_symbol")).agg(F.min("at").alias("_from"))
        late = chunks.join(begin.select("at", "state"), "at").join(first, F.col("symbol").eqNullSafe(F.col("_symbol"))).where("at >= _from").select("symbol", "at", "rows", "state")
        fixed = late.repartition("symbol").sortWithinPartitions("symbol", "at").mapInArrow(one_after_another, "at bigint, state binary")
        begin = begin.join(fixed.withColumnRenamed("state", "fixed"), "at", "left").select("symbol", "at", "leads", F.coalesce("fixed", "state").alias("state"))
    return chunks.join(begin.select("at", "state"), "at").select("symbol", "rows", "state").mapInArrow(result, f"symbol string, ts timestamp_ntz, {outputs}")
