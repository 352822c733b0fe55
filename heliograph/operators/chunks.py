"""A key's rows in time order, cut into chunks that tasks work on side by side.

All rows are sorted once over the cluster and numbered, so that a key's rows may lie
in any number of tasks. ``pos`` rises over all rows and by one inside a sorted
partition; rows of one key whose ``pos`` shares all but the last ``CHUNK_BITS`` bits are
a chunk. A chunk is packed into one row of at most ``2 ** CHUNK_BITS`` entries.
What a chunk passes on to the next is one row a chunk.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heliograph.operators.storage import shared_path

#: A chunk has at most this power of two of rows.
CHUNK_BITS = 12
#: Chunks' rows that one step of a kernel holds.
STEP_ROWS = 100_000


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: work after it starts there."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path, compression="zstd")
    return df.sparkSession.read.schema(df.schema).parquet(path)


def packed(df: DataFrame, by: str, order: Sequence[str], columns: Sequence[str], bits: int | None = None) -> DataFrame:
    """``by``, ``at`` (the chunk's first ``pos``), ``leads`` (the key's first chunk) and ``rows``, an array of structs of ``columns``, in the shared folder.

    Rows are ordered by ``by`` and ``order``; where those tie, by all ``columns``.
    """
    rest = [c for c in columns if c not in order]
    named = [by, *(c for c in columns if c != by)]
    rows = df.select(*dict.fromkeys([by, *order, *columns])).orderBy(F.asc_nulls_first(by), *order, *rest).withColumn("_pos", F.monotonically_increasing_id())
    width = CHUNK_BITS if bits is None else bits
    lists = rows.groupBy(by, F.shiftright("_pos", width)).agg(F.min("_pos").alias("at"), F.array_sort(F.collect_list(F.struct("_pos", F.struct(*named[1:]).alias("_row")))).alias("_list"))
    chunks = written(lists.select(by, "at", F.transform("_list", lambda x: x["_row"]).alias("rows")), "chunks")
    first = chunks.groupBy(by).agg(F.min("at").alias("at")).select("at", F.lit(True).alias("leads"))
    return chunks.join(first, "at", "left").select(by, "at", F.coalesce("leads", F.lit(False)).alias("leads"), "rows")


def passed_on(ends: DataFrame, by: str, column: str) -> DataFrame:
    """``at`` and the ``column`` of the same key's chunk before, null for the first; ``ends``: by, at, column, one row a chunk."""
    return ends.select("at", F.lag(column).over(Window.partitionBy(by).orderBy("at")).alias(column))


def runs(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the lists of ``column`` hold some ``STEP_ROWS`` entries together, one list at least."""
    for batch in batches:
        row = 0
        while row < batch.num_rows:
            end, held = row, 0
            while end < batch.num_rows and (end == row or held + len(batch.column(column)[end]) <= STEP_ROWS):
                held += len(batch.column(column)[end])
                end += 1
            yield batch.slice(row, end - row)
            row = end
