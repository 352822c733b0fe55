"""One position at a time, by pointer doubling.

An entry that is taken frees its key again at row ``free``; the next one taken is
the first entry at or after it. Every entry knows that next entry, so the
entries taken are a chain of pointers from the first entry of the key. The chain is
marked by doubling: with the pointers 2**k entries ahead, the entries marked
so far mark as many more, and the pointers joined with themselves reach twice as
far. A chain of n entries takes log2(n) rounds of joins on (key, row); each
round is a table in the shared folder. No key's rows are one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heliograph.operators.chunks import written

#: Rows of a key that are searched together for the next entry.
CELL = 4096


def next_entries(entries: DataFrame, key: str = "symbol", cell: int = CELL) -> DataFrame:
    """``key``, ``n`` and ``nxt``: the least ``n`` of the key's entries at or after ``free``, null if there is none.

    Entries and questions are laid together in cells of ``cell`` rows; what a
    cell has not is the first entry of a later one, of which there is one row a cell.
    """
    of = lambda c: F.floor(F.col(c) / cell)
    there = entries.select(key, F.col("n").alias("_at"), F.col("n").alias("_entry"), F.lit(None).cast("bigint").alias("_asks"), of("n").alias("_cell"))
    asked = entries.select(key, F.col("free").alias("_at"), F.lit(None).cast("bigint").alias("_entry"), F.col("n").alias("_asks"), of("free").alias("_cell"))
    inside = Window.partitionBy(key, "_cell").orderBy("_at").rangeBetween(Window.currentRow, Window.unboundedFollowing)
    own = there.unionByName(asked).withColumn("_own", F.min("_entry").over(inside)).where("_asks IS NOT NULL")
    cells = there.select(key, "_cell", "_entry").unionByName(asked.select(key, "_cell", F.lit(None).cast("bigint").alias("_entry"))).groupBy(key, "_cell").agg(F.min("_entry").alias("_first"))
    later = cells.select(F.col(key).alias("_key"), F.col("_cell").alias("_c"), F.min("_first").over(Window.partitionBy(key).orderBy("_cell").rowsBetween(1, Window.unboundedFollowing)).alias("_later"))
    found = own.join(later, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_cell") == F.col("_c")))
    return found.select(key, F.col("_asks").alias("n"), F.coalesce("_own", "_later").alias("nxt"))


def taken(entries: DataFrame, key: str = "symbol", cell: int = CELL) -> DataFrame:
    """``key`` and ``n`` of the entries that are taken; ``entries``: key, ``n`` (row number of the entry, distinct in its key) and ``free``, the first row that may enter again (after ``n``)."""
    entries = written(entries.select(key, F.col("n").cast("bigint").alias("n"), F.col("free").cast("bigint").alias("free")), "entries")
    jumps = written(next_entries(entries, key, cell), "jumps")
    marked = written(entries.groupBy(key).agg(F.min("n").alias("n")), "marked")
    out = marked
    while True:
        ahead = jumps.where("nxt IS NOT NULL").select(F.col(key).alias("_key"), F.col("n").alias("_n"), "nxt")
        more = written(out.join(ahead, F.col(key).eqNullSafe(F.col("_key")) & (F.col("n") == F.col("_n"))).select(key, F.col("nxt").alias("n")), "marked")
        if more.isEmpty():
            return out
        out = out.unionByName(more)
        far = ahead.select("_key", "_n", F.col("nxt").alias("_nxt"))
        jumps = written(jumps.where("nxt IS NOT NULL").join(far, F.col(key).eqNullSafe(F.col("_key")) & (F.col("nxt") == F.col("_n"))).select(key, "n", F.col("_nxt").alias("nxt")), "jumps")
