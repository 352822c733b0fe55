"""As-of joins: the last right row at or before each left row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, ts: str, by: Sequence[str], values: Sequence[str], slices: str = "day") -> DataFrame:
    """``left`` with the ``values`` of the last row of ``right`` with ``right.ts <= left.ts`` and equal ``by``; null where there is none.

    Both sides are laid together in slices of time, so that no key's whole
    history is one task. Inside a slice a running last value finds the row;
    what a slice starts with is carried over from the slices before it, of
    which there is one row a key and slice. Of right rows with equal time and
    key the greatest by ``values`` counts. Null times match nothing.
    """
    cell = [*by, "_slice"]
    lay = lambda df, right_side: df.withColumn("_slice", F.date_trunc(slices, F.col(ts).cast("timestamp"))).withColumn("_right", F.lit(int(right_side)))
    packed = right.where(F.col(ts).isNotNull()).groupBy(*by, ts).agg(F.max(F.struct(*values)).alias("_v"))
    rows = lay(left.select(F.struct(*left.columns).alias("_row"), *by, ts), False).unionByName(lay(packed, True), allowMissingColumns=True)
    from pyspark.sql import Window

    inside = Window.partitionBy(*cell).orderBy(F.col(ts), F.desc("_right")).rowsBetween(Window.unboundedPreceding, 0)
    own = rows.withColumn("_own", F.last("_v", True).over(inside)).where("_right = 0")
    ends = lay(packed, True).groupBy(*cell).agg(F.max_by("_v", ts).alias("_end"))
    # One row a key and slice, of either side: the last end before each slice.
    cells = ends.unionByName(lay(left.select(*by, ts), False).select(*cell).distinct(), allowMissingColumns=True).groupBy(*cell).agg(F.max("_end").alias("_end"))
    before = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = cells.withColumn("_before", F.last("_end", True).over(before)).select(*(F.col(c).alias(f"_k_{c}") for c in cell), "_before")
    same = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in cell]
    found = own.join(carried, same, "left").withColumn("_hit", F.when(F.col(ts).isNotNull(), F.coalesce("_own", "_before")))
    return found.select("_row.*", *(F.col("_hit")[v].alias(v) for v in values))
