"""Connected components as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliograph.llm.session import removed, written

#: A table of at most so many links (two integers each, some 20 MB) is broadcast to its joins and kept in few files.
SMALL_LINKS = 500_000
FEW_FILES = 8


def components(links: DataFrame) -> DataFrame:
    """Every ``id`` that occurs in links (a, b), with the least id that it reaches as ``component``.

    Alternates two steps on a table of links until it stops changing: each node
    links its larger neighbours to the least one around it, then its smaller
    neighbours and itself to the least of them. Both keep the components, and a
    group needs about log(size) rounds. Each round is a table in the shared
    folder; only its count and a checksum come to the driver. The count also
    says whether the next round's lookups are small enough to be broadcast.
    """
    spark = links.sparkSession
    now, now_at = written(links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    mark = lambda table: table.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")).first()
    before = mark(now)
    while True:
        small = before["n"] <= SMALL_LINKS
        lookup = F.broadcast if small else lambda table: table
        # Large step: for each u, link every larger neighbour to the least of u and its neighbours.
        around = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = around.where("v > u").join(lookup(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # Small step: for each u, link its smaller neighbours and itself to the least of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(lookup(least), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        after, after_at = written(after.coalesce(FEW_FILES) if small else after, "links")
        removed(spark, now_at)
        now, now_at = after, after_at
        state = mark(now)
        if state == before:
            break
        before = state
    nodes = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return nodes.unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
