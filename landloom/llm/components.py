"""Connected components of a large edge list, as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, materialise


def components(edges: DataFrame) -> DataFrame:
    """(a, b) edges of bigint nodes -> (node, root), root being the smallest node of the component.

    Large-star and small-star steps in turn: every node links its larger neighbours to its smallest one, then its
    smaller ones. Each step is a partial aggregation (smallest neighbour by node) and a join on the node, which adaptive
    execution splits where a hub is hot; nothing is gathered by node. The edges shrink to stars in O(log n) rounds. Each
    round is a table in the shared folder, so lost executors cost one round at most.
    """
    now = materialise(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc")
    before = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        small = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("m", F.col("u")).alias("m"))
        large = both.filter("v > u").join(small, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # Small star over u's smaller neighbours: all of them, and u, go to the smallest.
        least = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
        moved = large.join(least, F.col("u") == F.col("k")).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e"))
        after = materialise(moved.select("e.u", "e.v").filter("u <> v").distinct(), "cc")
        # The same edges as before: stars. Compared by count and an order-free checksum.
        mark = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop_table(now)
        now = after
        if mark == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = mark
