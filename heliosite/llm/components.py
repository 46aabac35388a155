"""Connected components of a table of edges, in Spark, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliosite.llm.storage import discarded, persisted


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable by ``edges``; nodes without an edge don't appear.

    Each round hangs every node's larger neighbours, then its smaller ones, under the smallest that it knows, without
    gathering a node's neighbours in one place. The number of rounds grows with the logarithm of the longest path.
    """
    pairs = persisted(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct())

    def star(table: DataFrame, large: bool) -> DataFrame:
        if large:
            both = table.unionByName(table.select(F.col("v").alias("u"), F.col("u").alias("v")))
        else:
            both = table.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        joined = both.join(low, "u")
        if large:
            return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v")).where("u <> v")).distinct()

    before = None
    while True:  # until a round changes nothing
        old, pairs = pairs, persisted(star(star(pairs, True), False))
        discarded(old)
        mark = pairs.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark == before:
            break
        before = mark
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
