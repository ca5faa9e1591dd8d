"""Connected components of an edge table, by alternating star contractions; edges stay distributed throughout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import saved


def _digest(edges: DataFrame) -> tuple:
    """Equal for equal edge sets; one row to the driver."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """edges (u, v), in any direction and with repeats, to (node, root): root is the smallest node that node reaches.

    Nodes without an edge to another node have no row. Each round hangs every node's larger neighbours below its
    smallest one, then its smaller ones likewise, until nothing changes: a number of rounds that grows with the
    logarithm of the longest path. A node with very many neighbours is only ever joined to one smallest neighbour, so
    its rows can be split among tasks.
    """
    small = saved(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    before = _digest(small)
    while True:
        both = small.unionByName(small.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = saved(
            large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        )
        after = _digest(small)
        if after == before:
            break
        before = after
    roots = small.select("v").distinct()
    return small.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select(F.col("v").alias("node"), F.col("v").alias("root")))
