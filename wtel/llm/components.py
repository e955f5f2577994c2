"""Connected components of a distributed graph by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wtel.llm.common import join_small, staged


def components(edges: DataFrame) -> DataFrame:
    """node, root of all nodes that ``edges`` (a, b) name; nodes of a component share a root.

    In each round every node goes to the least of itself and its neighbours, and the edges go with
    their ends. The graph shrinks until no edge is left; the rounds' maps are then chained. Least
    neighbours are aggregated before the shuffle, and a hub has lost its edges after one round.
    Nodes should be numbered without regard to the edges, as a path in sorted order shrinks slowly.
    Loops and repeated edges do no harm; no edges give no rows.
    """
    maps = []
    left = edges.select("a", "b")
    while True:
        both = left.where("a <> b").unionByName(left.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = staged(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("to")), "contraction")
        if to.isEmpty():
            break
        maps.append(to)
        first = join_small(left.where("a <> b"), to.toDF("a", "x"), "a", "inner")
        second = join_small(first, to.toDF("b", "y"), "b", "inner")
        moved = second.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        left = staged(moved.distinct(), "edges")
    nodes = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct()
    out = nodes.withColumn("root", F.col("node"))
    for to in maps:
        out = join_small(out, to.toDF("root", "to"), "root").select(
            "node", F.coalesce("to", "root").alias("root")
        )
    return staged(out, "components")
