"""Connected components of an undirected graph held as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkloom.llm.common import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b), component being the smallest node reachable.

    In each round every node points to its smallest neighbour if that is smaller than
    itself, pointers are followed, twice as far each time, to the ends of their chains, and
    the edges are moved to what their ends point to; loops and repeated edges go, and the
    nodes that are left are fewer than half.  A component's smallest node never moves, so it is
    what remains.  Sums and joins are by node, and a hub's edges are pre-aggregated.
    """
    both = lambda e: e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    label = None
    while True:
        if edges.isEmpty():
            if label is None:
                return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
            return label
        points = both(edges).groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("to"))
        points = cut(points)
        while True:
            hop = points.select(F.col("node").alias("to"), F.col("to").alias("next"))
            ahead = cut(points.join(hop, "to", "left").select("node", "to", F.coalesce("next", "to").alias("next")))
            points = ahead.select("node", F.col("next").alias("to"))
            if ahead.where("next <> to").isEmpty():
                break
        moved = _moved(_moved(edges, "a", points), "b", points)
        edges = cut(moved.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        if label is None:
            label = points.select("node", F.col("to").alias("component"))
        else:
            step = points.select(F.col("node").alias("component"), "to")
            label = label.join(step, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
        label = cut(label)


def _moved(edges: DataFrame, end: str, points: DataFrame) -> DataFrame:
    to = points.select(F.col("node").alias(end), F.col("to").alias("_to"))
    other = "b" if end == "a" else "a"
    return edges.join(to, end).select(F.col("_to").alias(end), other)
