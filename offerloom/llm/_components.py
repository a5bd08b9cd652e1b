"""Connected components over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage, forget


def _state(edges: DataFrame):
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, component) for each node of ``edges(a, b)`` that is not the least of its component.

    Each round hangs every node's larger neighbours, then its smaller ones, on the least
    one it knows (large and small stars), until nothing changes: about log2 of the
    longest path in rounds.  Only minima are grouped and then joined back, so a node
    with very many edges is spread over tasks.  Loops and repeated edges do no harm.
    """
    oriented = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = cut_lineage(oriented, "edges")
    state = _state(edges)
    while True:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = cut_lineage(large.where("a <> b").distinct(), "edges")
        least = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).union(least)
        before, edges = edges, cut_lineage(small.where("a <> b").distinct(), "edges")
        forget(before, large)
        after = _state(edges)
        if after == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        state = after
