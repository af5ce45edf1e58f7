"""Connected components by rounds of stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accesswatch.llm.common import cut


def _larger(edges: DataFrame) -> DataFrame:
    """Each larger neighbour of a node, and the node, is joined with the smallest of the neighbourhood."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _smaller(edges: DataFrame) -> DataFrame:
    """Each smaller neighbour of a node, and the node, is joined with the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(doc, component) of every document in ``links`` (a, b): the smallest document reachable.

    Alternating star rounds end when every edge leads straight to a smallest document; the number of rounds
    grows with the logarithm of the longest path. Minima are combined before each shuffle, and no round holds
    a component in one place. Links of a document with itself and links with a null are ignored.
    """
    edges = cut(links.where("a <> b").select("a", "b").distinct())
    before = None
    while True:
        edges = cut(_smaller(_larger(edges)))
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if tuple(state) == before:
            break
        before = tuple(state)
    least = edges.select(F.col("b").alias("doc")).distinct()
    return edges.select(F.col("a").alias("doc"), F.col("b").alias("component")).unionByName(
        least.select("doc", F.col("doc").alias("component"))
    )
