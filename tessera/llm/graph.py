"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import cut_lineage


def turned(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) as (u, v), u > v, written; edges of a node with itself are left out."""
    return cut_lineage(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), "edges")


def star_forest(at: DataFrame) -> DataFrame:
    """The edges (u, v) with every node of ``at`` (u, v), u > v, tied to the least node reachable.

    Alternates two star steps.  Large star: every larger neighbour of u is tied to the least of
    u's neighbourhood; small star: u and its smaller neighbours are tied to the least of them.
    Each edge stays one edge in both, so the number of edges never grows; many nodes that tie
    the same two others make one edge of them all again and again, so a round ends with the distinct ones.
    It ends when every node is a root (its neighbours are larger) or a leaf of one root (it has
    one neighbour, a smaller one).  The number of rounds grows with the logarithm of the longest
    path; a round writes its edges to the shared folder and nothing else: what a node's
    neighbourhood is follows from them.
    A hub's rows meet its least neighbour in an inner join that Spark may split when it is skewed."""
    while True:
        near = neighbourhoods(at)
        if near.filter("least < u and least < most").isEmpty():
            return at
        large = at.join(near.select(F.col("u").alias("v"), F.least("u", "least").alias("m")), "v").select("u", F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        at = cut_lineage(small.distinct(), "edges")


def neighbourhoods(at: DataFrame) -> DataFrame:
    """(u, least, most) of every node's neighbours; map-side combined, so a hub is one row."""
    either = at.unionByName(at.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return either.groupBy("u").agg(F.min("v").alias("least"), F.max("v").alias("most"))


def labels(forest: DataFrame) -> DataFrame:
    """(node, component) of the nodes of a star forest, not written."""
    return neighbourhoods(forest).select(F.col("u").alias("node"), F.least("u", "least").alias("component"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node reachable, for every node of ``edges`` (a, b)."""
    return cut_lineage(labels(star_forest(turned(edges))), "nodes")
