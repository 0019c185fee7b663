"""Connected components of an edge table by alternating large and small stars, without collecting anything."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _large(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Each neighbour above a node goes to the least of the node and its neighbours.

    The least of each node are written, so that the join with them can split a node of very many edges.
    """
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = scratch.written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Each node and its neighbours below go to the least of those."""
    down = scratch.written(edges.where("u > v"), "down")
    least = scratch.written(down.groupBy("u").agg(F.min("v").alias("m")), "least")
    rest = down.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.unionByName(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, tag: str = "stars") -> DataFrame:
    """(u, v), any order -> (node, root), root the least node of the component, for every node of an edge but the roots.

    A round reads the table of the round before, which is deleted when the next stands.
    """
    state, before = None, Scratch(edges.sparkSession)
    edges = before.written(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), tag)
    while True:
        now = Scratch(edges.sparkSession)
        with Scratch(edges.sparkSession) as inner:
            edges = now.written(_small(_large(edges, inner), inner).distinct(), tag)
        before.drop()
        seen = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state, before = seen, now
