"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FEW, Scratch


def _least(edges: DataFrame) -> DataFrame:
    """Each edge's first end with the least node among itself and its neighbours."""
    low = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return edges.join(low.hint("merge"), "u")


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root): for every node of a link, the least node that can be reached. ``links`` has columns a and b.

    Each step is a grouped minimum, combined before it is shuffled, and a join on the node that isn't broadcast; the number of
    steps grows with the logarithm of the largest distance. Links of a node with itself, or with null, count for nothing;
    repeated links are one, an empty table has no components, and other columns are not read.
    Steps end when every node's only neighbour is its root.
    """
    edges = scratch.keep(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), FEW)
    while True:
        # a star forest: nobody has two lesser neighbours, and no root has a lesser one
        ups = edges.groupBy("u").agg(F.count("*").alias("n"))
        chained = edges.select(F.col("v").alias("u")).join(ups.hint("merge"), "u", "left_semi")
        if not ups.where("n > 1").select("u").unionByName(chained).limit(1).count():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = _least(large)
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        new = scratch.keep(small.where("u <> v").distinct(), FEW)
        scratch.drop(edges)
        edges = new
