"""Connected components by contraction."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsudoi.session import cut_lineage

JUMPS = 3


def components(edges: DataFrame) -> DataFrame:
    """edges(a long, b long) -> (node, root): linked nodes carry the same root, one of their own.

    Each round hooks every node to its smallest neighbour, shortens these pointers by doubling and contracts the
    edges, so the graph shrinks by a constant share and the rounds are logarithmic in a path's length, if numbers are
    spread at random (hashes). Self links and null ends are ignored.
    """
    edges = cut_lineage(edges.where("a <> b").select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*").distinct())
    label = edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
    while not edges.isEmpty():
        point = edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("p"))
        for _ in range(JUMPS):
            point = point.join(point.select(F.col("a").alias("p"), F.col("p").alias("q")), "p").select("a", F.col("q").alias("p"))
        point = cut_lineage(point)
        to = point.select(F.col("a").alias("root"), "p")
        label = cut_lineage(label.join(to, "root", "left").select("node", F.coalesce("p", "root").alias("root")))
        a, b = point.select("a", F.col("p").alias("x")), point.select(F.col("a").alias("b"), F.col("p").alias("y"))
        edges = cut_lineage(edges.join(a, "a").join(b, "b").where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
    return label
