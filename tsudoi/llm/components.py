"""Connected components of a link table, by alternating large and small stars."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsudoi.llm.common import checkpointed


def components(links: DataFrame) -> DataFrame:
    """links(a long, b long) -> (node, root): every linked node with the smallest node it can reach.

    Each round points nodes at the smallest neighbour; it ends when no link moves, without a cap on rounds. A node with
    very many neighbours is reduced by a partial aggregate and met again by a join that AQE can split. Links to itself
    and null ends are ignored; an empty table gives an empty one.
    """
    now = checkpointed(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if mark == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = mark
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.select("u", F.col("m").alias("v")))
        now = checkpointed(small.distinct())
