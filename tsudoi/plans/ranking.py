"""Global and hot-group positions without one task holding a whole group.

A window without PARTITION BY, or over a key that owns a third of the rows, sorts everything in one task. Global positions
come from ranges instead: rows are range-partitioned by the whole order, sorted where they are, and the sizes of the ranges
become offsets. Runs inside a hot group are numbered in blocks of positions whose size is bounded.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tsudoi.session import cut_lineage

BLOCK = 1_000_000


def global_position(df: DataFrame, order: Sequence[str], out: str = "pos", parts: int | None = None) -> DataFrame:
    """1-based position in the order of the columns ``order``, nulls first; together they tell rows apart, or equal rows get
    positions in any order.

    The ranges are cut at sampled rows of the whole order, so neither a day that holds a third of the rows nor
    widely spaced ids make one large. The sorted rows are written once; only one count a range is summed up.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    ranged = cut_lineage(ranged).withColumn("_range", F.shiftright("_at", 33))
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each of ``parts`` ranges
    offsets = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = F.col("_at").bitwiseAND((1 << 33) - 1)
    return ranged.join(F.broadcast(offsets), "_range").withColumn(out, F.col("_before") + place + 1).drop("_range", "_at", "_before")


def run_numbers(df: DataFrame, group: Sequence[str], pos: str, key: str, out: str, block: int = BLOCK) -> DataFrame:
    """Number the runs of equal ``key`` by ``pos`` inside ``group``; a hot group is cut into blocks.

    A block counts its own changes; one summary row per block tells the next block where to go on."""
    keys = [*group, "_blk"]
    w = Window.partitionBy(*keys).orderBy(pos)
    same = F.lag(key).over(w).eqNullSafe(F.col(key)) | (F.row_number().over(w) == 1)
    rows = df.withColumn("_blk", F.floor(F.col(pos) / F.lit(block)))
    local = rows.withColumn("_chg", F.when(same, 0).otherwise(1)).withColumn(
        "_in", F.sum("_chg").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    blocks = local.groupBy(*keys).agg(F.max("_in").alias("_n"), F.min_by(F.struct(key), pos).alias("_first"), F.max_by(F.struct(key), pos).alias("_last"))
    order = Window.partitionBy(*group).orderBy("_blk")
    border = F.when(F.lag("_last").over(order).eqNullSafe(F.col("_first")), 0).otherwise(1)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    offsets = (blocks.withColumn("_border", border)
               .withColumn("_off", F.sum(F.col("_border") + F.col("_n")).over(upto) - F.col("_n")).select(*keys, "_off"))
    return local.join(offsets, keys).withColumn(out, F.col("_off") + F.col("_in")).drop("_chg", "_in", "_off", "_blk")


def top_k(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, out: str = "rn") -> DataFrame:
    """First ``k`` rows per group. The bare ``row_number <= k`` filter lets Spark limit each group
    before the shuffle (window group limit), so a hot group sends k rows per task."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(out) <= k)
