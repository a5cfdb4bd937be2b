"""Ranking helpers that hold at any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import materialise


def latest(df: DataFrame, key: str, late: str) -> DataFrame:
    """The latest row of each key as a partial aggregate (ties: the largest row)."""
    rest = [late] + [c for c in df.columns if c not in (key, late)]
    picked = df.groupBy(key).agg(F.max(F.struct(*rest)).alias("_row"))
    return picked.select(key, *[F.col(f"_row.{c}").alias(c) for c in rest])


def numbered(df: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """Positions 1, 2, ... over the whole table without gathering it in one task (ties: in any order).

    The rows are range-partitioned and sorted once; they are written with their partition and place before anything is
    counted, so that all later steps see the same partitions. The number of rows of the partitions before is added from a
    table with one row a partition.
    """
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # the lower bits count within a partition
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = materialise(ranged.select("*", F.spark_partition_id().alias("_part"), place.alias("_place")))
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(sizes.select("_part", before.alias("_before")))  # one row a partition
    return placed.join(starts, "_part", "left").withColumn(name, F.col("_before") + F.col("_place") + 1).drop("_part", "_place", "_before")


def first_n(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_rank") <= n).drop("_rank")
