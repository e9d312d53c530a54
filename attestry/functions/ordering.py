"""Positions and running totals that survive one very large group.

A plain window puts a whole group into one task. Here a group is cut into
blocks along its order, each block is summed with map-side combining, the
running total is taken over the block sums only, and rows are then ordered
inside their block. The block column must be monotone in the row order, so the
block sums of a group arrive in row order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_total(
    df: DataFrame,
    groups: Sequence[str],
    order: Sequence[str],
    block: Column,
    value: Column,
    name: str,
) -> DataFrame:
    """Add ``name``: the sum of ``value`` over the earlier rows of the row's group.

    ``order`` must be unique within a group.
    """
    keyed = df.withColumn("_block", block).withColumn("_value", value.cast("long"))
    sums = keyed.groupBy(*groups, "_block").agg(F.sum("_value").alias("_sum"))
    earlier_blocks = Window.partitionBy(*groups).orderBy("_block").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = sums.select(
        *groups,
        "_block",
        F.coalesce(F.sum("_sum").over(earlier_blocks), F.lit(0)).alias("_before"),
    )
    inside = Window.partitionBy(*groups, "_block").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, -1
    )
    return (
        keyed.withColumn("_inside", F.coalesce(F.sum("_value").over(inside), F.lit(0)))
        .join(offsets, [*groups, "_block"])
        .withColumn(name, F.col("_before") + F.col("_inside"))
        .drop("_block", "_value", "_inside", "_before")
    )


def position(
    df: DataFrame, groups: Sequence[str], order: Sequence[str], block: Column, name: str
) -> DataFrame:
    """Add ``name``: the 0-based position of a row in its group."""
    return running_total(df, groups, order, block, F.lit(1), name)
