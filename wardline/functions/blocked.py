"""Running totals and look-ahead for groups of any size.

A plain ``Window.partitionBy(key)`` sorts a whole group in one task. When a key may hold a
large share of the table, cut its rows into blocks by an expression that never decreases
along the order (``seq div n``, or a truncated timestamp), aggregate per block with map-side
combine, run the window over the small block table, and finish inside each block. With a
unique integer ``seq`` a block holds at most ``n`` rows, whatever the key distribution.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_sum(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    block: Column,
    value: str,
    before: str,
) -> DataFrame:
    """Add ``before``: the sum of ``value`` over all earlier rows of the same ``keys``."""
    blocked = df.withColumn("_block", block)
    totals = blocked.groupBy(*keys, "_block").agg(F.sum(value).alias("_total"))
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = totals.select(
        *keys, "_block", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_offset")
    )
    inside = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, -1
    )
    return (
        blocked.join(offsets, [*keys, "_block"])
        .withColumn(before, F.col("_offset") + F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .drop("_block", "_offset")
    )


def next_value(
    df: DataFrame,
    keys: list[str],
    order: str,
    block: Column,
    value: str,
    output: str,
) -> DataFrame:
    """Add ``output``: ``value`` of the next row of the same ``keys`` (null on the last)."""
    blocked = df.withColumn("_block", block)
    heads = blocked.groupBy(*keys, "_block").agg(
        F.min_by(F.col(value), F.col(order)).alias("_head")
    )
    following = Window.partitionBy(*keys).orderBy("_block")
    heads = heads.select(*keys, "_block", F.lead("_head").over(following).alias("_next_head"))
    inside = Window.partitionBy(*keys, "_block").orderBy(order)
    is_last = F.lead(F.lit(True)).over(inside).isNull()
    return (
        blocked.join(heads, [*keys, "_block"])
        .withColumn(
            output, F.when(is_last, F.col("_next_head")).otherwise(F.lead(value).over(inside))
        )
        .drop("_block", "_next_head")
    )
