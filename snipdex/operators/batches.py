"""Fixed-size batch numbers within a group, without one task per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


RANGE_ROWS = 1 << 16
MAX_SLICES = 64


def _ranges(df: DataFrame, order: str) -> Column:
    """A number per row that grows with `order`, with about `RANGE_ROWS` rows for each, however the values lie.

    Quantiles cut the values into slices with equal numbers of rows, and each slice is cut evenly; so a few values far
    off only widen the slice that they are in.
    """
    rows = df.agg(F.count(order)).first()[0]
    slices = max(1, min(MAX_SLICES, -(-rows // RANGE_ROWS)))
    parts = [i / slices for i in range(slices + 1)]
    edges = df.agg(F.percentile_approx(order, parts, 10_000)).first()[0] if rows else [0, 0]
    pieces = max(1, -(-rows // (slices * RANGE_ROWS)))
    found = F.lit(0).cast("long")
    for n, (low, high) in enumerate(zip(edges[:-1], edges[1:])):
        width = max(1, -(-(int(high) - int(low) + 1) // pieces))
        # What lies beyond the first and last edge of an approximate quantile belongs to the first and last slice.
        inside = F.floor((F.col(order) - F.lit(int(low))) / F.lit(width))
        own = F.lit(n * (pieces + 1)).cast("long") + F.greatest(F.lit(0), F.least(F.lit(pieces), inside))
        found = own if n == 0 else F.when(F.col(order) >= F.lit(int(low)), own).otherwise(found)
    return found


def position_in_group(df: DataFrame, group: str, order: str, span: int | None = None) -> DataFrame:
    """`position` (from 1, by a unique integer `order`) and `total` per group.

    Rows are ranked inside ranges of `span` order values, and each range is shifted by the
    counts of the ranges before it.  So a group of any size is spread over many tasks; only the
    counts per range are ordered as a whole.  By default the ranges follow from quantiles of the
    values, so neither hashes nor single values far off make ranges sparse or crowded.
    """
    ranged = df.withColumn("_range", F.floor(F.col(order) / F.lit(span)) if span else _ranges(df, order))
    counts = ranged.groupBy(group, "_range").agg(F.count(F.lit(1)).alias("_n"))
    by_range = Window.partitionBy(group).orderBy("_range")
    before = counts.select(
        group,
        "_range",
        (F.sum("_n").over(by_range.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_before"),
        F.sum("_n").over(Window.partitionBy(group)).alias("total"),
    )
    inside = F.row_number().over(Window.partitionBy(group, "_range").orderBy(order))
    return (
        ranged.withColumn("_inside", inside)
        .join(before, [group, "_range"])
        .withColumn("position", F.col("_before") + F.col("_inside"))
        .drop("_range", "_inside", "_before")
    )


def assign_batches(df: DataFrame, group: str, order: str, size: int, span: int | None = None) -> DataFrame:
    """Adds `batch` and `batches`, both counted from 1 within the group."""
    placed = position_in_group(df, group, order, span)
    number = F.floor((F.col("position") - 1) / F.lit(size)) + 1
    return placed.withColumn("batch", number).withColumn("batches", F.ceil(F.col("total") / F.lit(size)))
