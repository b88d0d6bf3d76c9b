"""Ordered work inside a key that may hold most of the rows.

A window over a whole key would put a hot key into one task.  Rows are windowed inside time
ranges of the key instead, and what has to cross a range border is carried over a small table
with one row per key and range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def previous_in_group(
    df: DataFrame, key: str, micros: str, tie: str, columns: list[str], span_us: int
) -> DataFrame:
    """Adds `prev_<column>` from the row before, by (micros, tie), within the key."""
    ranged = df.withColumn("_range", F.floor(F.col(micros) / F.lit(span_us)))
    last = F.max_by(F.struct(*columns), F.struct(micros, tie))
    ends = ranged.groupBy(key, "_range").agg(last.alias("_last"))
    carry = ends.select(
        key, "_range", F.lag("_last").over(Window.partitionBy(key).orderBy("_range")).alias("_carry")
    )
    inside = Window.partitionBy(key, "_range").orderBy(micros, tie)
    stepped = ranged.withColumn("_prev", F.lag(F.struct(*columns)).over(inside))
    joined = stepped.join(carry, [key, "_range"])
    prev = F.coalesce("_prev", "_carry")
    return joined.withColumns({f"prev_{c}": prev[c] for c in columns}).drop("_range", "_prev", "_carry")


def _bursts(rows: DataFrame, keys: list[str], order: list[str], gap_us: int) -> DataFrame:
    """Fold rows (first_us, last_us, n_changes, change_type) of a key that follow within the gap.

    All comes from one sort: the last row of a burst stands for it.  `_head` and `_tail` mark the
    first and the last burst of the key.
    """
    inside = Window.partitionBy(*keys).orderBy(*order)
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    marked = rows.withColumns(
        {
            "_opens": F.coalesce(F.col("first_us") - F.lag("last_us").over(inside) > gap_us, F.lit(True)),
            "_gap_after": F.lead("first_us").over(inside) - F.col("last_us"),
            "_total": F.sum("n_changes").over(so_far),
        }
    )
    folded = marked.withColumns(
        {
            "_start": F.max(F.when(F.col("_opens"), F.col("first_us"))).over(so_far),
            "_before": F.max(F.when(F.col("_opens"), F.col("_total") - F.col("n_changes"))).over(so_far),
        }
    ).filter(F.coalesce(F.col("_gap_after") > gap_us, F.lit(True)))
    return folded.select(
        *keys,
        F.col("_start").alias("first_us"),
        "last_us",
        (F.col("_total") - F.col("_before")).alias("n_changes"),
        "change_type",
        (F.col("_before") == 0).alias("_head"),
        F.col("_gap_after").isNull().alias("_tail"),
    )


def debounce(
    changes: DataFrame, gap_us: int, span_us: int, key: str = "path", time: str = "event_time", tie: str = "event_id"
) -> DataFrame:
    """One row per burst of changes of a path: first and last time, count, last change type.

    A burst ends when the next change comes more than `gap_us` later.  Changes are folded inside
    ranges of `span_us` first.  Only the first and the last piece of a range can go on in another
    one; these, two per key and range at most, are folded again together, while every other piece
    is complete and stays by itself.  Choose the span so that a range of the busiest path fits a
    task.

    Gives (key, first_us, last_us, n_changes, change_type).
    """
    us = F.unix_micros(F.col(time).cast("timestamp"))
    timed = changes.select(
        key, tie, "change_type", us.alias("first_us"), us.alias("last_us"), F.lit(1).cast("bigint").alias("n_changes"),
        F.floor(us / F.lit(span_us)).alias("_part"),
    )
    pieces = _bursts(timed, [key, "_part"], ["first_us", tie], gap_us)
    border = F.col("_head") | F.col("_tail")
    alone = pieces.withColumn("_part", F.when(~border, F.col("first_us")))
    whole = _bursts(alone.drop("_head", "_tail"), [key, "_part"], ["first_us"], gap_us)
    return whole.drop("_part", "_head", "_tail")
