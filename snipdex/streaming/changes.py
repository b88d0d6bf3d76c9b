"""Change streams: rename split, de-duplication, debouncing, and what a burst means.

Each function takes and gives a DataFrame and works on streams; all but the windowed ones work
on batch tables too.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values
DEFAULT_GAP = "500 milliseconds"
DEFAULT_LATENESS = "10 minutes"


def split_renames(changes: DataFrame) -> DataFrame:
    """A rename becomes the deletion of the old path and the creation of the new one.

    Needs path, new_path and change_type; gives the other columns unchanged.
    """
    one = F.array(F.struct(F.col("path").alias("path"), F.col("change_type").alias("change_type")))
    two = F.array(
        F.struct(F.col("path").alias("path"), F.lit("Deleted").alias("change_type")),
        F.struct(F.col("new_path").alias("path"), F.lit("Created").alias("change_type")),
    )
    rest = [c for c in changes.columns if c not in ("path", "new_path", "change_type")]
    parts = F.when(F.col("change_type") == "Renamed", two).otherwise(one)
    return changes.select(*rest, F.explode(parts).alias("_c")).select(*rest, "_c.*")


def drop_repeats(changes: DataFrame, lateness: str = DEFAULT_LATENESS) -> DataFrame:
    """Each event id once; on a stream within the watermark."""
    if changes.isStreaming:
        return changes.withWatermark("event_time", lateness).dropDuplicatesWithinWatermark(["event_id"])
    return changes.dropDuplicates(["event_id"])


def debounce_stream(
    changes: DataFrame, gap: str = DEFAULT_GAP, lateness: str | None = DEFAULT_LATENESS, keys: tuple[str, ...] = ("path",)
) -> DataFrame:
    """One row per burst of a path, given out once the burst has been quiet for `gap`.

    Bursts of one micro-batch are merged before the shuffle if the session sets
    `spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition`.  Pass no lateness for
    a stream that has a watermark already.
    """
    timed = changes if lateness is None else changes.withWatermark("event_time", lateness)
    order = F.struct("event_time", "event_id")
    bursts = timed.groupBy(*keys, F.session_window("event_time", gap).alias("w")).agg(
        F.max("event_time").alias("last_time"),
        F.count(F.lit(1)).alias("n_changes"),
        F.max_by("change_type", order).alias("change_type"),
    )
    return bursts.select(*keys, F.col("w.start").alias("first_time"), "last_time", "n_changes", "change_type")


def held_bursts(spark: SparkSession, checkpoint: str, keys: tuple[str, ...] = ("path",)) -> DataFrame:
    """The bursts that a stopped run of `debounce_stream` still holds, read from the state in its checkpoint.

    A bounded run ends before the last bursts have been quiet for long enough; nothing but the state is read.
    """
    operators = spark.read.format("state-metadata").load(checkpoint).filter("operatorName LIKE 'sessionWindow%'").select("operatorId").distinct().collect()
    columns = [*(F.col(f"value.{k}") for k in keys), *(F.col(f"value.{c}").alias(n) for c, n in (("session_window.start", "first_time"), ("max", "last_time"), ("count", "n_changes"), ("valueWithExtremumOrdering", "change_type")))]
    held = [spark.read.format("statestore").option("operatorId", r["operatorId"]).load(checkpoint).select(*columns) for r in operators]
    return functools.reduce(DataFrame.unionByName, held)


def burst_action(bursts: DataFrame) -> DataFrame:
    """The last change of a burst decides: a deletion removes the file, all else updates it."""
    return bursts.withColumn("action", F.when(F.col("change_type") == "Deleted", "delete").otherwise("update"))
