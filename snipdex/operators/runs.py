"""Totals and results of index runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def parse_totals(parsed: DataFrame, group: str = "library") -> DataFrame:
    """Files, snippets and errors per group from (path, snippets, error) rows.

    The errors themselves stay rows of the input; only their number and the first path are
    gathered.
    """
    return parsed.groupBy(group).agg(
        F.count(F.lit(1)).alias("files"),
        F.sum("snippets").alias("snippets"),
        F.count("error").alias("errors"),
        F.min(F.when(F.col("error").isNotNull(), F.col("path"))).alias("first_error"),
    )


def run_result(counts: DataFrame) -> DataFrame:
    """Success, rate and completion from total, ok and failed; `broken` marks impossible counts."""
    total, ok, failed = F.col("total"), F.col("ok"), F.col("failed")
    return counts.withColumns(
        {
            "success": failed == 0,
            "rate": F.when(total == 0, F.lit(1.0)).otherwise(ok / F.nullif(total, F.lit(0))),
            "completion": F.coalesce(F.try_divide(ok * 100.0, total), F.lit(0.0)),
            "broken": (ok + failed > total) | (total < 0) | (ok < 0) | (failed < 0),
        }
    )


class ObservedRun:
    """Counts of an index run, taken while its points are written: nothing is read or extracted a second time.

    Put `files` around the listing and `points` around the points, write the points, then ask for `result`.
    """

    def __init__(self):
        self._files, self._points = Observation(), Observation()

    def files(self, listing: DataFrame) -> DataFrame:
        return listing.observe(self._files, F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))

    def points(self, points: DataFrame) -> DataFrame:
        failed = F.count_if(~F.col("embed_ok"))
        return points.observe(self._points, F.count(F.lit(1)).alias("total"), failed.alias("failed"), F.count_if(F.col("embed_ok")).alias("ok"))

    def result(self, spark: SparkSession) -> DataFrame:
        """(files, bytes, total, ok, failed, success, rate, completion, broken): one row."""
        row = self._files.get | self._points.get
        names = ["files", "bytes", "total", "ok", "failed"]
        counts = spark.createDataFrame([tuple(int(row[n]) for n in names)], ", ".join(f"{n} long" for n in names))
        return run_result(counts)
