"""Library configuration as JSON documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value
EXPORT_VERSION = "1.0"


def export_documents(parsed: DataFrame, as_of: str, include_statistics: bool = False) -> DataFrame:
    """(id, document) per library, camel-case keys."""
    fields = [
        F.col("name").alias("libraryName"),
        F.coalesce("meta.projectType", F.lit("unknown")).alias("projectType"),
        F.col("watch").alias("watchConfiguration"),
        F.col("meta").alias("metadata"),
        F.lit(as_of).alias("exportDate"),
        F.lit(EXPORT_VERSION).alias("exportVersion"),
    ]
    if include_statistics:
        fields.append(F.col("stats").alias("statistics"))
    return parsed.select("id", F.to_json(F.struct(*fields)).alias("document"))


def write_export(parsed: DataFrame, path: str, as_of: str, include_statistics: bool = False) -> None:
    """One JSON document per line below `path`."""
    export_documents(parsed, as_of, include_statistics).select("document").write.mode("overwrite").text(path)
