"""Change records: one JSON document per record, as batch table, stream and sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snipdex import schemas

# Fixed values
RECORD_VERSION = "1.0"


def _flat(records: DataFrame) -> DataFrame:
    c = "change."
    return records.select(
        F.col(c + "id").alias("event_id"), F.col(c + "library").alias("library"), F.col(c + "filePath").alias("path"),
        F.col(c + "changeType").alias("change_type"), F.col(c + "timestamp").alias("event_time"),
        F.col(c + "status").alias("status"), F.col(c + "retryCount").alias("retry_count"),
        F.col(c + "lastRetry").alias("last_retry_at"), F.col(c + "errorMessage").alias("error_message"),
        F.col("savedAt").alias("saved_at"), "version",
    )


def _documents(spark: SparkSession, path: str) -> DataFrame:
    """Every line as a record, and its text as `damaged` where it cannot be read."""
    schema = f"{schemas.CHANGE_RECORD}, damaged string"
    return spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "damaged").json(path)


def rejected_changes(spark: SparkSession, path: str) -> DataFrame:
    """The text of documents that `read_changes` leaves out: damaged ones, and records without an id."""
    rows = _documents(spark, path)
    lost = rows.filter("damaged IS NOT NULL OR change.id IS NULL")
    return lost.select(F.coalesce("damaged", F.to_json(F.struct("change", "savedAt", "version"))).alias("document"))


def read_changes(spark: SparkSession, path: str, status: str | None = None) -> DataFrame:
    """The latest stored state of each record, oldest event first; see `rejected_changes` for damaged documents."""
    from snipdex.operators.index import upsert_latest

    good = _documents(spark, path).filter("damaged IS NULL")
    rows = upsert_latest(_flat(good).filter("event_id IS NOT NULL"), ["event_id"], ["saved_at", "retry_count"])
    if status:
        rows = rows.filter(F.col("status") == status)
    return rows.orderBy("event_time", "event_id")


def _stream(spark: SparkSession, path: str, max_files: int) -> DataFrame:
    reader = spark.readStream.schema(f"{schemas.CHANGE_RECORD}, damaged string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "damaged")
    return reader.option("maxFilesPerTrigger", max_files).json(path)


def stream_changes(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """New record files of a landing folder as a stream; see `stream_rejected` for what is left out."""
    return _flat(_stream(spark, path, max_files).filter("damaged IS NULL")).filter("event_id IS NOT NULL")


def stream_rejected(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """The text of documents that `stream_changes` leaves out, as a stream: damaged ones, and records without an id."""
    lost = _stream(spark, path, max_files).filter("damaged IS NOT NULL OR change.id IS NULL")
    return lost.select(F.coalesce("damaged", F.to_json(F.struct("change", "savedAt", "version"))).alias("document"))


def append_changes(changes: DataFrame, path: str, saved_at: str) -> None:
    """Append record states; a reader takes the latest one per id, so an update is one more row."""
    change = F.struct(
        F.col("event_id").cast("string").alias("id"), F.col("path").alias("filePath"), F.col("change_type").alias("changeType"),
        F.col("event_time").alias("timestamp"), F.col("library").alias("library"), F.col("status").alias("status"),
        F.col("retry_count").alias("retryCount"), F.col("last_retry_at").alias("lastRetry"), F.col("error_message").alias("errorMessage"),
    )
    rows = changes.select(
        change.alias("change"), F.lit(saved_at).cast("timestamp").alias("savedAt"), F.lit(RECORD_VERSION).alias("version")
    )
    rows.write.mode("append").json(path)
