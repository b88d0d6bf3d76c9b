"""Session set-up and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Text columns are wide: keep the Arrow batches handed to Python small.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


#: Stored tables with the whole texts of files: worth a slower codec, since they are the most of what a job stores.
TEXT_TABLES = {"masked", "pieces"}


def build_session(app: str = "snipdex", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the settings the operators are tuned for; `extra` wins."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see, as named by `spark.checkpoint.dir`.

    Only a local session may fall back to a temporary folder: on a cluster that
    folder would exist on one machine and be lost with it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="snipdex-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of this library's own intermediate tables."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def stored(df: DataFrame, label: str) -> DataFrame:
    """The same rows read back from a table in the shared folder: computed once, no lineage."""
    path = scratch_path(df.sparkSession, label)
    writer = df.write.option("compression", "zstd") if label in TEXT_TABLES else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread_scan(df: DataFrame, *keys: str) -> DataFrame:
    """A plain scan ahead of costly Python work, on at least as many partitions as there are cores.

    Large inputs already come in more splits than that and are left alone; only few or small
    files are shuffled.  Meant for scans and projections: on other plans asking for the
    partitions could run them.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= slots:
        return df
    return df.repartition(slots, *keys)
