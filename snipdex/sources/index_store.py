"""The point table on storage, partitioned by collection and by a bucket of the file path.

Changing a few files rewrites only the buckets those files fall in.  A touched bucket is first
written aside in the shared folder and then moved over by one dynamic overwrite, so a change
that is cut short can be applied again from the copy.  Every touched bucket keeps one marker
row; without it a bucket that became empty would keep its old rows.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snipdex.operators.index import POINT_COLUMNS, changed_since, file_key, replace_by_file
from snipdex.session import delete_path, path_exists, shared_dir

BUCKETS = 64
MAX_NAMED_FOLDERS = 4096
PARTITIONS = ["collection", "file_bucket"]
POINT_SCHEMA = (
    "collection string, point_id string, file_path string, namespace string, class_name string, member_name string, "
    "code string, start_line int, end_line int, vector array<float>, embed_ok boolean, live boolean, file_bucket int"
)


def _bucket(buckets: int):
    return F.pmod(F.xxhash64("collection", file_key()), F.lit(buckets)).cast("int").alias("file_bucket")


class IndexStore:
    """A stored index.  `buckets` is fixed for the life of the table."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def exists(self) -> bool:
        return path_exists(self.spark, self.path)

    def _raw(self) -> DataFrame:
        if not self.exists():
            return self.spark.createDataFrame([], POINT_SCHEMA)
        return self.spark.read.schema(POINT_SCHEMA).parquet(self.path)

    def _folder(self, collection: str, bucket: int | None = None) -> str:
        escape = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
        folder = f"{self.path}/collection={escape(collection)}"
        return folder if bucket is None else f"{folder}/file_bucket={bucket}"

    def _some(self, folders: list[str]) -> DataFrame:
        """Only the named folders; the rest of the index is neither listed nor read."""
        present = [f for f in folders if path_exists(self.spark, f)]
        if not present:
            return self.spark.createDataFrame([], POINT_SCHEMA)
        return self.spark.read.schema(POINT_SCHEMA).option("basePath", self.path).parquet(*present)

    def _touching(self, keys: DataFrame) -> DataFrame:
        """Stored rows whose folder occurs in `keys` (collection, maybe file_bucket).

        Few folders, as a bounded read shows, are opened by name; otherwise the index is scanned
        and joined.
        """
        names = keys.distinct().limit(MAX_NAMED_FOLDERS + 1).collect()
        if len(names) <= MAX_NAMED_FOLDERS:
            return self._some([self._folder(*n) for n in names])
        return self._raw().join(keys.distinct(), keys.columns, "left_semi")

    def read(self, collection: str | None = None) -> DataFrame:
        """Live points, of one collection or of all."""
        rows = self._raw() if collection is None else self._some([self._folder(collection)])
        return rows.filter("live").select(*POINT_COLUMNS)

    def read_collections(self, collections: DataFrame) -> DataFrame:
        """Live points of the collections named in a `collection` column; others are not opened."""
        return self._touching(collections.select("collection")).filter("live").select(*POINT_COLUMNS)

    def _with_markers(self, points: DataFrame, touched: DataFrame) -> DataFrame:
        """Points with their bucket, plus one marker row per touched folder."""
        columns = [*POINT_COLUMNS, "live", "file_bucket"]
        rows = points.withColumn("file_bucket", _bucket(self.buckets)).withColumn("live", F.lit(True))
        blank = {c: F.lit(None) for c in POINT_COLUMNS if c != "collection"}
        markers = touched.withColumns(blank).withColumn("live", F.lit(False))
        return rows.select(*columns).unionByName(markers.select(*columns))

    def _overwrite(self, rows: DataFrame) -> None:
        """Replace the folders that occur in the rows.

        The rebalance hint gathers the rows of a folder and lets a crowded folder be split.
        """
        out = rows.hint("rebalance", *PARTITIONS)
        writer = out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy(*PARTITIONS).parquet(self.path)

    def _staged(self, change_id: str) -> str:
        return f"{shared_dir(self.spark)}/staged/{hashlib.sha256(self.path.encode()).hexdigest()}-{change_id}"

    def _stored(self, path: str) -> DataFrame:
        return self.spark.read.schema(POINT_SCHEMA).parquet(path)

    def build(self, points: DataFrame, change_id: str) -> None:
        """Full build: the collections that occur in `points` are replaced as a whole.

        The points are computed once, into the shared folder.
        """
        staged = self._staged(change_id)
        if not path_exists(self.spark, staged + "/_SUCCESS"):
            points.select(*POINT_COLUMNS).write.mode("overwrite").parquet(staged)
        copy = self._stored(staged).select(*POINT_COLUMNS)
        touched = copy.select("collection", _bucket(self.buckets)).distinct()
        if self.exists():
            old = self._touching(copy.select("collection")).select(*PARTITIONS).distinct()
            touched = touched.unionByName(old).distinct()
        self._overwrite(self._with_markers(copy, touched))
        delete_path(self.spark, staged)

    def replace_files(self, changed: DataFrame, fresh: DataFrame, change_id: str) -> None:
        """Delete the points of the changed files and insert the fresh ones.

        `change_id` names the change, for example the batch of a stream: after a failure a second
        call with the same id finishes from the stored copy.  The copy is deleted once the change is
        done, so an id can be used again for another change; repeating a change gives the same table.
        """
        staged = self._staged(change_id)
        if not path_exists(self.spark, staged + "/_SUCCESS"):
            keys = changed.select("collection", "file_path").distinct()
            touched = keys.select("collection", _bucket(self.buckets)).distinct()
            current = self._touching(touched).filter("live")
            merged = replace_by_file(current.select(*POINT_COLUMNS), keys, fresh.select(*POINT_COLUMNS))
            self._with_markers(merged, touched).write.mode("overwrite").parquet(staged)
        self._overwrite(self._stored(staged))
        delete_path(self.spark, staged)

    def update(self, old: DataFrame, files: DataFrame, build, change_id: str) -> None:
        """Bring the index from the snapshot `old` to the current files, at the cost of the change."""
        gone, fresh = changed_since(old, files, build)
        self.replace_files(gone, fresh, change_id)

    def drop_collection(self, collection: str) -> None:
        """Empty every folder of a collection."""
        touched = self._some([self._folder(collection)]).select(*PARTITIONS).distinct()
        self._overwrite(self._with_markers(self._raw().filter(F.lit(False)).select(*POINT_COLUMNS), touched))

    def info(self) -> DataFrame:
        from snipdex.operators.knn import collection_info

        return collection_info(self.read())
