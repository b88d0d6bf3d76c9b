"""Keep a stored index fresh from a stream of change bursts."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snipdex.functions import paths as P
from snipdex.operators.index import file_key, upsert_latest
from snipdex.session import delete_path, scratch_path, stored
from snipdex.sources.index_store import IndexStore
from snipdex.streaming.changes import burst_action


def apply_bursts(
    bursts: DataFrame, store: IndexStore, files_of: Callable[[DataFrame], DataFrame], build: Callable[[DataFrame], DataFrame], change_id: str
) -> None:
    """Apply one batch of bursts (root, path, last_time, change_type) to the index.

    `files_of` maps (root, path, file_key) rows, with the path as the change had it, to files with
    their text, `build` maps files to points.
    The latest burst of a path counts; a file that is gone or gives no snippet only loses its
    points.
    """
    rows = burst_action(bursts).withColumn("file_key", file_key("path"))
    last = upsert_latest(rows.select("root", "file_key", "path", "last_time", "action"), ["root", "file_key"], ["last_time", "action", "path"])
    changed = last.select(P.collection_name(F.col("root")).alias("collection"), F.col("path").alias("file_path"))
    updates = last.filter("action = 'update'").select("root", "path", "file_key")
    # Cutting reads the files once for every language: without a copy, what finds their texts would run each time.
    found = files_of(updates)
    spark, path = found.sparkSession, scratch_path(found.sparkSession, "changed-files")
    found.write.parquet(path)
    store.replace_files(changed, build(spark.read.schema(found.schema).parquet(path)), change_id)
    delete_path(spark, path)


def apply_held(
    held: DataFrame, store: IndexStore, files_of: Callable[[DataFrame], DataFrame], build: Callable[[DataFrame], DataFrame], checkpoint: str, name: str = "held"
) -> None:
    """Apply the bursts that a bounded run has left in its state (`changes.held_bursts`), so that no change waits for a later run.

    A run that goes on from the same checkpoint gives these bursts out again, longer or as they are; that changes nothing
    but what came later.
    """
    rows = stored(held, f"{name}-in")
    # The id names what is applied: a copy that a failed call has left is used for the same bursts only.
    mark = rows.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64(*rows.columns))).first()
    if mark[0]:
        apply_bursts(rows, store, files_of, build, f"{name}-{hashlib.sha256(f'{checkpoint}:{mark}'.encode()).hexdigest()[:16]}")


def start_apply(
    bursts: DataFrame,
    store: IndexStore,
    files_of: Callable[[DataFrame], DataFrame],
    build: Callable[[DataFrame], DataFrame],
    checkpoint: str,
    name: str = "apply",
    **trigger,
):
    """Run `apply_bursts` for every micro-batch; a batch that is run again changes nothing.

    The batch is used several times, so it is stored first: running its plan again would run the
    window state again.
    """

    # Batches are numbered from 0 for every checkpoint, so the change id names the checkpoint too.
    run = f"{name}-{hashlib.sha256(checkpoint.encode()).hexdigest()[:16]}"

    def each(batch: DataFrame, batch_id: int) -> None:
        path = scratch_path(batch.sparkSession, f"{name}-in")
        batch.write.parquet(path)
        rows = batch.sparkSession.read.schema(batch.schema).parquet(path)
        if not rows.isEmpty():
            apply_bursts(rows, store, files_of, build, f"{run}-{batch_id}")
        delete_path(batch.sparkSession, path)

    writer = bursts.writeStream.queryName(name).option("checkpointLocation", checkpoint).foreachBatch(each)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
