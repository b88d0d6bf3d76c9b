"""Building and maintaining an index of points as set operations on DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snipdex.functions import paths as P
from snipdex.operators import embed as M
from snipdex.operators.extract import extract_snippets
from snipdex.session import stored

POINT_COLUMNS = [
    "collection", "point_id", "file_path", "namespace", "class_name", "member_name", "code",
    "start_line", "end_line", "vector", "embed_ok",
]


def point_id(collection: Column, path: Column, start: Column, end: Column, *names: Column) -> Column:
    """The same snippet always gets the same id, so a replayed write changes nothing."""
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in (collection, path, start, end, *names)]
    return F.sha2(F.concat_ws("\u0001", *parts), 256)


def to_points(embedded: DataFrame) -> DataFrame:
    """Point rows: original code as payload, the vector of the truncated text, no NULL names."""
    named = {c: F.coalesce(c, F.lit("")) for c in ("namespace", "class_name", "member_name")}
    rows = embedded.withColumns(named).withColumn("file_path", F.col("path"))
    key = point_id(*[F.col(c) for c in ("collection", "file_path", "start_line", "end_line", "namespace", "class_name", "member_name")])
    return rows.withColumn("point_id", key).select(*POINT_COLUMNS)


def build_index(
    files: DataFrame, model: M.Embedder, dim: int, max_tokens: int = M.DEFAULT_MAX_TOKENS, batch: int = M.DEFAULT_BATCH, rest: bool = False, **options
) -> DataFrame:
    """Points for a file listing (root, path, text): extract, clean, truncate, embed.

    With `rest`, lines outside of declarations become points too. Extraction shuffles masks of lines and
    pieces, and each text once.
    """
    placed = files.withColumn("collection", P.collection_name(F.col("root")))
    snippets = extract_snippets(placed, keep=("collection",), rest=rest)
    return to_points(M.embed(snippets, "code", model, dim, batch=batch, max_tokens=max_tokens, **options))


def file_snapshot(files: DataFrame) -> DataFrame:
    """(library, root, path, content_hash, size, modified) per file; the newest row of a path wins."""
    rows = files.select(
        "library",
        "root",
        P.normalize_path(F.col("path")).alias("path"),
        F.sha2(F.col("text"), 256).alias("content_hash"),
        "size",
        F.col("modified"),
    )
    return upsert_latest(rows, ["library", "path"], ["modified", "content_hash"])


def upsert_latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the one with the greatest order values."""
    rest = [c for c in rows.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")
    return rows.groupBy(*keys).agg(best).select(*keys, "_r.*").select(*rows.columns)


def delete_points(points: DataFrame, ids: DataFrame) -> DataFrame:
    return points.join(ids.select("point_id").distinct(), "point_id", "left_anti").select(*points.columns)


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(library, root, path, change) with change one of added, modified, deleted, unchanged.

    A file is modified if its content hash differs, or if a hash is missing and it is newer than
    its last indexing.
    """
    a = old.select("library", "path", F.col("root").alias("_root_a"), F.col("content_hash").alias("_old"), F.col("last_indexed").alias("_at"), F.lit(True).alias("_was"))
    b = new.select("library", "path", F.col("root").alias("_root_b"), F.col("content_hash").alias("_new"), F.col("modified").alias("_mod"), F.lit(True).alias("_is"))
    joined = a.join(b, ["library", "path"], "full_outer")
    no_hash = F.col("_old").isNull() | F.col("_new").isNull()
    newer = F.coalesce(F.col("_mod") > F.col("_at"), F.lit(True))
    change = (
        F.when(F.col("_was").isNull(), "added")
        .when(F.col("_is").isNull(), "deleted")
        .when(no_hash, F.when(newer, "modified").otherwise("unchanged"))
        .when(F.col("_old") != F.col("_new"), "modified")
        .otherwise("unchanged")
    )
    return joined.select("library", F.coalesce("_root_a", "_root_b").alias("root"), "path", change.alias("change"))


def replace_by_file(points: DataFrame, changed: DataFrame, fresh: DataFrame) -> DataFrame:
    """Points of the changed files give way to the fresh ones; a file without fresh points is gone.

    `changed` has (collection, file_path).  Paths are compared by `file_key`, so it does not matter
    in which case or with which separators a path was read.
    """
    return delete_by_file(points, changed).unionByName(fresh.select(*points.columns))


def file_key(path: Column | str = "file_path") -> Column:
    """What paths of one file have in common; `file_path` itself stays as it was read."""
    return P.normalize_path(F.col(path) if isinstance(path, str) else path)


def delete_by_file(points: DataFrame, changed: DataFrame) -> DataFrame:
    gone = changed.select("collection", file_key().alias("_file_key")).distinct()
    return points.withColumn("_file_key", file_key()).join(gone, ["collection", "_file_key"], "left_anti").select(*points.columns)


def changed_since(old: DataFrame, files: DataFrame, build) -> tuple[DataFrame, DataFrame]:
    """What differs from the snapshot `old`: files (collection, file_path) whose points must go, and fresh points.

    `files` has (library, root, path, text, size, modified), and `build` maps files to points; only
    added and modified files pass through it.
    """
    current = files.withColumn("_file_key", file_key("path"))
    # Changed paths only, used twice below.
    diff = stored(snapshot_diff(old, file_snapshot(files)).filter("change <> 'unchanged'"), "diff")
    touched = diff.filter("change <> 'deleted'").select("library", F.col("path").alias("_file_key"))
    fresh = build(current.join(touched, ["library", "_file_key"], "left_semi").select(*files.columns))
    gone = diff.select(P.collection_name(F.col("root")).alias("collection"), F.col("path").alias("file_path"))
    return gone, fresh


def incremental_rebuild(points: DataFrame, old: DataFrame, files: DataFrame, build) -> DataFrame:
    """The index of the current files, from the points of the snapshot `old`; see `changed_since`.

    This reads all points; `IndexStore.update` opens only the buckets of changed files.
    """
    return replace_by_file(points, *changed_since(old, files, build))


def present_hits(hits: DataFrame, points: DataFrame, base: str = "root") -> DataFrame:
    """Hits with their snippet, a path below the library, a four-place score and one metadata line.

    `points` has vec_id and the point columns and the library root as `base`.
    """
    facts = points.select("vec_id", "file_path", "namespace", "class_name", "member_name", "code", "start_line", "end_line", base)
    rows = hits.join(facts, "vec_id")
    words = [F.nullif(F.col(c), F.lit("")) for c in ("namespace", "class_name", "member_name")]
    return rows.select(
        "query_id",
        "rank",
        F.format_number("score", 4).alias("score"),
        P.relative_path(F.col("file_path"), F.col(base)).alias("file"),
        "start_line",
        "end_line",
        F.concat_ws(" | ", *words).alias("details"),
        "code",
    )


def within_path(hits: DataFrame, prefix: Column) -> DataFrame:
    """Hits whose file lies at or below a path; for answers from a parent library."""
    return hits.filter((file_key() == P.normalize_path(prefix)) | P.is_subdirectory(file_key(), P.normalize_path(prefix)))
