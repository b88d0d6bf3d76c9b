"""Digests of folders, built from the deepest folders up, and a diff that only descends into folders that differ.

A tree is a table in the shared folder with a folder per depth: every file and every folder of a library with its digest.
The digest of a file is its content hash; that of a folder comes from the names and digests of what it holds, as sums
that do not depend on order, so a folder with very many entries is aggregated in parts. Each level is read once.

The diff starts at the roots. Per depth it reads the entries below folders that differ, compares them by name, and goes
on with the folders among them; equal folders are left out with all that is below. A file without a hash never equals
another one, so its folders differ and the file itself is judged by its times.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snipdex.functions import paths as P
from snipdex.session import path_exists, scratch_path, stored

ENTRY = "library string, folder string, name string, is_file boolean, digest string, entries bigint, at timestamp"
#: Paths have no more segments than a file system allows in their length.
MAX_DEPTH = 2048


@dataclass
class FolderTree:
    spark: SparkSession
    path: str

    def level(self, depth: int) -> DataFrame:
        """Entries whose path has `depth` segments; roots have none."""
        folder = f"{self.path}/depth={depth}"
        if not path_exists(self.spark, folder):
            return self.spark.createDataFrame([], ENTRY)
        return self.spark.read.schema(ENTRY).parquet(folder)

    def entries(self) -> DataFrame:
        return self.spark.read.schema(f"{ENTRY}, depth int").parquet(self.path)


def _parent(path: str):
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def folder_tree(snapshot: DataFrame, at: str, path: str | None = None) -> FolderTree:
    """The tree of (library, root, path, content_hash, `at`) rows; `at` is when a file was changed or indexed."""
    spark = snapshot.sparkSession
    path = path or scratch_path(spark, "folders")
    rel = P.relative_path(P.normalize_path(F.col("path")), P.normalize_path(F.col("root")))
    rel = F.regexp_replace(rel, "^/+|/+$", "")
    files = snapshot.select("library", rel.alias("rel"), "content_hash", F.col(at).cast("timestamp").alias("at"))
    files = files.withColumns({"folder": _parent("rel"), "name": F.regexp_extract("rel", "[^/]*$", 0), "depth": F.size(F.split("rel", "/"))})
    # Unlike any digest of the other side: the time column tells the sides apart.
    digest = F.coalesce("content_hash", F.concat(F.lit(f"{at}?"), F.coalesce(F.col("at").cast("string"), F.lit(""))))
    leaves = files.select("library", "folder", "name", F.lit(True).alias("is_file"), digest.alias("digest"), F.lit(1).cast("long").alias("entries"), "at", "depth")
    leaves = stored(leaves, "leaves")
    deepest = leaves.agg(F.max("depth")).first()[0] or 0
    if deepest > MAX_DEPTH:
        raise ValueError(f"{deepest} levels of folders")
    below = None  # folders of the level at hand
    for depth in range(deepest, -1, -1):
        here = leaves.filter(F.col("depth") == depth).drop("depth")
        here = here if below is None else here.unionByName(below)
        here.write.parquet(f"{path}/depth={depth}")
        if not depth:
            break
        level = spark.read.schema(ENTRY).parquet(f"{path}/depth={depth}")
        one, two = (F.xxhash64("name", "is_file", "digest", F.lit(salt)) for salt in (1, 2))
        sums = F.concat_ws(":", F.count(F.lit(1)).cast("string"), F.bit_xor(one).cast("string"), F.sum(two.cast("decimal(38,0)")).cast("string"))
        up = level.groupBy("library", "folder").agg(F.sha2(sums, 256).alias("digest"), (F.sum("entries") + 1).alias("entries"))
        below = up.select(
            "library", _parent("folder").alias("parent"), F.regexp_extract("folder", "[^/]*$", 0).alias("name"), F.lit(False).alias("is_file"), "digest", "entries", F.lit(None).cast("timestamp").alias("at")
        ).withColumnRenamed("parent", "folder")
    return FolderTree(spark, path)


@dataclass
class TreeDiff:
    """Rows (library, path, change) of files that differ, and how many entries were compared at each depth."""

    changes: DataFrame
    compared: list[int]


def tree_diff(old: FolderTree, new: FolderTree) -> TreeDiff:
    """What `snapshot_diff` gives, but for unchanged files; `path` is below the library's root.

    `old` was built with the time of indexing, `new` with the time of change.
    """
    key = ["library", "folder", "name", "is_file"]
    differing, found, compared, depth = None, None, [], 0
    while True:
        sides = []
        for tree, word in ((old, "old"), (new, "new")):
            rows = tree.level(depth)
            if differing is not None:
                rows = rows.join(differing, ["library", "folder"], "left_semi")
            sides.append(rows.select(*key, F.col("digest").alias(f"{word}_digest"), F.col("at").alias(f"{word}_at"), F.lit(True).alias(f"is_{word}")))
        joined = stored(sides[0].join(sides[1], key, "full_outer"), "compared")
        compared.append(joined.count())
        if not compared[-1]:
            break
        differs = joined.filter(~F.col("old_digest").eqNullSafe(F.col("new_digest")))
        full = F.when(F.col("folder") == "", F.col("name")).otherwise(F.concat_ws("/", "folder", "name"))
        newer = F.coalesce(F.col("new_at") > F.col("old_at"), F.lit(True))
        no_hash = F.col("old_digest").contains("?") | F.col("new_digest").contains("?")
        change = F.when(F.col("is_old").isNull(), "added").when(F.col("is_new").isNull(), "deleted").when(~no_hash | newer, "modified")
        files = differs.filter("is_file").select("library", full.alias("path"), change.alias("change")).filter("change IS NOT NULL")
        found = files if found is None else found.unionByName(files)
        differing = differs.filter("NOT is_file").select("library", full.alias("folder"))
        depth += 1
    if found is None:
        found = old.spark.createDataFrame([], "library string, path string, change string")
    return TreeDiff(found, compared)
