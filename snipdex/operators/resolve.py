"""Which library answers for a path: nearest indexed ancestor, and readiness to search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snipdex.functions import paths as P

SALTS = 16
MAX_LISTED_ROOTS = 2000


def nearest_ancestor(
    paths: DataFrame,
    libraries: DataFrame,
    path_col: str = "path",
    root_col: str = "root",
    max_listed: int = MAX_LISTED_ROOTS,
    salts: int = SALTS,
) -> DataFrame:
    """Adds `nearest_root`: the longest root at or above the path, NULL if there is none.

    A bounded read first tells whether the roots are few.  If so they become a set inside the
    expression, which tells the deepest one, its name comes from a broadcast table of the roots, and
    the paths are not moved at all.  Otherwise the paths are spread over their
    ancestors and joined; common ancestors such as the top folder are hot keys, so that side is
    salted and the roots are repeated once per salt.
    """
    names = libraries.select(root_col).filter(F.col(root_col).isNotNull()).distinct()
    listed = [r[0] for r in names.limit(max_listed + 1).collect()]
    if len(listed) <= max_listed:
        by_key = {(r.rstrip("/") or "/"): r for r in sorted(listed)}
        if not by_key:
            return paths.withColumn("nearest_root", F.lit(None).cast("string"))
        above = F.filter(P.ancestors(F.col(path_col)), lambda a: a.isin(list(by_key)))
        rows = paths.withColumn("_deepest", F.try_element_at(above, F.lit(-1)))
        table = paths.sparkSession.createDataFrame(list(by_key.items()), "_key string, nearest_root string")  # at most max_listed rows
        return rows.join(F.broadcast(table), rows["_deepest"] == table["_key"], "left").drop("_deepest", "_key")

    distinct_paths = paths.select(F.col(path_col).alias("_p")).distinct()
    spread = distinct_paths.select(
        "_p",
        F.posexplode(P.ancestors(F.col("_p"))).alias("_depth", "_a"),
        F.pmod(F.xxhash64("_p"), F.lit(salts)).cast("int").alias("_salt"),
    )
    roots = names.select(F.rtrim(F.col(root_col), F.lit("/")).alias("_a"), F.col(root_col).alias("_root"))
    salted = roots.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    nearest = (
        spread.join(salted, ["_a", "_salt"])
        .groupBy("_p")
        .agg(F.max_by("_root", "_depth").alias("nearest_root"))
    )
    return paths.join(nearest, paths[path_col] == nearest["_p"], "left").drop("_p")


def search_readiness(requests: DataFrame, libraries: DataFrame, path_col: str = "path") -> DataFrame:
    """Requests with the library that answers, `ready`, and the reason where it is not.

    `libraries` has root, name and status.
    """
    found = nearest_ancestor(requests, libraries, path_col)
    facts = libraries.select(F.col("root").alias("nearest_root"), F.col("name").alias("library"), "status")
    joined = found.join(facts, "nearest_root", "left")
    reason = (
        F.when(F.col("library").isNull(), "no library")
        .when(F.lower("status") != "completed", F.concat(F.lit("status "), F.lower("status")))
    )
    return joined.withColumn("reason", reason).withColumn("ready", reason.isNull()).withColumn(
        "from_parent", F.col("library").isNotNull() & (F.col("nearest_root") != F.col(path_col))
    )
