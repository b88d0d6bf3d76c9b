"""Search requests end to end: which library, is it ready, embed, nearest points, presentation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snipdex.functions import paths as P
from snipdex.operators import embed as M
from snipdex.operators import filters, knn
from snipdex.operators.resolve import search_readiness

# Fixed values
DEFAULT_K = 5
MAX_LISTED_PATHS = 2000


def judge_requests(requests: DataFrame, libraries: DataFrame) -> DataFrame:
    """Requests (query_id, query, path, k) with root, library and `reason` where one is refused.

    `libraries` has root, name and status.
    """
    clean = requests.withColumns({"path": P.normalize_path(F.col("path")), "k": F.coalesce("k", F.lit(DEFAULT_K))})
    ready = search_readiness(clean, libraries).withColumnRenamed("nearest_root", "root")
    reason = F.coalesce(filters.query_problem(F.col("query"), F.col("k")), F.col("reason"))
    return ready.select("query_id", "query", "path", "k", "root", "library", "from_parent", reason.alias("reason"))


def _scoped_points(points: DataFrame, asked: DataFrame) -> DataFrame:
    """Points once per asked path at or above their file; `scope` is that path."""
    wanted = asked.select("path").distinct()
    listed = [r["path"] for r in wanted.limit(MAX_LISTED_PATHS + 1).collect()]
    above = P.ancestors(P.normalize_path(F.col("file_path")))
    if len(listed) <= MAX_LISTED_PATHS:
        above = F.filter(above, lambda a: a.isin(listed)) if listed else F.array().cast("array<string>")
        return points.select("*", F.explode(above).alias("scope"))
    spread = points.select("*", F.explode(above).alias("scope"))
    return spread.join(wanted.withColumnRenamed("path", "scope"), "scope")


def search_requests(
    requests: DataFrame,
    libraries: DataFrame,
    points: DataFrame,
    model: M.Embedder,
    dim: int,
    max_tokens: int = M.DEFAULT_MAX_TOKENS,
    inside_path: bool = False,
    batch: int = M.DEFAULT_BATCH,
) -> DataFrame:
    """Hits (query_id, vec_id, score, rank, root, from_parent) of the requests that are ready.

    Each request looks into the collection of its nearest indexed library; with `inside_path`
    only at points below the asked path, which is decided before the best k are taken.
    """
    asked = judge_requests(requests, libraries).filter("reason IS NULL")
    asked = asked.withColumn("collection", P.collection_name(F.col("root")))
    embedded = M.embed(asked, "query", model, dim, batch=batch, max_tokens=max_tokens).filter("embed_ok")
    scope = F.col("path") if inside_path else F.col("collection")
    queries = embedded.select(
        "query_id", F.col("vector").alias("q_vector"), scope.alias("scope"), "k", "root", "from_parent"
    )
    usable = points.filter("embed_ok").withColumn("vec_id", F.col("point_id"))
    # Other collections are dropped before any vector goes to Python.
    usable = usable.join(asked.select("collection").distinct(), "collection", "left_semi")
    if inside_path:
        vectors = _scoped_points(usable, asked).select("scope", "vec_id", "vector")
    else:
        vectors = usable.select(F.col("collection").alias("scope"), "vec_id", "vector")
    most = asked.agg(F.max("k")).first()[0] or DEFAULT_K
    hits = knn.knn_join(queries.select("query_id", "q_vector", "scope"), vectors, min(int(most), filters.MAX_RESULTS))
    limits = asked.select("query_id", "k", "root", "from_parent")
    return hits.join(limits, "query_id").filter(F.col("rank") <= F.col("k")).select(
        "query_id", "vec_id", "score", "rank", "root", "from_parent"
    )
