"""Vector search over the embeddings table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snipdex.functions import vectors as V
from snipdex.operators import ivf, knn
from snipdex.plans.catalog import query
from snipdex.plans.domain import load
from snipdex.session import scratch_path

DIM = 64


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "embeddings").select(
        "vec_id", F.col("embedding").alias("vector"), F.col("label").alias("scope")
    )


def _as_queries(vectors: DataFrame) -> DataFrame:
    return vectors.select(F.col("vec_id").alias("query_id"), F.col("vector").alias("q_vector"))


def _centroids(vectors: DataFrame) -> DataFrame:
    """Mean vector per label; partial sums keep the shuffle at one row per label and task."""
    means = F.array(*[F.avg(F.get("vector", F.lit(i)).cast("double")) for i in range(DIM)])
    return vectors.groupBy("scope").agg(means.alias("q_vector")).withColumn("query_id", F.col("scope"))


VECTORS_SQL = """e AS (
  SELECT vec_id, label, v, sqrt(list_dot_product(v, v)) AS n
  FROM (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings))"""

CENTROIDS_SQL = VECTORS_SQL + """, c AS (
  SELECT label, v, sqrt(list_dot_product(v, v)) AS n FROM (
    SELECT label, list(m ORDER BY pos) AS v FROM (
      SELECT label, pos, avg(x) AS m FROM (
        SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM e) GROUP BY label, pos)
    GROUP BY label))"""


def _pairs_sql(k: int, threshold: float | None = None) -> str:
    return f"""WITH {VECTORS_SQL}, s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, round(list_dot_product(a.v, b.v) / (a.n * b.n), 9) AS score
  FROM e a JOIN e b ON a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank
      FROM s WHERE {f'score >= {threshold}' if threshold is not None else 'true'})
SELECT query_id, vec_id, rank, round(score, 6) AS score FROM r WHERE rank <= {k}"""


def _hits(df: DataFrame) -> DataFrame:
    return df.select("query_id", "vec_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query("knn_exact", _pairs_sql(5))
def knn_exact(spark, sf_dir):
    v = _vectors(spark, sf_dir).drop("scope")
    return _hits(knn.knn_join(_as_queries(v), v, 5, exclude_self=True))


@query("knn_threshold", _pairs_sql(10, 0.3))
def knn_threshold(spark, sf_dir):
    v = _vectors(spark, sf_dir).drop("scope")
    return _hits(knn.knn_join(_as_queries(v), v, 10, threshold=0.3, exclude_self=True))


@query("knn_blocks", _pairs_sql(3))
def knn_blocks(spark, sf_dir):
    """The form for more queries than may be broadcast."""
    v = _vectors(spark, sf_dir).drop("scope")
    return _hits(knn.knn_join(_as_queries(v), v, 3, exclude_self=True, max_broadcast=64))


@query(
    "centroid_search",
    f"""WITH {CENTROIDS_SQL}, s AS (
  SELECT c.label AS query_id, e.vec_id, round(list_dot_product(c.v, e.v) / (c.n * e.n), 9) AS score FROM c, e),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, vec_id, rank, round(score, 6) AS score FROM r WHERE rank <= 5""",
)
def centroid_search(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return _hits(knn.knn_join(_centroids(v).drop("scope"), v.drop("scope"), 5))


@query(
    "collection_search",
    f"""WITH {CENTROIDS_SQL}, s AS (
  SELECT c.label AS query_id, e.vec_id, round(list_dot_product(c.v, e.v) / (c.n * e.n), 9) AS score
  FROM c JOIN e ON c.label = e.label),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, vec_id, rank, round(score, 6) AS score FROM r WHERE rank <= 5""",
)
def collection_search(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return _hits(knn.knn_join(_centroids(v), v, 5))


@query("knn_lsh")
def knn_lsh(spark, sf_dir):
    v = _vectors(spark, sf_dir).drop("scope")
    return _hits(knn.knn_lsh(_as_queries(v), v, DIM, 5, exclude_self=True))


@query("knn_lsh_recall", "SELECT true AS recall_ok, CAST(0 AS BIGINT) AS wrong_scores")
def knn_lsh_recall(spark, sf_dir):
    """Approximate against exact neighbours: at least nine of ten found, and no score that exact search does not give."""
    v = _vectors(spark, sf_dir).drop("scope")
    near = knn.knn_lsh(_as_queries(v), v, DIM, 5, exclude_self=True).select("query_id", "vec_id", F.col("score").alias("near_score"))
    exact = knn.knn_join(_as_queries(v), v, 5, exclude_self=True)
    worst = exact.groupBy("query_id").agg(F.min("score").alias("worst"))
    joined = exact.join(near, ["query_id", "vec_id"], "full_outer").join(worst, "query_id")
    wrong = F.when(F.col("score").isNotNull(), F.abs(F.col("score") - F.col("near_score")) > 1e-6).otherwise(F.col("near_score") > F.col("worst") + 1e-6)
    return joined.agg(
        (F.count_if(F.col("score").isNotNull() & F.col("near_score").isNotNull()) >= 0.9 * F.count("score")).alias("recall_ok"),
        F.count_if(F.coalesce(wrong, F.lit(False))).alias("wrong_scores"),
    )


def _inverted_file(spark, vectors) -> ivf.InvertedFile:
    path = scratch_path(spark, "ivf")
    ivf.build(vectors, path, DIM)
    return ivf.open_index(spark, path)


def _hundredth(vectors: DataFrame) -> DataFrame:
    return _as_queries(vectors.filter(F.col("vec_id") % 100 == 0))


@query("ivf_recall", "SELECT count(*) AS queries, true AS recall_ok, true AS fewer_scores, CAST(0 AS BIGINT) AS wrong_scores FROM embeddings WHERE vec_id % 100 = 0")
def ivf_recall(spark, sf_dir):
    """Lists asked by every hundredth vector: nine of ten neighbours found, fewer scores than exact search, none wrong."""
    v = _vectors(spark, sf_dir).drop("scope")
    index, asked = _inverted_file(spark, v), _hundredth(v)
    probes, _ = ivf.choose_probes(index, _as_queries(v), 5, exclude_self=True)
    near = ivf.search(index, asked, 5, probes, exclude_self=True).select("query_id", "vec_id", F.col("score").alias("near_score"))
    exact = knn.knn_join(asked, v, 5, exclude_self=True)
    joined = exact.join(near, ["query_id", "vec_id"], "left")
    share = ivf.scored_share(index, asked, probes)
    return joined.agg(
        F.count_distinct("query_id").alias("queries"),
        (F.count("near_score") >= 0.9 * F.count("score")).alias("recall_ok"),
        F.lit(share < 1).alias("fewer_scores"),
        F.count_if(F.abs(F.col("score") - F.col("near_score")) > 1e-6).alias("wrong_scores"),
    )


@query("ivf_exact", _pairs_sql(5).replace("ON a.vec_id <> b.vec_id", "ON a.vec_id <> b.vec_id AND a.vec_id % 100 = 0"))
def ivf_exact(spark, sf_dir):
    """Exact neighbours from the stored lists, without the blocks that can hold none."""
    v = _vectors(spark, sf_dir).drop("scope")
    return _hits(ivf.search_exact(_inverted_file(spark, v), _hundredth(v), 5, exclude_self=True))


CLUSTERED_SQL = _pairs_sql(10, 0.95).replace("CAST(embedding AS DOUBLE[]) AS v", "list_transform(embedding, lambda x, i: CAST(x AS DOUBLE) + CASE WHEN i = label + 1 THEN 4 ELSE 0 END) AS v")


def _clustered(spark, sf_dir) -> DataFrame:
    """The vectors moved apart by their label."""
    v = _vectors(spark, sf_dir)
    moved = F.transform("vector", lambda x, i: x.cast("double") + F.when(i == F.col("scope"), 4.0).otherwise(0.0))
    return v.select("vec_id", moved.alias("vector"))


@query("knn_bounded", CLUSTERED_SQL)
def knn_bounded(spark, sf_dir):
    """All close pairs of clustered vectors: blocks are skipped by their distances to pivots."""
    v = _clustered(spark, sf_dir)
    return _hits(ivf.search_exact(_inverted_file(spark, v), _as_queries(v), 10, threshold=0.95, exclude_self=True))


@query("knn_bounded_work", "SELECT count(*) AS queries, true AS most_skipped FROM embeddings")
def knn_bounded_work(spark, sf_dir):
    """What the bounds leave out: more than half of the blocks and of the scores."""
    v = _clustered(spark, sf_dir)
    index = _inverted_file(spark, v)
    work = ivf.skipped_blocks(index, ivf.with_floors(index, _as_queries(v), 10, 0.95, exclude_self=True))
    less = (F.sum("skipped") > 0.5 * F.sum("blocks")) & (F.sum("scored") < 0.5 * F.sum("vectors"))
    return work.agg(F.count(F.lit(1)).alias("queries"), less.alias("most_skipped"))


MIXED_SQL = """WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 <> 0 THEN label END AS scope, CAST(CASE WHEN vec_id % 5 = 0 THEN embedding[1:32] ELSE embedding END AS DOUBLE[]) AS v FROM embeddings),
n AS (SELECT *, sqrt(list_dot_product(v, v)) AS n FROM e),
s AS (SELECT a.vec_id AS query_id, b.vec_id, round(list_dot_product(a.v, b.v) / (a.n * b.n), 9) AS score
  FROM n a JOIN n b ON a.scope = b.scope AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, vec_id, rank, round(score, 6) AS score FROM r WHERE rank <= 3"""


def _mixed_search(spark, sf_dir, max_broadcast):
    """Vectors of two lengths, some without a scope: the rows do not depend on the form of the join."""
    v = _mixed_lengths(spark, sf_dir, 5).withColumn("scope", F.when(F.col("vec_id") % 7 != 0, F.col("scope")))
    asked = v.select(F.col("vec_id").alias("query_id"), F.col("vector").alias("q_vector"), "scope")
    return _hits(knn.knn_join(asked, v, 3, exclude_self=True, max_broadcast=max_broadcast))


@query("knn_mixed_few", MIXED_SQL)
def knn_mixed_few(spark, sf_dir):
    return _mixed_search(spark, sf_dir, 1 << 20)


@query("knn_mixed_many", MIXED_SQL)
def knn_mixed_many(spark, sf_dir):
    return _mixed_search(spark, sf_dir, 16)


@query(
    "cosine_to_centroid",
    f"""WITH {CENTROIDS_SQL}
SELECT e.vec_id, round(list_dot_product(c.v, e.v) / (c.n * e.n), 6) AS score FROM e JOIN c ON e.label = c.label""",
)
def cosine_to_centroid(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    score = V.cosine_similarity(F.col("vector"), F.col("q_vector"))
    return v.join(_centroids(v).drop("query_id"), "scope").select("vec_id", F.round(score, 6).alias("score"))


def _mixed_lengths(spark, sf_dir, every=10):
    """Every tenth vector is cut short, so that there is something to reject."""
    v = _vectors(spark, sf_dir)
    short = F.slice("vector", 1, DIM // 2)
    return v.withColumn("vector", F.when(F.col("vec_id") % every == 0, short).otherwise(F.col("vector")))


@query(
    "vector_dim_filter",
    f"""SELECT vec_id, vec_id % 10 <> 0 AS accepted, CASE WHEN vec_id % 10 = 0 THEN 32 ELSE {DIM} END AS dim
FROM embeddings""",
)
def vector_dim_filter(spark, sf_dir):
    v = _mixed_lengths(spark, sf_dir)
    good = knn.valid_vectors(v, "vector", DIM).withColumn("accepted", F.lit(True))
    bad = knn.rejected_vectors(v, "vector", DIM).withColumn("accepted", F.lit(False))
    return good.unionByName(bad).select("vec_id", "accepted", F.size("vector").alias("dim"))


@query(
    "collection_info",
    f"""SELECT 'label_' || label AS collection, count(*) AS points,
  max(CASE WHEN vec_id % 10 = 0 THEN 32 ELSE {DIM} END) AS dimension,
  CASE WHEN count(DISTINCT vec_id % 10 = 0) = 1 THEN 'green' ELSE 'mixed' END AS status
FROM embeddings GROUP BY label""",
)
def collection_info(spark, sf_dir):
    v = _mixed_lengths(spark, sf_dir)
    return knn.collection_info(v.withColumn("collection", F.concat(F.lit("label_"), F.col("scope").cast("string"))))
