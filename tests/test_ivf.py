"""The stored inverted file: approximate search by lists, exact search with bounds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from snipdex.operators import ivf, knn
from snipdex.session import scratch_path

DIM = 16


def table(spark, rows, ids=None):
    ids = ids if ids is not None else range(len(rows))
    return spark.createDataFrame([(i if isinstance(i, str) else int(i), r.tolist()) for i, r in zip(ids, rows)], f"vec_id {'string' if ids is not None and isinstance(ids[0], str) else 'long'}, vector array<double>")


def asked(vectors):
    return vectors.select(F.col("vec_id").alias("query_id"), F.col("vector").alias("q_vector"))


def clusters(n, seed=5, spread=0.15):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, DIM))
    # A third of all vectors is in one cluster.
    own = np.where(rng.random(n) < 0.33, 0, rng.integers(0, 12, n))
    return centres[own] + spread * rng.standard_normal((n, DIM))


@pytest.fixture(scope="module")
def index(spark):
    vectors = table(spark, clusters(1500)).repartition(6)
    path = scratch_path(spark, "ivf-test")
    ivf.build(vectors, path, DIM, lists=24)
    return vectors, ivf.open_index(spark, path)


def rows(df):
    return sorted((r.query_id, r.rank, r.vec_id, round(r.score, 8)) for r in df.collect())


def test_every_vector_is_in_one_block(index):
    vectors, found = index
    assert found.rows() == 1500 == found.vectors.count() and len(found.centroids) == 24
    kept = {(r["list"], r["ring"]): r["count"] for r in found.vectors.groupBy("list", "ring").count().collect()}
    assert kept == {tuple(b): c for b, c in zip(found.blocks.tolist(), found.counts.tolist())}
    for r in found.vectors.limit(50).collect():
        unit = np.array(r.vector) / np.linalg.norm(r.vector)
        assert r["list"] == (found.centroids @ unit).argmax()
        block = found.blocks.tolist().index([r["list"], r["ring"]])
        far = np.append(np.linalg.norm(found.pivots - unit, axis=1), np.linalg.norm(found.centroids[r["list"]] - unit))
        assert (far >= found.low[block] - 1e-9).all() and (far <= found.high[block] + 1e-9).all()


@pytest.mark.parametrize("max_broadcast,cell_rows", [(5000, None), (10, None), (10, 64)])
@pytest.mark.parametrize("k,threshold", [(4, None), (7, 0.9), (2000, 0.97)])
def test_exact_search_equals_the_join(index, k, threshold, max_broadcast, cell_rows):
    vectors, found = index
    some = asked(vectors.filter("vec_id % 37 = 0"))
    got = ivf.search_exact(found, some, k, threshold, exclude_self=True, max_broadcast=max_broadcast, cell_rows=cell_rows)
    assert rows(got) == rows(knn.knn_join(some, vectors, k, threshold, exclude_self=True))


def test_bounds_skip_most_blocks_of_clusters(index):
    vectors, found = index
    queries = ivf.with_floors(found, asked(vectors), 5, 0.9)
    work = ivf.skipped_blocks(found, queries).agg(F.sum("blocks"), F.sum("skipped"), F.sum("vectors"), F.sum("scored"), F.min("scored")).first()
    assert work[1] > 0.5 * work[0] and work[3] < 0.5 * work[2] and work[4] > 0


def test_probes_come_from_measured_recall(spark, index):
    vectors, found = index
    queries = asked(vectors.filter("vec_id % 3 = 0"))
    probes, recall = ivf.choose_probes(found, queries, 5, exclude_self=True)
    assert 1 <= probes < len(found.centroids) and recall >= 0.9
    near = {(r.query_id, r.vec_id) for r in ivf.search(found, queries, 5, probes, exclude_self=True).collect()}
    exact = {(r.query_id, r.vec_id) for r in knn.knn_join(queries, vectors, 5, exclude_self=True).collect()}
    assert len(near & exact) >= 0.9 * len(exact)
    assert ivf.scored_share(found, queries, probes) < 0.5
    assert ivf.scored_share(found, queries, len(found.centroids)) == 1
    every = ivf.search(found, queries, 5, len(found.centroids), exclude_self=True)
    assert rows(every) == rows(knn.knn_join(queries, vectors, 5, exclude_self=True))
    by_key = ivf.search(found, queries, 5, probes, exclude_self=True, max_broadcast=3)
    assert {(r.query_id, r.vec_id) for r in by_key.collect()} == near


def test_a_search_opens_only_its_lists(index):
    vectors, found = index
    plan = ivf.search(found, asked(vectors.filter("vec_id = 3")), 2, 2)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [list" in plan or "list#" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_settings_stay_with_the_index(spark, index):
    path = scratch_path(spark, "ivf-settings")
    ivf.save_settings(spark, path, 3, 0.93, 5)
    ivf.save_settings(spark, path, 4, 0.95, 5)
    assert ivf.load_settings(spark, path) == {"probes": 4, "recall": 0.95, "k": 5}


def test_odd_vectors(spark):
    unit = np.eye(DIM)
    data = [unit[0], unit[1], unit[0], np.zeros(DIM), np.ones(3), -unit[0]]
    vectors = table(spark, data, ["b", "c", "a", "zero", "short", "far"])
    path = scratch_path(spark, "ivf-odd")
    ivf.build(vectors, path, DIM, lists=50)
    found = ivf.open_index(spark, path)
    assert found.rows() == 4
    got = ivf.search_exact(found, asked(vectors), 2)
    assert rows(got) == rows(knn.knn_join(asked(knn.valid_vectors(vectors, "vector", DIM)), knn.valid_vectors(vectors, "vector", DIM), 2))
    assert [r.vec_id for r in got.filter("query_id = 'b'").orderBy("rank").collect()] == ["a", "b"]
    assert ivf.search(found, asked(vectors.filter("false")), 2, 1).count() == 0
    assert ivf.choose_probes(found, asked(vectors.filter("false")), 2) == (1, 1.0)


def test_an_empty_index(spark):
    vectors = table(spark, clusters(3)).filter("false")
    path = scratch_path(spark, "ivf-empty")
    ivf.build(vectors, path, DIM, lists=4)
    assert ivf.open_index(spark, path).rows() == 0
