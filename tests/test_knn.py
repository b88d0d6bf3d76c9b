import numpy as np
import pytest
from pyspark.sql import functions as F

from snipdex.functions.vectors import cosine_similarity
from snipdex.operators import knn

DIM = 8


def frame(spark, rows, ddl):
    return spark.createDataFrame(rows, ddl)


@pytest.fixture(scope="module")
def data(spark):
    """A third of all vectors are copies of one vector; some are zero or too short."""
    rng = np.random.default_rng(3)
    hot = rng.standard_normal(DIM).tolist()
    rows = []
    for i in range(300):
        vector = hot if i % 3 == 0 else rng.standard_normal(DIM).tolist()
        if i % 50 == 7:
            vector = [0.0] * DIM
        if i % 50 == 8:
            vector = vector[:3]
        rows.append((i, vector, "big" if i % 3 else "hot"))
    vectors = frame(spark, rows, "vec_id long, vector array<double>, scope string").cache()
    queries = vectors.filter("vec_id % 5 = 0").select(F.col("vec_id").alias("query_id"), F.col("vector").alias("q_vector"), "scope")
    return queries, vectors


def rows(df):
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in df.collect())


def brute(queries, vectors, k, threshold=None, scoped=False):
    out = []
    vs = [r for r in vectors.collect() if len(r["vector"]) == DIM and np.linalg.norm(r["vector"]) > 0]
    for q in queries.collect():
        if len(q["q_vector"]) != DIM or np.linalg.norm(q["q_vector"]) == 0:
            continue
        a = np.array(q["q_vector"])
        scored = []
        for v in vs:
            if scoped and v["scope"] != q["scope"]:
                continue
            b = np.array(v["vector"])
            score = round(float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)), 9)
            if threshold is None or score >= threshold:
                scored.append((-score, v["vec_id"]))
        for rank, (s, vec_id) in enumerate(sorted(scored)[:k], 1):
            out.append((q["query_id"], rank, vec_id, -s))
    return sorted(out)


def near(got, want):
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], atol=1e-8)


@pytest.mark.parametrize("k,threshold", [(1, None), (7, None), (20, 0.5)])
def test_both_forms_match_brute_force(data, k, threshold):
    queries, vectors = (d.drop("scope") for d in data)
    want = brute(*data, k, threshold)
    near(rows(knn.knn_join(queries, vectors, k, threshold)), want)
    near(rows(knn.knn_join(queries, vectors, k, threshold, max_broadcast=5, cell_rows=40)), want)


def test_scoped_search_stays_in_scope(data):
    queries, vectors = data
    want = brute(queries, vectors, 6, scoped=True)
    near(rows(knn.knn_join(queries, vectors, 6)), want)
    near(rows(knn.knn_join(queries, vectors, 6, max_broadcast=5, cell_rows=30)), want)


def test_partitioning_does_not_matter(data):
    queries, vectors = (d.drop("scope") for d in data)
    results = [rows(knn.knn_join(queries, vectors.repartition(n), 5)) for n in (1, 8)]
    assert results[0] == results[1]


def test_small_score_blocks_give_the_same(data, monkeypatch):
    queries, vectors = (d.drop("scope") for d in data)
    want = rows(knn.knn_join(queries, vectors, 5))
    monkeypatch.setattr(knn, "CELL_BYTES", 4096)
    assert rows(knn.knn_join(queries, vectors, 5)) == want
    assert rows(knn.knn_join(queries, vectors, 5, max_broadcast=1, cell_rows=50)) == want


def test_matches_the_readable_expression(data):
    queries, vectors = (d.drop("scope") for d in data)
    pairs = queries.join(vectors, F.size("q_vector") == F.size("vector"))
    scored = pairs.withColumn("score", F.round(cosine_similarity(F.col("q_vector"), F.col("vector")), 9)).filter("score IS NOT NULL")
    want = knn.rank_hits(scored.filter(F.size("vector") == DIM), 4)
    near(rows(knn.knn_join(queries, vectors, 4)), rows(want))


def test_exclude_self_and_string_ids(data):
    queries, vectors = (d.drop("scope") for d in data)
    q = queries.withColumn("query_id", F.concat(F.lit("v"), "query_id"))
    v = vectors.withColumn("vec_id", F.concat(F.lit("v"), "vec_id"))
    got = rows(knn.knn_join(q, v, 3, exclude_self=True))
    assert got and all(g[0] != g[2] for g in got)
    assert rows(knn.knn_join(q, v, 3, exclude_self=True, max_broadcast=1, cell_rows=64)) == got


def test_search_and_empty_inputs(spark, data):
    _, vectors = data
    query = vectors.filter("vec_id = 1").first()["vector"]
    best = knn.search(vectors, query, 3).collect()
    assert best[0]["vec_id"] == 1 and best[0]["score"] == pytest.approx(1.0) and len(best) == 3
    nothing = spark.createDataFrame([], "query_id long, q_vector array<double>")
    assert knn.knn_join(nothing, vectors.drop("scope"), 3).count() == 0


def test_lsh_scores_are_exact_and_recall_is_high(spark):
    emb = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    v = emb.select("vec_id", F.col("embedding").alias("vector"))
    q = emb.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q_vector"))
    exact = {(r[0], r[2]): r[3] for r in rows(knn.knn_join(q, v, 5))}
    found = rows(knn.knn_lsh(q, v, 64, 5, tables=10, bits=5, probes=3))
    assert len({(r[0], r[2]) for r in found} & set(exact)) / len(exact) > 0.85
    assert all(abs(exact[(r[0], r[2])] - r[3]) < 1e-8 for r in found if (r[0], r[2]) in exact)
    split = rows(knn.knn_lsh(q, v, 64, 5, tables=10, bits=5, probes=3, cell_rows=16))
    assert split == found


def shares_found(spark, rows, **settings):
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)], "vec_id long, vector array<double>").cache()
    q = v.filter("vec_id % 40 = 0").select(F.col("vec_id").alias("query_id"), F.col("vector").alias("q_vector"))
    exact = {(r[0], r[2]) for r in knn.knn_join(q, v, 5, exclude_self=True).select("query_id", "rank", "vec_id").collect()}
    found = {(r[0], r[2]) for r in knn.knn_lsh(q, v, rows.shape[1], 5, exclude_self=True, **settings).select("query_id", "rank", "vec_id").collect()}
    return len(exact & found) / len(exact), knn.lsh_settings(q, v, rows.shape[1], 5, exclude_self=True)


def test_lsh_recall_does_not_fall_with_the_table(spark):
    """Even vectors, the worst case: fixed tables and probes with bits from the row count find about half."""
    found, _ = shares_found(spark, np.random.default_rng(1).standard_normal((16_000, 64)))
    assert found >= 0.9


def test_lsh_uses_buckets_where_they_serve(spark, monkeypatch):
    """Groups of near vectors: a setting is found that reaches the recall with few scores."""
    rng = np.random.default_rng(2)
    rows = np.repeat(rng.standard_normal((1000, 32)), 8, axis=0) + 0.1 * rng.standard_normal((8000, 32))
    monkeypatch.setattr(knn, "SHUFFLED_ROW", 1)
    found, settings = shares_found(spark, rows)
    assert settings is not None and found >= 0.9


def test_neighbour_buckets_go_by_margin():
    rows = np.random.default_rng(5).standard_normal((20, 16))
    got = knn._codes(rows, 2, 6, 9, 7)
    side = (rows @ knn._planes(16, 2, 6, 7)).reshape(20, 2, 6)
    for r in range(20):
        for t in range(2):
            own = sum(1 << b for b in range(6) if side[r, t, b] > 0)
            want = sorted(range(64), key=lambda c: sum(side[r, t, b] ** 2 for b in range(6) if (c ^ own) >> b & 1))[:10]
            assert got[r, t].tolist() == want


def test_collection_info(spark):
    df = frame(spark, [("a", [1.0, 2.0]), ("a", [1.0]), ("b", [1.0])], "collection string, vector array<double>")
    got = {tuple(r) for r in knn.collection_info(df).collect()}
    assert got == {("a", 2, 2, "mixed"), ("b", 1, 1, "green")}


@pytest.mark.parametrize("kind", [np.float32, np.float64])
@pytest.mark.parametrize("k, threshold", [(3, None), (400, None), (5, 0.4)])
def test_blocks_scored_in_single_precision_first_give_the_exact_best(monkeypatch, kind, k, threshold):
    """Slices of both sides, many copies, almost equal rows, zero and missing numbers."""
    import pyarrow as pa

    monkeypatch.setattr(knn, "COLUMNS", 64)
    monkeypatch.setattr(knn, "CELL_BYTES", 4 * 64 * 50)
    rng = np.random.default_rng(1)
    rows = rng.standard_normal((300, DIM)).astype(kind)
    rows[40:140] = rows[40]
    rows[200:220] = rows[200] * (1 + 1e-7 * rng.standard_normal((20, DIM)))
    rows[7], rows[8, 0] = 0, np.nan
    ids = np.array([f"v{i:03}" for i in rng.permutation(300)])
    array = pa.chunked_array([pa.array(list(rows[:100]), pa.list_(pa.from_numpy_dtype(kind))), pa.array(list(rows[100:]), pa.list_(pa.from_numpy_dtype(kind)))])
    side = knn._Side(array, ids, DIM)
    got = [np.concatenate(c) for c in zip(*knn._best_of_block(side, side, k, threshold))]
    unit, usable = knn._matrix(array, DIM)
    want = knn._best(unit[usable], unit[usable], ids[usable], k, threshold)
    assert all(np.array_equal(a, b) for a, b in zip(got, want)) and len(side) == 298


def test_blocks_go_to_all_cores_and_stay_few(spark):
    def blocks(rows, cores):
        return -(-rows // knn._block_rows(rows, rows, 64, cores))

    assert blocks(51_282, 12) ** 2 >= 3 * 12 and blocks(3_000_000, 12) <= 16 and blocks(1000, 12) == 1
    v = spark.range(6000).select(F.col("id").alias("vec_id"), F.array(*[F.randn(i) for i in range(DIM)]).alias("vector"))
    hits = knn._by_blocks(v.select(F.col("vec_id").alias("query_id"), F.col("vector").alias("q_vector")), v, DIM, 2, None, False, None)
    assert hits.groupBy("query_id").count().agg(F.min("count")).first()[0] >= 4  # two of each block


def test_settings_bound_the_copies(spark, monkeypatch):
    """However dear scores are, a row is shuffled to a bounded number of places."""
    monkeypatch.setattr(knn, "SHUFFLED_ROW", 0)
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(np.random.default_rng(5).standard_normal((3000, DIM)))], "vec_id long, vector array<double>")
    tables, _, probes = knn.lsh_settings(v.select(F.col("vec_id").alias("query_id"), F.col("vector").alias("q_vector")), v, DIM, 5, exclude_self=True)
    assert tables * (1 + probes) + tables <= 64
