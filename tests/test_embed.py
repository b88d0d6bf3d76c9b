import numpy as np
import pytest
from pyspark.sql import functions as F

from snipdex.operators import embed as M


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(i, f"word{i} common\n" * 3) for i in range(25)] + [(99, "  ")], "id int, t string").repartition(3)


def test_vector_stays_with_its_row(texts):
    model = M.hashed_tokens(16)
    got = {r["id"]: r for r in M.embed(texts, "t", model, 16, batch=4).collect()}
    assert set(got) == set(range(25))
    for i, row in got.items():
        assert np.allclose(row["vector"], model([row["t"]])[0], atol=1e-6) and row["embed_ok"]
        assert row["t"] == f"word{i} common\n" * 3


def test_model_sees_truncated_batches(texts):
    def model(batch):
        assert len(batch) <= 4
        return np.array([[len(t), 1.0] for t in batch])

    got = M.embed(texts, "t", model, 2, batch=4, max_tokens=6).collect()
    assert len(got) == 25 and all(r["vector"][0] < len(r["t"]) for r in got)


def test_long_first_line_is_embedded_in_parts(spark):
    long = "alpha " * 500 + "beta"
    model = M.hashed_tokens(32)
    got = M.embed(spark.createDataFrame([(1, long)], "id int, t string"), "t", model, 32, max_tokens=60).first()
    assert got["embed_ok"] and got["t"] == long and np.linalg.norm(got["vector"]) == pytest.approx(1, abs=1e-5)
    assert np.dot(got["vector"], model(["alpha"])[0]) > 0.9 and abs(np.dot(got["vector"], model(["beta"])[0])) > 0


def test_retry_then_success(texts):
    def factory():
        state = {"calls": 0}

        def model(batch):
            state["calls"] += 1
            if state["calls"] % 2:
                raise IOError("busy")
            return np.ones((len(batch), 2))

        return model

    got = M.embed(texts, "t", factory(), 2, batch=5, base_ms=1).collect()
    assert all(r["embed_ok"] for r in got)


def test_fallback_and_strict(texts):
    def broken(batch):
        return np.ones((len(batch) + 1, 2))

    got = M.embed(texts, "t", broken, 2, batch=5, attempts=2, base_ms=1).collect()
    assert len(got) == 25 and not any(r["embed_ok"] for r in got) and all(r["vector"] == [0.0, 0.0] for r in got)
    with pytest.raises(Exception, match="wanted"):
        M.embed(texts, "t", broken, 2, attempts=1, strict=True).collect()


def test_models_by_name(texts):
    M.register_embedder("ones", lambda dim: lambda batch: np.ones((len(batch), dim)))
    assert M.embed(texts, "t", M.embedder("Ones", dim=3), 3).filter(F.size("vector") == 3).count() == 25
    with pytest.raises(ValueError, match="unknown embedder"):
        M.embedder("nothing")


def test_workers_need_no_copy_of_the_package(tmp_path):
    """Another working directory, and the package only on the driver's path."""
    import os
    import subprocess
    import sys

    code = (
        "import sys; sys.path.insert(0, %r)\n"
        "from snipdex.session import build_session\n"
        "from snipdex.operators import embed, extract, knn\n"
        "s = build_session(master='local[2]', **{'spark.ui.enabled': 'false'})\n"
        "files = s.createDataFrame([('/r/a.py', 'def f(): pass')], 'path string, text string')\n"
        "points = embed.embed(extract.extract_snippets(files), 'code', embed.hashed_tokens(8), 8)\n"
        "q = s.createDataFrame([(1, [1.0] * 8)], 'query_id int, q_vector array<double>')\n"
        "v = points.selectExpr('path vec_id', 'vector')\n"
        "assert knn.knn_join(q, v, 1).count() == 1\n"
        "assert knn.knn_join(q, v, 1, max_broadcast=0).count() == 1\n"
        "assert knn.knn_lsh(q, v, 8, 1, tables=2, bits=1).count() >= 0\n"
    ) % os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    run = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert run.returncode == 0, run.stderr[-2000:]
