import pytest
from pyspark.sql import functions as F

from snipdex.operators import embed as M
from snipdex.operators import index as I
from snipdex.operators import search as S

DIM = 32


@pytest.fixture(scope="module")
def world(spark):
    rows = [
        ("/a", "/a/src/one.py", "def alpha():\n    return 'red apple'\ndef beta():\n    return 'blue sky'"),
        ("/a", "/a/docs/two.py", "def gamma():\n    return 'red apple pie'"),
        ("/b", "/b/three.py", "def delta():\n    return 'red apple'"),
    ]
    files = spark.createDataFrame(rows, "root string, path string, text string")
    points = I.build_index(files, M.hashed_tokens(DIM), DIM).cache()
    libraries = spark.createDataFrame([("/a", "A", "Completed"), ("/b", "B", "Failed")], "root string, name string, status string")
    requests = spark.createDataFrame(
        [(1, "red apple", "/A/docs", 5), (2, "red apple", "/a", 1), (3, "red", "/b", 5), (4, "x", "/c", 5), (5, " ", "/a", 5), (6, "sky", "/a", None)],
        "query_id int, query string, path string, k int",
    )
    return requests, libraries, points


def answer(world, **options):
    requests, libraries, points = world
    hits = S.search_requests(requests, libraries, points, M.hashed_tokens(DIM), DIM, **options)
    names = points.select(F.col("point_id").alias("vec_id"), "member_name")
    out = {}
    for r in hits.join(names, "vec_id").orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append(r["member_name"].split(" ")[0])
    return out


def test_requests_are_judged(world):
    requests, libraries, _ = world
    got = {r["query_id"]: (r["library"], r["reason"], r["from_parent"]) for r in S.judge_requests(requests, libraries).collect()}
    assert got[1] == ("A", None, True) and got[2] == ("A", None, False)
    assert got[3][1] == "status failed" and got[4][1] == "no library" and got[5][1] == "blank query"


def test_search_stays_in_the_library_and_keeps_k(world):
    got = answer(world)
    assert set(got) == {1, 2, 6} and len(got[1]) == 3 and len(got[2]) == 1 and "delta" not in sum(got.values(), [])
    assert got[6][0] == "beta"


@pytest.mark.parametrize("listed", [2000, 0])
def test_search_inside_the_asked_folder(world, monkeypatch, listed):
    monkeypatch.setattr(S, "MAX_LISTED_PATHS", listed)
    got = answer(world, inside_path=True)
    assert got[1] == ["gamma"] and len(got[2]) == 1
