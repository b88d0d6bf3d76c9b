"""Every registered query against its SQL on the smallest data."""

import pytest

import __spark_entry__ as driver
from snipdex.plans import all_queries, all_sql
from tests.compare import compare, connect

SF = "/root/testdata/sf0.001"
QUERIES = all_queries()
SQL = all_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    state, rows, _, why = compare(spark, con, SF, name, QUERIES[name], SQL.get(name))
    assert state in ("same", "rows only"), (state, why)
    assert rows > 0


def test_every_check_has_a_query():
    assert set(SQL) <= set(QUERIES)
    assert set(QUERIES) - set(SQL) == {"knn_lsh"}


def test_entry(spark):
    assert driver.entry(spark).columns == ["query_id", "vec_id", "rank", "score"]


CROSS = ("CartesianProduct", "BroadcastNestedLoopJoin")
STREAMS = {"apply_stream", "debounce_stream", "lifecycle_stream", "index_store", "incremental_store", "index_rebuild_drop", "change_records_stream"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - STREAMS))
def test_no_cross_join(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in CROSS), plan
    assert "BatchEvalPython" not in plan


def test_filters_and_columns_reach_the_scan(spark):
    plan = QUERIES["duplicate_guard"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<c_custkey:bigint>" in plan
    plan = QUERIES["task_library_join"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(c_custkey)" in plan or "IsNotNull(c_nationkey)" in plan
