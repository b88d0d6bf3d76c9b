import json

import pytest
from pyspark.sql import functions as F

from snipdex import schemas
from snipdex.operators import batches as B
from snipdex.operators import migrate as M
from snipdex.operators import profile as Q
from snipdex.operators import registry as R
from snipdex.operators import resolve as V
from snipdex.operators import runs as N
from snipdex.operators import tasks as T
from snipdex.sources.registry_tables import conform


def library(i, status="Pending", files=0, snippets=0, watch=None, meta=None, stats=None, path=None, updated="2024-01-01"):
    return (i, f"lib{i}", path or f"/p/{i}", f"code_index_{i}", status, json.dumps(watch or {}), json.dumps(stats or {}), json.dumps(meta or {}), updated, files, snippets, True)


def table(spark, rows):
    ddl = "id int, name string, codebase_path string, collection_name string, status string, watch_config string, statistics string, metadata string, updated_at string, total_files bigint, indexed_snippets bigint, is_active boolean"
    df = spark.createDataFrame(rows, ddl).withColumn("updated_at", F.col("updated_at").cast("timestamp"))
    return conform(df, "libraries")


@pytest.fixture(scope="module")
def three(spark):
    """Three libraries whose keys are spelled in different cases."""
    return table(spark, [
        library(1, watch={"FilePatterns": ["*.py"], "IsEnabled": True}, meta={"ProjectType": "script", "Team": "A", "Tags": ["tag1"]}),
        library(2, watch={"filePatterns": ["*.cs"], "isEnabled": True}, meta={"projectType": "webapi", "team": "A", "tags": ["tag2"]}),
        library(3, watch={"FILEPATTERNS": ["*.py"], "isenabled": False}, meta={"projecttype": "script", "TEAM": "B", "Tags": ["tag3"], "extra": "x"}),
    ])


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_json_filters(three):
    parsed = R.parse(three)
    assert ids(R.list_monitored(parsed)) == [1, 2]
    assert ids(R.list_by_metadata(parsed, projectType="webapi")) == [2]
    assert ids(R.list_by_metadata(parsed, team="A")) == [1, 2]
    assert ids(R.list_by_metadata(parsed, team="A", projectType="script")) == [1]
    assert ids(R.list_by_tag(parsed, "tag3")) == [3]
    assert ids(R.list_by_key(three, "metadata", "Extra", "x")) == [3]


def test_damaged_json_is_skipped(spark):
    rows = [list(library(1)), list(library(2, watch={"isEnabled": True}))]
    rows[0][5], rows[0][6] = "{broken", ""
    parsed = R.parse(table(spark, [tuple(r) for r in rows]))
    assert ids(R.list_monitored(parsed)) == [2]
    assert parsed.filter("id = 1").select("watch", "stats").first() == (None, None)


def test_defaults_and_nested_lists(spark):
    watch = {"CustomFilters": [{"Name": "n", "Pattern": "*t*"}, {"name": "m", "enabled": False}]}
    stats = {"IndexingHistory": [{"Date": "2024-01-01T00:00:00", "Duration": 2.5, "FilesProcessed": 3, "SnippetsCreated": 4}], "LanguageDistribution": {"python": 2}}
    row = R.parse(table(spark, [library(1, watch=watch, stats=stats)])).first()
    assert row["watch"]["maxFileSize"] == 10 << 20 and row["watch"]["includeSubdirectories"] and row["watch"]["isEnabled"]
    assert [tuple(f) for f in row["watch"]["customFilters"]] == [("n", "*t*", True), ("m", "", False)]
    assert row["stats"]["indexingHistory"][0]["filesProcessed"] == 3 and row["stats"]["languageDistribution"] == {"python": 2}


def test_statistics(spark):
    rows = [library(1, "Completed", 100, 500, stats={"LastIndexingDuration": 30.0}), library(2, "Failed", 50, 200, stats={"lastIndexingDuration": 10.0})]
    got = R.global_statistics(R.parse(table(spark, rows))).first().asDict()
    assert (got["total_libraries"], got["total_files"], got["total_snippets"]) == (2, 150, 700)
    assert (got["completed"], got["failed"], got["monitored"], got["average_duration"]) == (1, 1, 2, 20.0)


def test_lookup_and_order(spark):
    df = table(spark, [library(1, path="/A/B", updated="2024-01-03"), library(2, updated="2024-01-05")])
    assert ids(R.by_path(df, "\\a\\.\\b\\")) == [1] and ids(R.by_id(df, 2)) == [2] and ids(R.by_collection(df, "code_index_1")) == [1]
    assert [r["id"] for r in R.list_all(df).collect()] == [2, 1]
    assert [r["id"] for r in R.order_by_last_indexed(df.withColumn("created_at", F.col("updated_at"))).collect()] == [2, 1]


def test_json_updates(three):
    chosen = three.filter("id = 1").select("id")
    more = R.append_metadata(three, chosen, "owner", F.lit('"me"'))
    docs = {r["id"]: json.loads(r["metadata"]) for r in more.collect()}
    assert docs[1]["owner"] == "me" and docs[1]["Tags"] == ["tag1"] and "owner" not in docs[2]
    less = R.remove_metadata(more, chosen, "owner")
    assert "owner" not in json.loads(less.filter("id = 1").first()["metadata"])


def test_history_grows(spark):
    parsed = R.parse(table(spark, [library(1), library(2)]))
    runs = spark.createDataFrame([(1, "2024-02-01", 3.0, 10, 20)], "id int, date string, duration double, files int, snippets int")
    got = {r["id"]: r["stats"] for r in R.append_history(parsed, runs).collect()}
    assert got[1]["lastIndexingDuration"] == 3.0 and got[1]["indexingHistory"][0]["snippetsCreated"] == 20 and got[2]["indexingHistory"] == []


def test_duplicates_patch_and_status(spark):
    existing = table(spark, [library(1, path="/a")])
    new = table(spark, [library(5, path="/A/"), library(6, path="/b"), library(7, path="/B")])
    good, refused = R.reject_duplicates(new, existing)
    assert ids(good) == [6] and ids(refused) == [5, 7]
    patches = spark.createDataFrame([(1, None, "Failed")], "id int, name string, status string")
    row = R.patch(existing, patches, "id").first()
    assert (row["name"], row["status"]) == ("lib1", "Failed")
    marked = R.set_status(existing, spark.createDataFrame([(1,), (1,), (9,)], "id int"), "Indexing", "2025-01-01").collect()
    assert len(marked) == 1 and marked[0]["status"] == "Indexing"
    assert R.uniqueness_violations(new.unionByName(new), ["id"]).count() == 3


def test_null_parents_survive_a_cascade(spark):
    children = spark.createDataFrame([(1, 10), (2, 11), (3, None)], "task_id int, library_id int")
    deleted = spark.createDataFrame([(10,)], "library_id int")
    assert sorted(r["task_id"] for r in R.cascade_delete(children, deleted, "library_id").collect()) == [2, 3]
    assert sorted((r["task_id"], r["library_id"]) for r in R.set_null_on_delete(children, deleted, "library_id").collect() if r["library_id"]) == [(2, 11)]


ROOTS = ["/a", "/a/b", "/x/"]
PATHS = ["/a/b/c", "/a/b", "/ab", "/a/q", "/x/y", "/", None, "/a/b/c"]
NEAREST = {"/a/b/c": "/a/b", "/a/b": "/a/b", "/ab": None, "/a/q": "/a", "/x/y": "/x/", "/": None, None: None}


@pytest.mark.parametrize("listed", [100, 0])
def test_nearest_ancestor(spark, listed):
    paths = spark.createDataFrame([(p,) for p in PATHS], "path string")
    roots = spark.createDataFrame([(r,) for r in ROOTS], "root string")
    got = V.nearest_ancestor(paths, roots, max_listed=listed).collect()
    assert len(got) == len(PATHS) and all(NEAREST[r["path"]] == r["nearest_root"] for r in got)


def test_nearest_ancestor_without_libraries(spark):
    paths = spark.createDataFrame([("/a",)], "path string")
    roots = spark.createDataFrame([], "root string")
    assert V.nearest_ancestor(paths, roots).first()["nearest_root"] is None


def test_search_readiness(spark):
    libraries = spark.createDataFrame([("/a", "A", "Completed"), ("/b", "B", "Indexing")], "root string, name string, status string")
    asked = spark.createDataFrame([("/a",), ("/a/x",), ("/b/x",), ("/c",)], "path string")
    got = {r["path"]: (r["ready"], r["reason"], r["from_parent"]) for r in V.search_readiness(asked, libraries).collect()}
    assert got == {"/a": (True, None, False), "/a/x": (True, None, True), "/b/x": (False, "status indexing", True), "/c": (False, "no library", False)}


def listing(spark, paths):
    return spark.createDataFrame([(lib, p, 10) for lib, p in paths], "library string, rel_path string, size long")


def test_project_types(spark):
    rows = [("ts", "package.json"), ("ts", "tsconfig.json")] + [("ts", f"src/a{i}.ts") for i in range(10)]
    rows += [("mix", "App/App.csproj"), ("mix", "go.mod"), ("none", "readme.md"), ("deep", "x/go.mod"), ("deep", "x/main.go")]
    got = {r["library"]: r for r in Q.detect_project_type(listing(spark, rows)).collect()}
    assert (got["ts"]["project_type"], got["ts"]["confidence"], got["ts"]["alternatives"]) == ("typescript", 1.0, ["javascript"])
    assert (got["mix"]["project_type"], got["mix"]["confidence"], got["mix"]["alternatives"]) == ("mixed", 0.8, ["go"])
    assert (got["none"]["project_type"], got["none"]["confidence"]) == ("unknown", 0.0)
    assert (got["deep"]["project_type"], got["deep"]["confidence"]) == ("go", 0.01)


def test_structure(spark):
    rows = [("l", "top.md"), ("l", "src/Unit_Tests/a.py"), ("l", "node_modules/p/q.js")] + [("l", f"logs/{i}.log") for i in range(101)] + [("flat", "a")]
    got = {r["library"]: r for r in Q.structure_profile(listing(spark, rows)).collect()}
    assert (got["l"]["total_files"], got["l"]["directories"], got["l"]["has_tests"], got["l"]["has_docs"]) == (104, 5, True, False)
    assert got["l"]["suggested_excludes"] == ["node_modules"] and got["l"]["advice"] == ["exclude_logs"]
    assert (got["flat"]["directories"], got["flat"]["has_tests"], got["flat"]["suggested_excludes"]) == (0, False, [])


def test_positions_with_a_hot_group(spark):
    rows = [(i * 7, "hot" if i % 3 else f"g{i % 5}") for i in range(400)]
    df = spark.createDataFrame(rows, "id long, g string")
    got = {r["id"]: (r["position"], r["total"], r["batch"], r["batches"]) for r in B.assign_batches(df, "g", "id", 9, span=50).collect()}
    groups = {}
    for i, g in sorted(rows):
        groups.setdefault(g, []).append(i)
    want = {i: (n + 1, len(m), n // 9 + 1, -(-len(m) // 9)) for m in groups.values() for n, i in enumerate(m)}
    assert got == want


def test_a_value_far_off_does_not_crowd_a_range(spark, monkeypatch):
    monkeypatch.setattr(B, "RANGE_ROWS", 500)
    values = [*range(0, 30_000, 3), 2**62, -(2**61)]
    df = spark.createDataFrame([("a" if v % 3 else "b", v) for v in values], "g string, id long")
    ranged = df.select(B._ranges(df, "id").alias("r")).groupBy("r").count()
    assert ranged.agg(F.max("count")).first()[0] < 1200 and ranged.count() > 10
    got = {r["id"]: (r["position"], r["total"]) for r in B.position_in_group(df, "g", "id").collect()}
    for group in "ab":
        own = sorted(v for v in values if ("a" if v % 3 else "b") == group)
        assert [got[v] for v in own] == [(i + 1, len(own)) for i in range(len(own))]
    assert B.position_in_group(df.filter("false"), "g", "id").count() == 0


def test_transitions(spark):
    rows = [(1, "a", 0, "Pending"), (2, "a", 1, "Indexing"), (3, "a", 2, "Indexing"), (4, "a", 3, "Completed"), (5, "a", 4, "Indexing"), (6, "b", 0, "Failed")]
    df = spark.createDataFrame(rows, "id long, k string, us long, status string")
    got = {r["id"]: r["allowed"] for r in T.audit_transitions(df, "k", "us", "id", 2).collect()}
    assert got == {1: True, 2: True, 3: False, 4: True, 5: False, 6: False}


def test_requeue_lists_each_task_once(spark):
    rows = [(1, "Running", 2, "2024-01-02"), (2, "Pending", 3, "2024-01-02"), (3, "Pending", 3, "2024-01-01"), (4, "Completed", 4, "2024-01-01")]
    df = spark.createDataFrame(rows, "task_id int, status string, priority int, created_at string")
    got = [(r["task_id"], r["status"], r["interrupted"]) for r in T.requeue(df.unionByName(df)).collect()]
    assert got == [(3, "Pending", False), (2, "Pending", False), (1, "Pending", True)]
    assert [r["task_id"] for r in T.work_queue(df).collect()] == [3, 2]


def test_run_result(spark):
    df = spark.createDataFrame([(100, 50, 0), (0, 0, 0), (3, 2, 2)], "total long, ok long, failed long")
    got = [(r["success"], r["rate"], r["completion"], r["broken"]) for r in N.run_result(df).orderBy("total").collect()]
    assert got[0] == (True, 1.0, 0.0, False) and got[1][3] is True and got[2] == (True, 0.5, 50.0, False)


def test_migration(spark):
    doc = {"codebaseMappings": [{"id": "1", "friendlyName": "n", "codebasePath": "/p", "collectionName": "c", "indexingStatus": "Completed", "isMonitoring": True, "lastIndexed": "2024-01-02T00:00:00Z", "statistics": {"totalFiles": 3, "indexedSnippets": 9, "lastIndexingDuration": "12s"}}], "globalSettings": {"a": 1, "b": "x", "c": [1]}}
    raw = spark.createDataFrame([(json.dumps(doc),)], "d string").select(F.from_json("d", schemas.as_struct(schemas.LEGACY_CONFIG)).alias("x")).select("x.*")
    types = spark.createDataFrame([("/p", "python")], "codebase_path string, project_type string")
    row = R.parse(M.migrate_libraries(raw, "2024-06-01", types=types)).first()
    assert row["status"] == "Completed" and row["stats"]["lastIndexingDuration"] == 12.0 and row["stats"]["indexingHistory"][0]["duration"] == 12.0
    assert row["watch"]["filePatterns"] == ["*.cs"] and row["watch"]["isEnabled"] and row["meta"]["projectType"] == "python"
    assert M.migrate_libraries(raw, "2024-06-01", existing=types).count() == 0
    got = {r["key"]: (r["value_json"], r["type"]) for r in M.migrate_settings(raw).collect()}
    assert got == {"a": ("1", "number"), "b": ('"x"', "string"), "c": ("[1]", "array")}


def test_batches_of_sparse_order_values(spark):
    rows = [(g, (i * 2654435761) % (1 << 40) * (1 if g else -1)) for g in (0, 1) for i in range(500)]
    df = spark.createDataFrame(rows, "g int, o long")
    got = B.assign_batches(df, "g", "o", 100).collect()
    for g in (0, 1):
        mine = sorted((r["o"], r["batch"]) for r in got if r["g"] == g)
        assert [b for _, b in mine] == [i // 100 + 1 for i in range(500)]
    assert B.assign_batches(df.filter("false"), "g", "o", 100).count() == 0


def test_evidence_of_project_types(spark):
    files = spark.createDataFrame([("l", "a/x.csproj"), ("l", "a/b.cs"), ("l", "c.cs"), ("l", "setup.py")], "library string, rel_path string")
    row = Q.detect_project_type(files).first()
    assert row["project_type"] == "csharp" and row["evidence"] == ["csharp: *.csproj", "csharp: 2 files .cs", "python: setup.py", "python: 1 files .py"]


def test_legacy_documents_go_to_all_cores(spark):
    from snipdex.plans.configurations import _legacy_documents

    sf = "/root/testdata/sf0.001"
    rows = _legacy_documents(spark, sf)
    assert rows.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert rows.count() == spark.read.parquet(f"{sf}/customer.parquet").count()
