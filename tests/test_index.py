import pytest
from pyspark.sql import functions as F

from snipdex.operators import embed as M
from snipdex.operators import index as I
from snipdex.session import scratch_path
from snipdex.sources.index_store import IndexStore


def build(files):
    return I.build_index(files, M.hashed_tokens(8), 8)


def tree(spark, contents, library="lib"):
    rows = [(library, f"/{library}", f"/{library}/{name}", text, len(text)) for name, text in contents.items()]
    df = spark.createDataFrame(rows, "library string, root string, path string, text string, size long")
    return df.withColumn("modified", F.lit("2024-01-02").cast("timestamp"))


def summary(points):
    return sorted((r["file_path"], r["member_name"], r["start_line"], r["code"], r["point_id"]) for r in points.collect())


FIRST = {"a.py": "def a():\n    pass", "b.py": "def b():\n    pass\ndef c():\n    pass", "gone.py": "def g():\n    pass"}
SECOND = {"a.py": "def a():\n    pass", "b.py": "def b():\n    return 2", "new.js": "function n() {\n}"}


def test_ids_do_not_depend_on_the_run(spark):
    files = tree(spark, FIRST)
    assert summary(build(files)) == summary(build(files.repartition(3)))
    assert len({r["point_id"] for r in build(files).collect()}) == 4


def test_payload_has_no_nulls(spark):
    row = build(tree(spark, FIRST)).first()
    assert row["namespace"] == "" and row["class_name"] == "a" and len(row["vector"]) == 8


def test_incremental_equals_rebuild(spark):
    before, after = tree(spark, FIRST), tree(spark, SECOND)
    lost = tree(spark, {"x.py": "def x():\n    pass"}, library="old")
    points = build(before.unionByName(lost))
    old = I.file_snapshot(before.unionByName(lost)).withColumnRenamed("modified", "last_indexed")
    rebuilt = []

    def counting(files):
        rebuilt.extend(sorted(r["path"] for r in files.select("path").collect()))
        return build(files)

    got = I.incremental_rebuild(points, old, after, counting)
    assert summary(got) == summary(build(after))
    assert rebuilt == ["/lib/b.py", "/lib/new.js"]


def test_snapshot_diff(spark):
    t1, t2 = "2024-01-01", "2024-02-01"

    def table(rows, name):
        df = spark.createDataFrame(rows, "path string, content_hash string, at string")
        return df.select(F.lit("l").alias("library"), F.lit("/l").alias("root"), "path", "content_hash", F.col("at").cast("timestamp").alias(name))

    old = table([("same", "h", t1), ("hash", "h", t2), ("time", None, t1), ("calm", None, t2), ("gone", "h", t1)], "last_indexed")
    new = table([("same", "h", t2), ("hash", "i", t1), ("time", "h", t2), ("calm", "h", t1), ("fresh", "h", t1)], "modified")
    got = {r["path"]: r["change"] for r in I.snapshot_diff(old, new).collect()}
    assert got == {"same": "unchanged", "hash": "modified", "time": "modified", "calm": "unchanged", "gone": "deleted", "fresh": "added"}


def test_upsert_and_delete(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "point_id string, v int, t string")
    got = {tuple(r) for r in I.upsert_latest(df, ["point_id"], ["v"]).collect()}
    assert got == {("a", 2, "y"), ("b", 1, "z")}
    assert I.delete_points(df, df.filter("point_id = 'a'")).count() == 1


@pytest.fixture
def store(spark):
    made = IndexStore(spark, scratch_path(spark, "store"), buckets=4)
    made.build(build(tree(spark, FIRST)), scratch_path(spark, "c").rsplit("/", 1)[-1])
    return made


def changed(spark, *names, library="lib"):
    df = spark.createDataFrame([(f"/{library}/{n}",) for n in names], "file_path string")
    from snipdex.functions.paths import collection_name

    return df.withColumn("collection", collection_name(F.lit(f"/{library}")))


def test_store_round_trip_and_rebuild(spark, store):
    assert summary(store.read()) == summary(build(tree(spark, FIRST)))
    store.build(build(tree(spark, SECOND)), scratch_path(spark, "c").rsplit("/", 1)[-1])
    assert summary(store.read()) == summary(build(tree(spark, SECOND)))
    assert [r["points"] for r in store.info().collect()] == [3]


def test_replace_is_idempotent_and_can_empty_a_folder(spark, store):
    fresh = build(tree(spark, {"b.py": SECOND["b.py"]}))
    for _ in range(2):
        store.replace_files(changed(spark, "b.py", "gone.py", "never.py"), fresh, "batch-1")
        want = summary(build(tree(spark, {"a.py": FIRST["a.py"], "b.py": SECOND["b.py"]})))
        assert summary(store.read()) == want
    store.replace_files(changed(spark, "a.py", "b.py"), fresh.limit(0), "batch-2")
    assert store.read().count() == 0


def test_a_change_cut_short_is_applied_from_its_copy(spark, store, monkeypatch):
    fresh = build(tree(spark, {"b.py": SECOND["b.py"]}))
    monkeypatch.setattr(IndexStore, "_overwrite", lambda self, rows: (_ for _ in ()).throw(IOError("lost")))
    with pytest.raises(IOError):
        store.replace_files(changed(spark, "b.py"), fresh, "batch-9")
    monkeypatch.undo()
    store.replace_files(changed(spark, "b.py"), fresh.limit(0), "batch-9")
    assert ("/lib/b.py", "b (Function)") in {(r["file_path"], r["member_name"]) for r in store.read().collect()}


def test_other_collections_are_not_touched(spark, store):
    store.build(build(tree(spark, {"z.py": "def z():\n    pass"}, library="two")), scratch_path(spark, "c").rsplit("/", 1)[-1])
    assert store.read().count() == 5
    name = store.read().filter("file_path LIKE '/two%'").first()["collection"]
    assert store.read(name).count() == 1
    names = spark.createDataFrame([(name,), ("code_index_none",)], "collection string")
    assert [r["file_path"] for r in store.read_collections(names).collect()] == ["/two/z.py"]
    files = store.read_collections(names).inputFiles()
    assert files and all(name in f for f in files)
    store.drop_collection(name)
    assert store.read().count() == 4


def test_present_hits(spark):
    points = build(tree(spark, FIRST)).withColumn("vec_id", F.col("point_id")).withColumn("root", F.lit("/lib"))
    hits = points.filter("member_name = 'c (Function)'").select(F.lit(1).alias("query_id"), "vec_id", F.lit(0.123456).alias("score"), F.lit(1).alias("rank"))
    row = I.present_hits(hits, points).first()
    assert (row["score"], row["file"], row["start_line"], row["details"]) == ("0.1235", "b.py", 3, "b | c (Function)")
    inside = I.within_path(points, F.lit("/lib/b.py"))
    assert inside.count() == 2


def test_wide_changes_fall_back_to_a_join(spark, store, monkeypatch):
    from snipdex.sources import index_store

    monkeypatch.setattr(index_store, "MAX_NAMED_FOLDERS", 0)
    store.replace_files(changed(spark, "gone.py"), build(tree(spark, FIRST)).limit(0), "batch-wide")
    assert {r["file_path"] for r in store.read().collect()} == {"/lib/a.py", "/lib/b.py"}


def test_paths_with_capitals_are_replaced(spark):
    before, after = tree(spark, {"Src/Main.py": "def a():\n    pass", "Src/Gone.py": "def g():\n    pass"}), tree(spark, {"Src/Main.py": "def b():\n    pass"})
    points = build(before)
    old = I.file_snapshot(before).withColumnRenamed("modified", "last_indexed")
    got = I.incremental_rebuild(points, old, after, build)
    assert [(r["file_path"], r["member_name"]) for r in got.collect()] == [("/lib/Src/Main.py", "b (Function)")]
    store = IndexStore(spark, scratch_path(spark, "capitals"), buckets=3)
    store.build(points, "one")
    changed = spark.createDataFrame([(points.first()["collection"], "/LIB/src/main.py")], "collection string, file_path string")
    store.replace_files(changed, build(after), "two")
    assert sorted(r["member_name"] for r in store.read().collect()) == ["b (Function)", "g (Function)"]
    store.replace_files(changed, build(tree(spark, {"Src/Main.py": "def c():\n    pass"})), "two")  # the id is free again
    assert sorted(r["member_name"] for r in store.read().collect()) == ["c (Function)", "g (Function)"]
