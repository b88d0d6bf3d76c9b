import json

import pytest
from pyspark.sql import functions as F

from snipdex.operators import registry as R
from snipdex.sources import change_records, export, registry_tables
from pyspark.sql.datasource import EqualTo, IsNotNull, LessThan

from snipdex.sources.files import list_files, scan_files, scan_patterns, unread_files
from snipdex.sources.tree import TreeReader


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree") / "My Lib"
    files = {
        "a.py": b"\xef\xbb\xbfdef a():\n  pass", "src/B.PY": b"caf\xc3\xa9", "src/bad.py": b"ok \xff end", "bin/x.py": b"x",
        "binary/y.py": b"y", "src/c.txt": b"c", "src/big.py": b"z" * 500,
    }
    for name, body in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(body)
    return str(root)


def test_scan(spark, tree):
    rows = {r["rel_path"]: r for r in scan_files(spark, tree, ["*.py"], ["bin"], max_size=100).collect()}
    assert set(rows) == {"a.py", "src/B.PY", "src/bad.py", "binary/y.py"}
    assert rows["a.py"]["text"] == "def a():\n  pass" and rows["src/B.PY"]["text"] == "café" and rows["src/bad.py"]["text"] == "ok � end"
    assert rows["a.py"]["path"] == tree + "/a.py" and rows["a.py"]["library"] == "My Lib" and len(rows["a.py"]["content_hash"]) == 64


def test_scan_flat_and_by_pattern(spark, tree):
    assert [r["rel_path"] for r in scan_files(spark, tree, ["*.py"], recursive=False).collect()] == ["a.py"]
    assert {r["rel_path"] for r in scan_files(spark, tree, ["src/**"]).collect()} == {"src/B.PY", "src/bad.py", "src/c.txt", "src/big.py"}
    assert scan_patterns(spark, tree, ["*.py", ".py", "src/*"]).count() == 7


def test_filters_reach_the_reader(spark, tree):
    plan = list_files(spark, tree, ["bin"]).filter("size <= 100 AND rel_path LIKE 'src/%' AND upper(name) <> 'X'")._jdf.queryExecution().executedPlan().toString()
    assert "upper(name" in plan and "size#" not in plan.split("Filter")[1].split("\n")[0]
    listed = list_files(spark, tree, ["bin"]).filter("size <= 100 AND rel_path LIKE 'src/%'")
    assert {r["rel_path"] for r in listed.collect()} == {"src/B.PY", "src/bad.py", "src/c.txt"}
    reader = TreeReader({"path": tree, "exclude": '["bin"]'})
    left = list(reader.pushFilters([LessThan(("size",), 10), IsNotNull(("size",)), EqualTo(("content",), b"x")]))
    assert [type(f) for f in left] == [EqualTo] and len(reader.pushed) == 2
    assert {r["rel_path"] for r in scan_files(spark, "file://" + tree, ["*.py"], ["bin"], max_size=100).collect()} == {"a.py", "src/B.PY", "src/bad.py", "binary/y.py"}


@pytest.fixture
def opened(monkeypatch):
    """Folders that are listed and files that are opened."""
    from pyarrow import fs

    seen = []

    class Watched(fs.LocalFileSystem):
        pass

    real = TreeReader._open

    class Spy:
        def __init__(self, system):
            self.system = system

        def get_file_info(self, what):
            seen.append(what.base_dir if isinstance(what, fs.FileSelector) else what)
            return self.system.get_file_info(what)

        def open_input_stream(self, path):
            seen.append(path)
            if path.endswith("locked.py"):
                raise PermissionError("locked")
            return self.system.open_input_stream(path)

    monkeypatch.setattr(TreeReader, "_open", lambda self: (Spy(real(self)[0]), real(self)[1]))
    return seen


def read_tree(**options):
    reader = TreeReader(options)
    return {row["rel_path"]: row for part in reader.partitions() for batch in reader.read(part) for row in batch.to_pylist()}


def test_excluded_folders_are_not_opened(tmp_path, opened, monkeypatch):
    for name in ("a.py", "node_modules/x/locked.py", "node_modules/y.py", "src/.git/z.py", "src/b.py", "src/locked.py", "src/big.py", "src/deep/er/c.py"):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("x" * (2000 if "big" in name else 3))
    monkeypatch.setattr("snipdex.sources.tree.MAX_CONTENT", 1000)
    rows = read_tree(path=str(tmp_path), include='["*.py"]', exclude='["node_modules", ".git"]')
    assert set(rows) == {"a.py", "src/b.py", "src/locked.py", "src/big.py", "src/deep/er/c.py"}
    assert rows["src/locked.py"]["error"] == "PermissionError: locked" and rows["src/locked.py"]["content"] is None
    assert rows["src/big.py"]["error"].startswith("2000 bytes") and rows["src/big.py"]["content"] is None
    assert rows["src/deep/er/c.py"]["content"] == b"xxx"
    assert not any("node_modules" in str(p) or ".git" in str(p) for p in opened)
    opened.clear()
    assert len(read_tree(path=str(tmp_path), include='["*.py"]', content="false")) == 8
    assert not any(str(p).endswith(".py") and not isinstance(p, list) for p in opened if isinstance(p, str) and "/" in p and p.endswith("b.py"))


def test_many_folders_become_parts(spark, tmp_path, monkeypatch):
    for i in range(30):
        for j in range(3):
            folder = tmp_path / f"d{i}" / f"e{j}"
            folder.mkdir(parents=True)
            (folder / "f.txt").write_text(f"{i} {j}")
        (tmp_path / f"top{i}.txt").write_text("top")
    monkeypatch.setattr("snipdex.sources.tree.MIN_PARTITIONS", 20)
    reader = TreeReader({"path": str(tmp_path)})
    parts = reader.partitions()
    assert len(parts) >= 20 and sum(len(p.folders) for p in parts) >= 20
    assert len(read_tree(path=str(tmp_path))) == 120
    assert scan_files(spark, str(tmp_path), ["*.txt"]).count() == 120
    flat = scan_files(spark, str(tmp_path), ["*.txt"], recursive=False)
    assert flat.count() == 30 and unread_files(spark, str(tmp_path), ["*.txt"]).count() == 0
    (tmp_path / "empty").mkdir()
    assert scan_files(spark, str(tmp_path / "empty"), ["*.txt"]).count() == 0


def test_change_records(spark, tmp_path):
    folder = str(tmp_path / "changes")
    ddl = "event_id string, library string, path string, change_type string, event_time string, status string, retry_count int, last_retry_at timestamp, error_message string"
    rows = [("e1", "l", "/p", "Created", "2024-01-02", "Pending", 0, None, None), ("e2", "l", "/q", "Deleted", "2024-01-01", "Pending", 0, None, None)]
    df = spark.createDataFrame(rows, ddl).withColumn("event_time", F.col("event_time").cast("timestamp"))
    change_records.append_changes(df, folder, "2024-01-03")
    update = df.filter("event_id = 'e1'").withColumns({"status": F.lit("Failed"), "retry_count": F.lit(1)})
    change_records.append_changes(update, folder, "2024-01-04")
    (tmp_path / "changes" / "broken.json").write_text("{not json")
    got = change_records.read_changes(spark, folder).collect()
    assert [(r["event_id"], r["status"], r["retry_count"]) for r in got] == [("e2", "Pending", 0), ("e1", "Failed", 1)]
    assert [r["event_id"] for r in change_records.read_changes(spark, folder, "Failed").collect()] == ["e1"]
    stream = change_records.stream_changes(spark, folder)
    out = str(tmp_path / "out")
    stream.writeStream.format("parquet").option("checkpointLocation", out + "-state").trigger(availableNow=True).start(out).awaitTermination()
    assert spark.read.parquet(out).count() == 3


def test_registry_tables(spark, tmp_path):
    base = str(tmp_path)
    df = spark.createDataFrame([(1, "/a", "c1"), (2, "/b", "c2")], "id int, codebase_path string, collection_name string")
    registry_tables.write_table(df, base, "libraries")
    back = registry_tables.read_table(spark, base, "libraries")
    assert back.count() == 2 and "watch_config" in back.columns
    with pytest.raises(ValueError, match="not unique"):
        registry_tables.write_table(df.withColumn("codebase_path", F.lit("/a")), base, "libraries")
    with pytest.raises(ValueError):  # what is stored counts too
        registry_tables.write_table(df, base, "libraries", mode="append")
    assert registry_tables.read_table(spark, base, "libraries").count() == df.count()


def test_legacy_config_any_case(spark, tmp_path):
    doc = {"CodebaseMappings": [{"Id": "1", "friendlyname": 'say "id": x', "Statistics": {"TotalFiles": 2}}], "globalSettings": {"k": {"x": 1}}}
    (tmp_path / "c.json").write_text(json.dumps(doc, indent=2))
    row = registry_tables.read_legacy_config(spark, str(tmp_path / "c.json")).selectExpr("codebaseMappings[0].statistics.totalFiles n", "codebaseMappings[0].friendlyName f", "to_json(globalSettings['k']) k").first()
    assert (row["n"], row["f"], row["k"]) == (2, 'say "id": x', '{"x":1}')


def test_export(spark, tmp_path):
    ddl = "id int, name string, watch_config string, statistics string, metadata string"
    rows = [(1, "n", '{"FilePatterns":["*.py"]}', '{"TotalFiles":3}', '{"ProjectType":"python"}')]
    parsed = R.parse(spark.createDataFrame(rows, ddl))
    export.write_export(parsed, str(tmp_path / "e"), "2024-01-01", include_statistics=True)
    doc = json.loads(spark.read.text(str(tmp_path / "e")).first()[0])
    assert doc["watchConfiguration"]["filePatterns"] == ["*.py"] and doc["statistics"]["totalFiles"] == 3 and doc["projectType"] == "python"


def test_damaged_records_are_reported(spark, tmp_path):
    folder = tmp_path / "records"
    folder.mkdir()
    good = '{"change":{"id":"e1","filePath":"/a"},"savedAt":"2024-01-01T00:00:00Z","version":"1.0"}'
    (folder / "a.json").write_text(good + "\n{broken\n" + '{"change":{"filePath":"/b"}}\n')
    assert [r["event_id"] for r in change_records.read_changes(spark, str(folder)).collect()] == ["e1"]
    rejected = sorted(r["document"] for r in change_records.rejected_changes(spark, str(folder)).collect())
    assert len(rejected) == 2 and rejected[1] == "{broken" and "/b" in rejected[0]
