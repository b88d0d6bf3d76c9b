import pytest
from pyspark.sql import functions as F

from snipdex.operators import audit as A
from snipdex.operators import presets as P

DDL = (
    "config_id int, file_patterns array<string>, exclude_patterns array<string>, include_subdirectories boolean, "
    "is_enabled boolean, max_file_size long, custom_filters array<struct<name:string,pattern:string,enabled:boolean>>"
)
MB = 1 << 20


def configs(spark, *rows):
    return spark.createDataFrame(list(rows), DDL)


@pytest.fixture(scope="module")
def cases(spark):
    return configs(
        spark,
        (1, ["*.js", "*.ts"], ["out", "obj"], True, True, 7 * MB, [("skip-drafts", "*draft*", True)]),
        (2, [], ["logs/../../up"], True, True, -50, [(" ", "", True)]),
        (3, ["*.py", "*.zzz", "*.ts", "*.py"], ["dist", "../up", "obj"], True, True, 150 * MB, [("ok", "*a*", True), (" ", "*b*", True)]),
        (4, ["*.cs", "a b", None], ["old.CS", "x" * 501], True, True, 101 * MB, [("bad!", "a;b", True)]),
    )


def test_audit(cases):
    got = {}
    for r in A.audit_watch(cases).collect():
        got.setdefault(r["config_id"], set()).add(r["rule"])
    assert 1 not in got
    assert got[2] == {"no file pattern", "unsafe exclude pattern", "size not positive", "blank filter name"}
    assert got[3] == {"invalid file pattern", "unsafe exclude pattern", "size above limit", "blank filter name"}
    assert got[4] == {"invalid file pattern", "blank file pattern", "long exclude pattern", "size above limit", "invalid filter name", "invalid filter pattern", "covered by exclude"}


def test_clean(cases):
    row = A.clean_config(cases.filter("config_id = 3")).first()
    assert row["file_patterns"] == ["*.py", "*.ts"] and row["exclude_patterns"] == ["dist", "obj"]
    assert row["max_file_size"] == 100 * MB and len(row["removed"]) == 3 and row["changed"]
    same = A.clean_config(cases.filter("config_id = 1")).first()
    assert not same["changed"] and same["removed"] == []


def test_suggestions(spark, cases):
    rows = cases.filter("config_id < 4").withColumn("project_type", F.lit("Python"))
    got = {(r["config_id"], r["rule"]): r["value"] for r in A.suggestions(rows).collect()}
    assert got[(2, "warning: add file patterns")] == "*.py"
    assert got[(1, "info: add excludes")] == ".git,node_modules,__pycache__,.venv,venv"
    assert (3, "warning: lower the size limit") in got


def test_diff(spark, cases):
    one = cases.filter("config_id = 1")
    assert A.diff_configs(one, one).count() == 0
    other = one.withColumn("file_patterns", F.array(F.lit("*.ts"), F.lit("*.md"))).withColumn("is_enabled", F.lit(False))
    got = {r["property"]: (r["added"], r["removed"], r["old"], r["new"]) for r in A.diff_configs(one, other).collect()}
    assert got == {"FilePatterns": (["*.md"], ["*.js"], "*.js,*.ts", "*.ts,*.md"), "IsEnabled": ([], [], "true", "false")}


def test_apply(spark, cases):
    wanted = cases.filter("config_id IN (1, 2)").withColumn("is_enabled", F.lit(False))
    applied, backup, findings = A.apply_configs(cases, wanted)
    assert {r["config_id"]: r["is_enabled"] for r in applied.collect()} == {1: False, 2: True, 3: True, 4: True}
    assert [(r["config_id"], r["is_enabled"]) for r in backup.collect()] == [(1, True)]
    assert {r["config_id"] for r in findings.collect()} == {2}
    checked, _, _ = A.apply_configs(cases, wanted, validate_only=True)
    assert all(r["is_enabled"] for r in checked.collect())


def test_built_in_presets(spark):
    table = P.built_in_presets(spark)
    assert table.count() >= 8
    rows = table.withColumns({"config_id": F.hash("preset_id"), "custom_filters": F.array().cast("array<struct<name:string,pattern:string,enabled:boolean>>")})
    # Some built-in presets exclude derived files of a type they include.
    assert {r["rule"] for r in A.audit_watch(rows).collect()} <= {"covered by exclude"}
    assert A.audit_presets(rows).count() == 0


def test_merge_and_recommend(spark):
    table = P.built_in_presets(spark).filter("preset_id IN ('typescript', 'javascript')")
    members = table.withColumns({"g": F.lit(1), "pos": F.when(F.col("preset_id") == "typescript", 0).otherwise(1)})
    members = members.withColumn("is_enabled", F.col("pos") == 0)
    row = P.merge_presets(members, "g", "pos").first()
    assert row["file_patterns"] == ["*.ts", "*.tsx", "*.js", "*.jsx", "*.mjs", "*.vue"]
    assert row["exclude_patterns"] == ["node_modules", "dist", "build", ".git", "coverage", "*.d.ts"] and row["is_enabled"] is False
    none = members.withColumns({"file_patterns": F.array().cast("array<string>"), "exclude_patterns": F.array().cast("array<string>")})
    assert P.merge_presets(none, "g", "pos").first()["file_patterns"] == []
    asked = spark.createDataFrame([("Python",), ("none",)], "project_type string")
    got = P.recommend(asked, P.built_in_presets(spark)).collect()
    assert [(r["asked"], r["preset_id"]) for r in got] == [("python", "python")]
    found = P.lookup(spark.createDataFrame([("GO",), ("nope",)], "preset_id string"), P.built_in_presets(spark))
    assert [r["preset_id"] for r in found.collect()] == ["go"]


def test_import_of_documents(spark):
    from snipdex.operators import config_io as C
    from snipdex.operators import registry as R

    ddl = "id int, name string, watch_config string, statistics string, metadata string, updated_at timestamp"
    meta = '{"ProjectType":"python","Team":"t","CustomSettings":{"a":"1","b":"2"}}'
    rows = [(i, f"n{i}", '{"FilePatterns":["*.py"]}', "{}", meta, None) for i in (1, 2, 3)]
    libraries = spark.createDataFrame(rows, ddl)
    good = '{"watchConfiguration":{"filePatterns":["*.md"]},"metadata":{"team":"","framework":"x","tags":["n"],"customSettings":{"b":"3"}}}'
    docs = spark.createDataFrame([(1, good), (2, '{"watchConfiguration":{"filePatterns":[]},"metadata":{}}'), (3, '{"metadata":{}}')], "id int, document string")
    applied, backup, refused = C.apply_documents(libraries, C.read_documents(docs), "2025-01-01")
    got = {r["id"]: r for r in R.parse(applied).collect()}
    assert got[1]["watch"]["filePatterns"] == ["*.md"] and got[1]["meta"]["team"] == "t" and got[1]["meta"]["framework"] == "x"
    assert got[1]["meta"]["customSettings"] == {"a": "1", "b": "3"} and got[1]["meta"]["tags"] == ["n"]
    assert got[2]["watch"]["filePatterns"] == ["*.py"] and [r["id"] for r in backup.collect()] == [1]
    assert {(r["id"], r["rule"]) for r in refused.collect()} == {(2, "no file pattern"), (3, "missing part")}
    same, _, _ = C.apply_documents(libraries, C.read_documents(docs), "2025-01-01", validate_only=True)
    assert {r["watch_config"] for r in same.collect()} == {'{"FilePatterns":["*.py"]}'}
