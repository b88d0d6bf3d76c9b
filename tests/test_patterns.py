"""Globs that cover others, patterns as a table, vectors by content, and counts taken while writing."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from snipdex.functions import paths as P
from snipdex.functions.globs import covers
from snipdex.operators import embed as M
from snipdex.operators import pattern_table as T
from snipdex.operators.runs import ObservedRun

GLOBS = ["**/*.py", "src/**", "*.ts", "*.tsx", "src/*.py", "**/bin/**", "bin/**", "src/**/*.py", "**", "*", "a?c", "abc", "**/a/*.py", "src/core/**", "s*/**", "?rc/**", "A?C", "*.t*"]


def test_covering_agrees_with_matches():
    rng = random.Random(1)
    paths = {"".join(rng.choices("abcsrpyt./inox", k=rng.randint(1, 7))).strip("/") for _ in range(20_000)} | {"src/a.py", "src/core/x.py", "bin/x", "a/bin/b", "src/b/c/d.py", "x.ts", "x.tsx", "abc", "axc", "src/core/a/b", "xrc/z", "a/x.py", "q/a/b.py", "src/a/b.py", "s/y", "sx/y/z", "src/x", "x/y.py", "A/bin/q/r"}
    paths.discard("")
    matched = {g: {p for p in paths if re.match(P.glob_regex([g]), p)} for g in GLOBS}
    for wide, narrow in itertools.product(GLOBS, GLOBS):
        assert covers(wide, narrow) == (matched[narrow] <= matched[wide]), (wide, narrow)


@pytest.mark.parametrize("pattern,key", [("**/*.py", "e:.py"), ("src/**", "d:src"), ("**/node_modules/**", "d:node_modules"), ("Makefile", "n:makefile"), ("*", "*"), ("a*b", "*"), ("x/*.tar.gz", "e:.gz"), ("**/*test*", "*"), ("lib/**/*x.c?", "d:lib")])
def test_keys_of_patterns(pattern, key):
    assert T.pattern_key(pattern) == key


def test_files_by_patterns_of_their_library(spark):
    rng = random.Random(2)
    names = ["a.py", "b.tar.gz", "Makefile", "x.C", "README", "t.tsx", "t.ts", ".env"]
    files = [(lib, "/".join([*rng.choices(["src", "Bin", "core", "node_modules"], k=rng.randint(0, 3)), rng.choice(names)])) for lib in "abcd" for _ in range(60)]
    files = sorted(set(files))
    own = {
        "a": (["*.py", "src/**"], ["bin", "**/core/*.py"]),
        "b": (["**"], ["*.ts", "**/*.tsx", " ", "src/core/**"]),
        "c": (["makefile", "**/README", ".env"], []),
    }
    patterns = [(lib, kind, p) for lib, both in own.items() for kind, some in zip(("include", "exclude"), both) for p in some]
    rows = spark.createDataFrame(files, "library string, rel_path string").withColumn("size", F.lit(1))
    got = T.filter_by_patterns(rows, spark.createDataFrame(patterns, "library string, kind string, pattern string"))
    assert got.columns == ["library", "rel_path", "size"]
    want = []
    for lib, (include, exclude) in own.items():
        kept = rows.filter(F.col("library") == lib).filter(P.glob_match(F.col("rel_path"), include, [e for e in exclude if e.strip()]))
        want += [(r.library, r.rel_path) for r in kept.collect()]
    assert sorted((r.library, r.rel_path) for r in got.collect()) == sorted(want) and want


def test_covered_includes(spark):
    rows = [("a", "include", "*.py"), ("a", "include", "src/*.js"), ("a", "exclude", "**/*.p*"), ("a", "exclude", "src"), ("b", "include", "*.py"), ("b", "exclude", "*.py"), ("b", "exclude", "")]
    got = T.covered_patterns(spark.createDataFrame(rows, "library string, kind string, pattern string"))
    assert sorted(tuple(r) for r in got.collect()) == [("a", "*.py", "**/*.p*"), ("a", "src/*.js", "src")] or sorted(tuple(r) for r in got.collect()) == [("a", "*.py", "**/*.p*")]


def test_each_text_goes_through_the_model_once(spark, tmp_path):
    log = tmp_path / "calls"
    log.mkdir()

    def model(texts):
        import uuid

        (log / uuid.uuid4().hex).write_text("\n".join(texts))
        if any("bad" in t for t in texts):
            raise RuntimeError("bad")
        return [[float(len(t)), 1.0] for t in texts]

    def calls():
        return sorted(line for f in log.iterdir() for line in f.read_text().split("\n"))

    first = spark.createDataFrame([(1, "x"), (2, "yy"), (3, "x"), (4, "  "), (5, "bad")], "n int, t string").repartition(3)
    again = spark.createDataFrame([(6, "x"), (7, "zzz"), (8, "zzz"), (9, "bad")], "n int, t string")
    cache = str(tmp_path / "cache")
    one = M.embed_once(first, "t", model, 2, cache, "m", batch=1, attempts=1)
    assert {r.n: (r.vector, r.embed_ok) for r in one.collect()} == {1: ([1, 1], True), 2: ([2, 1], True), 3: ([1, 1], True), 5: ([0, 0], False)}
    two = M.embed_once(again, "t", model, 2, cache, "m", batch=1, attempts=1)
    assert {r.n: (r.vector[0], r.embed_ok) for r in two.collect()} == {6: (1, True), 7: (3, True), 8: (3, True), 9: (0, False)}
    assert calls() == ["bad", "bad", "x", "yy", "zzz"]
    M.embed_once(again.filter("n = 6"), "t", model, 2, cache, "other model", batch=1)
    assert calls().count("x") == 2


def test_counts_come_from_the_pass_that_writes(spark, tmp_path):
    run = ObservedRun()
    files = run.files(spark.createDataFrame([("a", 3), ("b", 4)], "path string, size long"))
    points = run.points(files.selectExpr("explode(sequence(1, size)) n").withColumn("embed_ok", F.col("n") < 4))
    points.write.parquet(str(tmp_path / "points"))
    row = run.result(spark).first()
    assert (row.files, row.bytes, row.total, row.ok, row.failed, row.success, row.broken) == (2, 7, 7, 6, 1, False, False)
