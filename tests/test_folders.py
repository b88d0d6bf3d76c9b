"""Folder digests and the diff that descends only where they differ."""

import datetime
import random

import pytest

from snipdex.operators import folders
from snipdex.operators import index as I

DDL = "library string, root string, path string, content_hash string, {} timestamp"
T0 = datetime.datetime(2024, 1, 1)


def table(spark, rows, at):
    return spark.createDataFrame([(lib, f"/repo/{lib}", f"/repo/{lib}/{p}", h, t) for lib, p, h, t in rows], DDL.format(at))


def both(spark, old, new):
    old, new = table(spark, old, "last_indexed"), table(spark, new, "modified")
    found = folders.tree_diff(folders.folder_tree(old, "last_indexed"), folders.folder_tree(new, "modified"))
    want = I.snapshot_diff(old, new).filter("change <> 'unchanged'").collect()
    got = sorted((r.library, f"/repo/{r.library}/{r.path}", r.change) for r in found.changes.collect())
    assert got == sorted((r.library, r.path, r.change) for r in want)
    return got, found.compared


def random_tree(seed, n):
    rng = random.Random(seed)
    return {(rng.choice("ab"), "/".join(rng.choice("xyz") for _ in range(rng.randint(0, 4))) + f"/f{i}.py"): f"{rng.random()}" for i in range(n)}


@pytest.mark.parametrize("seed", [1, 2])
def test_diff_equals_the_join_of_snapshots(spark, seed):
    rng = random.Random(seed)
    files = {(lib, p.lstrip("/")): h for (lib, p), h in random_tree(seed, 120).items()}
    old, new = [], []
    for (lib, p), h in files.items():
        kind = rng.choice(["same"] * 6 + ["gone", "new", "edit", "unknown"])
        if kind != "new":
            old.append((lib, p, None if kind == "unknown" and rng.random() < 0.5 else h, T0 + datetime.timedelta(days=rng.randint(0, 2))))
        if kind != "gone":
            new.append((lib, p, None if kind == "unknown" else h + "!" if kind == "edit" else h, T0 + datetime.timedelta(days=1)))
    got, _ = both(spark, old, new)
    assert {c for _, _, c in got} == {"added", "deleted", "modified"}


def test_equal_folders_are_left_out(spark):
    files = [("a", f"d{i}/e{j}/f{k}.py", f"{i}{j}{k}", T0) for i in range(10) for j in range(5) for k in range(8)]
    changed = [(lib, p, "other" if p == "d3/e2/f1.py" else h, t) for lib, p, h, t in files]
    got, compared = both(spark, files, changed)
    assert got == [("a", "/repo/a/d3/e2/f1.py", "modified")]
    # The root, its folders, the folders of one of them, the files of one of those.
    assert compared == [1, 10, 5, 8, 0]
    assert both(spark, files, files) == ([], [1, 0])


def test_odd_trees(spark):
    one = [("a", "x", "1", T0), ("a", "y/z", "2", T0), ("b", "only.py", "3", T0)]
    two = [("a", "x/inner", "1", T0), ("a", "y/z", "2", T0)]
    got, _ = both(spark, one, two)
    assert got == [("a", "/repo/a/x", "deleted"), ("a", "/repo/a/x/inner", "added"), ("b", "/repo/b/only.py", "deleted")]
    assert both(spark, [], two)[0] == [("a", "/repo/a/x/inner", "added"), ("a", "/repo/a/y/z", "added")]
    assert both(spark, [], [])[0] == []
    tree = folders.folder_tree(table(spark, one, "modified"), "modified")
    root = {r.library: r.entries for r in tree.level(0).collect()}
    assert root == {"a": 4, "b": 2}
