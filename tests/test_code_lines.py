"""Blocks of indented code as windows over lines, against the plain walk over one text."""

import random

import pytest

from snipdex.operators import code_lines
from snipdex.operators.masking import python_mask
from tests.plain_code import python_blocks

LINES = [
    "class A(Base):", "def f(a,", "    b):", "    def g(self):", "        return (", "        1)", "", "   ", "x = [", "]", "# def no():", "    # y",
    'T = """', 'class in_text:', '"""', "async def h(): pass", "  async   def k(x):", "s = 'a \\", "b'", "total = 1 + \\", "    2", "if x:", ")", "  }", "defx = 1", "class", "def 1x():",
    "\tdef tabbed():", "    class Inner: pass", "café = ñ", "def naïve():", "print('}{ (') # (", "\r", "def r():\r",
]


def rows(df):
    names = ("path", "language", "namespace", "class_name", "member_name", "kind", "code", "start_line", "end_line")
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def plain(files):
    return sorted((path, "python", *s) for path, text in files if text and text.strip() for s in python_blocks(path, text))


@pytest.mark.parametrize("range_lines", [1, 3, 4096])
def test_lines_give_the_same_blocks(spark, range_lines):
    rng = random.Random(range_lines)
    files = [(f"/r/f{i}.py", "\n".join(rng.choices(LINES, k=rng.randint(1, 40)))) for i in range(250)]
    files += [("/r/none.py", None), ("/r/blank.py", " \n\t"), ("/r/empty.py", ""), ("/r/x.y.py", "x = 1\n"), ("/r/one.py", "def f(): pass")]
    df = spark.createDataFrame(files, "path string, text string").repartition(5)
    assert rows(code_lines.python_snippets(df, range_lines=range_lines)) == plain(files)


def test_one_long_file_goes_to_many_tasks(spark):
    part = "class C{0}:\n    def m(self):\n        s = ')}} ({0}'\n        return s\n\n"
    text = "".join(part.format(i) for i in range(6000))
    df = spark.createDataFrame([("/r/long.py", text)], "path string, text string")
    found = code_lines.python_snippets(df, range_lines=256)
    assert found.count() == 12_000
    assert rows(found.filter("start_line > 29990")) == [r for r in plain([("/r/long.py", text)]) if r[-2] > 29_990]
    lines = code_lines.logical_lines(code_lines.file_lines(code_lines.masked_files(df, python_mask(df.text), "path", "text", ()), 256))
    assert lines.select("range").distinct().count() == 30_001 // 256 + 1


def test_kept_columns_and_repeated_files(spark):
    files = [("a", "/r/f.py", "def f(): pass"), ("b", "/r/f.py", "def f(): pass"), ("b", "/r/f.py", "x = 1")]
    df = spark.createDataFrame(files, "collection string, path string, text string")
    found = code_lines.python_snippets(df, keep=("collection",))
    assert sorted((r.collection, r.member_name) for r in found.collect()) == [("a", "f (Function)"), ("b", "Entire File"), ("b", "f (Function)")]
    assert code_lines.python_snippets(df.filter("false")).count() == 0
