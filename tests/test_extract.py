import random

import pytest
from pyspark.sql import functions as F

from snipdex.operators import extract as E
from snipdex.operators.code_lines import rest_of_lines
from snipdex.session import stored

CSHARP = '''using System;
namespace A.B
{
    // a } brace
    [Attr("x;{")]
    public class Foo<T> : Base where T : new()
    {
        private int _a = 1, _b;
        private readonly Dictionary<string, int> map = new() { ["a;"] = 1 };
        public event EventHandler Full { add { } remove { } }
        public string Name { get; set; } = "x";
        public int Twice => _a * 2;
        public Foo(int a) : base(a) { _a = a; }
        [Test] public async Task<int> Run<TX>(List<TX> xs = null) where TX : class
        {
            if (xs == null) { return "}"; }
            return 1;
        }
        void IFoo.Bar() { }
        class Nested { void Hidden() { } }
        public static Foo operator +(Foo a, Foo b) => a;
        private Func<int, int> f = x => { return x; };
    }
    public enum Color { Red, Green }
    public record Point(int X, int Y);
}
'''


def cut(spark, path, text, rest=False):
    """Snippets of one file by their place: namespace, class name, member name, kind, code, first line, last line."""
    found = E.extract_snippets(spark.createDataFrame([(path, text)], "path string, text string"), rest=rest)
    return sorted((tuple(r)[2:] for r in found.collect()), key=lambda s: (s[5], -s[6], text.find(s[2].split(" ")[0])))


def names(found):
    return [(s[2], s[5], s[6]) for s in found]


def test_python_blocks(spark):
    code = "import x\n\nclass A(Base):\n    x = 1\n\n    def m(self):\n        return 1\n\n    async def n(self):\n        def inner():\n            pass\n\n        return 2\ny = 2\n"
    assert names(cut(spark, "/p/a.py", code)) == [
        ("A (Class)", 3, 5), ("m (Function)", 6, 8), ("n (Function)", 9, 9), ("inner (Function)", 10, 12)
    ]
    owners = [s[1] for s in cut(spark, "/p/a.py", code)]
    assert owners == ["A", "a", "a", "a"]


def test_no_header_gives_the_whole_file(spark):
    assert list(cut(spark, "/p/a.py", "x = 1\ny = 2")) == [("", "a", "Entire File", "file", "x = 1\ny = 2", 1, 2)]
    assert names(cut(spark, "/p/a.js", "foo();")) == [("整个文件", 1, 1)]
    assert names(cut(spark, "/p/a.ts", "foo();")) == [("Entire File", 1, 1)]
    assert list(cut(spark, "/p/a.cs", "int x;")) == []


def test_javascript_blocks(spark):
    code = "export default function f(a) {\n  if (a) { return {}; }\n}\nconst g = async (x) => {\n  return 1;\n};\nclass Q extends R.S {\n}\nfunction classify() {\n}\nfunction broken() {\n  {\n"
    assert names(cut(spark, "/p/a.js", code)) == [
        ("f (Function)", 1, 3), ("g (Arrow Function)", 4, 6), ("Q (Class)", 7, 8), ("classify (Function)", 9, 10)
    ]


def test_typescript_blocks(spark):
    code = "export interface I extends J {\n  a: string;\n}\nexport type T = string | number;\nenum E { A }\ntype O = {\n  x: number\n}\nexport const h: Fn = (a) => {\n}\n"
    assert names(cut(spark, "/p/a.ts", code)) == [
        ("I (Interface)", 1, 3), ("T (Type Alias)", 4, 4), ("E (Enum)", 5, 5), ("O (Type Alias)", 6, 8), ("h (Arrow Function)", 9, 10)
    ]


def test_razor_blocks_are_balanced(spark):
    code = "<p>@{ var x = new { a = 1 }; }</p>\n@code {\n int y;\n}\n@functions { }"
    found = list(cut(spark, "/p/a.cshtml", code))
    assert names(found) == [("Block 1 (Razor Block)", 1, 1), ("Block 2 (Code Block)", 2, 4)]
    assert found[0][4] == "var x = new { a = 1 };"


def test_csharp_members(spark):
    found = [(s[2], s[3]) for s in cut(spark, "/p/Foo.cs", CSHARP)]
    assert found == [
        ("Foo (类)", "class"), ("_a (字段)", "field"), ("_b (字段)", "field"), ("map (字段)", "field"), ("Full (事件)", "event"),
        ("Name (属性)", "property"), ("Twice (属性)", "property"), ("Foo (构造函数)", "constructor"), ("Run (方法)", "method"),
        ("Bar (方法)", "method"), ("f (字段)", "field"), ("Color (枚举)", "enum"), ("Point (记录)", "record"),
    ]
    assert {s[0] for s in cut(spark, "/p/Foo.cs", CSHARP)} == {"A.B"}
    run = next(s for s in cut(spark, "/p/Foo.cs", CSHARP) if s[2].startswith("Run"))
    assert (run[5], run[6]) == (14, 18)
    assert names(cut(spark, "/p/a.cs", "class A { }" + " " * 1_000_000)) == [("A (类)", 1, 1)]
    long = "class A {\n" + "  // line\n" * 1000 + "}"
    assert next(iter(cut(spark, "/p/a.cs", long)))[4] == long


def test_dispatch_and_registration(spark):
    rows = [("/r/a.py", "def f():\n  pass"), ("/r/b.go", "func main() {}"), ("/r/c.cs", CSHARP), ("/r/d.js", "  "), ("/r/e.py", None)]
    files = spark.createDataFrame(rows, "path string, text string")
    found = E.extract_snippets(files)
    assert {r["path"] for r in found.collect()} == {"/r/a.py", "/r/c.cs"}
    assert {r["member_name"] for r in E.methods_only(found).collect()} == {"Run (方法)", "Bar (方法)"}

    def lines(path, text):
        for n, line in enumerate(text.split("\n"), 1):
            if line == "boom":
                raise ValueError("boom")
            yield "", path, f"line {n}", "line", line, n, n

    E.register_extractor("python", lines)
    try:
        more = files.union(spark.createDataFrame([("/r/bad.py", "x\nboom")], files.schema))
        got = E.extract_snippets(more.filter(F.col("path").endswith(".py")))
        assert {(r["path"], r["member_name"]) for r in got.collect()} == {("/r/a.py", "line 1"), ("/r/a.py", "line 2"), ("/r/bad.py", "Entire File")}
        report = {r["path"]: (r["snippets"], r["error"]) for r in E.parse_report(more.filter("text IS NOT NULL")).collect()}
        assert report["/r/bad.py"] == (0, "ValueError: boom") and report["/r/a.py"] == (2, None)
    finally:
        E.register_extractor("python", None)


def test_views_and_table_functions_for_sql(spark):
    rows = [("/r/a.py", "def f():\n  pass\ndef g():\n  pass"), ("/r/b.cob", "x"), ("/r/c.cs", " "), ("/r/d.js", "function h() {}")]
    spark.createDataFrame(rows, "path string, text string").createOrReplaceTempView("sql_files")
    E.register_sql(spark, "sql_files")
    got = spark.sql("SELECT path, member_name, start_line FROM snippets").collect()
    assert sorted(tuple(r) for r in got) == [("/r/a.py", "f (Function)", 1), ("/r/a.py", "g (Function)", 3), ("/r/d.js", "h (Function)", 1)]

    def lines(path, text):
        for n, line in enumerate(text.split("\n"), 1):
            if line == "boom":
                raise ValueError("boom")
            yield "", path, f"line {n}", "line", line, n, n

    E.register_extractor("cobol", lines)
    try:
        E.register_sql_function(spark)
        texts = [("cobol", "/r/b", "x\ny"), ("cobol", "/r/bad", "x\nboom"), ("other", "/r/c", "x")]
        spark.createDataFrame(texts, "lang string, path string, text string").createOrReplaceTempView("sql_texts")
        got = spark.sql("SELECT path, member_name FROM sql_texts, LATERAL extract_snippets(lang, path, text)").collect()
        assert sorted(tuple(r) for r in got) == [("/r/b", "line 1"), ("/r/b", "line 2"), ("/r/bad", "Entire File")]
    finally:
        E.register_extractor("cobol", None)


def test_python_strings_brackets_and_comments(spark):
    code = '''def f(
    a: int = 1,
) -> dict[str, int]:
    """A text with
class of things: x
at the left margin.
"""
    x = "def g(:"
# a comment
    return (
1)
class B(
    Base): pass
'''
    assert names(cut(spark, "/p/a.py", code)) == [("f (Function)", 1, 11), ("B (Class)", 12, 14)]


def test_script_strings_and_types(spark):
    code = """function a() { return "{"; }
const re = /[{]/;
function b() { return '}' + `x ${ `}` } {`; } // {
async function* c() {}
export default class D extends E {}
"""
    assert names(cut(spark, "/p/a.js", code)) == [("a (Function)", 1, 1), ("b (Function)", 3, 3), ("c (Function)", 4, 4), ("D (Class)", 5, 5)]
    typed = """export abstract class A<T extends { a: number }> extends B<T> implements C, D<{ x: 1 }> {
  m() {}
}
export const f = async <T,>(a: T): Promise<{ b: T }> => {
  return { b: a };
};
function g(
  a: string,
): { c: number } {
  return { c: 1 };
}
function over(a: string): void;
type U<T> =
  | { kind: "a" }
  | T
const enum E { X = "}" }
declare function outside(x: number): void
let y = 1
"""
    assert names(cut(spark, "/p/a.ts", typed)) == [
        ("A (Class)", 1, 3), ("f (Arrow Function)", 4, 6), ("g (Function)", 7, 11), ("U (Type Alias)", 13, 15), ("E (Enum)", 16, 16)
    ]


def test_csharp_raw_and_nested_strings(spark):
    code = '''class A {
  string R() { return """
    } " {
    """; }
  string N(string x) => $"{N("}")} {{ {x}";
  string V() { return @"c:\\" + $@"{x}""}"; }
  int Last() { return 1; }
}'''
    assert [s[2] for s in cut(spark, "/p/a.cs", code)] == ["A (类)", "R (方法)", "N (方法)", "V (方法)", "Last (方法)"]


def test_rest_covers_all_lines(spark):
    code = "import x\n\nclass A:\n    def m(self):\n        pass\n    y = 1\n\nz = 2\n"
    found = cut(spark, "/p/a.py", code, rest=True)
    rest = [s for s in found if s[3] == "rest"]
    assert names(rest) == [("Rest (File)", 1, 1), ("Rest (File)", 6, 8)] and rest[1][4] == "    y = 1\n\nz = 2"
    covered = {n for s in found for n in range(s[5], s[6] + 1)}
    assert {n for n, line in enumerate(code.split("\n"), 1) if line.strip()} <= covered


@pytest.mark.parametrize("range_lines", [1, 2, 100])
def test_rest_over_ranges(spark, range_lines):
    text = "a\n\n\nb\nc\n \nd\n\n\ne"
    files = spark.createDataFrame([("/r/x.ts", text), ("/r/y.ts", "q\nr"), ("/r/z.ts", " \n")], "path string, text string")
    snippets = spark.createDataFrame([("/r/x.ts", 4, 4), ("/r/x.ts", 4, 4), ("/r/x.ts", 7, 9), ("/r/y.ts", 1, 2)], "path string, start_line int, end_line int")
    found = rest_of_lines(files, snippets, "path", "text", range_lines=range_lines)
    assert sorted((r.path, r.code, r.start_line, r.end_line) for r in found.collect()) == [("/r/x.ts", "a", 1, 1), ("/r/x.ts", "c", 5, 5), ("/r/x.ts", "e", 10, 10)]


PARTS = {
    ".py": ["import x", "", "   ", "def f():\n    # é\n    return 1", "y = 2", "class A:\n\n    z = 1", "\tq()", "s = '''\ndef no():\n'''"],
    ".js": ["foo();", "", "  ", "function a() {\n  return '{';\n}", "  // é {", "const g = () => {\n}; bar();", "class Q {\n\n}", "type T = { a: 1 } & B"],
    ".ts": ["foo();", "", "  ", "type T = { a: 1 } &\n  B", "  // é {", "export const g = (a: { b: 1 }) => {\n}", "enum E {\n A }", "type U =\n  | B"],
    ".cs": ["using X;", "", "  ", "class A {\n  // é }\n  int x, y;\n\n  void M() {\n  }\n}", "// end", "namespace N {", "enum E { A,\n B }", "}", "}"],
}


def _uncovered(text, found):
    """Runs of lines with text that no snippet has, by a walk over all lines."""
    lines, runs = text.split("\n"), [[]]
    covered = {n for first, last in found for n in range(first, last + 1)}
    for n, line in enumerate(lines, 1):
        if n in covered:
            runs.append([])
        elif line.strip() or runs[-1]:
            runs[-1].append(n)
    ends = [(run[0], max(n for n in run if lines[n - 1].strip())) for run in runs if run]
    return [("\n".join(lines[a - 1 : b]).rstrip(), a, b) for a, b in ends]


@pytest.mark.parametrize("suffix", sorted(PARTS))
@pytest.mark.parametrize("size", [2, 4096])
def test_rest_is_what_no_snippet_has(spark, suffix, size):
    """In files of one range and of several ones, with places beside and in each other, and in files without any."""
    from snipdex.operators import code_lines, code_pieces

    form = {".py": code_lines.python_snippets, ".cs": code_pieces.csharp_snippets}.get(suffix, code_pieces.script_snippets)
    rng = random.Random(size)
    files = [(f"/r/f{i}{suffix}", "\n".join(rng.choices(PARTS[suffix], k=rng.randint(1, 12)))) for i in range(120)] + [(f"/r/none{suffix}", None), (f"/r/blank{suffix}", " \n")]
    df = spark.createDataFrame(files, "path string, text string").repartition(3)
    found = form(df, "path", "text", (), size, rest=True).collect()
    for path, text in files:
        here = [r for r in found if r.path == path]
        assert all(r.code.count("\n") == r.end_line - r.start_line for r in here)
        rest = sorted((r.code, r.start_line, r.end_line) for r in here if r.kind == "rest")
        assert rest == sorted(_uncovered(text, [(r.start_line, r.end_line) for r in here if r.kind != "rest"]) if text and text.strip() else [])
    plain = form(df, "path", "text", (), size).collect()
    assert sorted(map(tuple, plain)) == sorted(tuple(r) for r in found if r.kind != "rest")


@pytest.mark.parametrize("suffix", sorted(PARTS))
def test_texts_are_stored_once(spark, monkeypatch, suffix):
    """Of all that is stored for snippets and the rest, only one table has the texts; rows of windows have none."""
    import os

    from snipdex.operators import code_lines, code_pieces

    sizes = {}

    def watched(df, label):
        table = stored(df, label)
        sizes[label] = sizes.get(label, 0) + sum(os.path.getsize(f.removeprefix("file://")) for f in table.inputFiles())
        return table

    for module in (code_lines, code_pieces, E):
        monkeypatch.setattr(module, "stored", watched)
    rng = random.Random(1)
    block = {".py": "# {0}\ndef f():\n    # {1}\n    return 1\n{0}", ".cs": "// {0}\nclass A {{\n  // {1}\n}}"}.get(suffix, "// {0}\nfunction f() {{\n  // {1}\n}}\n")
    texts = ["\n".join(block.format(rng.randbytes(200).hex(), rng.randbytes(200).hex()) for _ in range(20)) for _ in range(100)]
    df = spark.createDataFrame([(f"/r/f{i}{suffix}", text) for i, text in enumerate(texts)], "path string, text string").repartition(2)
    assert E.extract_snippets(df, rest=True).count() >= 4000
    texts_bytes = sum(map(len, texts))
    assert sum(sizes.values()) < 1.3 * texts_bytes, sizes
    lines = code_lines.file_lines(spark.createDataFrame([(1, "a\nb")], "file long, mask string"), 1)
    assert lines.columns == ["file", "range", "n", "mask"]


def test_a_batch_of_files_is_masked_in_slices():
    """All texts of a batch in order, with never more than a slice of them as Python strings."""
    import tracemalloc

    import pyarrow as pa

    from snipdex.operators import masking

    texts = [("x = 'é'\n" * (i % 400)) if i % 7 else None for i in range(10000)]
    batch = pa.array(texts + ["long " * 200000, ""])
    tracemalloc.start()
    seen, largest = 0, 0
    for some in masking.text_slices(batch.slice(1)):
        size = sum(len((t or "").encode()) for t in some)
        largest = max(largest, size if len(some) > 1 else 0)
        assert some[0] == batch[seen + 1].as_py() and some[-1] == batch[seen + len(some)].as_py()
        seen += len(some)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert seen == len(batch) - 1 and largest <= masking.SLICE_BYTES
    assert peak < 8 << 20 < batch.nbytes


def _times_made(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("made_here")


def _made(spark, suffix):
    """Files whose text is an expression, as a listing may have it."""
    text = F.regexp_replace(F.concat(F.lit("def f():\n    a = "), F.col("id").cast("string")), "made_here", "x")
    return spark.range(3).select(F.concat(F.lit("/r/f"), F.col("id").cast("string"), F.lit(suffix)).alias("path"), text.alias("text"))


@pytest.mark.parametrize("suffix", [".py", ".ts", ".cs"])
def test_source_texts_are_made_once(spark, monkeypatch, suffix):
    """No filter on the text is pushed below: every text would be made again, and for every language."""
    from snipdex.operators import code_lines, code_pieces

    seen = []

    def watched(df, label):
        if label in ("masked", "pieces"):
            seen.append(_times_made(df))
        return stored(df, label)

    for module in (code_lines, code_pieces):
        monkeypatch.setattr(module, "stored", watched)
    assert E.extract_snippets(_made(spark, suffix)).count() == (0 if suffix == ".cs" else 3)
    assert seen == [1, 1, 1]


def test_embedded_texts_are_made_once(spark):
    from snipdex.operators import embed

    rows = embed.embed(_made(spark, ".py"), "text", embed.hashed_tokens(4), 4)
    assert _times_made(rows) == 1 and rows.count() == 3
