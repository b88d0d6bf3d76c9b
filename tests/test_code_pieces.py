"""Declarations in braces as windows over pieces, against the plain walk over one text."""

import random

import pytest

from snipdex.operators import code_pieces
from snipdex.operators import extract as E
from tests.plain_code import csharp_members

# Lines, and the declarations in them.
SCRIPT = {
    "function a() { return '{'; }": [("a", "Function")],
    "const re = /[{]/;": [],
    "function b(x = {a: 1}, [c]) {\n  return `}` + `x ${ `}` } {`; // {\n}": [("b", "Function")],
    "async function* c() {}": [("c", "Function")],
    "export default class D extends E {}": [("D", "Class")],
    "export default async function f(a) {\n  if (a) { return {}; }\n}": [("f", "Function")],
    "const g = async (x) => {\n  return 1;\n}": [("g", "Arrow Function")],
    "let h = y => { }": [("h", "Arrow Function")],
    "var k = (a) => a + 1;": [],
    "foo();": [],
    "foo(() => {\n  function no() {}\n})": [],
    "": [],
    "  ": [],
    "class Q extends R.S {\n  m() { return {}; }\n}": [("Q", "Class")],
    "function classify() {\n}": [("classify", "Function")],
    "import x from 'y';": [],
    "export { a, b };": [],
    "/* function z() { } */": [],
    "if (x) {\n  function inner() {}\n}": [],
    "const o = {\n  f: function () {}\n};": [],
    "function $naïve_1() {\n}": [("$naïve_1", "Function")],
}
TYPED = SCRIPT | {
    "export abstract class A<T extends { a: number }> extends B<T> implements C, D<{ x: 1 }> {\n  m() {}\n}": [("A", "Class")],
    "export const f = async <T,>(a: T): Promise<{ b: T }> => {\n  return { b: a };\n}": [("f", "Arrow Function")],
    "function g(\n  a: string,\n): { c: number } {\n  return { c: 1 };\n}": [("g", "Function")],
    "function over(a: string): void;": [],
    'type U<T> =\n  | { kind: "a" }\n  | T': [("U", "Type Alias")],
    'const enum E { X = "}" }': [("E", "Enum")],
    "declare function outside(x: number): void": [],
    "let y = 1": [],
    "export interface I extends J {\n  a: string;\n}": [("I", "Interface")],
    "export type T = string | number;": [("T", "Type Alias")],
    "enum E2 { A }": [("E2", "Enum")],
    "type O = {\n  x: number\n}": [("O", "Type Alias")],
    "export const h: Fn = (a) => {\n}": [("h", "Arrow Function")],
    "const z: () => { a: number } = () => {\n  return 1\n}": [("z", "Arrow Function")],
    "type F = (a: string) =>\n  void": [("F", "Type Alias")],
}


def rows(df):
    names = ("path", "language", "namespace", "class_name", "member_name", "kind", "code", "start_line", "end_line")
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def expected(path, parts, known):
    """What the parts declare, each with its own lines; a file without a declaration is one snippet."""
    stem, language, out, line = path.split("/")[-1].split(".")[0], "typescript" if path.endswith("ts") else "javascript", [], 1
    for part in parts:
        for name, kind in known[part]:
            out.append((path, language, "", stem, f"{name} ({kind})", kind.lower(), part, line, line + part.count("\n")))
        line += part.count("\n") + 1
    text = "\n".join(parts)
    if not out and text.strip():
        out.append((path, language, "", stem, E.WHOLE_FILE.get(language, E.WHOLE_FILE[""]), "file", text, 1, line - 1))
    return out


@pytest.mark.parametrize("range_pieces", [1, 5, 4096])
def test_declarations_of_scripts(spark, range_pieces):
    rng = random.Random(range_pieces)
    made = [(f"/r/f{i}.js", rng.choices(list(SCRIPT), k=rng.randint(1, 8)), SCRIPT) for i in range(150)]
    made += [(f"/r/f{i}.ts", rng.choices(list(TYPED), k=rng.randint(1, 8)), TYPED) for i in range(150)]
    files = [(path, "\n".join(parts)) for path, parts, _ in made] + [("/r/none.js", None), ("/r/blank.ts", " \n")]
    df = spark.createDataFrame(files, "path string, text string").repartition(5)
    got, want = rows(code_pieces.script_snippets(df, range_pieces=range_pieces)), sorted(r for m in made for r in expected(*m))
    texts = dict(files)
    for path in sorted({r[0] for r in set(got) ^ set(want)})[:4]:
        print("=====", path, repr(texts[path]))
        print([r[4:] for r in got if r[0] == path and r not in want])
        print([r[4:] for r in want if r[0] == path and r not in got])
    assert got == want


CSHARP = [
    "    private int _a = 1, _b;", "    public string Name { get; set; } = \"x;\";", "    public int Twice => _a * 2;", "    public event EventHandler Full { add { } remove { } }", "    // a } brace",
    "    [Test] public async Task<int> Run<TX>(List<TX> xs = null) where TX : class\n    {\n        if (xs == null) { return \"}\"; }\n        return 1;\n    }", "    void IFoo.Bar() { }", "    class Nested { void Hidden() { } }",
    "    public static Foo operator +(Foo a, Foo b) => a;", "    private Func<int, int> f = x => { return x; };", "    private readonly Dictionary<string, int> map = new() { [\"a;\"] = 1 };", "", "    public Foo(int a) : base(a) { _a = a; }",
    '    string R() { return """\n    } " {\n    """; }', "    delegate void D();", "    int[] xs = { 1, 2 };", "    public Dictionary<string, List<int>> M() => new() { };", "    const int C = 3;", "    int this[int i] { get { return 1; } }",
]
TYPES = ["public class Foo<T> : Base where T : new()\n{\n@\n}", "interface IBar { @\n}", "[Attr(\"x;{\")]\npublic struct S {\n@\n}", "public enum Color { Red, Green }", "public record Point(int X, int Y);", "record class R2 { @\n}", "using System;", ""]


@pytest.mark.parametrize("range_pieces", [1, 7, 4096])
def test_types_and_members(spark, range_pieces):
    """Against the plain walk over one text."""
    rng = random.Random(range_pieces)
    files = []
    for i in range(220):
        types = "\n".join(rng.choice(TYPES).replace("@", "\n".join(rng.choices(CSHARP, k=rng.randint(0, 6)))) for _ in range(rng.randint(1, 4)))
        frame = rng.choice(["@", "using X;\nnamespace A.B\n{\n@\n}\n", "namespace A.C;\n\n@\n", "namespace A { namespace B { @ } class Last { int z; } }\nclass Out { }", "#region x {\n@\n#endregion"])
        files.append((f"/r/f{i}.cs", frame.replace("@", types)))
    files += [("/r/none.cs", None), ("/r/open.cs", "class A { void B() {"), ("/r/stray.cs", "} class A { }"), ("/r/no.cs", "int x;")]
    df = spark.createDataFrame(files, "path string, text string").repartition(5)
    got = rows(code_pieces.csharp_snippets(df, range_pieces=range_pieces))
    want = sorted((path, "csharp", *s) for path, text in files if text for s in csharp_members(path, text))
    texts = dict(files)
    for path in sorted({r[0] for r in set(got) ^ set(want)})[:4]:
        print("=====", path, repr(texts[path]))
        print([r[2:] for r in got if r[0] == path and r not in want])
        print([r[2:] for r in want if r[0] == path and r not in got])
    assert got == want
