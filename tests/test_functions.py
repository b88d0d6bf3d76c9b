import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from snipdex.functions import jsonx as J
from snipdex.functions import paths as P
from snipdex.functions import rules as R
from snipdex.functions import text as X
from snipdex.functions import vectors as V


def one(spark, column, value, ddl="v string"):
    return spark.createDataFrame([(value,)], ddl).select(column.alias("r")).first()["r"]


def each(spark, column, values, ddl="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {ddl}")
    return [r["r"] for r in rows.select("i", column.alias("r")).orderBy("i").collect()]


v = None


@pytest.fixture(autouse=True, scope="module")
def column(spark):
    """Columns need a running session."""
    global v
    v = F.col("v")


def test_token_estimate(spark):
    texts = ["", "a b", "中 文", "abcdefgh", "   ", "x\ty\r\nz"]
    assert each(spark, X.estimate_tokens(v), texts) == [0, 2, 4, 2, 0, 3]


def brute_tokens(text):
    if not text:
        return 0
    words = len([w for w in text.replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w])
    cjk = sum("一" <= c <= "鿿" for c in text)
    rest = len(text) - words - cjk
    return max(words + cjk + int(rest / 4), len(text) // 4)


def brute_truncate(text, limit):
    if brute_tokens(text) <= limit:
        return text
    kept, total = [], 0
    for line in text.split("\n"):
        total += brute_tokens(line + "\n")
        if total > limit:
            break
        kept.append(line)
    return "\n".join(kept).rstrip(X.TRIM_END)


TEXTS = st.lists(st.text(alphabet="ab 中文\t\n\r{}", max_size=60), min_size=1, max_size=20)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(TEXTS)
def test_tokens_and_truncation_match_brute_force(spark, texts):
    assert each(spark, X.estimate_tokens(v), texts) == [brute_tokens(t) for t in texts]
    assert each(spark, X.truncate_lines(v, 7), texts) == [brute_truncate(t, 7) for t in texts]


def test_first_line_over_the_limit_empties_the_text(spark):
    assert one(spark, X.truncate_lines(v, 2), "one two three four\nx") == ""


def test_truncate_chars_and_cap(spark):
    assert one(spark, X.truncate_chars(v, 2), "abcdefghij") == "abcdefgh"
    assert one(spark, X.cap_snippet(v), "x" * 2000) == "x" * 2000
    assert one(spark, X.cap_snippet(v), "x" * 2001) == "x" * 1950 + X.SNIPPET_MARKER
    assert each(spark, X.estimate_tokens_simple(v), ["", "a", "abcde"]) == [0, 1, 2]


@pytest.mark.parametrize("size,overlap", [(4, 1), (5, 3), (3, 0), (7, 6)])
def test_chunks(spark, size, overlap):
    texts = ["", "a", "abcdefg", "abcdefghijklmnopqrstuvwxyz", "line\nbreaks\n\nkept"]

    def brute(t):
        out, at, step = [], 0, size - overlap
        while t and (at == 0 or at + overlap < len(t)):
            out.append(t[at : at + size])
            at += step
        return out

    assert each(spark, X.chunks(v, size, overlap), texts) == [brute(t) for t in texts]


def test_lines(spark):
    assert one(spark, X.line_number(v, F.lit(0)), "a\nb\nc") == 1
    assert one(spark, X.line_number(v, F.lit(4)), "a\nb\nc") == 3
    assert one(spark, X.leading_indent(v), "\t  x") == "\t  "


def test_normalize_and_collection(spark):
    paths = ["/A/b", "/a/./B/../b/", "a\\B\\", "/", "/a//b"]
    assert each(spark, P.normalize_path(v), paths) == ["/a/b", "/a/b", "a/b", "/", "/a/b"]
    assert one(spark, P.collection_name(v), "/A/b") == "code_index_662b7b62"


def test_relative_depth_and_parts(spark):
    assert one(spark, P.relative_path(v, F.lit("/a/")), "/a/b/c.py") == "b/c.py"
    assert one(spark, P.relative_path(v, F.lit("/a")), "/ab/c.py") == "/ab/c.py"
    assert each(spark, P.directory_depth(v, F.lit("/a")), ["/a", "/a/b/c", "/ab"]) == [0, 2, -1]
    assert each(spark, P.extension(v), ["x/A.Py", "x.d/a", ".git", "a.", "a.tar.gz"]) == [".py", "", ".git", "", ".gz"]
    assert each(spark, P.file_stem(v), ["x/A.b.py", "a"]) == ["A.b", "a"]


def test_glob(spark):
    rule = P.glob_match(v, ["*.cs"], ["bin"])
    paths = ["a/b/C.CS", "x/bin/y.cs", "x/binary/y.cs", "bin/y.cs", "a.csx", "top.cs"]
    assert each(spark, rule, paths) == [True, False, True, False, False, True]
    flat = P.glob_match(v, ["*.cs", ".py"], recursive=False)
    assert each(spark, flat, ["a/b.cs", "b.cs", "c.py", "a/c.py"]) == [False, True, True, False]
    deep = P.glob_match(v, ["src/**/*.t[s]"], [])
    assert each(spark, deep, ["src/a.t[s]", "src/x/y/a.t[s]", "src/a.ts"]) == [True, True, False]


def test_other_filters(spark):
    assert each(spark, P.watch_match(v, [], ["BIN"]), ["a/bin/x", "a/x"]) == [False, True]
    assert each(spark, P.contains_match(v, ["*.cs"]), ["a/x.csproj", "cs/x.py"]) == [True, False]
    assert each(spark, P.has_segment(v, ["Bin"]), ["a\\BIN\\x", "a/binary/x"]) == [True, False]
    assert each(spark, P.detect_language(v), ["a.PY", "a.tsx", "a.go", "", None]) == [
        "python", "typescript", "unknown", "unknown", "unknown"
    ]


def test_rules(spark):
    assert each(spark, R.parse_duration(v), ["12s", "5ms", "", "x", None, "1.5s", "s", "1e5s"]) == [
        12.0, 0.005, 0.0, 0.0, 0.0, 1.5, 0.0, 0.0
    ]
    assert each(spark, R.legacy_status(v), ["COMPLETED", "indexing", "?", None]) == ["Completed", "Indexing", "Pending", "Pending"]
    assert each(spark, R.backoff_ms(1000, v), [1, 2, 5, 6, 60], "int") == [1000, 2000, 16000, 30000, 30000]
    assert each(spark, R.preset_slug(v), ["My  Preset! (v2)", "Ä b"]) == ["my_preset_v2", "ä_b"]
    assert each(spark, R.project_category(v), ["CSharp", "python", "cobol"]) == ["Backend", "Data/Backend", "Other"]


def test_json(spark):
    docs = ['{"K":1,"tags":["a"],"s":"x\\"{["}', "{}", "[1,[2]]", "{bad", '{"k":9}}', '1,"w":2', '1],[2', "", "null", "7"]
    assert each(spark, J.is_valid(v), docs) == [True, True, True, False, False, False, False, False, True, True]
    assert each(spark, J.field(v, "k"), docs[:2] + ['{"K":1,"k":2}']) == ["1", None, "2"]
    assert each(spark, J.depth(v), docs[:3] + ['{"a":{}}', '{"a":{"b":1}}', "5"]) == [2, 0, 2, 1, 2, 0]
    assert each(spark, J.type_at(v, "$.a"), ['{"a":1}', '{"a":"x"}', '{"a":[1]}', '{"a":{}}', '{"a":true}', '{"a":1.5}', '{"a":null}', "{}", "{"]) == [
        "integer", "text", "array", "object", "true", "real", "null", None, None
    ]
    assert one(spark, J.set_key(v, "b", F.lit("[1]")), '{"a": 1.5}') == '{"a":1.5,"b":[1]}'
    assert one(spark, J.insert_key(v, "a", F.lit("2")), '{"a":1}') == '{"a":1}'
    assert one(spark, J.remove_key(v, "a"), '{"a":1,"b":"x"}') == '{"b":"x"}'
    assert one(spark, J.array_has(v, "$.t", "x"), '{"t":["x","y"]}') is True
    assert one(spark, J.array_length(v, "$.t"), '{"t":["x","y"]}') == 2


def test_cosine(spark):
    rows = [([1.0, 0.0], [2.0, 0.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 2.0]), ([1.0, 1.0], [-1.0, -1.0])]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>")
    got = [r[0] for r in df.select(V.cosine_similarity(F.col("a"), F.col("b"))).collect()]
    assert got[0] == pytest.approx(1.0) and got[1] is None and got[2] is None and got[3] == pytest.approx(-1.0)
    unit = df.select(V.norm(V.l2_normalize(F.col("b"))).alias("n")).collect()
    assert [round(r["n"], 6) for r in unit] == [1.0, 1.0, 1.0, 1.0]


def test_json_edits_ignore_case_and_keep_what_is_no_object(spark):
    docs = ['{"Team":"a","x":1}', None, "oops", "[1]", "{}", ""]
    assert each(spark, J.remove_key(v, "team"), docs) == ['{"x":1}', None, "oops", "[1]", "{}", ""]
    assert each(spark, J.set_key(v, "team", F.lit('"b"')), docs) == ['{"x":1,"team":"b"}', '{"team":"b"}', "oops", "[1]", '{"team":"b"}', ""]
    assert each(spark, J.insert_key(v, "TEAM", F.lit('"b"')), docs) == ['{"Team":"a","x":1}', '{"TEAM":"b"}', "oops", "[1]", '{"TEAM":"b"}', ""]
    assert each(spark, J.is_object(v), docs) == [True, True, False, False, True, False]
