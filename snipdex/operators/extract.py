"""Cut source files into line-ranged snippets.

Python, scripts and C# are cut by windows over lines (`code_lines`) or over pieces between brackets (`code_pieces`). What
lies here blanks out their comments and strings, which is the only step in Python, and handles the languages that a
function cuts file by file: `register_extractor` adds or replaces one.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snipdex import schemas
from snipdex.functions import paths as P
from snipdex.operators.masking import blank, text_slices
from snipdex.session import stored

# namespace, class name, member name, kind, code, first line, last line
Snippet = tuple[str, str, str, str, str, int, int]
Extractor = Callable[[str, str], Iterator[Snippet]]

# Labels of members as they appear in member names
WHOLE_FILE = {"javascript": "整个文件", "": "Entire File"}
CSHARP_LABELS = {
    "class": "类", "interface": "接口", "struct": "结构体", "record": "记录", "enum": "枚举",
    "method": "方法", "constructor": "构造函数", "property": "属性", "field": "字段", "event": "事件",
}
CSHARP_MODIFIERS = set(
    "public private protected internal static readonly virtual override abstract sealed async extern unsafe "
    "partial new const volatile ref required".split()
)
FLUSH_ROWS = 2000


def _stem(path: str) -> str:
    return re.sub(r"\.[^.]*$", "", re.split(r"[/\\]", path)[-1])


def _whole(path: str, text: str, language: str = "") -> Snippet:
    label = WHOLE_FILE.get(language, WHOLE_FILE[""])
    return "", _stem(path), label, "file", text, 1, text.count("\n") + 1


class _Lines:
    """Line numbers of growing offsets."""

    def __init__(self, text: str):
        self.text, self.at, self.line = text, 0, 1

    def __call__(self, offset: int) -> int:
        if offset < self.at:
            self.at, self.line = 0, 1
        self.line += self.text.count("\n", self.at, offset)
        self.at = offset
        return self.line


def _brace_pairs(text: str) -> dict[int, int]:
    """Closing brace of every opening one."""
    pairs, stack = {}, []
    for match in re.finditer(r"[{}]", text):
        if match[0] == "{":
            stack.append(match.start())
        elif stack:
            pairs[stack.pop()] = match.start()
    return pairs


RAZOR_LABELS = {"code": "Code Block", "functions": "Functions Block", "": "Razor Block"}


def razor_blocks(path: str, text: str) -> Iterator[Snippet]:
    """`@code{}`, `@functions{}` and `@{}` up to the matching brace, numbered; braces in their strings do not count."""
    pairs, line, number, taken = _brace_pairs(re.sub(r'"(?:\\.|[^"\\\n])*"', lambda m: blank(m[0]), text)), _Lines(text), 0, 0
    for match in re.finditer(r"@(code|functions|)\s*\{", text):
        end = pairs.get(match.end() - 1)
        if end is None or match.start() < taken:
            continue
        taken = end
        code = text[match.end() : end].strip()
        if not code:
            continue
        number += 1
        first = line(match.start())
        last = first + text.count("\n", match.start(), end + 1)
        yield "", _stem(path), f"Block {number} ({RAZOR_LABELS[match[1]]})", "block", code, first, last
    if not number:
        yield _whole(path, text)


#: Languages that one function cuts file by file. A registered one takes the place of the column form.
EXTRACTORS: dict[str, Extractor] = {"cshtml": razor_blocks}
#: Languages that windows over lines or pieces cut.
COLUMN_FORMS = {"python": "lines", "javascript": "script", "typescript": "script", "csharp": "csharp"}


def register_extractor(language: str, extractor: Extractor | None) -> None:
    """Cut a language by a function; None goes back to what the library has."""
    if extractor is None:
        EXTRACTORS.pop(language, None)
    else:
        EXTRACTORS[language] = extractor


def _snippet_schema() -> T.StructType:
    return T.StructType.fromDDL(schemas.SNIPPET)


def _snippets_of(table: dict[str, Extractor], path: str, text: str, language: str) -> list[Snippet]:
    """The snippets of a file; one that cannot be cut is a snippet as a whole, and `parse_report` tells why."""
    try:
        return list(table[language](path, text))
    except Exception:
        return [_whole(path, text)]


def _with_text(ready: DataFrame, languages: Iterable[str]) -> DataFrame:
    return ready.filter(F.col("_language").isin(list(languages)) & F.col("_text").rlike("\\S"))


def _by_function(ready: DataFrame, keep: tuple[str, ...], table: dict[str, Extractor]) -> DataFrame:
    """Snippets of (keep, _path, _text, _language) files whose language one function cuts."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType([ready.schema[c] for c in keep] + _snippet_schema().fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        rows: list[tuple] = []
        for batch in batches:
            for values in zip(*(c.to_pylist() for c in batch.columns)):
                *kept, name, body, lang = values
                rows.extend((*kept, name, lang, *s) for s in _snippets_of(table, name, body, lang))
                if len(rows) >= FLUSH_ROWS:
                    yield _record_batch(rows, arrow)
                    rows = []
        if rows:
            yield _record_batch(rows, arrow)

    return ready.mapInArrow(run, schema)


def _record_batch(rows: list[tuple], arrow: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)


def extract_snippets(files: DataFrame, path: str = "path", text: str = "text", keep: tuple[str, ...] = (), rest: bool = False) -> DataFrame:
    """Snippets of every file with a known language; `keep` columns are repeated per snippet.

    Blank texts give no rows; a file that cannot be cut is one snippet.  With `rest`, lines that belong to no snippet
    (imports, statements between declarations) become snippets of kind `rest`, so every line with text is in one; `keep`
    and path have to tell files apart then.
    """
    from snipdex.operators.code_lines import python_snippets, rest_of_lines
    from snipdex.operators.code_pieces import csharp_snippets, script_snippets

    table = dict(EXTRACTORS)
    forms = {"lines": python_snippets, "script": script_snippets, "csharp": csharp_snippets}
    ready = files.select(*keep, F.col(path).alias("_path"), F.col(text).alias("_text"), P.detect_language(F.col(path)).alias("_language"))
    # The language decides first, and the forms look at a text only once it is there: a filter on the text would be pushed
    # into the plan of `files` and have every text made again for every form.
    parts = []
    for name, form in forms.items():
        languages = [lang for lang, kind in COLUMN_FORMS.items() if kind == name and lang not in table]
        if languages:
            parts.append(form(ready.filter(F.col("_language").isin(languages)), "_path", "_text", keep, rest=rest))
    if table:
        known = _with_text(ready, table)
        found = _by_function(known, keep, table)
        if rest:
            found = stored(found, "snippets")  # used twice
            found = found.unionByName(rest_of_lines(known, found, "_path", "_text", keep))
        parts.append(found)
    return functools.reduce(DataFrame.unionByName, parts)


def parse_report(files: DataFrame, path: str = "path", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep, path, snippets, error) per file with a known language: how many snippets, or why none.

    Only functions can fail; what windows cut has no error. `keep` and path have to tell files apart.
    """
    table = dict(EXTRACTORS)

    def problem(name: str, body: str | None, lang: str) -> str | None:
        try:
            if lang in table:
                for _ in table[lang](name, body):
                    pass
        except Exception as e:
            return f"{type(e).__name__}: {e}"

    @F.arrow_udf("string")
    def error(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for names, bodies, languages in batches:
            first = 0
            for some in text_slices(bodies):
                here = slice(first, first + len(some))
                first = here.stop
                yield pa.array([problem(*file) for file in zip(names[here].to_pylist(), some, languages[here].to_pylist())], pa.string())

    listed = files.withColumn("_language", P.detect_language(F.col(path))).filter(F.col("_language").isin([*table, *COLUMN_FORMS]))
    key = [*keep, path]
    counts = extract_snippets(listed, path, text, keep).groupBy(*(F.col(k if k != path else "path").alias(f"_k{i}") for i, k in enumerate(key))).agg(F.count(F.lit(1)).alias("_n"))
    # Texts that windows cut stay in the JVM.
    judged = listed.select(*key, error(F.col(path), F.when(F.col("_language").isin(list(table)), F.col(text)), F.col("_language")).alias("error"))
    same = functools.reduce(lambda a, b: a & b, (judged[k].eqNullSafe(counts[f"_k{i}"]) for i, k in enumerate(key)))
    joined = judged.join(counts, same, "left")
    snippets = F.when(F.col("error").isNull(), F.coalesce("_n", F.lit(0))).otherwise(0).cast("int")
    return joined.select(*keep, F.col(path).alias("path"), snippets.alias("snippets"), "error")


def register_sql(spark: SparkSession, files: str, name: str = "snippets") -> None:
    """Make the snippets of a view of files (path, text) a view for SQL: `SELECT ... FROM snippets`."""
    extract_snippets(spark.table(files)).createOrReplaceTempView(name)


def register_sql_function(spark: SparkSession, name: str = "extract_snippets") -> None:
    """Make registered functions a table function for SQL: `FROM files, LATERAL extract_snippets(language, path, text)`.

    A file that cannot be cut is one snippet.
    """
    table = dict(EXTRACTORS)
    columns = schemas.SNIPPET.replace("path string, language string, ", "")

    @F.udtf(returnType=columns, useArrow=True)
    class Snippets:
        def eval(self, language: str, path: str, text: str):
            if language in table and text and text.strip():
                yield from _snippets_of(table, path, text, language)

    spark.udtf.register(name, Snippets)


def methods_only(snippets: DataFrame) -> DataFrame:
    return snippets.filter(F.col("kind") == "method")
