"""Extraction over source files that hold the texts' own punctuation, in comments and in strings, for four languages."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from snipdex.operators import extract as E
from snipdex.plans.catalog import query
from snipdex.plans.domain import FILES_SQL, files

# Per language: first line, then what stands before the number, the text in a comment, the text in a string, and behind.
LAYOUT = {
    "py": ("import os\n", "def part_", "():\n    # ", '\n    return """', '"""'),
    "js": ('import x from "y";\n', "function part_", "() {\n  // ", "\n  return `", "`;\n}"),
    "ts": ('import x from "y";\n', "export const part_", " = (a: { b: string }) => {\n  // ", "\n  return `", "`;\n}"),
    "cs": ("using System;\n", "class Part_", " {\n  // ", '\n  string S = @"', '";\n}'),
}
MEMBER = {"py": " (Function)", "js": " (Function)", "ts": " (Arrow Function)", "cs": " (类)"}
# What would end the string, or begin an escape or a hole, is written as the language wants it.
HELD = {"py": [("\\", " "), ('"', "'")], "js": [("\\", " "), ("`", "'"), ("${", "{")], "ts": [("\\", " "), ("`", "'"), ("${", "{")], "cs": [('"', '""')]}


def _quoted(text: str) -> str:
    return "('" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "')"


def _held_sql(language: str) -> str:
    return functools.reduce(lambda x, p: f"replace({x}, {_quoted(p[0])}, {_quoted(p[1])})", HELD[language], "x")


def _member_sql(n: int, language: str) -> str:
    _, name, before, between, behind = LAYOUT[language]
    lines = 3 if language == "py" else 4
    code = f"{_quoted(name)} || i || {_quoted(before)} || x || {_quoted(between)} || {_held_sql(language)} || {_quoted(behind)}"
    label = f"'{'Part_' if language == 'cs' else 'part_'}' || i || '{MEMBER[language]}'"
    return f"SELECT path, '{language}' AS language, {label} AS member_name, 2 + {lines} * i AS start_line, 1 + {lines} * (i + 1) AS end_line, md5({code}) AS code_md5 FROM l WHERE doc_id % 4 = {n}"


def _coverage_sql() -> str:
    members = " UNION ALL ".join(_member_sql(n, language) for n, language in enumerate(LAYOUT))
    field = f"""SELECT path, 'cs', 'S (字段)', 4 + 4 * i, 4 + 4 * i, md5({_quoted('string S = @"')} || {_held_sql("cs")} || {_quoted('";')}) FROM l WHERE doc_id % 4 = 3"""
    heads = " ".join(f"WHEN '{language}' THEN md5({_quoted(parts[0].rstrip())})" for language, parts in LAYOUT.items())
    return f"""WITH {FILES_SQL}, l AS (SELECT doc_id, path, replace(x, chr(13), ' ') AS x, i FROM (
  SELECT doc_id, '/cover/' || doc_id || '.' || ['py', 'js', 'ts', 'cs'][doc_id % 4 + 1] AS path, unnest(string_split(text, chr(10))) AS x,
    generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM files)),
c AS ({members})
SELECT * FROM c UNION ALL {field}
UNION ALL SELECT path, language, 'Rest (File)', 1, 1, CASE language {heads} END FROM (SELECT DISTINCT path, language FROM c)"""


def _declaration(parts: list[str], held: list[tuple[str, str]]):
    """The function of a line and its number that writes a declaration around the line."""

    def write(x, i):
        inside = functools.reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), held, x)
        return F.concat(F.lit(parts[0]), i.cast("string"), F.lit(parts[1]), x, F.lit(parts[2]), inside, F.lit(parts[3]))

    return write


@query("extract_coverage", _coverage_sql())
def extract_coverage(spark, sf_dir):
    """Every line is in a snippet or in the rest, whatever characters the texts hold."""
    lines = F.transform(F.split("text", "\n"), lambda x: F.replace(x, F.lit("\r"), F.lit(" ")))
    number = F.col("doc_id") % 4
    text, suffix = F.lit(None), F.lit(None)
    for n, (language, (head, *parts)) in enumerate(LAYOUT.items()):
        part = _declaration(parts, HELD[language])
        text = F.when(number == n, F.concat(F.lit(head), F.array_join(F.transform(lines, part), "\n"))).otherwise(text)
        suffix = F.when(number == n, F.lit(language)).otherwise(suffix)
    sources = files(spark, sf_dir, spread=True).select(F.concat(F.lit("/cover/"), "doc_id", F.lit("."), suffix).alias("path"), text.alias("text"))
    found = E.extract_snippets(sources, rest=True)
    places = [F.col(c).cast("long").alias(c) for c in ("start_line", "end_line")]
    return found.select("path", F.regexp_extract("path", "[.]([a-z]+)$", 1).alias("language"), "member_name", *places, F.md5("code").alias("code_md5"))
