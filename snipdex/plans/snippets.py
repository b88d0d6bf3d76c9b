"""Snippet extraction from source texts that Spark writes around the lines of each document."""

from __future__ import annotations

from pyspark.sql import functions as F

from snipdex.operators import extract as E
from snipdex.operators import runs as N
from snipdex.plans.catalog import query
from snipdex.plans.domain import FILES_SQL, files


def _numbered(lines, write):
    return F.array_join(F.transform(lines, lambda line, i: write(line, i.cast("string"))), "\n")


def _cat(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def code_files(spark, sf_dir):
    """Every document as a source file of its library: one member per line of text."""
    lines = F.transform(F.split("text", "\n"), lambda x: F.regexp_replace(x, "[^\\p{L}0-9 ]", " "))
    name = F.col("doc_id").cast("string")
    python = _cat(
        "class Doc_", name, "(Base):\n",
        _numbered(lines, lambda x, i: _cat("    def part_", i, "(self):\n        s = '", x, "'\n")),
    )
    javascript = _numbered(lines, lambda x, i: _cat("function part_", i, "() {\n  return '", x, "';\n}\n"))
    typescript = F.array_join(
        F.transform(
            lines,
            lambda x, i: F.when(i % 3 == 0, _cat("export interface Part_", i.cast("string"), " {\n  v: '", x, "';\n}\n"))
            .when(i % 3 == 1, _cat("enum Part_", i.cast("string"), " {\n  A = '", x, "'\n}\n"))
            .otherwise(_cat("export const part_", i.cast("string"), " = (a) => {\n  return '", x, "';\n}\n")),
        ),
        "\n",
    )
    members = F.transform(
        lines,
        lambda x, i: F.when(i % 2 == 0, _cat("    public string Part_", i.cast("string"), "()\n    {\n        return \"", x, "\";\n    }\n"))
        .otherwise(_cat("    public string Prop_", i.cast("string"), " { get; set; }\n")),
    )
    csharp = _cat("namespace Demo.Lib;\n\npublic class Doc_", name, "\n{\n", F.array_join(members, "\n"), "}\n")
    code = F.when(F.col("lang") == "en", python).when(F.col("lang") == "fr", javascript).when(F.col("lang") == "de", typescript).otherwise(csharp)
    return files(spark, sf_dir, spread=True).withColumn("text", code)


# Expected snippets, from the layout in which `code_files` writes the lines.
SNIPPETS_SQL = f"""{FILES_SQL},
l AS (SELECT doc_id, library, path, lang, regexp_replace(x, '[^\\p{{L}}0-9 ]', ' ', 'g') AS x, i FROM (
  SELECT doc_id, library, path, lang, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM files)),
members AS (
  SELECT doc_id, library, path, 'python' AS language, '' AS namespace, 'doc_' || doc_id AS class_name, 'part_' || i || ' (Function)' AS member_name,
    '    def part_' || i || '(self):' || chr(10) || '        s = ''' || x || '''' || chr(10) AS code, 2 + 3 * i AS start_line, 4 + 3 * i AS end_line FROM l WHERE lang = 'en'
  UNION ALL SELECT doc_id, library, path, 'python', '', 'Doc_' || doc_id, 'Doc_' || doc_id || ' (Class)', 'class Doc_' || doc_id || '(Base):', 1, 1 FROM files WHERE lang = 'en'
  UNION ALL SELECT doc_id, library, path, 'javascript', '', 'doc_' || doc_id, 'part_' || i || ' (Function)',
    'function part_' || i || '() {{' || chr(10) || '  return ''' || x || ''';' || chr(10) || '}}', 1 + 4 * i, 3 + 4 * i FROM l WHERE lang = 'fr'
  UNION ALL SELECT doc_id, library, path, 'typescript', '', 'doc_' || doc_id,
    CASE i % 3 WHEN 0 THEN 'Part_' || i || ' (Interface)' WHEN 1 THEN 'Part_' || i || ' (Enum)' ELSE 'part_' || i || ' (Arrow Function)' END,
    CASE i % 3 WHEN 0 THEN 'export interface Part_' || i || ' {{' || chr(10) || '  v: ''' || x || ''';' WHEN 1 THEN 'enum Part_' || i || ' {{' || chr(10) || '  A = ''' || x || ''''
      ELSE 'export const part_' || i || ' = (a) => {{' || chr(10) || '  return ''' || x || ''';' END || chr(10) || '}}', 1 + 4 * i, 3 + 4 * i FROM l WHERE lang = 'de'
  UNION ALL SELECT doc_id, library, path, 'csharp', 'Demo.Lib', 'Doc_' || doc_id,
    CASE i % 2 WHEN 0 THEN 'Part_' || i || ' (方法)' ELSE 'Prop_' || i || ' (属性)' END,
    CASE i % 2 WHEN 0 THEN 'public string Part_' || i || '()' || chr(10) || '    {{' || chr(10) || '        return "' || x || '";' || chr(10) || '    }}'
      ELSE 'public string Prop_' || i || ' {{ get; set; }}' END,
    5 + 5 * ((i + 1) // 2) + 2 * (i // 2), 5 + 5 * ((i + 1) // 2) + 2 * (i // 2) + CASE i % 2 WHEN 0 THEN 3 ELSE 0 END FROM l WHERE lang = 'es'
  UNION ALL SELECT doc_id, any_value(library), any_value(path), 'csharp', 'Demo.Lib', 'Doc_' || doc_id, 'Doc_' || doc_id || ' (类)',
    'public class Doc_' || doc_id || chr(10) || '{{' || chr(10) || string_agg(CASE i % 2 WHEN 0 THEN '    public string Part_' || i || '()' || chr(10) || '    {{' || chr(10)
      || '        return "' || x || '";' || chr(10) || '    }}' || chr(10) ELSE '    public string Prop_' || i || ' {{ get; set; }}' || chr(10) END, chr(10) ORDER BY i) || '}}',
    3, 5 + 5 * ((max(i) + 2) // 2) + 2 * ((max(i) + 1) // 2) - 1 FROM l WHERE lang = 'es' GROUP BY doc_id),
snippets AS (SELECT doc_id, library, path, language, namespace, class_name, member_name,
  code, start_line, end_line FROM members)"""


@query(
    "extract_code",
    f"""WITH {SNIPPETS_SQL} SELECT path, language, namespace, class_name, member_name, start_line, end_line, md5(code) AS code_md5 FROM snippets""",
)
def extract_code(spark, sf_dir):
    found = E.extract_snippets(code_files(spark, sf_dir))
    return found.select("path", "language", "namespace", "class_name", "member_name", "start_line", "end_line", F.md5("code").alias("code_md5"))


@query("extract_methods", f"WITH {SNIPPETS_SQL} SELECT path, member_name FROM snippets WHERE member_name LIKE '% (方法)'")
def extract_methods(spark, sf_dir):
    return E.methods_only(E.extract_snippets(code_files(spark, sf_dir))).select("path", "member_name")


@query(
    "extract_totals",
    f"""WITH {SNIPPETS_SQL}, n AS (SELECT library, path, count(*) AS c FROM snippets GROUP BY library, path)
SELECT library, count(*) AS files, sum(c) AS snippets, 0 AS errors, CAST(NULL AS VARCHAR) AS first_error FROM n GROUP BY library""",
)
def extract_totals(spark, sf_dir):
    return N.parse_totals(E.parse_report(code_files(spark, sf_dir), keep=("library",)))


@query(
    "extract_markup",
    f"""WITH {FILES_SQL}, l AS (SELECT doc_id, regexp_replace(x, '[^\\p{{L}}0-9 ]', ' ', 'g') AS x, i FROM (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM files))
SELECT doc_id, 'Block ' || (i + 1) || CASE i % 3 WHEN 0 THEN ' (Code Block)' WHEN 1 THEN ' (Functions Block)' ELSE ' (Razor Block)' END AS member_name,
  2 + 3 * i AS start_line, 4 + 3 * i AS end_line, md5('var s = new {{ t = "' || x || '" }};') AS code_md5 FROM l""",
)
def extract_markup(spark, sf_dir):
    lines = F.transform(F.split("text", "\n"), lambda x: F.regexp_replace(x, "[^\\p{L}0-9 ]", " "))
    blocks = F.transform(
        lines,
        lambda x, i: _cat(
            F.when(i % 3 == 0, "@code ").when(i % 3 == 1, "@functions").otherwise("@"),
            '{\n  var s = new { t = "', x, '" };\n}',
        ),
    )
    pages = files(spark, sf_dir, spread=True).select("doc_id", F.concat(F.lit("/v/doc_"), "doc_id", F.lit(".cshtml")).alias("path"), _cat("<p>page</p>\n", F.array_join(blocks, "\n")).alias("text"))
    found = E.extract_snippets(pages, keep=("doc_id",))
    return found.select("doc_id", "member_name", "start_line", "end_line", F.md5("code").alias("code_md5"))
