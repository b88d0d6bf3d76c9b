"""Path, glob, language and ancestor queries over files and page addresses."""

from __future__ import annotations

from pyspark.sql import functions as F

from snipdex.functions import paths as P
from snipdex.operators import filters, profile, resolve
from snipdex.operators.pattern_table import covered_patterns, filter_by_patterns
from snipdex.plans.catalog import query
from snipdex.plans.domain import FILES_SQL, REGISTRY_SQL, files, load, registry

LANGUAGE_SQL = """CASE lower(regexp_extract(path, '(\\.[^./]+)$', 1)) WHEN '.py' THEN 'python' WHEN '.js' THEN 'javascript'
 WHEN '.ts' THEN 'typescript' WHEN '.cs' THEN 'csharp' ELSE 'unknown' END"""


@query("detect_language", f"WITH {FILES_SQL} SELECT doc_id, {LANGUAGE_SQL} AS language FROM files")
def detect_language(spark, sf_dir):
    return files(spark, sf_dir).select("doc_id", P.detect_language(F.col("path")).alias("language"))


@query(
    "supported_language",
    f"""WITH {FILES_SQL} SELECT {LANGUAGE_SQL} AS language, count(*) AS files,
  max(CASE lang WHEN 'en' THEN 'Python' WHEN 'fr' THEN 'JavaScript' WHEN 'de' THEN 'TypeScript' ELSE 'C#' END) AS display_name
FROM files WHERE lang IN ('en', 'fr', 'de', 'es') GROUP BY 1""",
)
def supported_language(spark, sf_dir):
    counts = filters.supported_only(files(spark, sf_dir)).groupBy("language").agg(F.count(F.lit(1)).alias("files"))
    names = filters.language_dimension(spark).select("language", "display_name")
    return counts.join(names, "language")


@query(
    "glob_filter",
    f"""WITH {FILES_SQL} SELECT doc_id, rel_path FROM files
WHERE (lower(rel_path) LIKE '%.py' OR lower(rel_path) LIKE 'src/core/%.ts' OR lower(rel_path) LIKE '%.js')
  AND NOT ('/' || rel_path LIKE '%/bin/%' OR '/' || rel_path LIKE '%/node_modules/%' OR rel_path LIKE 'logs/%.js')""",
)
def glob_filter(spark, sf_dir):
    listing = files(spark, sf_dir).select("doc_id", "rel_path")
    return filters.glob_filter(listing, ["*.PY", "src/core/*.ts", ".js"], ["bin", "node_modules", "logs/*.js"])


@query(
    "segment_filter",
    f"""WITH {FILES_SQL} SELECT doc_id, rel_path FROM files
WHERE NOT list_has_any(string_split(lower(path), '/'), ['bin', 'obj', 'node_modules'])""",
)
def segment_filter(spark, sf_dir):
    listing = files(spark, sf_dir).select("doc_id", "rel_path", "path")
    return listing.filter(~P.has_segment(F.col("path"), ["BIN", "obj", "node_modules"])).drop("path")


@query(
    "path_filters",
    f"""WITH {FILES_SQL} SELECT doc_id,
  (rel_path LIKE '%.py' OR rel_path LIKE '%.ts') AND rel_path NOT LIKE '%test%' AS watched,
  string_split(rel_path, '/')[-1] LIKE '%.cs%' AND path NOT LIKE '%obj%' AS loosely_matched,
  lang IN ('en', 'fr') AS right_extension, size <= 1000 AS small_enough,
  NOT (string_split(rel_path, '/')[-1] LIKE 'doc_1%') AS custom_ok,
  path LIKE root || '/src/%' AS in_source,
  string_split(rel_path, '/')[-1] AS file_name,
  regexp_replace(string_split(rel_path, '/')[-1], '\\.[^.]*$', '') AS stem,
  regexp_replace(path, '/[^/]*$', '') AS parent
FROM files""",
)
def path_filters(spark, sf_dir):
    listing = files(spark, sf_dir)
    path, rel = F.col("path"), F.col("rel_path")
    return listing.select(
        "doc_id",
        P.watch_match(rel, ["*.py", ".ts"], ["Test"]).alias("watched"),
        P.contains_match(path, ["*.cs"], ["obj"]).alias("loosely_matched"),
        P.has_extension(rel, [".py", ".JS"]).alias("right_extension"),
        (F.col("size") <= 1000).alias("small_enough"),
        (~rel.rlike(P.glob_regex(["**/doc_1*"]))).alias("custom_ok"),
        P.is_subdirectory(path, F.concat("root", F.lit("/src/"))).alias("in_source"),
        P.file_name(rel).alias("file_name"),
        P.file_stem(rel).alias("stem"),
        P.parent_path(path).alias("parent"),
    )


@query(
    "size_custom_filter",
    f"""WITH {FILES_SQL} SELECT doc_id, size FROM files
WHERE size <= 2000 AND rel_path NOT LIKE 'docs/%' AND NOT (string_split(rel_path, '/')[-1] LIKE '%7.py')""",
)
def size_custom_filter(spark, sf_dir):
    listing = filters.size_filter(files(spark, sf_dir).select("doc_id", "size", "rel_path"), 2000)
    rules = [
        {"name": "docs", "pattern": "docs/**", "enabled": True},
        {"name": "sevens", "pattern": "*7.py", "enabled": True},
        {"name": "off", "pattern": "*", "enabled": False},
    ]
    return filters.custom_pattern_filter(listing, rules).drop("rel_path")


@query(
    "collection_name",
    f"""WITH {FILES_SQL} SELECT path, 'code_index_' || substr(sha256(lower(path)), 1, 8) AS collection,
  lower(path) AS normalized FROM files""",
)
def collection_name(spark, sf_dir):
    listing = files(spark, sf_dir).select("path", "root", "rel_path")
    # A messy spelling of the same path must give the same collection.
    messy = F.concat("root", F.lit("\\.\\x\\..\\"), F.upper("rel_path"))
    return listing.select(
        "path", P.collection_name(messy).alias("collection"), P.normalize_path(messy).alias("normalized")
    )


@query(
    "relative_path",
    f"""WITH {FILES_SQL} SELECT doc_id, rel_path AS relative,
  CASE WHEN rel_path LIKE 'src/%' THEN len(string_split(rel_path, '/')) - 1 ELSE -1 END AS depth_in_source,
  len(string_split(rel_path, '/')) AS depth FROM files""",
)
def relative_path(spark, sf_dir):
    path, root = F.col("path"), F.col("root")
    return files(spark, sf_dir).select(
        "doc_id",
        P.relative_path(path, root).alias("relative"),
        P.directory_depth(path, F.concat(root, F.lit("/src"))).alias("depth_in_source"),
        P.directory_depth(path, root).alias("depth"),
    )


HOST = "^https?://([^/?#]+)"
REST = "^https?://[^/?#]+([^?#]*)"


def _page_paths(spark, sf_dir):
    url = F.col("url")
    rest = F.rtrim(F.regexp_extract(url, REST, 1), F.lit("/"))
    host = F.regexp_extract(url, HOST, 1)
    return load(spark, sf_dir, "pages").select(
        "page_id", F.concat(F.lit("/"), host, rest).alias("path"), host.alias("host"), rest.alias("rest")
    )


PAGE_PATHS_SQL = f"""p AS (SELECT page_id, '/' || regexp_extract(url, '{HOST}', 1) ||
    rtrim(regexp_extract(url, '{REST}', 1), '/') AS path,
  regexp_extract(url, '{HOST}', 1) AS host, regexp_extract(url, '{REST}', 1) AS rest FROM pages),
libs AS (SELECT DISTINCT '/' || host AS root FROM p WHERE host NOT LIKE 'm.%'
         UNION SELECT DISTINCT '/' || host || '/' || string_split(rest, '/')[2] FROM p WHERE host LIKE 'blog.%')"""


def _page_libraries(spark, sf_dir):
    pages = _page_paths(spark, sf_dir)
    hosts = pages.filter(~F.col("host").startswith("m.")).select(F.concat(F.lit("/"), "host").alias("root"))
    blogs = pages.filter(F.col("host").startswith("blog.")).select(
        F.concat(F.lit("/"), "host", F.lit("/"), F.get(F.split("rest", "/"), F.lit(1))).alias("root")
    )
    return hosts.union(blogs).distinct()


@query(
    "nearest_ancestor",
    f"""WITH {PAGE_PATHS_SQL}
SELECT p.page_id, arg_max(l.root, length(l.root)) AS nearest_root FROM p
LEFT JOIN libs l ON p.path = l.root OR starts_with(p.path, l.root || '/') GROUP BY p.page_id""",
)
def nearest_ancestor(spark, sf_dir):
    pages = _page_paths(spark, sf_dir).select("page_id", "path")
    found = resolve.nearest_ancestor(pages, _page_libraries(spark, sf_dir))
    return found.select("page_id", "nearest_root")


@query(
    "search_ready",
    f"""WITH {FILES_SQL}, {REGISTRY_SQL}
SELECT f.doc_id, r.name AS library, CASE WHEN r.name IS NULL THEN 'no library'
    WHEN lower(r.status) <> 'completed' THEN 'status ' || lower(r.status) END AS reason,
  r.name IS NOT NULL AND lower(r.status) = 'completed' AS ready, r.name IS NOT NULL AS from_parent
FROM files f LEFT JOIN registry r ON r.codebase_path = f.root AND r.is_active""",
)
def search_ready(spark, sf_dir):
    libraries = registry(spark, sf_dir).filter("is_active").select(F.col("codebase_path").alias("root"), "name", "status")
    asked = files(spark, sf_dir).select("doc_id", "path")
    return resolve.search_readiness(asked, libraries).select("doc_id", "library", "reason", "ready", "from_parent")


@query(
    "file_profile",
    f"""WITH {FILES_SQL} SELECT library, lower(regexp_extract(rel_path, '(\\.[^./]+)$', 1)) AS extension,
  count(*) AS files, sum(size) AS bytes FROM files GROUP BY 1, 2""",
)
def file_profile(spark, sf_dir):
    return profile.file_type_profile(files(spark, sf_dir))


# Folders above each file, by the fixed folder list of the derived files.
FOLDERS_SQL = """folders AS (SELECT DISTINCT library, d FROM (
  SELECT library, unnest([regexp_replace(rel_path, '/[^/]*$', ''), string_split(rel_path, '/')[1]]) AS d FROM files))"""


@query(
    "structure_advice",
    f"""WITH {FILES_SQL}, {FOLDERS_SQL},
t AS (SELECT library, count(*) AS total_files, sum(size) AS total_bytes FROM files GROUP BY library),
g AS (SELECT library, count(*) AS directories, bool_or(d LIKE '%test%') AS has_tests, bool_or(d LIKE '%doc%') AS has_docs,
        concat_ws(',', CASE WHEN bool_or(d = 'node_modules') THEN 'node_modules' END,
                  CASE WHEN bool_or(d = 'bin') THEN 'bin' END, CASE WHEN bool_or(d = 'obj') THEN 'obj' END) AS excludes
      FROM folders GROUP BY library)
SELECT t.library, total_files, total_bytes, directories, has_tests, has_docs, excludes,
  concat_ws(',', CASE WHEN total_files > 8 THEN 'add_excludes' END, CASE WHEN total_bytes > 10000 THEN 'lower_size_limit' END) AS advice
FROM t JOIN g ON t.library = g.library""",
)
def structure_advice(spark, sf_dir):
    facts = profile.structure_profile(files(spark, sf_dir))
    lowered = profile.structure_advice(many=8, large=10_000)
    return facts.select(
        "library", "total_files", "total_bytes", "directories", "has_tests", "has_docs",
        F.array_join("suggested_excludes", ",").alias("excludes"), F.array_join(lowered, ",").alias("advice"),
    )


def _with_markers(spark, sf_dir):
    """The derived files plus one marker file at the top of two thirds of the libraries."""
    listing = files(spark, sf_dir).select("library", "rel_path", "size")
    n = F.substring("library", 4, 10).cast("int") % 6
    marker = (
        F.when(n == 0, "package.json").when(n == 1, "go.mod").when(n == 2, "app.csproj").when(n == 3, "setup.py")
    )
    marks = listing.select("library").distinct().select("library", marker.alias("rel_path"), F.lit(1).cast("long").alias("size"))
    return listing.unionByName(marks.filter("rel_path IS NOT NULL"))


DETECT_SQL = f"""WITH {FILES_SQL}, c AS (
  SELECT library, CAST(substr(library, 4) AS INTEGER) % 6 AS n, count(*) FILTER (lang = 'es') AS cs,
    count(*) FILTER (lang = 'de') AS ts, count(*) FILTER (lang = 'fr') AS js,
    count(*) FILTER (lang = 'en') + CASE WHEN CAST(substr(library, 4) AS INTEGER) % 6 = 3 THEN 1 ELSE 0 END AS py
  FROM files GROUP BY library),
s AS (
  SELECT library, 0 AS place, 'csharp' AS kind, least(0.5, cs * 0.01) + CASE WHEN n = 2 THEN 0.8 ELSE 0 END AS score FROM c UNION ALL
  SELECT library, 1, 'typescript', least(0.6, ts * 0.01) + CASE WHEN n = 0 THEN 0.3 ELSE 0 END FROM c UNION ALL
  SELECT library, 2, 'javascript', least(0.5, js * 0.01) + CASE WHEN n = 0 THEN 0.6 ELSE 0 END FROM c UNION ALL
  SELECT library, 3, 'python', least(0.6, py * 0.01) + CASE WHEN n = 3 THEN 0.4 ELSE 0 END FROM c UNION ALL
  SELECT library, 6, 'go', CASE WHEN n = 1 THEN 0.8 ELSE 0 END FROM c),
v AS (SELECT library, place, kind, round(least(1.0, CAST(score AS DOUBLE)), 6) AS score FROM s WHERE score > 0),
r AS (SELECT *, max(score) OVER (PARTITION BY library) AS top,
        row_number() OVER (PARTITION BY library ORDER BY score DESC, place) AS rank FROM v)
SELECT library, CASE WHEN count(*) FILTER (score >= round(top * 0.8, 6)) > 1 THEN 'mixed' ELSE arg_min(kind, rank) END AS project_type,
  round(avg(score) FILTER (score >= round(top * 0.8, 6)), 6) AS confidence,
  coalesce(string_agg(kind, ',' ORDER BY rank) FILTER (rank BETWEEN 2 AND 4), '') AS alternatives
FROM r GROUP BY library"""


@query("detect_type", DETECT_SQL)
def detect_type(spark, sf_dir):
    found = profile.detect_project_type(_with_markers(spark, sf_dir))
    return found.select("library", "project_type", "confidence", F.array_join("alternatives", ",").alias("alternatives"))


@query(
    "detect_type_light",
    """SELECT source AS library, CASE CAST(substr(source, 4) AS INTEGER) % 6 WHEN 0 THEN 'typescript' WHEN 2 THEN 'csharp'
  ELSE 'mixed' END AS project_type FROM documents GROUP BY source""",
)
def detect_type_light(spark, sf_dir):
    return profile.detect_by_marker(_with_markers(spark, sf_dir))


# Includes and excludes of the libraries by their number; what they keep is written out in the SQL.
INCLUDES = [["*.py", "*.ts"], ["src/**"], ["**/doc_*.js", "tests/*"]]
EXCLUDES = [["node_modules", "bin", "**/*9.ts"], ["**/core/**"]]


def _library_patterns(rows):
    """A table of patterns (library, kind, pattern): every library has the sets of its number."""
    number = F.regexp_extract("library", "([0-9]+)", 1).cast("int")
    libraries = rows.select("library").distinct().withColumn("n", F.coalesce(number, F.lit(0)))

    def sets(kind, lists):
        patterns = F.element_at(F.array(*(F.array(*(F.lit(p) for p in some)) for some in lists)), (F.col("n") % len(lists) + 1).cast("int"))
        return libraries.select("library", F.lit(kind).alias("kind"), F.explode(patterns).alias("pattern"))

    return sets("include", INCLUDES).unionByName(sets("exclude", EXCLUDES))


@query(
    "library_patterns",
    f"""WITH {FILES_SQL}, f AS (SELECT *, coalesce(TRY_CAST(regexp_extract(library, '([0-9]+)', 1) AS INTEGER), 0) AS n FROM files)
SELECT library, rel_path FROM f
WHERE CASE n % 3 WHEN 0 THEN rel_path LIKE '%.py' OR rel_path LIKE '%.ts' WHEN 1 THEN rel_path LIKE 'src/%'
    ELSE regexp_matches(rel_path, '(^|/)doc_[^/]*[.]js$') OR regexp_matches(rel_path, '^tests/[^/]*$') END
  AND NOT CASE n % 2 WHEN 0 THEN regexp_matches(rel_path, '(^|/)(node_modules|bin)/') OR rel_path LIKE '%9.ts' ELSE regexp_matches(rel_path, '(^|/)core/') END""",
)
def library_patterns(spark, sf_dir):
    """All files by the patterns of their own library, from a table of patterns."""
    rows = files(spark, sf_dir).select("library", "rel_path")
    return filter_by_patterns(rows, _library_patterns(rows))


# Whether the exclude covers the include, told by hand.
COVERED = [
    ("src/**", "**/*.py", False), ("*.py", "**/*.py", True), ("src/**/*.py", "*.py", False), ("src/**/*.py", "**/*.py", True), ("*.ts", "**/*.tsx", False), ("*.tsx", "**/*.ts*", True),
    ("src/*.js", "src/**", True), ("src/**", "src/*", False), ("**/bin/x.cs", "bin", True), ("bin/**", "**/bin/**", True), ("d?c/*.md", "doc/**", False), ("doc/*.md", "d?c/**", True),
]


@query(
    "pattern_cover",
    f"""WITH c AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{a}', '{b}', {str(c).lower()})" for i, (a, b, c) in enumerate(COVERED))}) AS t(n, pattern, "exclude", covered))
SELECT doc_id AS library, pattern, "exclude" FROM documents JOIN c ON doc_id % {len(COVERED)} = n WHERE covered""",
)
def pattern_cover(spark, sf_dir):
    """Includes that an exclude of the same library covers; every document stands for a library with one of each."""
    pairs = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b, _ in COVERED))
    rows = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("library"), F.element_at(pairs, (F.col("doc_id") % len(COVERED) + 1).cast("int")).alias("p"))
    sides = [rows.select("library", F.lit(kind).alias("kind"), F.col(f"p.{side}").alias("pattern")) for kind, side in (("include", "a"), ("exclude", "b"))]
    return covered_patterns(sides[0].unionByName(sides[1]))


@query(
    "detect_evidence",
    DETECT_SQL[: DETECT_SQL.index("v AS (")]
    + """e AS (
  SELECT library, 'csharp' AS project_type, concat_ws('; ', CASE WHEN n = 2 THEN '*.csproj' END, CASE WHEN cs > 0 THEN cs || ' files .cs' END) AS evidence FROM c UNION ALL
  SELECT library, 'typescript', concat_ws('; ', CASE WHEN n = 0 THEN 'package.json' END, CASE WHEN ts > 0 THEN ts || ' files .ts .tsx' END) FROM c UNION ALL
  SELECT library, 'javascript', concat_ws('; ', CASE WHEN n = 0 THEN 'package.json' END, CASE WHEN js > 0 THEN js || ' files .js' END) FROM c UNION ALL
  SELECT library, 'python', concat_ws('; ', CASE WHEN n = 3 THEN 'setup.py' END, CASE WHEN py > 0 THEN py || ' files .py' END) FROM c UNION ALL
  SELECT library, 'go', CASE WHEN n = 1 THEN 'go.mod' ELSE '' END FROM c)
SELECT library, project_type, evidence FROM e WHERE evidence <> ''""",
)
def detect_evidence(spark, sf_dir):
    """What speaks for each project type of a library, flattened to a row per type."""
    found = profile.evidence_scores(_with_markers(spark, sf_dir)).select("library", F.explode("scores").alias("s"))
    return found.select("library", "s.project_type", F.array_join("s.evidence", "; ").alias("evidence"))
