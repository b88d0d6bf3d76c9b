"""Configuration audits, clean-up, comparison, presets and legacy migration over part and customer."""

from __future__ import annotations

from pyspark.sql import functions as F

from snipdex import schemas
from snipdex.functions import jsonx as J
from snipdex.operators import audit as A
from snipdex.operators import migrate as M
from snipdex.operators import presets as P
from snipdex.operators import registry as R
from snipdex.plans.catalog import query
from snipdex.plans.domain import CONFIGS_SQL, REGISTRY_SQL, TYPES_BY_BRAND, configs, load, registry
from snipdex.session import spread_scan

EXTENSIONS_SQL = "(" + ", ".join(f"'{e}'" for e in A.ALLOWED_EXTENSIONS) + ")"


def unsafe_sql(p: str) -> str:
    parts = [".." if u == ".." else u for u in A.UNSAFE_PARTS]
    return "(" + " OR ".join(f"contains({p}, '{u}')" for u in parts) + ")"


def valid_sql(p: str) -> str:
    return (
        f"(CASE WHEN starts_with({p}, '*.') THEN lower(substr({p}, 2)) IN {EXTENSIONS_SQL} "
        f"ELSE regexp_matches({p}, '^[\\w*?./-]+$') END)"
    )


def name_sql(p: str) -> str:
    return f"(trim({p}) <> '' AND length({p}) <= 50 AND regexp_matches({p}, '^[\\w\\-\\s]+$'))"


def filter_sql(p: str) -> str:
    return f"(trim({p}) <> '' AND length({p}) <= 200 AND NOT {unsafe_sql(p)})"


AUDIT_SQL = f"""{CONFIGS_SQL},
fp AS (SELECT config_id, unnest(file_patterns) AS p FROM configs),
ep AS (SELECT config_id, unnest(exclude_patterns) AS e FROM configs),
cf AS (SELECT config_id, f.name AS name, f.pattern AS pattern FROM (SELECT config_id, unnest(custom_filters) AS f FROM configs)),
findings AS (
  SELECT config_id, 'no file pattern' AS rule, '' AS value FROM configs WHERE len(file_patterns) = 0 UNION ALL
  SELECT config_id, 'blank file pattern', p FROM fp WHERE trim(p) = '' UNION ALL
  SELECT config_id, 'invalid file pattern', p FROM fp WHERE trim(p) <> '' AND NOT {valid_sql('p')} UNION ALL
  SELECT config_id, 'unsafe file pattern', p FROM fp WHERE trim(p) <> '' AND {unsafe_sql('p')} UNION ALL
  SELECT config_id, 'unsafe exclude pattern', e FROM ep WHERE trim(e) <> '' AND {unsafe_sql('e')} UNION ALL
  SELECT config_id, 'size not positive', CAST(max_file_size AS VARCHAR) FROM configs WHERE max_file_size <= 0 UNION ALL
  SELECT config_id, 'size above limit', CAST(max_file_size AS VARCHAR) FROM configs WHERE max_file_size > 104857600 UNION ALL
  SELECT config_id, 'blank filter name', name FROM cf WHERE trim(name) = '' UNION ALL
  SELECT config_id, 'invalid filter name', name FROM cf WHERE trim(name) <> '' AND NOT {name_sql('name')} UNION ALL
  SELECT config_id, 'invalid filter pattern', pattern FROM cf WHERE trim(name) <> '' AND NOT {filter_sql('pattern')} UNION ALL
  SELECT fp.config_id, 'covered by exclude', p || ' by ' || e FROM fp JOIN ep ON fp.config_id = ep.config_id
    WHERE starts_with(p, '*.') AND contains(lower(e), lower(substr(p, 2))))"""


@query("config_audit", f"WITH {AUDIT_SQL} SELECT config_id, rule, value FROM findings")
def config_audit(spark, sf_dir):
    return A.audit_watch(configs(spark, sf_dir))


CLEAN_SQL = f"""{CONFIGS_SQL}, cleaned AS (SELECT config_id,
  list_filter(list_transform(file_patterns, lambda p: trim(p)), lambda p: p <> '' AND NOT {unsafe_sql('p')} AND {valid_sql('p')}) AS fps,
  list_filter(list_transform(exclude_patterns, lambda p: trim(p)), lambda p: p <> '' AND NOT {unsafe_sql('p')}) AS eps,
  list_filter(custom_filters, lambda f: {name_sql('f.name')} AND {filter_sql('f.pattern')}) AS cfs,
  file_patterns, exclude_patterns, custom_filters, max_file_size FROM configs),
d AS (SELECT *, list_filter(fps, lambda p, i: list_position(fps, p) = i) AS fpd, list_filter(eps, lambda p, i: list_position(eps, p) = i) AS epd FROM cleaned)"""


@query(
    "config_clean",
    f"""WITH {CLEAN_SQL} SELECT config_id, array_to_string(fpd, ',') AS patterns, array_to_string(epd, ',') AS excludes,
  len(cfs) AS filters, least(max_file_size, 104857600) AS max_file_size,
  len(file_patterns) - len(fps) + len(exclude_patterns) - len(eps) + len(custom_filters) - len(cfs) AS removed,
  fpd <> file_patterns OR epd <> exclude_patterns OR max_file_size > 104857600 AS changed FROM d""",
)
def config_clean(spark, sf_dir):
    rows = A.clean_config(configs(spark, sf_dir))
    return rows.select(
        "config_id", F.array_join("file_patterns", ",").alias("patterns"), F.array_join("exclude_patterns", ",").alias("excludes"),
        F.size("custom_filters").alias("filters"), "max_file_size", F.size("removed").alias("removed"), "changed",
    )


def _newer(spark, sf_dir):
    """A second version of the configurations: one more pattern, other excludes, flags and sizes in places."""
    key = F.col("config_id")
    return configs(spark, sf_dir).withColumns(
        {
            "file_patterns": F.when(key % 2 == 0, F.array_append("file_patterns", F.lit("*.md"))).otherwise(F.col("file_patterns")),
            "exclude_patterns": F.when(key % 3 == 0, F.filter("exclude_patterns", lambda e: e != "bin")).otherwise(F.col("exclude_patterns")),
            "is_enabled": F.when(key % 5 == 0, ~F.col("is_enabled")).otherwise(F.col("is_enabled")),
            "max_file_size": F.when(key % 7 == 0, F.col("max_file_size") + 1).otherwise(F.col("max_file_size")),
            "include_subdirectories": F.when(key % 11 == 0, ~F.col("include_subdirectories")).otherwise(F.col("include_subdirectories")),
        }
    )


@query(
    "config_diff",
    f"""WITH {CONFIGS_SQL} SELECT config_id, 'FilePatterns' AS property, array_to_string(file_patterns, ',') AS old,
  array_to_string(list_append(file_patterns, '*.md'), ',') AS new, '*.md' AS added, '' AS removed FROM configs WHERE config_id % 2 = 0
UNION ALL SELECT config_id, 'ExcludePatterns', array_to_string(exclude_patterns, ','),
  array_to_string(list_filter(exclude_patterns, lambda e: e <> 'bin'), ','), '', 'bin' FROM configs WHERE config_id % 3 = 0 AND list_contains(exclude_patterns, 'bin')
UNION ALL SELECT config_id, 'IsEnabled', CAST(is_enabled AS VARCHAR), CAST(NOT is_enabled AS VARCHAR), '', '' FROM configs WHERE config_id % 5 = 0
UNION ALL SELECT config_id, 'MaxFileSize', CAST(max_file_size AS VARCHAR), CAST(max_file_size + 1 AS VARCHAR), '', '' FROM configs WHERE config_id % 7 = 0
UNION ALL SELECT config_id, 'IncludeSubdirectories', CAST(include_subdirectories AS VARCHAR), CAST(NOT include_subdirectories AS VARCHAR), '', ''
  FROM configs WHERE config_id % 11 = 0""",
)
def config_diff(spark, sf_dir):
    rows = A.diff_configs(configs(spark, sf_dir), _newer(spark, sf_dir))
    return rows.withColumns({c: F.array_join(c, ",") for c in ("added", "removed")})


COMMON_SQL = """CASE project_type WHEN 'csharp' THEN ['.git','node_modules','bin','obj','.vs'] WHEN 'typescript' THEN ['.git','node_modules','dist','build']
  WHEN 'javascript' THEN ['.git','node_modules','dist','build'] WHEN 'python' THEN ['.git','node_modules','__pycache__','.venv','venv']
  WHEN 'java' THEN ['.git','node_modules','target','build'] ELSE ['.git','node_modules'] END"""


@query(
    "suggest_excludes",
    f"""WITH {CONFIGS_SQL}, m AS (SELECT config_id, list_filter({COMMON_SQL}, lambda c: NOT list_contains(exclude_patterns, c)) AS missing FROM configs)
SELECT config_id, 'info: add excludes' AS rule, array_to_string(missing, ',') AS value FROM m WHERE len(missing) > 0
UNION ALL SELECT config_id, 'warning: add file patterns', CASE project_type WHEN 'csharp' THEN '*.cs,*.csx' WHEN 'typescript' THEN '*.ts,*.tsx'
  WHEN 'javascript' THEN '*.js,*.jsx' WHEN 'python' THEN '*.py' WHEN 'java' THEN '*.java' ELSE '*.cs' END FROM configs WHERE len(file_patterns) = 0
UNION ALL SELECT config_id, 'warning: lower the size limit', '10485760' FROM configs WHERE max_file_size > 52428800""",
)
def suggest_excludes(spark, sf_dir):
    return A.suggestions(configs(spark, sf_dir))


@query(
    "list_set_ops",
    f"""WITH {CONFIGS_SQL} SELECT config_id, len(list_distinct(file_patterns)) AS distinct_patterns,
  array_to_string(list_filter(['*.cs', '*.md'], lambda p: NOT list_contains(file_patterns, p)), ',') AS added,
  len(list_filter(list_distinct(file_patterns), lambda p: p NOT IN ('*.cs', '*.md'))) AS removed FROM configs""",
)
def list_set_ops(spark, sf_dir):
    added, removed = A.list_difference(F.col("file_patterns"), A.strings(["*.cs", "*.md"]))
    return configs(spark, sf_dir).select(
        "config_id", F.size(F.array_distinct("file_patterns")).alias("distinct_patterns"),
        F.array_join(added, ",").alias("added"), F.size(removed).alias("removed"),
    )


@query(
    "preset_merge",
    f"""WITH {CONFIGS_SQL},
u AS (SELECT preset_group, config_id, 'file_patterns' AS kind, unnest(file_patterns) AS pattern, generate_subscripts(file_patterns, 1) AS i FROM configs
  UNION ALL SELECT preset_group, config_id, 'exclude_patterns', unnest(exclude_patterns), generate_subscripts(exclude_patterns, 1) FROM configs),
f AS (SELECT preset_group, kind, pattern, min(config_id * 1000 + i) AS seen FROM u GROUP BY 1, 2, 3),
l AS (SELECT preset_group, string_agg(pattern, ',' ORDER BY seen) FILTER (kind = 'file_patterns') AS patterns,
  string_agg(pattern, ',' ORDER BY seen) FILTER (kind = 'exclude_patterns') AS excludes FROM f GROUP BY 1)
SELECT c.preset_group, coalesce(any_value(l.patterns), '') AS patterns, coalesce(any_value(l.excludes), '') AS excludes,
  arg_max(is_enabled, config_id) AS is_enabled, arg_max(include_subdirectories, config_id) AS include_subdirectories,
  arg_max(max_file_size, config_id) AS max_file_size FROM configs c LEFT JOIN l ON c.preset_group = l.preset_group GROUP BY c.preset_group""",
)
def preset_merge(spark, sf_dir):
    merged = P.merge_presets(configs(spark, sf_dir), "preset_group", "config_id")
    return merged.select(
        "preset_group", F.array_join("file_patterns", ",").alias("patterns"), F.array_join("exclude_patterns", ",").alias("excludes"),
        "is_enabled", "include_subdirectories", "max_file_size",
    )


def _custom(spark, sf_dir):
    """Every part is a custom preset, tagged with the type that follows its own."""
    ring = {a: b for a, b in zip(TYPES_BY_BRAND, TYPES_BY_BRAND[1:] + TYPES_BY_BRAND[:1])}
    follow = F.element_at(F.create_map(*[F.lit(x) for kv in ring.items() for x in kv]), F.col("project_type"))
    return configs(spark, sf_dir).select(
        F.concat(F.lit("Preset_"), F.col("config_id").cast("string")).alias("preset_id"), "name",
        F.initcap("project_type").alias("project_type"), F.lit(False).alias("is_built_in"), F.array(follow).alias("tags"),
        "file_patterns", "exclude_patterns", "include_subdirectories", "is_enabled", "max_file_size",
    )


BUILT_SQL = "built AS (SELECT * FROM (VALUES " + ", ".join(f"('{b[0]}', '{b[1]}')" for b in P.BUILT_IN) + ") AS t(preset_id, name))"
NEXT_SQL = "(['typescript','javascript','python','java','other','csharp'])[list_position(['csharp','typescript','javascript','python','java','other'], project_type)]"


@query(
    "preset_match",
    f"""WITH {CONFIGS_SQL}, {BUILT_SQL},
offers AS (SELECT preset_id, name, true AS is_built_in, preset_id AS asked FROM built UNION ALL
  SELECT preset_id, name, true, 'built-in' FROM built UNION ALL
  SELECT 'Preset_' || config_id, name, false, project_type FROM configs UNION ALL
  SELECT 'Preset_' || config_id, name, false, {NEXT_SQL} FROM configs),
r AS (SELECT *, row_number() OVER (PARTITION BY asked ORDER BY is_built_in DESC, name, preset_id) AS place FROM offers
      WHERE asked IN (SELECT project_type FROM configs))
SELECT asked, place, preset_id, name, is_built_in FROM r WHERE place <= 3""",
)
def preset_match(spark, sf_dir):
    presets = P.all_presets(spark, _custom(spark, sf_dir))
    return P.recommend(configs(spark, sf_dir), presets).select("asked", "place", "preset_id", "name", "is_built_in")


@query(
    "preset_lookup",
    f"""WITH {CONFIGS_SQL}, {BUILT_SQL}, asked AS (SELECT config_id, 'preset_' || (config_id * 2) AS id FROM configs UNION ALL
  SELECT config_id, upper(project_type) FROM configs),
p AS (SELECT preset_id, name FROM built UNION ALL SELECT 'Preset_' || config_id, name FROM configs)
SELECT config_id, preset_id, p.name FROM asked JOIN p ON lower(asked.id) = lower(p.preset_id)""",
)
def preset_lookup(spark, sf_dir):
    rows = configs(spark, sf_dir)
    doubled = rows.select("config_id", F.concat(F.lit("preset_"), (F.col("config_id") * 2).cast("string")).alias("preset_id"))
    typed = rows.select("config_id", F.upper("project_type").alias("preset_id"))
    presets = P.all_presets(spark, _custom(spark, sf_dir))
    return P.lookup(doubled.unionByName(typed), presets).select("config_id", "preset_id", "name")


@query(
    "preset_audit",
    f"""WITH {CONFIGS_SQL}, p AS (SELECT config_id, CASE WHEN config_id % 9 = 0 THEN ' ' ELSE name END AS name,
  CASE WHEN config_id % 10 <> 0 THEN file_patterns END AS fp, max_file_size, CASE WHEN config_id % 8 <> 0 THEN project_type END AS pt FROM configs)
SELECT config_id, 'blank name' AS rule, '' AS value FROM p WHERE trim(name) = '' UNION ALL
SELECT config_id, 'no watch configuration', '' FROM p WHERE fp IS NULL UNION ALL
SELECT config_id, 'no file pattern', '' FROM p WHERE len(fp) = 0 UNION ALL
SELECT config_id, 'size not positive', '0' FROM p WHERE fp IS NOT NULL AND max_file_size <= 0 UNION ALL
SELECT config_id, 'no metadata', '' FROM p WHERE pt IS NULL""",
)
def preset_audit(spark, sf_dir):
    key = F.col("config_id")
    rows = configs(spark, sf_dir).withColumns(
        {
            "name": F.when(key % 9 == 0, " ").otherwise(F.col("name")),
            "file_patterns": F.when(key % 10 != 0, F.col("file_patterns")),
            "project_type": F.when(key % 8 != 0, F.col("project_type")),
        }
    )
    return A.audit_presets(rows)


@query(
    "metadata_audit",
    f"""WITH {CONFIGS_SQL}, m AS (SELECT config_id, name, project_type AS pt, max_file_size,
  CASE config_id % 5 WHEN 0 THEN 'urgent' WHEN 1 THEN 'HIGH' WHEN 2 THEN '' ELSE 'low' END AS pr FROM configs)
SELECT config_id, 'blank project type' AS rule, '' AS value FROM m WHERE config_id % 13 = 0 UNION ALL
SELECT config_id, 'unknown project type', pt FROM m WHERE pt = 'other' AND config_id % 13 <> 0 UNION ALL
SELECT config_id, 'unknown priority', pr FROM m WHERE pr = 'urgent' UNION ALL
SELECT config_id, 'invalid tag', name FROM m WHERE contains(name, ' ') UNION ALL
SELECT config_id, 'long tag', repeat(substr(name, 1, 3), 20) FROM m WHERE config_id % 4 = 0 UNION ALL
SELECT config_id, 'invalid tag', repeat(substr(name, 1, 3), 20) FROM m WHERE config_id % 4 = 0 AND contains(substr(name, 1, 3), ' ') UNION ALL
SELECT config_id, 'blank tag', ' ' FROM m WHERE config_id % 6 = 0 UNION ALL
SELECT config_id, 'blank setting key', '' FROM m WHERE config_id % 17 = 0 UNION ALL
SELECT config_id, 'long setting key', repeat('k', 101) FROM m WHERE config_id % 19 = 0 UNION ALL
SELECT config_id, 'large setting value', 'owner' FROM m WHERE config_id % 23 = 0""",
)
def metadata_audit(spark, sf_dir):
    key, name = F.col("config_id"), F.col("name")
    priority = F.when(key % 5 == 0, "urgent").when(key % 5 == 1, "HIGH").when(key % 5 == 2, "").otherwise("low")
    tags = F.array_compact(
        F.array(F.lit("ok.tag"), name, F.when(key % 4 == 0, F.repeat(F.substring(name, 1, 3), 20)), F.when(key % 6 == 0, " "))
    )
    owner = F.when(key % 23 == 0, F.repeat(F.lit("v"), 10001)).otherwise(name)
    second = F.when(key % 17 == 0, "").when(key % 19 == 0, F.repeat(F.lit("k"), 101)).otherwise("other")
    third = F.when((key % 17 == 0) & (key % 19 == 0), F.repeat(F.lit("k"), 101)).otherwise("third")
    settings = F.create_map(F.lit("owner"), owner, second, F.lit("1"), third, F.lit("2"))
    rows = configs(spark, sf_dir).select(
        "config_id", F.when(key % 13 != 0, F.col("project_type")).alias("project_type"), priority.alias("priority"),
        tags.alias("tags"), settings.alias("custom_settings"),
    )
    return A.audit_metadata(rows)


@query(
    "config_json_audit",
    """SELECT config_id, 'blank JSON' AS rule, '' AS value FROM (SELECT p_partkey AS config_id FROM part) WHERE config_id % 10 = 0 UNION ALL
SELECT p_partkey, 'invalid JSON', '' FROM part WHERE p_partkey % 10 = 1 UNION ALL
SELECT p_partkey, 'JSON too deep', '12' FROM part WHERE p_partkey % 10 = 2""",
)
def config_json_audit(spark, sf_dir):
    key = F.col("config_id")
    good = F.to_json(F.struct("file_patterns", "custom_filters"))
    deep = F.concat(F.lit("[" * 11), F.lit('{"a": 1}'), F.lit("]" * 11))
    doc = F.when(key % 10 == 0, "  ").when(key % 10 == 1, F.concat(good, F.lit("]"))).when(key % 10 == 2, deep).otherwise(good)
    return A.audit_json(configs(spark, sf_dir).select("config_id", doc.alias("doc")), "doc")


@query(
    "apply_config",
    f"""WITH {AUDIT_SQL}, w AS (SELECT config_id FROM configs WHERE config_id % 2 = 0),
bad AS (SELECT DISTINCT f.config_id FROM findings f JOIN w ON f.config_id = w.config_id)
SELECT c.config_id, w.config_id IS NOT NULL AND b.config_id IS NULL AS backed_up,
  CASE WHEN w.config_id IS NOT NULL AND b.config_id IS NULL THEN NOT is_enabled ELSE is_enabled END AS is_enabled
FROM configs c LEFT JOIN w ON c.config_id = w.config_id LEFT JOIN bad b ON c.config_id = b.config_id""",
)
def apply_config(spark, sf_dir):
    current = configs(spark, sf_dir)
    wanted = current.filter("config_id % 2 = 0").withColumn("is_enabled", ~F.col("is_enabled"))
    applied, backup, _ = A.apply_configs(current, wanted)
    kept = backup.select("config_id", F.lit(True).alias("backed_up"))
    return applied.join(kept, "config_id", "left").select(
        "config_id", F.coalesce("backed_up", F.lit(False)).alias("backed_up"), "is_enabled"
    )


@query(
    "recommended_settings",
    f"""WITH {REGISTRY_SQL} SELECT id, CASE id % 3 WHEN 0 THEN 'csharp' WHEN 1 THEN 'python' ELSE 'cobol' END AS project_type,
  CASE id % 3 WHEN 0 THEN 'dotnet' WHEN 1 THEN 'python' ELSE 'mixed' END AS framework,
  CASE id % 3 WHEN 0 THEN 4 WHEN 1 THEN 4 ELSE 9 END AS patterns, 'normal' AS priority FROM registry""",
)
def recommended_settings(spark, sf_dir):
    kind = F.when(F.col("id") % 3 == 0, "csharp").when(F.col("id") % 3 == 1, "python").otherwise("cobol")
    types = registry(spark, sf_dir).select("id", kind.alias("project_type"))
    rows = P.recommended_settings(types, spark)
    return rows.select("id", "project_type", "framework", F.size("file_patterns").alias("patterns"), "priority")


def _legacy_documents(spark, sf_dir):
    """One legacy document per customer, with two mappings and three settings."""
    key = F.col("c_custkey")
    text = key.cast("string")

    def mapping(n: int):
        name = F.concat(F.lit(f"m{n}_"), text)
        seconds = F.when(key % 3 == n, F.concat(text, F.lit("s"))).when(key % 3 == 1 - n, F.concat(text, F.lit("ms")))
        status = F.get(F.array(*[F.lit(s) for s in ("COMPLETED", "failed", "Indexing", "cancelled", "odd")]), (key % 5).cast("int"))
        watcher = F.struct(
            F.array(F.lit("*.py"), F.lit("*.js")).alias("fileExtensions"), F.array(F.lit("dist")).alias("excludeDirectories"),
            F.lit(False).alias("includeSubdirectories"),
        )
        return F.struct(
            F.concat(F.lit("id"), name).alias("id"), name.alias("friendlyName"), F.concat(F.lit("/repo/"), name).alias("codebasePath"),
            F.concat(F.lit("code_index_"), name).alias("collectionName"), status.alias("indexingStatus"),
            (key % 2 == n).alias("isMonitoring"), F.lit("2024-01-01T00:00:00Z").alias("createdAt"),
            F.when(key % 4 != 0, "2024-02-01T00:00:00Z").alias("lastIndexed"), F.when(key % 2 == 0, watcher).alias("watcherConfig"),
            F.struct((key % 100).cast("int").alias("totalFiles"), (key % 100 * 3).cast("int").alias("indexedSnippets"), seconds.alias("lastIndexingDuration")).alias("statistics"),
        )

    settings = F.struct((key % 10).alias("retries"), F.col("c_name").alias("owner"), F.struct(F.lit(True).alias("deep")).alias("options"))
    document = F.to_json(F.struct(F.array(mapping(0), mapping(1)).alias("codebaseMappings"), settings.alias("globalSettings")))
    # A row of a small file stands for a long document: a few splits would keep a few cores busy.
    text_rows = spread_scan(load(spark, sf_dir, "customer"), "c_custkey").select("c_custkey", document.alias("doc"))
    return text_rows.select("c_custkey", F.from_json("doc", schemas.as_struct(schemas.LEGACY_CONFIG)).alias("d")).select("c_custkey", "d.*")


@query(
    "legacy_migration",
    """WITH m AS (SELECT c_custkey AS k, unnest([0, 1]) AS n FROM customer),
d AS (SELECT k, n, 'm' || n || '_' || k AS name, CASE k % 3 WHEN n THEN CAST(k AS DOUBLE) WHEN 1 - n THEN k / 1000.0 ELSE 0 END AS duration FROM m)
SELECT name, (['Completed','Failed','Indexing','Cancelled','Pending'])[CAST(k % 5 + 1 AS INTEGER)] AS status, k % 2 = n AS is_enabled,
  CASE WHEN k % 2 = 0 THEN '*.py,*.js' ELSE '*.cs' END AS patterns, CASE WHEN k % 2 = 0 THEN 'dist' ELSE 'bin,obj,.git' END AS excludes,
  duration, CASE WHEN k % 4 <> 0 AND duration > 0 THEN 1 ELSE 0 END AS runs, k % 100 AS total_files, k % 100 AS csharp_files, k % 100 * 3 AS indexed_snippets,
  'migrated,legacy' AS tags, 'id' || name AS original_id FROM d""",
)
def legacy_migration(spark, sf_dir):
    rows = R.parse(M.migrate_libraries(_legacy_documents(spark, sf_dir), "2024-06-01 00:00:00"))
    return rows.select(
        "name", "status", F.col("watch.isEnabled").alias("is_enabled"), F.array_join("watch.filePatterns", ",").alias("patterns"),
        F.array_join("watch.excludePatterns", ",").alias("excludes"), F.col("stats.lastIndexingDuration").alias("duration"),
        F.size("stats.indexingHistory").alias("runs"), "total_files", F.element_at("stats.languageDistribution", "csharp").alias("csharp_files"),
        "indexed_snippets", F.array_join("meta.tags", ",").alias("tags"), F.element_at("meta.customSettings", "originalId").alias("original_id"),
    )


@query(
    "legacy_settings",
    """SELECT 'retries' AS key, CAST(c_custkey % 10 AS VARCHAR) AS value_json, 'number' AS type FROM customer UNION ALL
SELECT 'owner', '"' || c_name || '"', 'string' FROM customer UNION ALL SELECT 'options', '{"deep":true}', 'object' FROM customer""",
)
def legacy_settings(spark, sf_dir):
    return M.migrate_settings(_legacy_documents(spark, sf_dir)).select("key", "value_json", "type")


@query(
    "config_export",
    f"""WITH {REGISTRY_SQL} SELECT id, name AS library_name, coalesce(project_type, 'unknown') AS project_type,
  array_to_string(file_patterns, ',') AS patterns, CASE WHEN id % 2 = 0 THEN total_files END AS total_files FROM registry""",
)
def config_export(spark, sf_dir):
    """Export documents, read back by path; only even libraries export their statistics."""
    from snipdex.sources.export import export_documents

    parsed = R.parse(registry(spark, sf_dir))
    even = export_documents(parsed.filter("id % 2 = 0"), "2024-06-01", include_statistics=True)
    odd = export_documents(parsed.filter("id % 2 = 1"), "2024-06-01")
    doc = F.col("document")
    return even.unionByName(odd).select(
        "id", J.extract(doc, "$.libraryName").alias("library_name"), J.extract(doc, "$.projectType").alias("project_type"),
        F.array_join(F.from_json(J.extract(doc, "$.watchConfiguration.filePatterns"), "array<string>"), ",").alias("patterns"),
        J.extract(doc, "$.statistics.totalFiles").cast("long").alias("total_files"),
    )


IMPORT_STATE_SQL = """CASE WHEN id % 4 = 0 THEN 'bad size' WHEN id % 4 = 1 THEN 'bad priority' WHEN id % 4 = 2 THEN 'good' ELSE 'none' END"""


@query(
    "import_config",
    f"""WITH {REGISTRY_SQL}, s AS (SELECT *, {IMPORT_STATE_SQL} AS state FROM registry)
SELECT id, state = 'good' AS backed_up, CASE state WHEN 'bad size' THEN 'size not positive' WHEN 'bad priority' THEN 'unknown priority' END AS refused,
  CASE WHEN state = 'good' THEN '*.md' ELSE array_to_string(file_patterns, ',') END AS patterns,
  coalesce(project_type, 'unknown') AS project_type, CASE WHEN state = 'good' THEN 'import' ELSE team END AS team,
  CASE WHEN state = 'good' THEN 2 ELSE 1 END AS settings FROM s""",
)
def import_config(spark, sf_dir):
    """Import a changed export of three quarters of the libraries; two thirds of those are refused."""
    from snipdex.operators import config_io as C

    libraries = registry(spark, sf_dir)
    part = F.col("id") % 4
    size = F.when(part == 0, "0").otherwise("1000")
    priority = F.when(part == 1, "urgent").otherwise("high")
    document = F.concat(
        F.lit('{"WatchConfiguration":{"filePatterns":["*.md"],"maxFileSize":'), size,
        F.lit('},"metadata":{"projectType":"'), F.lit(""), F.lit('","team":"import","priority":"'), priority,
        F.lit('","tags":["imported"],"customSettings":{"by":"import"}}}'),
    )
    # An empty project type keeps the old one, but is refused by the audit unless it is left out.
    document = F.replace(document, F.lit('"projectType":"",'), F.lit(""))
    wanted = C.read_documents(libraries.filter(part != 3).select("id", document.alias("document")))
    applied, backup, refused = C.apply_documents(libraries, wanted, "2025-01-01")
    rows = R.parse(applied).select(
        "id", F.array_join("watch.filePatterns", ",").alias("patterns"), F.coalesce("meta.projectType", F.lit("unknown")).alias("project_type"),
        F.col("meta.team").alias("team"), F.size("meta.customSettings").alias("settings"),
    )
    kept = backup.select("id", F.lit(True).alias("backed_up"))
    said = refused.groupBy("id").agg(F.max("rule").alias("refused"))
    return rows.join(kept, "id", "left").join(said, "id", "left").withColumn("backed_up", F.coalesce("backed_up", F.lit(False)))


@query(
    "apply_preset",
    f"""WITH {REGISTRY_SQL} SELECT id, CASE id % 3 WHEN 0 THEN 'go' WHEN 1 THEN 'rust' ELSE coalesce(project_type, 'unknown') END AS project_type,
  CASE id % 3 WHEN 0 THEN '*.go' WHEN 1 THEN '*.rs' ELSE array_to_string(file_patterns, ',') END AS patterns,
  id % 3 <> 2 AS backed_up FROM registry""",
)
def apply_preset(spark, sf_dir):
    from snipdex.operators import config_io as C

    libraries = registry(spark, sf_dir)
    chosen = F.when(F.col("id") % 3 == 0, "GO").when(F.col("id") % 3 == 1, "rust").otherwise("nothing")
    wanted = C.preset_documents(libraries.select("id", chosen.alias("preset_id")), P.built_in_presets(spark))
    applied, backup, _ = C.apply_documents(libraries, wanted, "2025-01-01")
    rows = R.parse(applied).select(
        "id", F.coalesce("meta.projectType", F.lit("unknown")).alias("project_type"), F.array_join("watch.filePatterns", ",").alias("patterns")
    )
    kept = backup.select("id", F.lit(True).alias("backed_up"))
    return rows.join(kept, "id", "left").withColumn("backed_up", F.coalesce("backed_up", F.lit(False)))
