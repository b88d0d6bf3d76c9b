"""Corpus tables derived from the given tables, in Spark and in SQL.

The given data has no source trees, so files, registries, tasks, change events and
configurations are derived row by row from documents, orders, events and part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from snipdex.functions.paths import literal_map
from snipdex.session import spread_scan

EXTENSION_BY_LANG = {"en": ".py", "fr": ".js", "de": ".ts", "es": ".cs"}
DIRECTORIES = ["src", "src/core", "tests", "docs", "bin/debug", "node_modules/pkg", "obj", "logs"]
DAY_US = 86_400_000_000


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ts_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def files(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    """One file per document; every source is a library.  `spread` uses all cores on small inputs."""
    docs = load(spark, sf_dir, "documents")
    if spread:
        docs = spread_scan(docs, "doc_id")
    ext = F.coalesce(F.element_at(literal_map(EXTENSION_BY_LANG), F.col("lang")), F.lit(".txt"))
    folder = F.element_at(F.array(*[F.lit(d) for d in DIRECTORIES]), (F.col("doc_id") % 8 + 1).cast("int"))
    root = F.concat(F.lit("/repo/"), F.col("source"))
    rel = F.concat(folder, F.lit("/doc_"), F.col("doc_id").cast("string"), ext)
    return docs.select(
        "doc_id",
        F.col("source").alias("library"),
        root.alias("root"),
        rel.alias("rel_path"),
        F.concat(root, F.lit("/"), rel).alias("path"),
        F.col("n_chars").alias("size"),
        "lang",
        "text",
    )


FILES_SQL = f"""files AS (
  SELECT doc_id, source AS library, '/repo/' || source AS root,
         ({DIRECTORIES!r})[CAST(doc_id % 8 + 1 AS INTEGER)] || '/doc_' || doc_id ||
           CASE lang WHEN 'en' THEN '.py' WHEN 'fr' THEN '.js' WHEN 'de' THEN '.ts'
                     WHEN 'es' THEN '.cs' ELSE '.txt' END AS rel_path,
         '/repo/' || source || '/' || ({DIRECTORIES!r})[CAST(doc_id % 8 + 1 AS INTEGER)] || '/doc_' || doc_id ||
           CASE lang WHEN 'en' THEN '.py' WHEN 'fr' THEN '.js' WHEN 'de' THEN '.ts'
                     WHEN 'es' THEN '.cs' ELSE '.txt' END AS path,
         n_chars AS size, lang, text
  FROM documents)"""


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One library per source; JSON keys are Pascal-cased in even rows and camel-cased in odd ones."""
    docs = load(spark, sf_dir, "documents").groupBy("source")
    totals = docs.agg(
        F.count(F.lit(1)).alias("total_files"),
        F.sum(F.ceil(F.col("n_chars") / 100)).alias("indexed_snippets"),
        F.sum("n_chars").alias("chars"),
        *[F.count_if(F.col("lang") == lang).alias(lang) for lang in EXTENSION_BY_LANG],
    ).withColumn("id", F.substring("source", 4, 10).cast("int"))
    i = F.col("id")

    def pick(*values):
        return F.element_at(F.array(*[F.lit(v) for v in values]), i % len(values) + 1)

    watch = [
        ("FilePatterns", F.array(F.lit("*.py"), F.when(i % 3 == 0, "*.js").otherwise("*.ts"))),
        ("ExcludePatterns", F.array(F.lit("bin"), F.lit("obj"))),
        ("IncludeSubdirectories", F.lit(True)),
        ("IsEnabled", i % 3 != 1),
        ("MaxFileSize", F.lit(10 << 20)),
        ("CustomFilters", F.array().cast("array<struct<Name:string,Pattern:string,Enabled:boolean>>")),
    ]
    languages = F.create_map(
        F.lit("python"), F.col("en"), F.lit("javascript"), F.col("fr"),
        F.lit("typescript"), F.col("de"), F.lit("csharp"), F.col("es"),
    )
    statistics = [
        ("IndexedSnippets", F.col("indexed_snippets")),
        ("TotalFiles", F.col("total_files")),
        ("LastIndexingDuration", F.col("total_files") / 4),
        ("AverageFileSize", F.floor(F.col("chars") / F.col("total_files"))),
        ("LanguageDistribution", languages),
    ]
    metadata = [
        ("ProjectType", F.when(i % 6 != 5, pick("webapi", "script", "library"))),
        ("Framework", pick("net8.0", "node", "python")),
        ("Team", F.when(i % 4 != 3, pick("backend", "frontend", "data"))),
        ("Priority", pick("low", "normal", "high", "critical")),
        ("Tags", F.array(F.concat(F.lit("tag"), (i % 3 + 1).cast("string")), F.lit("auto"))),
        ("CustomSettings", F.create_map(F.lit("owner"), F.col("source"))),
    ]

    def document(fields):
        camel = F.to_json(F.struct(*[c.alias(n[0].lower() + n[1:]) for n, c in fields]))
        pascal = F.to_json(F.struct(*[c.alias(n) for n, c in fields]))
        return F.when(i % 2 == 0, pascal).otherwise(camel)

    day = F.lit("2024-01-01").cast("timestamp_ntz")
    return totals.select(
        "id",
        F.col("source").alias("name"),
        F.concat(F.lit("/repo/"), F.col("source")).alias("codebase_path"),
        F.concat(F.lit("code_index_"), F.substring(F.sha2(F.concat(F.lit("/repo/"), F.col("source")), 256), 1, 8)).alias("collection_name"),
        pick("Completed", "Failed", "Pending", "Indexing", "Cancelled").alias("status"),
        document(watch).alias("watch_config"),
        document(statistics).alias("statistics"),
        document(metadata).alias("metadata"),
        day.alias("created_at"),
        (day + F.make_dt_interval(days=i)).alias("updated_at"),
        F.when(i % 5 == 0, day + F.make_dt_interval(days=i * 2)).alias("last_indexed_at"),
        "total_files",
        F.col("indexed_snippets").cast("long").alias("indexed_snippets"),
        (i % 7 != 6).alias("is_active"),
    )


REGISTRY_SQL = """registry AS (
  SELECT id, source AS name, '/repo/' || source AS codebase_path,
         'code_index_' || substr(sha256('/repo/' || source), 1, 8) AS collection_name,
         (['Completed','Failed','Pending','Indexing','Cancelled'])[id % 5 + 1] AS status,
         ['*.py', CASE WHEN id % 3 = 0 THEN '*.js' ELSE '*.ts' END] AS file_patterns,
         id % 3 <> 1 AS is_enabled, total_files / 4.0 AS duration,
         CASE WHEN id % 6 <> 5 THEN (['webapi','script','library'])[id % 3 + 1] END AS project_type,
         (['net8.0','node','python'])[id % 3 + 1] AS framework,
         CASE WHEN id % 4 <> 3 THEN (['backend','frontend','data'])[id % 3 + 1] END AS team,
         (['low','normal','high','critical'])[id % 4 + 1] AS priority,
         ['tag' || (id % 3 + 1), 'auto'] AS tags,
         TIMESTAMP '2024-01-01' AS created_at,
         TIMESTAMP '2024-01-01' + to_days(id) AS updated_at,
         CASE WHEN id % 5 = 0 THEN TIMESTAMP '2024-01-01' + to_days(id * 2) END AS last_indexed_at,
         total_files, indexed_snippets, chars, en, fr, de, es, id % 7 <> 6 AS is_active
  FROM (SELECT source, CAST(substr(source, 4) AS INTEGER) AS id, count(*) AS total_files,
               CAST(sum(ceil(n_chars / 100.0)) AS BIGINT) AS indexed_snippets,
               CAST(sum(n_chars) AS BIGINT) AS chars,
               count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'fr') AS fr,
               count(*) FILTER (lang = 'de') AS de, count(*) FILTER (lang = 'es') AS es
        FROM documents GROUP BY source))"""

TASK_TYPES = ["Indexing", "Rebuilding", "FileUpdate", "FileDelete", "WatcherRestart", "SystemMaintenance"]


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One background task per order; the customer stands for the library."""
    key, price = F.col("o_orderkey"), F.col("o_totalprice")
    status = (
        F.when(price < 20000, "Failed")
        .when(price > 480000, "Cancelled")
        .when(F.col("o_orderstatus") == "O", "Pending")
        .when(F.col("o_orderstatus") == "P", "Running")
        .otherwise("Completed")
    )
    kind = F.element_at(F.array(*[F.lit(t) for t in TASK_TYPES]), (key % 6 + 1).cast("int"))
    return load(spark, sf_dir, "orders").select(
        key.alias("task_id"),
        F.col("o_custkey").alias("library_id"),
        kind.alias("type"),
        status.alias("status"),
        F.greatest(F.lit(1), 5 - F.substring("o_orderpriority", 1, 1).cast("int")).alias("priority"),
        F.col("o_orderdate").alias("created_at"),
        price.alias("cost"),
    )


TASKS_SQL = f"""tasks AS (
  SELECT o_orderkey AS task_id, o_custkey AS library_id,
         ({TASK_TYPES!r})[CAST(o_orderkey % 6 + 1 AS INTEGER)] AS type,
         CASE WHEN o_totalprice < 20000 THEN 'Failed' WHEN o_totalprice > 480000 THEN 'Cancelled'
              WHEN o_orderstatus = 'O' THEN 'Pending' WHEN o_orderstatus = 'P' THEN 'Running'
              ELSE 'Completed' END AS status,
         greatest(1, 5 - CAST(substr(o_orderpriority, 1, 1) AS INTEGER)) AS priority,
         o_orderdate AS created_at, o_totalprice AS cost
  FROM orders)"""

CHANGE_BY_EVENT = {"signup": "Created", "click": "Modified", "view": "Modified", "error": "Deleted", "purchase": "Renamed"}


def changes_from(events: DataFrame) -> DataFrame:
    """One file change per event; the user stands for the file."""
    user = F.col("user_id").cast("string")
    root = F.concat(F.lit("/repo/src"), (F.col("user_id") % 20).cast("string"))
    stem = F.concat(root, F.lit("/src/file_"), user)
    kind = F.element_at(literal_map(CHANGE_BY_EVENT), F.col("event_type"))
    return events.select(
        "event_id",
        F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string")).alias("library"),
        F.concat(stem, F.lit(".py")).alias("path"),
        F.when(kind == "Renamed", F.concat(stem, F.lit("_v2.py"))).alias("new_path"),
        kind.alias("change_type"),
        F.col("ts").cast("timestamp").alias("event_time"),
        "value",
    )


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes_from(load(spark, sf_dir, "events"))


CHANGES_SQL = """changes AS (
  SELECT event_id, 'src' || (user_id % 20) AS library,
         '/repo/src' || (user_id % 20) || '/src/file_' || user_id || '.py' AS path,
         CASE WHEN event_type = 'purchase'
              THEN '/repo/src' || (user_id % 20) || '/src/file_' || user_id || '_v2.py' END AS new_path,
         CASE event_type WHEN 'signup' THEN 'Created' WHEN 'click' THEN 'Modified'
              WHEN 'view' THEN 'Modified' WHEN 'error' THEN 'Deleted' ELSE 'Renamed' END AS change_type,
         ts AS event_time, value
  FROM events)"""

PATTERNS_BY_TYPE = {
    "ECONOMY": ["*.cs", "*.csx"],
    "STANDARD": ["*.ts", "*.tsx", "*.js"],
    "SMALL": ["*.py", "*.exe"],
    "MEDIUM": [],
    "LARGE": ["*.cs", "*.zzz", "*.ts", "*.cs"],
    "PROMO": ["src/**/*.py", " ", "../up/*.py"],
}
EXCLUDES_BY_SIZE = [
    ["bin", "obj", ".git"],
    ["bin", "../outside", "obj"],
    ["node_modules", " dist ", "node_modules"],
    ["*.py", "~tmp"],
    [],
]
FILTERS_BY_KEY = [
    [],
    [("skip-drafts", "*draft*", True)],
    [(" ", "*x*", True), ("ok name", "*.tmp", False)],
    [("bad!name", "..", True)],
]
TYPES_BY_BRAND = ["csharp", "typescript", "javascript", "python", "java", "other"]


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def _choose(key: Column, options: list[Column]) -> Column:
    chosen = options[-1]
    for n, option in reversed(list(enumerate(options[:-1]))):
        chosen = F.when(key == n, option).otherwise(chosen)
    return chosen


def configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One watch configuration per part."""
    filter_type = "array<struct<name:string,pattern:string,enabled:boolean>>"
    filters = [
        F.array(*[F.struct(F.lit(n).alias("name"), F.lit(p).alias("pattern"), F.lit(e).alias("enabled")) for n, p, e in f]).cast(filter_type)
        for f in FILTERS_BY_KEY
    ]
    patterns = F.lit(None).cast("array<string>")
    for kind, values in PATTERNS_BY_TYPE.items():
        patterns = F.when(F.col("p_type") == kind, _strings(values)).otherwise(patterns)
    brand = F.regexp_extract("p_brand", "([0-9]+)", 1).cast("int")
    return load(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("config_id"),
        F.col("p_brand").alias("preset_group"),
        F.col("p_name").alias("name"),
        _choose(brand % 6, [F.lit(t) for t in TYPES_BY_BRAND]).alias("project_type"),
        F.coalesce(patterns, _strings([])).alias("file_patterns"),
        _choose(F.col("p_size") % 5, [_strings(v) for v in EXCLUDES_BY_SIZE]).alias("exclude_patterns"),
        ((F.col("p_size") - 1) * F.lit(4 << 20).cast("long")).alias("max_file_size"),
        (F.col("p_size") % 2 == 0).alias("include_subdirectories"),
        (F.col("p_partkey") % 3 != 0).alias("is_enabled"),
        _choose(F.col("p_partkey") % 4, filters).alias("custom_filters"),
    )


def _sql_list(values: list[str]) -> str:
    return "CAST([" + ", ".join(f"'{v}'" for v in values) + "] AS VARCHAR[])"


def _sql_filters(values: list[tuple]) -> str:
    rows = ", ".join(f"{{'name': '{n}', 'pattern': '{p}', 'enabled': {str(e).lower()}}}" for n, p, e in values)
    return f"CAST([{rows}] AS STRUCT(name VARCHAR, pattern VARCHAR, enabled BOOLEAN)[])"


CONFIGS_SQL = (
    "configs AS (\n  SELECT p_partkey AS config_id, p_brand AS preset_group, p_name AS name,\n"
    f"    ({TYPES_BY_BRAND!r})[CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INTEGER) % 6 + 1] AS project_type,\n"
    "    CASE p_type " + " ".join(f"WHEN '{k}' THEN {_sql_list(v)}" for k, v in PATTERNS_BY_TYPE.items())
    + f" ELSE {_sql_list([])} END AS file_patterns,\n    CASE p_size % 5 "
    + " ".join(f"WHEN {n} THEN {_sql_list(v)}" for n, v in enumerate(EXCLUDES_BY_SIZE))
    + " END AS exclude_patterns,\n    CAST((p_size - 1) AS BIGINT) * 4194304 AS max_file_size,\n"
    "    p_size % 2 = 0 AS include_subdirectories, p_partkey % 3 <> 0 AS is_enabled,\n    CASE p_partkey % 4 "
    + " ".join(f"WHEN {n} THEN {_sql_filters(v)}" for n, v in enumerate(FILTERS_BY_KEY))
    + " END AS custom_filters\n  FROM part)"
)
