"""Move a legacy configuration document into registry rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snipdex.functions import rules

# Fixed values
LEGACY_PATTERNS = ["*.cs"]
LEGACY_EXCLUDES = ["bin", "obj", ".git"]
DEFAULT_MAX_FILE_SIZE = 10 << 20


def migrate_libraries(
    documents: DataFrame, as_of: str, existing: DataFrame | None = None, types: DataFrame | None = None
) -> DataFrame:
    """One registry row per mapping of the documents; nothing if libraries exist already.

    `types` may give (codebase_path, project_type).
    """
    mapped = documents.select(F.explode("codebaseMappings").alias("m")).select("m.*")
    if existing is not None and not existing.isEmpty():
        mapped = mapped.filter(F.lit(False))
    if types is not None:
        mapped = mapped.join(types, mapped["codebasePath"] == types["codebase_path"], "left").drop("codebase_path")
    else:
        mapped = mapped.withColumn("project_type", F.lit(None).cast("string"))
    duration = rules.parse_duration(F.col("statistics.lastIndexingDuration"))
    files = F.coalesce("statistics.totalFiles", F.lit(0))
    snippets = F.coalesce("statistics.indexedSnippets", F.lit(0))

    def strings(values):
        return F.array(*[F.lit(v) for v in values])

    watch = F.struct(
        F.coalesce("watcherConfig.fileExtensions", strings(LEGACY_PATTERNS)).alias("filePatterns"),
        F.coalesce("watcherConfig.excludeDirectories", strings(LEGACY_EXCLUDES)).alias("excludePatterns"),
        F.coalesce("watcherConfig.includeSubdirectories", F.lit(True)).alias("includeSubdirectories"),
        F.coalesce("isMonitoring", F.lit(False)).alias("isEnabled"),
        F.lit(DEFAULT_MAX_FILE_SIZE).alias("maxFileSize"),
        F.array().cast("array<struct<name:string,pattern:string,enabled:boolean>>").alias("customFilters"),
    )
    run = F.struct(
        F.col("lastIndexed").alias("date"), duration.alias("duration"), files.alias("filesProcessed"),
        snippets.alias("snippetsCreated"),
    )
    has_run = F.col("lastIndexed").isNotNull() & (duration > 0)
    history = F.when(has_run, F.array(run)).otherwise(F.slice(F.array(run), 1, 0))
    statistics = F.struct(
        snippets.alias("indexedSnippets"), files.alias("totalFiles"), duration.alias("lastIndexingDuration"),
        F.lit(0).alias("averageFileSize"), F.create_map(F.lit("csharp"), files).alias("languageDistribution"),
        history.alias("indexingHistory"),
    )
    settings = F.create_map(
        F.lit("originalId"), F.coalesce("id", F.lit("")), F.lit("friendlyName"), F.coalesce("friendlyName", F.lit("")),
        F.lit("migrationDate"), F.lit(as_of), F.lit("originalCreatedAt"), F.coalesce(F.col("createdAt").cast("string"), F.lit("")),
    )
    metadata = F.struct(
        F.coalesce("project_type", F.lit("unknown")).alias("projectType"), F.lit("unknown").alias("framework"),
        F.lit("default").alias("team"), F.lit("normal").alias("priority"),
        strings(["migrated", "legacy"]).alias("tags"), settings.alias("customSettings"),
    )
    return mapped.select(
        F.col("id").alias("original_id"),
        F.col("friendlyName").alias("name"),
        F.col("codebasePath").alias("codebase_path"),
        F.col("collectionName").alias("collection_name"),
        rules.legacy_status(F.col("indexingStatus")).alias("status"),
        F.to_json(watch).alias("watch_config"),
        F.to_json(statistics).alias("statistics"),
        F.to_json(metadata).alias("metadata"),
        F.col("createdAt").alias("created_at"),
        F.lit(as_of).cast("timestamp").alias("updated_at"),
        F.col("lastIndexed").alias("last_indexed_at"),
        files.cast("bigint").alias("total_files"),
        snippets.cast("bigint").alias("indexed_snippets"),
        F.lit(True).alias("is_active"),
    )


def migrate_settings(documents: DataFrame) -> DataFrame:
    """One system-configuration row per global setting, with the JSON text and its type."""
    rows = documents.select(F.explode("globalSettings").alias("key", "v"))
    shape = F.schema_of_variant("v")
    kind = (
        F.when(F.col("v").isNull() | F.is_variant_null("v"), "string")
        .when(shape.startswith("OBJECT"), "object")
        .when(shape.startswith("ARRAY"), "array")
        .when(shape == "BOOLEAN", "boolean")
        .when(shape == "STRING", "string")
        .otherwise("number")
    )
    return rows.select(
        "key", F.to_json("v").alias("value_json"), kind.alias("type"),
        F.concat(F.lit("migrated setting "), "key").alias("description"), F.lit(True).alias("is_editable"),
    )
