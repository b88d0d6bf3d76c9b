"""Library registry: typed JSON, lookups, statistics and row maintenance.

JSON columns are read once, ignoring the case of their keys, into typed structs; predicates
then act on ordinary columns.  Stored text is kept as it is.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snipdex import schemas
from snipdex.functions import jsonx as J
from snipdex.functions.paths import normalize_path

# Fixed values
DEFAULT_MAX_FILE_SIZE = 10 << 20
MISSING_PROJECT_TYPE = "unknown"
MISSING_TEAM = "default"


def _read(members: Column, name: str, kind: str, default: Column | None = None) -> Column:
    raw = J.lookup(members, name)
    if kind == "string":
        value = raw
    elif kind.startswith(("array", "map")):
        value = F.from_json(raw, kind)
    else:
        value = raw.try_cast(kind)
    return value if default is None else F.coalesce(value, default)


def _empty(kind: str) -> Column:
    return (F.create_map() if kind.startswith("map") else F.array()).cast(kind)


def _filters(members: Column) -> Column:
    listed = F.from_json(J.lookup(members, "customFilters"), "array<map<string,string>>")
    return F.coalesce(
        F.transform(
            listed,
            lambda m: F.struct(
                F.coalesce(J.lookup(m, "name"), F.lit("")).alias("name"),
                F.coalesce(J.lookup(m, "pattern"), F.lit("")).alias("pattern"),
                F.coalesce(J.lookup(m, "enabled").try_cast("boolean"), F.lit(True)).alias("enabled"),
            ),
        ),
        F.array().cast("array<struct<name:string,pattern:string,enabled:boolean>>"),
    )


def _history(members: Column) -> Column:
    listed = F.from_json(J.lookup(members, "indexingHistory"), "array<map<string,string>>")
    rows = F.transform(
        listed,
        lambda m: F.struct(
            J.lookup(m, "date").try_cast("timestamp").alias("date"),
            J.lookup(m, "duration").try_cast("double").alias("duration"),
            J.lookup(m, "filesProcessed").try_cast("int").alias("filesProcessed"),
            J.lookup(m, "snippetsCreated").try_cast("int").alias("snippetsCreated"),
        ),
    )
    return F.coalesce(rows, F.array().cast(schemas.HISTORY))


def _build(members: Column, fields: list[tuple[str, str, Column | None]], extra: dict[str, Column]) -> Column:
    parts = [_read(members, n, k, d).alias(n) for n, k, d in fields]
    parts += [c.alias(n) for n, c in extra.items()]
    return F.when(members.isNotNull(), F.struct(*parts))


def watch_struct(members: Column) -> Column:
    strings = "array<string>"
    fields = [
        ("filePatterns", strings, _empty(strings)),
        ("excludePatterns", strings, _empty(strings)),
        ("includeSubdirectories", "boolean", F.lit(True)),
        ("isEnabled", "boolean", F.lit(True)),
        ("maxFileSize", "bigint", F.lit(DEFAULT_MAX_FILE_SIZE).cast("bigint")),
    ]
    return _build(members, fields, {"customFilters": _filters(members)})


def statistics_struct(members: Column) -> Column:
    counts = "map<string,bigint>"
    fields = [
        ("indexedSnippets", "bigint", F.lit(0).cast("bigint")),
        ("totalFiles", "bigint", F.lit(0).cast("bigint")),
        ("lastIndexingDuration", "double", None),
        ("averageFileSize", "bigint", F.lit(0).cast("bigint")),
        ("languageDistribution", counts, _empty(counts)),
    ]
    return _build(members, fields, {"indexingHistory": _history(members)})


def metadata_struct(members: Column) -> Column:
    strings, settings = "array<string>", "map<string,string>"
    fields = [
        ("projectType", "string", None),
        ("framework", "string", None),
        ("team", "string", None),
        ("priority", "string", None),
        ("tags", strings, _empty(strings)),
        ("customSettings", settings, _empty(settings)),
    ]
    return _build(members, fields, {})


def parse(libraries: DataFrame) -> DataFrame:
    """Adds `watch`, `stats` and `meta`; each is NULL where its text is no JSON object."""
    members = libraries.withColumns(
        {
            "_w": J.entries(F.col("watch_config")),
            "_s": J.entries(F.col("statistics")),
            "_m": J.entries(F.col("metadata")),
        }
    )
    return members.withColumns(
        {
            "watch": watch_struct(F.col("_w")),
            "stats": statistics_struct(F.col("_s")),
            "meta": metadata_struct(F.col("_m")),
        }
    ).drop("_w", "_s", "_m")


# Lookups and lists: active rows, newest first


def _active(libraries: DataFrame, condition: Column) -> DataFrame:
    return libraries.filter(F.col("is_active") & condition)


def _newest(libraries: DataFrame) -> DataFrame:
    return libraries.orderBy(F.desc("updated_at"), "id")


def by_id(libraries: DataFrame, library_id: int) -> DataFrame:
    return _active(libraries, F.col("id") == library_id)


def by_path(libraries: DataFrame, path: str) -> DataFrame:
    return _active(libraries, normalize_path(F.col("codebase_path")) == normalize_path(F.lit(path)))


def by_collection(libraries: DataFrame, collection: str) -> DataFrame:
    return _active(libraries, F.col("collection_name") == collection)


def has_status(status: str) -> Column:
    return F.col("status") == status


def is_monitored() -> Column:
    return F.col("watch.isEnabled")


def has_metadata(**wanted: str) -> Column:
    """Equality on typed metadata fields, for example `projectType="webapi"`."""
    return functools.reduce(lambda a, b: a & b, (F.col(f"meta.{name}") == value for name, value in wanted.items()), F.lit(True))


def has_key(column: str, key: str, value: str) -> Column:
    """Equality on any top-level key of a JSON column."""
    return J.field(F.col(column), key) == value


def has_tag(tag: str) -> Column:
    return F.array_contains("meta.tags", tag)


def list_all(libraries: DataFrame) -> DataFrame:
    return _newest(libraries.filter("is_active"))


def list_by_status(libraries: DataFrame, status: str) -> DataFrame:
    return _newest(_active(libraries, has_status(status)))


def list_monitored(parsed: DataFrame) -> DataFrame:
    return _newest(_active(parsed, is_monitored()))


def list_by_metadata(parsed: DataFrame, **wanted: str) -> DataFrame:
    return _newest(_active(parsed, has_metadata(**wanted)))


def list_by_key(libraries: DataFrame, column: str, key: str, value: str) -> DataFrame:
    return _newest(_active(libraries, has_key(column, key, value)))


def list_by_tag(parsed: DataFrame, tag: str) -> DataFrame:
    return _newest(_active(parsed, has_tag(tag)))


def list_each(libraries: DataFrame, lists: dict[str, Column], name: str = "list") -> DataFrame:
    """Active libraries once for every list whose condition they meet, from one pass; `name` tells the list."""
    met = F.array_compact(F.array(*(F.when(condition, F.lit(key)) for key, condition in lists.items())))
    return libraries.filter("is_active").select(F.explode(met).alias(name), *libraries.columns)


def order_by_last_indexed(libraries: DataFrame) -> DataFrame:
    return libraries.orderBy(F.desc(F.coalesce("last_indexed_at", "created_at")), "id")


# Projections


def flatten(parsed: DataFrame) -> DataFrame:
    return parsed.select(
        "id", "name", "codebase_path", "collection_name", "status",
        F.coalesce("meta.projectType", F.lit(MISSING_PROJECT_TYPE)).alias("project_type"),
        F.coalesce("meta.team", F.lit("")).alias("team"),
        F.coalesce("meta.framework", F.lit("")).alias("framework"),
        F.coalesce("meta.priority", F.lit("normal")).alias("priority"),
        F.col("meta.tags").alias("tags"),
        "total_files", "indexed_snippets",
        F.coalesce("watch.isEnabled", F.lit(False)).alias("is_monitored"),
        F.col("watch.filePatterns").alias("file_patterns"),
        F.col("watch.excludePatterns").alias("exclude_patterns"),
        "created_at", "updated_at", "last_indexed_at",
    )


def statistics_row(parsed: DataFrame) -> DataFrame:
    return parsed.select(
        "id", "name", "status", "total_files", "indexed_snippets",
        F.col("stats.lastIndexingDuration").alias("last_duration"),
        F.col("stats.averageFileSize").alias("average_file_size"),
        F.size("stats.languageDistribution").alias("languages"),
        F.coalesce("watch.isEnabled", F.lit(False)).alias("is_monitored"),
    )


def legacy_row(parsed: DataFrame) -> DataFrame:
    """The row shape of the older flat configuration: lower-case status, duration as text."""
    duration = F.coalesce("stats.lastIndexingDuration", F.lit(0.0))
    whole = duration == F.floor(duration)
    return parsed.select(
        F.col("id").cast("string").alias("id"),
        F.col("name").alias("friendly_name"),
        "codebase_path",
        "collection_name",
        F.lower("status").alias("indexing_status"),
        F.coalesce("watch.isEnabled", F.lit(False)).alias("is_monitoring"),
        F.concat(F.when(whole, duration.cast("long").cast("string")).otherwise(duration.cast("string")), F.lit("s")).alias("last_duration"),
        "total_files",
        "indexed_snippets",
    )


# Statistics


def global_statistics(parsed: DataFrame) -> DataFrame:
    return parsed.filter("is_active").agg(
        F.count(F.lit(1)).alias("total_libraries"),
        F.sum("total_files").alias("total_files"),
        F.sum("indexed_snippets").alias("total_snippets"),
        F.count_if(F.col("status") == "Completed").alias("completed"),
        F.count_if(F.col("status") == "Failed").alias("failed"),
        F.count_if(F.col("watch.isEnabled")).alias("monitored"),
        F.count_if(F.col("is_active")).alias("active"),
        F.avg("stats.lastIndexingDuration").alias("average_duration"),
    )


def language_distribution(parsed: DataFrame) -> DataFrame:
    pairs = parsed.filter("is_active").select(F.explode("stats.languageDistribution").alias("language", "n"))
    return pairs.groupBy("language").agg(F.sum("n").alias("files"))


def distribution(parsed: DataFrame, field: str, missing: str) -> DataFrame:
    value = F.coalesce(F.col(field), F.lit(missing))
    return parsed.filter("is_active").groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("libraries"))


def project_type_distribution(parsed: DataFrame) -> DataFrame:
    return distribution(parsed, "meta.projectType", MISSING_PROJECT_TYPE)


def team_distribution(parsed: DataFrame) -> DataFrame:
    return distribution(parsed, "meta.team", MISSING_TEAM)


def status_report(parsed: DataFrame) -> DataFrame:
    """Libraries, monitored ones and files per status."""
    return parsed.filter("is_active").groupBy("status").agg(
        F.count(F.lit(1)).alias("libraries"), F.count_if(F.col("watch.isEnabled")).alias("monitored")
    ).orderBy(F.desc("libraries"), "status")


def top_libraries(parsed: DataFrame, n: int = 10) -> DataFrame:
    size = F.col("stats.averageFileSize") * F.col("total_files")
    listed = parsed.filter("is_active").select("id", "name", "indexed_snippets", "total_files", size.alias("size_bytes"))
    return listed.orderBy(F.desc("size_bytes"), "id").limit(n)


def recent_activity(libraries: DataFrame, n: int = 10) -> DataFrame:
    """The newest creations, updates and index runs in one list."""
    active = libraries.filter("is_active")
    parts = [
        active.select("id", "name", F.lit(label).alias("activity"), F.col(column).alias("at_time"))
        for label, column in [("created", "created_at"), ("updated", "updated_at"), ("indexed", "last_indexed_at")]
    ]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2]).filter("at_time IS NOT NULL")
    return rows.orderBy(F.desc("at_time"), "id", "activity").limit(n)


def type_rollup(parsed: DataFrame) -> DataFrame:
    value = F.coalesce(F.col("meta.projectType"), F.lit(MISSING_PROJECT_TYPE))
    return parsed.filter("is_active").groupBy(value.alias("project_type")).agg(
        F.count(F.lit(1)).alias("libraries"), F.sum("indexed_snippets").alias("snippets")
    )


# Row maintenance


def reject_duplicates(new: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New rows whose normalized path is free, and the refused rest.

    Of several new rows for one path the lowest id is taken.
    """
    keyed = new.withColumn("_key", normalize_path(F.col("codebase_path")))
    taken = existing.filter("is_active").select(normalize_path(F.col("codebase_path")).alias("_key")).distinct()
    first = keyed.groupBy("_key").agg(F.min("id").alias("_first"))
    marked = keyed.join(first, "_key").join(taken.withColumn("_taken", F.lit(True)), "_key", "left")
    free = F.col("_taken").isNull() & (F.col("id") == F.col("_first"))
    extra = ["_key", "_first", "_taken"]
    return marked.filter(free).drop(*extra), marked.filter(~free).drop(*extra)


def set_status(libraries: DataFrame, ids: DataFrame, status: str, as_of: str) -> DataFrame:
    """New status and update time for the rows whose id is listed."""
    listed = ids.select("id").distinct().withColumn("_hit", F.lit(True))
    joined = libraries.join(listed, "id", "left")
    hit = F.col("_hit").isNotNull()
    stamp = F.lit(as_of).cast(libraries.schema["updated_at"].dataType)
    return joined.withColumns(
        {
            "status": F.when(hit, F.lit(status)).otherwise(F.col("status")),
            "updated_at": F.when(hit, stamp).otherwise(F.col("updated_at")),
        }
    ).select(*libraries.columns)


def patch(base: DataFrame, patches: DataFrame, key: str) -> DataFrame:
    """Field-wise update: a NULL in the patch keeps the old value."""
    changed = [c for c in patches.columns if c != key]
    renamed = patches.select(key, *[F.col(c).alias(f"_new_{c}") for c in changed])
    joined = base.join(renamed, key, "left")
    return joined.select(
        *[F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c) if c in changed else F.col(c) for c in base.columns]
    )


def append_metadata(libraries: DataFrame, ids: DataFrame, name: str, value_json: Column) -> DataFrame:
    """Set one metadata key in the listed rows."""
    listed = ids.select("id").distinct().withColumn("_hit", F.lit(True))
    joined = libraries.join(listed, "id", "left")
    new = J.set_key(F.col("metadata"), name, value_json)
    return joined.withColumn("metadata", F.when(F.col("_hit").isNotNull(), new).otherwise(F.col("metadata"))).select(
        *libraries.columns
    )


def remove_metadata(libraries: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    listed = ids.select("id").distinct().withColumn("_hit", F.lit(True))
    joined = libraries.join(listed, "id", "left")
    new = J.remove_key(F.col("metadata"), name)
    return joined.withColumn("metadata", F.when(F.col("_hit").isNotNull(), new).otherwise(F.col("metadata"))).select(
        *libraries.columns
    )


def cascade_delete(children: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    """Children whose parent is not deleted; children without a parent stay."""
    return children.join(deleted.select(key).distinct(), key, "left_anti")


def set_null_on_delete(children: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    """All children; the key of those whose parent is deleted becomes NULL."""
    gone = deleted.select(key).distinct().withColumn("_gone", F.lit(True))
    joined = children.join(gone, key, "left")
    return joined.withColumn(key, F.when(F.col("_gone").isNull(), F.col(key))).select(*children.columns)


def append_history(parsed: DataFrame, runs: DataFrame) -> DataFrame:
    """Add one run row (id, date, duration, files, snippets) to each library's history."""
    entry = F.struct(
        F.col("date").cast("timestamp").alias("date"), F.col("duration").cast("double").alias("duration"),
        F.col("files").cast("int").alias("filesProcessed"), F.col("snippets").cast("int").alias("snippetsCreated"),
    )
    latest = runs.select("id", entry.alias("_run"), F.col("duration").alias("_duration"))
    joined = parsed.join(latest, "id", "left")
    grown = F.col("stats").withField(
        "indexingHistory", F.array_append(F.col("stats.indexingHistory"), F.col("_run"))
    ).withField("lastIndexingDuration", F.col("_duration").cast("double"))
    return joined.withColumn("stats", F.when(F.col("_run").isNotNull(), grown).otherwise(F.col("stats"))).drop("_run", "_duration")


def uniqueness_violations(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")
