"""Import of configuration documents and presets into registry rows: validate, back up, patch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snipdex.functions import jsonx as J
from snipdex.operators import audit as A
from snipdex.operators import presets as P
from snipdex.operators import registry as R
from snipdex.session import stored


def read_documents(documents: DataFrame) -> DataFrame:
    """(id, watch, meta) of exported documents (id, document)."""
    members = J.entries(F.col("document"))
    parts = documents.select(
        "id",
        J.entries(J.lookup(members, "watchConfiguration")).alias("_w"),
        J.entries(J.lookup(members, "metadata")).alias("_m"),
    )
    return parts.select("id", R.watch_struct(F.col("_w")).alias("watch"), R.metadata_struct(F.col("_m")).alias("meta"))


def preset_documents(requests: DataFrame, presets: DataFrame) -> DataFrame:
    """(id, watch, meta) for requests (id, preset_id); unknown presets give no row."""
    found = P.lookup(requests, presets)
    watch = F.struct(
        F.col("file_patterns").alias("filePatterns"), F.col("exclude_patterns").alias("excludePatterns"),
        F.col("include_subdirectories").alias("includeSubdirectories"), F.col("is_enabled").alias("isEnabled"),
        F.col("max_file_size").alias("maxFileSize"),
        F.array().cast("array<struct<name:string,pattern:string,enabled:boolean>>").alias("customFilters"),
    )
    meta = F.struct(
        F.col("project_type").alias("projectType"), "framework", F.lit(P.DEFAULT_TEAM).alias("team"),
        F.lit(P.DEFAULT_PRIORITY).alias("priority"), F.array(F.lit("built-in"), "project_type").alias("tags"),
        F.create_map(F.lit("embeddingModel"), F.lit(P.DEFAULT_MODEL)).alias("customSettings"),
    )
    return found.select("id", watch.alias("watch"), meta.alias("meta"))


def judge_documents(wanted: DataFrame) -> DataFrame:
    """(id, watch, meta, findings): what speaks against each document; a missing half is a finding."""
    rows = wanted.select(
        "id", "watch", "meta",
        F.col("watch.filePatterns").alias("file_patterns"), F.col("watch.excludePatterns").alias("exclude_patterns"),
        F.col("watch.maxFileSize").alias("max_file_size"), F.col("watch.customFilters").alias("custom_filters"),
        F.coalesce("meta.projectType", F.lit("unknown")).alias("project_type"), F.col("meta.priority").alias("priority"),
        F.col("meta.tags").alias("tags"), F.col("meta.customSettings").alias("custom_settings"),
    )
    missing = F.array(F.struct(F.lit("missing part").alias("rule"), F.lit("").alias("value"))).cast(A.FINDINGS)
    whole = F.col("watch").isNotNull() & F.col("meta").isNotNull()
    return rows.select("id", "watch", "meta", F.when(whole, A.all_findings()).otherwise(missing).alias("findings"))


def _merged(old: Column, new: Column) -> Column:
    """Metadata where filled new fields win, tags are replaced, and settings are united."""

    def pick(name: str) -> Column:
        return F.coalesce(F.nullif(new[name], F.lit("")), old[name]).alias(name)

    kept = F.map_filter(old["customSettings"], lambda k, _: ~F.map_contains_key(new["customSettings"], k))
    settings = F.coalesce(F.map_concat(kept, new["customSettings"]), new["customSettings"])
    return F.struct(
        *[pick(n) for n in ("projectType", "framework", "team", "priority")],
        new["tags"].alias("tags"), settings.alias("customSettings"),
    )


def apply_documents(libraries: DataFrame, wanted: DataFrame, as_of: str, validate_only: bool = False):
    """Registry rows with the accepted configurations (id, watch, meta) put in.

    Gives (applied registry, backup of the rows that change, findings of refused rows).
    """
    # Judged once: the refusals and the accepted rows both read this.
    judged = stored(judge_documents(wanted), "judged")
    refused = judged.select("id", F.explode("findings").alias("f")).select("id", "f.rule", "f.value")
    accepted = judged.filter(F.size("findings") == 0).drop("findings")
    if validate_only:
        accepted = accepted.filter(F.lit(False))
    new = accepted.select("id", F.col("watch").alias("_watch"), F.col("meta").alias("_meta"))
    joined = R.parse(libraries).join(new, "id", "left")
    hit = F.col("_watch").isNotNull()
    stamp = F.lit(as_of).cast(libraries.schema["updated_at"].dataType)
    applied = joined.withColumns(
        {
            "watch_config": F.when(hit, F.to_json("_watch")).otherwise(F.col("watch_config")),
            "metadata": F.when(hit, F.to_json(_merged(F.col("meta"), F.col("_meta")))).otherwise(F.col("metadata")),
            "updated_at": F.when(hit, stamp).otherwise(F.col("updated_at")),
        }
    ).select(*libraries.columns)
    backup = libraries.join(accepted.select("id"), "id", "left_semi")
    return applied, backup, refused
