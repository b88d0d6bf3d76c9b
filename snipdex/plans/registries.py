"""Registry lookups, lists, statistics and JSON predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from snipdex.functions import jsonx as J
from snipdex.operators import registry as R
from snipdex.plans.catalog import query
from snipdex.plans.domain import REGISTRY_SQL, files, load, registry, ts_text
from snipdex.session import spread_scan

MONITORED = "is_active AND is_enabled"


def _parsed(spark, sf_dir):
    return R.parse(registry(spark, sf_dir))


@query(
    "registry_stats",
    f"""WITH {REGISTRY_SQL} SELECT count(*) AS total_libraries, sum(total_files) AS total_files,
  sum(indexed_snippets) AS total_snippets, count(*) FILTER (status = 'Completed') AS completed,
  count(*) FILTER (status = 'Failed') AS failed, count(*) FILTER (is_enabled) AS monitored,
  count(*) AS active, avg(duration) AS average_duration FROM registry WHERE is_active""",
)
def registry_stats(spark, sf_dir):
    return R.global_statistics(_parsed(spark, sf_dir))


@query(
    "language_distribution",
    f"""WITH {REGISTRY_SQL}, a AS (SELECT * FROM registry WHERE is_active)
SELECT 'python' AS language, sum(en) AS files FROM a UNION ALL SELECT 'javascript', sum(fr) FROM a
UNION ALL SELECT 'typescript', sum(de) FROM a UNION ALL SELECT 'csharp', sum(es) FROM a""",
)
def language_distribution(spark, sf_dir):
    return R.language_distribution(_parsed(spark, sf_dir))


@query(
    "type_distribution",
    f"WITH {REGISTRY_SQL} SELECT coalesce(project_type, 'unknown') AS value, count(*) AS libraries FROM registry WHERE is_active GROUP BY 1",
)
def type_distribution(spark, sf_dir):
    return R.project_type_distribution(_parsed(spark, sf_dir))


@query(
    "team_distribution",
    f"WITH {REGISTRY_SQL} SELECT coalesce(team, 'default') AS value, count(*) AS libraries FROM registry WHERE is_active GROUP BY 1",
)
def team_distribution(spark, sf_dir):
    return R.team_distribution(_parsed(spark, sf_dir))


@query(
    "status_report",
    f"""WITH {REGISTRY_SQL} SELECT status, count(*) AS libraries, count(*) FILTER (is_enabled) AS monitored
FROM registry WHERE is_active GROUP BY status""",
)
def status_report(spark, sf_dir):
    return R.status_report(_parsed(spark, sf_dir))


@query(
    "library_list",
    f"""WITH {REGISTRY_SQL}, l AS (
  SELECT 'all' AS list, id, status FROM registry WHERE is_active UNION ALL
  SELECT 'completed', id, status FROM registry WHERE is_active AND status = 'Completed' UNION ALL
  SELECT 'monitored', id, status FROM registry WHERE {MONITORED} UNION ALL
  SELECT 'webapi', id, status FROM registry WHERE is_active AND project_type = 'webapi' UNION ALL
  SELECT 'backend', id, status FROM registry WHERE is_active AND team = 'backend' UNION ALL
  SELECT 'high', id, status FROM registry WHERE is_active AND priority = 'high' UNION ALL
  SELECT 'node', id, status FROM registry WHERE is_active AND framework = 'node' UNION ALL
  SELECT 'tag2', id, status FROM registry WHERE is_active AND list_contains(tags, 'tag2'))
SELECT * FROM l""",
)
def library_list(spark, sf_dir):
    """Eight lists from one pass over the registry."""
    lists = {
        "all": F.lit(True),
        "completed": R.has_status("Completed"),
        "monitored": R.is_monitored(),
        "webapi": R.has_metadata(projectType="webapi"),
        "backend": R.has_metadata(team="backend"),
        "high": R.has_metadata(priority="high"),
        "node": R.has_key("metadata", "framework", "node"),
        "tag2": R.has_tag("tag2"),
    }
    return R.list_each(_parsed(spark, sf_dir), lists).select("list", "id", "status")


@query(
    "library_lookup",
    f"""WITH {REGISTRY_SQL} SELECT 'id' AS by, id, name FROM registry WHERE is_active AND id = 3 UNION ALL
SELECT 'path', id, name FROM registry WHERE is_active AND codebase_path = '/repo/src4' UNION ALL
SELECT 'collection', id, name FROM registry WHERE is_active AND collection_name = 'code_index_' || substr(sha256('/repo/src5'), 1, 8)""",
)
def library_lookup(spark, sf_dir):
    libraries = registry(spark, sf_dir)
    import hashlib

    name = "code_index_" + hashlib.sha256(b"/repo/src5").hexdigest()[:8]
    found = {
        "id": R.by_id(libraries, 3),
        "path": R.by_path(libraries, "\\Repo\\.\\SRC4\\"),
        "collection": R.by_collection(libraries, name),
    }
    parts = [rows.select(F.lit(by).alias("by"), "id", "name") for by, rows in found.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "library_flat",
    f"""WITH {REGISTRY_SQL} SELECT id, name, coalesce(project_type, 'unknown') AS project_type, coalesce(team, '') AS team,
  framework, priority, array_to_string(tags, ',') AS tags, is_enabled AS is_monitored,
  array_to_string(file_patterns, ',') AS file_patterns, 'bin,obj' AS exclude_patterns,
  strftime(updated_at, '%Y-%m-%d %H:%M:%S.%f') AS updated_at FROM registry""",
)
def library_flat(spark, sf_dir):
    flat = R.flatten(_parsed(spark, sf_dir))
    lists = {c: F.array_join(c, ",") for c in ("tags", "file_patterns", "exclude_patterns")}
    return flat.withColumns(lists).withColumn("updated_at", ts_text(F.col("updated_at"))).select(
        "id", "name", "project_type", "team", "framework", "priority", "tags", "is_monitored",
        "file_patterns", "exclude_patterns", "updated_at",
    )


@query(
    "library_rows",
    f"""WITH {REGISTRY_SQL} SELECT id, name, total_files, indexed_snippets, duration AS last_duration,
  chars // total_files AS average_file_size, 4 AS languages, is_enabled AS is_monitored, lower(status) AS legacy_status,
  regexp_replace(regexp_replace(CAST(duration AS VARCHAR), '0+$', ''), '\\.$', '') || 's' AS legacy_duration
FROM registry""",
)
def library_rows(spark, sf_dir):
    parsed = _parsed(spark, sf_dir)
    legacy = R.legacy_row(parsed).select(
        F.col("id").cast("int").alias("id"), F.col("indexing_status").alias("legacy_status"),
        F.col("last_duration").alias("legacy_duration"),
    )
    return R.statistics_row(parsed).drop("status").join(legacy, "id")


@query(
    "top_libraries",
    f"""WITH {REGISTRY_SQL} SELECT id, name, indexed_snippets, total_files, (chars // total_files) * total_files AS size_bytes
FROM registry WHERE is_active ORDER BY size_bytes DESC, id LIMIT 10""",
)
def top_libraries(spark, sf_dir):
    return R.top_libraries(_parsed(spark, sf_dir))


@query(
    "recent_activity",
    f"""WITH {REGISTRY_SQL}, a AS (
  SELECT id, name, 'created' AS activity, created_at AS at_time FROM registry WHERE is_active UNION ALL
  SELECT id, name, 'updated', updated_at FROM registry WHERE is_active UNION ALL
  SELECT id, name, 'indexed', last_indexed_at FROM registry WHERE is_active AND last_indexed_at IS NOT NULL)
SELECT id, name, activity, strftime(at_time, '%Y-%m-%d %H:%M:%S.%f') AS at_time FROM a ORDER BY a.at_time DESC, id, activity LIMIT 10""",
)
def recent_activity(spark, sf_dir):
    return R.recent_activity(registry(spark, sf_dir)).withColumn("at_time", ts_text(F.col("at_time")))


@query(
    "type_rollup",
    f"""WITH {REGISTRY_SQL} SELECT coalesce(project_type, 'unknown') AS project_type, count(*) AS libraries,
  sum(indexed_snippets) AS snippets FROM registry WHERE is_active GROUP BY 1""",
)
def type_rollup(spark, sf_dir):
    return R.type_rollup(_parsed(spark, sf_dir))


@query(
    "size_stats",
    """SELECT source AS library, lang, count(*) AS files, sum(n_chars) AS bytes, round(avg(n_chars), 6) AS average_size,
  max(n_chars) AS largest FROM documents GROUP BY source, lang""",
)
def size_stats(spark, sf_dir):
    return files(spark, sf_dir).groupBy("library", "lang").agg(
        F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"),
        F.round(F.avg("size"), 6).alias("average_size"), F.max("size").alias("largest"),
    )


def _event_docs(spark, sf_dir):
    """Event properties grown to a richer document; every seventh one is cut off."""
    user = F.col("user_id").cast("string")
    doc = F.concat(
        F.regexp_replace("props", "\\}$", ""),
        F.lit(', "isEnabled": '), F.when(F.col("event_id") % 2 == 0, "true").otherwise("false"),
        F.lit(', "tags": ["'), F.col("event_type"), F.lit('", "u'), user,
        F.lit('"], "nested": {"team": "team'), (F.col("user_id") % 5).cast("string"), F.lit('", "ratio": 0.5}, "gone": null}'),
    )
    cut = F.when(F.col("event_id") % 7 == 0, F.substring(doc, F.lit(1), F.length(doc) - 1)).otherwise(doc)
    return spread_scan(load(spark, sf_dir, "events"), "event_id").select("event_id", cut.alias("doc"))


DOCS_SQL = """docs AS (SELECT event_id, event_type, user_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k,
  event_id % 7 <> 0 AS valid FROM events)"""


@query(
    "json_predicates",
    f"""WITH {DOCS_SQL} SELECT event_id, valid,
  CASE WHEN valid THEN k END AS k, CASE WHEN valid THEN 2 END AS n_tags,
  valid AND event_id % 2 = 0 AS enabled, valid AND event_type = 'click' AS is_click,
  valid AND user_id % 5 = 3 AS in_team3, valid AND ('u' || user_id) LIKE '%u1%' AS tags_like
FROM docs""",
)
def json_predicates(spark, sf_dir):
    docs = _event_docs(spark, sf_dir).withColumn("valid", J.is_valid(F.col("doc")))
    doc = F.when(F.col("valid"), F.col("doc"))

    def holds(condition):
        return F.coalesce(condition, F.lit(False))

    return docs.select(
        "event_id",
        "valid",
        J.extract(doc, "$.k").cast("long").alias("k"),
        J.array_length(doc, "$.tags").alias("n_tags"),
        holds(J.field(doc, "IsEnabled") == "true").alias("enabled"),
        holds(J.array_has(doc, "$.tags", "click")).alias("is_click"),
        holds(J.extract(doc, "$.nested.team") == "team3").alias("in_team3"),
        holds(J.contains_text(doc, "$.tags", "u1")).alias("tags_like"),
    )


@query(
    "json_type_valid",
    f"""WITH {DOCS_SQL}, v AS (SELECT * FROM docs WHERE valid)
SELECT event_id, 'object' AS root_type, 'integer' AS k_type, 'array' AS tags_type, 'real' AS ratio_type,
  'null' AS gone_type, CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END AS flag_type, CAST(NULL AS VARCHAR) AS absent_type
FROM v UNION ALL SELECT event_id, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM docs WHERE NOT valid""",
)
def json_type_valid(spark, sf_dir):
    doc = F.col("doc")
    paths = {
        "root_type": "$", "k_type": "$.k", "tags_type": "$.tags", "ratio_type": "$.nested.ratio",
        "gone_type": "$.gone", "flag_type": "$.isEnabled", "absent_type": "$.nothing",
    }
    return _event_docs(spark, sf_dir).select("event_id", *[J.type_at(doc, p).alias(n) for n, p in paths.items()])


@query(
    "json_set_remove",
    """SELECT event_id, '{"k":' || k || ',"team":"t' || (user_id % 5) || '"}' AS with_team,
  '{"k":' || (k + 1) || '}' AS replaced, '{"k":' || k || '}' AS kept, '{}' AS emptied
FROM (SELECT event_id, user_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events)""",
)
def json_set_remove(spark, sf_dir):
    events = load(spark, sf_dir, "events")
    doc = F.regexp_replace("props", " ", "")
    team = F.concat(F.lit('"t'), (F.col("user_id") % 5).cast("string"), F.lit('"'))
    more = (J.extract(F.col("props"), "$.k").cast("long") + 1).cast("string")
    return events.select(
        "event_id",
        J.set_key(doc, "team", team).alias("with_team"),
        J.set_key(doc, "k", more).alias("replaced"),
        J.insert_key(doc, "k", more).alias("kept"),
        J.remove_key(doc, "k").alias("emptied"),
    )


@query(
    "json_each",
    f"""WITH {REGISTRY_SQL} SELECT id, 'python' AS key, en AS value FROM registry UNION ALL SELECT id, 'javascript', fr FROM registry
UNION ALL SELECT id, 'typescript', de FROM registry UNION ALL SELECT id, 'csharp', es FROM registry""",
)
def json_each(spark, sf_dir):
    inner = J.field(F.col("statistics"), "languageDistribution")
    rows = registry(spark, sf_dir).select("id", F.explode(J.entries(inner)).alias("key", "value"))
    return rows.withColumn("value", F.col("value").cast("long"))


@query(
    "json_audit",
    f"""WITH {DOCS_SQL} SELECT event_id, depth, CASE WHEN depth IS NULL THEN 'invalid' WHEN depth > 3 THEN 'too deep' ELSE 'ok' END AS verdict
FROM (SELECT event_id, CASE WHEN event_id % 11 = 10 THEN NULL ELSE 1 + event_id % 5 END AS depth FROM docs)""",
)
def json_audit(spark, sf_dir):
    """Event properties wrapped in up to four levels of objects and arrays; some are damaged."""
    wrapped = F.col("props")
    for level in range(4):
        left, right = ('{"in [{": ', "}") if level % 2 else ("[", "]")
        wrapped = F.when(F.col("event_id") % 5 > level, F.concat(F.lit(left), wrapped, F.lit(right))).otherwise(wrapped)
    doc = F.when(F.col("event_id") % 11 == 10, F.concat(wrapped, F.lit("}"))).otherwise(wrapped)
    docs = load(spark, sf_dir, "events").select("event_id", doc.alias("doc"))
    depth = F.when(J.is_valid(F.col("doc")), J.depth(F.col("doc")))
    verdict = F.when(F.col("depth").isNull(), "invalid").when(F.col("depth") > 3, "too deep").otherwise("ok")
    return docs.select("event_id", depth.alias("depth")).withColumn("verdict", verdict)


@query(
    "recently_indexed",
    f"""WITH {REGISTRY_SQL} SELECT id, strftime(coalesce(last_indexed_at, created_at), '%Y-%m-%d %H:%M:%S.%f') AS indexed
FROM registry ORDER BY coalesce(last_indexed_at, created_at) DESC, id LIMIT 10""",
)
def recently_indexed(spark, sf_dir):
    rows = R.order_by_last_indexed(registry(spark, sf_dir)).limit(10)
    return rows.select("id", ts_text(F.coalesce("last_indexed_at", "created_at")).alias("indexed"))


@query(
    "history_append",
    f"""WITH {REGISTRY_SQL} SELECT id, CASE WHEN id % 2 = 0 THEN 1 ELSE 0 END AS runs,
  CASE WHEN id % 2 = 0 THEN en + 0.5 ELSE duration END AS last_duration, CASE WHEN id % 2 = 0 THEN total_files END AS files FROM registry""",
)
def history_append(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    number = F.substring("source", 4, 10).cast("int")
    runs = docs.groupBy(number.alias("id")).agg(
        F.lit("2024-06-01").alias("date"), (F.count_if(F.col("lang") == "en") + 0.5).alias("duration"),
        F.count(F.lit(1)).alias("files"), F.count(F.lit(1)).alias("snippets"),
    ).filter("id % 2 = 0")
    rows = R.append_history(_parsed(spark, sf_dir), runs)
    return rows.select(
        "id", F.size("stats.indexingHistory").alias("runs"), F.col("stats.lastIndexingDuration").alias("last_duration"),
        F.get(F.col("stats.indexingHistory"), F.lit(0))["filesProcessed"].alias("files"),
    )


@query(
    "metadata_update",
    f"""WITH {REGISTRY_SQL} SELECT id, CASE WHEN id % 2 = 0 THEN 'me' END AS reviewer, id % 2 = 1 AS has_priority FROM registry""",
)
def metadata_update(spark, sf_dir):
    """Set one metadata key in the even libraries and remove another one."""
    libraries = registry(spark, sf_dir)
    even = libraries.filter("id % 2 = 0").select("id")
    grown = R.append_metadata(libraries, even, "reviewer", F.lit('"me"'))
    cut = R.remove_metadata(grown, even, "Priority")
    return cut.select(
        "id", J.extract(F.col("metadata"), "$.reviewer").alias("reviewer"),
        J.field(F.col("metadata"), "priority").isNotNull().alias("has_priority"),
    )
