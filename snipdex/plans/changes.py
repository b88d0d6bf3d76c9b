"""Change events: bursts, renames, states, retention; batch and streaming forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from snipdex.operators import embed as M
from snipdex.operators import index as I
from snipdex.operators import sessions
from snipdex.plans.catalog import query
from snipdex.plans.domain import CHANGES_SQL, DAY_US, changes, changes_from, load, ts_text
from snipdex.session import scratch_path
from snipdex.sources.index_store import IndexStore
from snipdex.streaming import changes as C
from snipdex.streaming import lifecycle as L
from snipdex.streaming.apply import apply_held, start_apply

GAP_US = 6 * 3_600_000_000

BURSTS_SQL = f"""{CHANGES_SQL},
g AS (SELECT *, CASE WHEN event_time - lag(event_time) OVER w <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS opens FROM changes WINDOW w AS (PARTITION BY path ORDER BY event_time, event_id)),
n AS (SELECT *, sum(opens) OVER (PARTITION BY path ORDER BY event_time, event_id) AS burst FROM g),
bursts AS (SELECT path, min(event_time) AS first_time, max(event_time) AS last_time, count(*) AS n_changes,
  arg_max(change_type, (event_time, event_id)) AS change_type FROM n GROUP BY path, burst)"""


@query(
    "debounce_batch",
    f"""WITH {BURSTS_SQL} SELECT path, strftime(first_time, '%Y-%m-%d %H:%M:%S.%f') AS first_time,
  strftime(last_time, '%Y-%m-%d %H:%M:%S.%f') AS last_time, n_changes, change_type FROM bursts""",
)
def debounce_batch(spark, sf_dir):
    bursts = sessions.debounce(changes(spark, sf_dir), GAP_US, DAY_US)
    times = {n: ts_text(F.timestamp_micros(c)) for n, c in (("first_time", "first_us"), ("last_time", "last_us"))}
    return bursts.withColumns(times).drop("first_us", "last_us")


@query(
    "burst_action",
    f"""WITH {BURSTS_SQL} SELECT change_type, CASE WHEN change_type = 'Deleted' THEN 'delete' ELSE 'update' END AS action,
  count(*) AS bursts, sum(n_changes) AS n_changes FROM bursts GROUP BY 1, 2""",
)
def burst_action(spark, sf_dir):
    bursts = C.burst_action(sessions.debounce(changes(spark, sf_dir), GAP_US, DAY_US))
    return bursts.groupBy("change_type", "action").agg(F.count(F.lit(1)).alias("bursts"), F.sum("n_changes").alias("n_changes"))


@query(
    "rename_split",
    f"""WITH {CHANGES_SQL} SELECT event_id, path, CASE WHEN change_type = 'Renamed' THEN 'Deleted' ELSE change_type END AS change_type FROM changes
UNION ALL SELECT event_id, new_path, 'Created' FROM changes WHERE change_type = 'Renamed'""",
)
def rename_split(spark, sf_dir):
    return C.split_renames(changes(spark, sf_dir)).select("event_id", "path", "change_type")


@query(
    "debounce_stream",
    f"""WITH {BURSTS_SQL} SELECT path, strftime(first_time, '%Y-%m-%d %H:%M:%S.%f') AS first_time,
  strftime(last_time, '%Y-%m-%d %H:%M:%S.%f') AS last_time, n_changes, change_type FROM bursts""",
)
def debounce_stream(spark, sf_dir):
    """The bursts a stream over all events gives out, and those its state still holds at its end."""
    source = load(spark, sf_dir, "events")
    # A pattern lets the source be one file or a folder of files.
    stream = spark.readStream.schema(source.schema).parquet(f"{sf_dir}/events.parque[t]")
    bursts = C.debounce_stream(changes_from(stream), "6 hours", "10 minutes")
    out = scratch_path(spark, "bursts")
    run = bursts.writeStream.format("parquet").option("checkpointLocation", out + "-state").trigger(availableNow=True).start(out)
    run.awaitTermination()
    rows = spark.read.schema(bursts.schema).parquet(out)
    rows = rows.unionByName(C.held_bursts(spark, out + "-state"))
    return rows.withColumns({c: ts_text(F.col(c)) for c in ("first_time", "last_time")})


STATES_SQL = f"""{CHANGES_SQL}, s AS (SELECT path AS event_id, event_time, event_id AS n, path,
  CASE change_type WHEN 'Created' THEN 'Pending' WHEN 'Modified' THEN 'Processing' WHEN 'Deleted' THEN 'Failed' ELSE 'Completed' END AS status FROM changes)"""


def _as_states(rows):
    """Change events as state reports; the path stands for the event id."""
    kind = F.col("change_type")
    status = F.when(kind == "Created", "Pending").when(kind == "Modified", "Processing").when(kind == "Deleted", "Failed").otherwise("Completed")
    return rows.select(F.col("path").alias("event_id"), "path", "event_time", status.alias("status"))


def _states(spark, sf_dir):
    return _as_states(changes(spark, sf_dir))


@query(
    "event_state",
    f"""WITH {STATES_SQL} SELECT event_id, arg_max(status, event_time) AS status, count(*) FILTER (status = 'Failed') AS retry_count,
  strftime(max(event_time), '%Y-%m-%d %H:%M:%S.%f') AS event_time FROM s GROUP BY event_id""",
)
def event_state(spark, sf_dir):
    rows = L.latest_state(_states(spark, sf_dir))
    return rows.select("event_id", "status", "retry_count", ts_text(F.col("event_time")).alias("event_time"))


@query(
    "event_dedup",
    f"WITH {CHANGES_SQL} SELECT event_id, path FROM changes",
)
def event_dedup(spark, sf_dir):
    """Every event arrives twice and is kept once."""
    rows = changes(spark, sf_dir)
    return C.drop_repeats(rows.unionByName(rows)).select("event_id", "path")


@query(
    "event_retention",
    f"""WITH {STATES_SQL} SELECT event_id, status, strftime(event_time, '%Y-%m-%d %H:%M:%S.%f') AS event_time FROM s
WHERE NOT (status IN ('Completed', 'Failed', 'Expired') AND event_time < TIMESTAMP '2024-01-31' - INTERVAL 7 DAY)""",
)
def event_retention(spark, sf_dir):
    kept = L.retention(_states(spark, sf_dir), "2024-01-31", "7 days")
    return kept.select("event_id", "status", ts_text(F.col("event_time")).alias("event_time"))


def _user_files(spark, sf_dir):
    """The file of a user: a function for every line of the document of the same number, with the line in it."""
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.concat(F.lit("def f_"), i.cast("string"), F.lit("():\n    # "), x))
    docs = load(spark, sf_dir, "documents").select("doc_id", F.array_join(lines, "\n").alias("text"))

    def files_of(wanted):
        number = F.regexp_extract("path", "file_([0-9]+)", 1).cast("long")
        return wanted.withColumn("doc_id", number).join(docs, "doc_id").select("root", "path", "text")

    return files_of


@query(
    "apply_stream",
    f"""WITH {CHANGES_SQL}, c AS (
  SELECT event_id, library, path, CASE WHEN change_type = 'Renamed' THEN 'Deleted' ELSE change_type END AS change_type, event_time FROM changes
  UNION ALL SELECT event_id, library, new_path, 'Created', event_time FROM changes WHERE change_type = 'Renamed'),
g AS (SELECT *, CASE WHEN event_time - lag(event_time) OVER w <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS opens FROM c WINDOW w AS (PARTITION BY path ORDER BY event_time, event_id)),
n AS (SELECT *, sum(opens) OVER (PARTITION BY path ORDER BY event_time, event_id) AS burst FROM g),
b AS (SELECT library, path, max(event_time) AS last_time, arg_max(change_type, (event_time, event_id)) AS change_type FROM n GROUP BY library, path, burst),
l AS (SELECT library, path, arg_max(change_type, last_time) AS change_type FROM b GROUP BY library, path),
t AS (SELECT doc_id, count(*) AS snippets, md5(string_agg('def f_' || i || '():' || chr(10) || '    # ' || x, chr(10) ORDER BY i)) AS code_md5
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents) GROUP BY doc_id)
SELECT 'code_index_' || substr(sha256('/repo/' || l.library), 1, 8) AS collection, l.path AS file_path,
  d.snippets, d.code_md5 FROM l JOIN t d ON d.doc_id = CAST(regexp_extract(l.path, 'file_([0-9]+)', 1) AS BIGINT)
WHERE l.change_type <> 'Deleted'""",
)
def apply_stream(spark, sf_dir):
    """The index after a stream of all changes: renames split, bursts debounced, files replaced; then what the state holds."""
    source = load(spark, sf_dir, "events")
    stream = changes_from(spark.readStream.schema(source.schema).parquet(f"{sf_dir}/events.parque[t]"))
    rooted = C.split_renames(stream).withColumn("root", F.concat(F.lit("/repo/"), "library"))
    bursts = C.debounce_stream(rooted, "6 hours", "10 minutes", keys=("root", "path"))
    path = scratch_path(spark, "stream-index")
    store = IndexStore(spark, path, buckets=4)
    model = M.embedder("hashed_tokens", dim=16)
    build = lambda files: I.build_index(files, model, 16, batch=200)
    files_of = _user_files(spark, sf_dir)
    start_apply(bursts, store, files_of, build, path + "-state", name=path.rsplit("/", 1)[-1]).awaitTermination()
    apply_held(C.held_bursts(spark, path + "-state", ("root", "path")), store, files_of, build, path + "-state")
    code = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start_line", "code"))), lambda x: x["code"]), "\n")
    return store.read().groupBy("collection", "file_path").agg(F.count(F.lit(1)).alias("snippets"), F.md5(code).alias("code_md5"))


TTL_MS = 3 * 86_400_000


@query(
    "lifecycle_stream",
    f"""WITH {STATES_SQL}, f AS (SELECT event_id, arg_max(status, event_time) AS status, count(*) FILTER (status = 'Failed') AS retry_count,
  max(event_time) AS at_time FROM s GROUP BY event_id)
SELECT event_id, CASE WHEN status IN ('Pending', 'Processing') AND epoch_us(at_time) // 1000 + {TTL_MS} <=
    (SELECT epoch_us(max(event_time)) // 1000 FROM s) - 600000 THEN 'Expired' ELSE status END AS status, retry_count FROM f""",
)
def lifecycle_stream(spark, sf_dir):
    """The last state of every event id after a stream of all state reports."""
    source = load(spark, sf_dir, "events")
    stream = changes_from(spark.readStream.schema(source.schema).parquet(f"{sf_dir}/events.parque[t]"))
    states = L.lifecycle_stream(_as_states(stream), TTL_MS, "10 minutes")
    out = scratch_path(spark, "lifecycle")
    with L.rocksdb_state(spark):
        run = states.writeStream.format("parquet").option("checkpointLocation", out + "-state").trigger(availableNow=True).start(out)
        run.awaitTermination()
    rows = spark.read.schema(states.schema).parquet(out)
    order = F.struct("last_us", F.col("status") == "Expired", "retry_count")
    return rows.groupBy("event_id").agg(F.max_by("status", order).alias("status"), F.max("retry_count").alias("retry_count"))
