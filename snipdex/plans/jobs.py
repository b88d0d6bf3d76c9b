"""Task queues, summaries, joins to libraries, retention, status audits and small rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from snipdex.functions import rules
from snipdex.operators import registry as R
from snipdex.operators import runs as N
from snipdex.operators import tasks as T
from snipdex.plans.catalog import query
from snipdex.plans.domain import DAY_US, FILES_SQL, REGISTRY_SQL, TASKS_SQL, files, load, registry, tasks, ts_text

TS = "strftime(created_at, '%Y-%m-%d %H:%M:%S.%f') AS created_at"


@query(
    "task_summary",
    f"""WITH {TASKS_SQL} SELECT count(*) AS total, count(*) FILTER (status = 'Pending') AS pending,
  count(*) FILTER (status = 'Running') AS running, count(*) FILTER (status = 'Completed') AS completed,
  count(*) FILTER (status = 'Failed') AS failed, count(*) FILTER (status = 'Cancelled') AS cancelled FROM tasks""",
)
def task_summary(spark, sf_dir):
    return T.summary(tasks(spark, sf_dir))


@query(
    "work_queue",
    f"""WITH {TASKS_SQL} SELECT task_id, priority, {TS} FROM tasks WHERE status = 'Pending'
ORDER BY priority DESC, tasks.created_at, task_id LIMIT 50""",
)
def work_queue(spark, sf_dir):
    return T.work_queue(tasks(spark, sf_dir)).select("task_id", "priority", ts_text(F.col("created_at")).alias("created_at"))


@query("task_list", f"WITH {TASKS_SQL} SELECT task_id, type, {TS} FROM tasks WHERE status = 'Failed'")
def task_list(spark, sf_dir):
    return T.by_status(tasks(spark, sf_dir), "Failed").select("task_id", "type", ts_text(F.col("created_at")).alias("created_at"))


@query(
    "requeue_union",
    f"""WITH {TASKS_SQL} SELECT task_id, 'Pending' AS status, status = 'Running' AS interrupted, priority
FROM tasks WHERE status IN ('Pending', 'Running')""",
)
def requeue_union(spark, sf_dir):
    return T.requeue(tasks(spark, sf_dir)).select("task_id", "status", "interrupted", "priority")


@query(
    "task_retention",
    f"""WITH {TASKS_SQL} SELECT task_id, status FROM tasks
WHERE NOT (status IN ('Completed', 'Failed') AND created_at < TIMESTAMP '2001-01-01' - INTERVAL 730 DAY)""",
)
def task_retention(spark, sf_dir):
    kept = T.retained(tasks(spark, sf_dir), "2001-01-01", "730 days", ["Completed", "Failed"])
    return kept.select("task_id", "status")


def _customers(spark, sf_dir):
    """Customers of the even nations stand for the libraries that still exist."""
    return load(spark, sf_dir, "customer").filter("c_nationkey % 2 = 0").select(
        F.col("c_custkey").alias("library_id"), F.col("c_name").alias("library")
    )


@query(
    "task_library_join",
    f"""WITH {TASKS_SQL} SELECT t.task_id, c.c_name AS library,
  CASE WHEN c.c_custkey IS NULL THEN 'Failed' ELSE t.status END AS status,
  CASE WHEN c.c_custkey IS NULL THEN 'library not found' END AS error_message
FROM tasks t LEFT JOIN customer c ON t.library_id = c.c_custkey AND c.c_nationkey % 2 = 0""",
)
def task_library_join(spark, sf_dir):
    joined = T.with_library(tasks(spark, sf_dir), _customers(spark, sf_dir))
    return joined.select("task_id", "library", "status", "error_message")


@query(
    "cascade_delete",
    f"""WITH {TASKS_SQL} SELECT 'details' AS child, t.task_id, t.library_id FROM tasks t JOIN customer c ON t.library_id = c.c_custkey
  WHERE c.c_nationkey % 2 = 0
UNION ALL SELECT 'tasks', t.task_id, c.c_custkey FROM tasks t LEFT JOIN customer c ON t.library_id = c.c_custkey AND c.c_nationkey % 2 = 0""",
)
def cascade_delete(spark, sf_dir):
    deleted = load(spark, sf_dir, "customer").filter("c_nationkey % 2 <> 0").select(F.col("c_custkey").alias("library_id"))
    rows = tasks(spark, sf_dir).select("task_id", "library_id")
    details = R.cascade_delete(rows, deleted, "library_id").select(F.lit("details").alias("child"), "task_id", "library_id")
    nulled = R.set_null_on_delete(rows, deleted, "library_id").select(F.lit("tasks").alias("child"), "task_id", "library_id")
    return details.unionByName(nulled)


@query(
    "duplicate_guard",
    """WITH n AS (SELECT c_custkey AS id, '/repo/src' || (c_custkey % 40) AS path FROM customer),
m AS (SELECT min(id) AS id FROM n GROUP BY path)
SELECT n.id, n.path, n.id IN (SELECT id FROM m) AND CAST(substr(n.path, 10) AS INTEGER) >= 20 AS accepted FROM n""",
)
def duplicate_guard(spark, sf_dir):
    """New registrations from customers against the libraries of the documents."""
    number = (F.col("c_custkey") % 40).cast("string")
    new = load(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.concat(F.lit("/Repo/SRC"), number, F.lit("/")).alias("codebase_path")
    )
    existing = registry(spark, sf_dir).withColumn("is_active", F.lit(True))
    good, refused = R.reject_duplicates(new, existing)
    both = good.withColumn("accepted", F.lit(True)).unionByName(refused.withColumn("accepted", F.lit(False)))
    return both.select("id", F.lower(F.rtrim("codebase_path", F.lit("/"))).alias("path"), "accepted")


@query(
    "membership_update",
    f"""WITH {REGISTRY_SQL}, hit AS (SELECT DISTINCT CAST(o_custkey % 50 AS INTEGER) AS id FROM orders WHERE o_totalprice > 490000)
SELECT r.id, CASE WHEN h.id IS NULL THEN r.status ELSE 'Pending' END AS status,
  strftime(CASE WHEN h.id IS NULL THEN r.updated_at ELSE TIMESTAMP '2025-01-01' END, '%Y-%m-%d %H:%M:%S.%f') AS updated_at
FROM registry r LEFT JOIN hit h ON r.id = h.id""",
)
def membership_update(spark, sf_dir):
    ids = load(spark, sf_dir, "orders").filter("o_totalprice > 490000").select((F.col("o_custkey") % 50).cast("int").alias("id"))
    done = R.set_status(registry(spark, sf_dir), ids, "Pending", "2025-01-01")
    return done.select("id", "status", ts_text(F.col("updated_at")).alias("updated_at"))


@query(
    "registry_patch",
    f"""WITH {REGISTRY_SQL}, p AS (SELECT CAST(substr(source, 4) AS INTEGER) AS id, max(n_chars) AS total_files FROM documents
  GROUP BY source HAVING CAST(substr(source, 4) AS INTEGER) % 2 = 0)
SELECT r.id, CASE WHEN r.id % 4 = 0 THEN 'Renamed ' || r.name ELSE r.name END AS name, coalesce(p.total_files, r.total_files) AS total_files
FROM registry r LEFT JOIN p ON r.id = p.id""",
)
def registry_patch(spark, sf_dir):
    number = F.substring("source", 4, 10).cast("int")
    largest = load(spark, sf_dir, "documents").groupBy("source").agg(F.max("n_chars").alias("total_files"))
    patches = largest.filter(number % 2 == 0).select(
        number.alias("id"), F.when(number % 4 == 0, F.concat(F.lit("Renamed "), "source")).alias("name"), "total_files"
    )
    return R.patch(registry(spark, sf_dir), patches, "id").select("id", "name", "total_files")


STATUS_SQL = """h AS (SELECT event_id, user_id, ts, CASE event_type WHEN 'signup' THEN 'Pending' WHEN 'click' THEN 'Indexing'
  WHEN 'view' THEN 'Indexing' WHEN 'purchase' THEN 'Completed' ELSE 'Failed' END AS status FROM events)"""


@query(
    "status_transition_audit",
    f"""WITH {STATUS_SQL}, p AS (SELECT *, lag(status) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM h)
SELECT event_id, status, before, CASE WHEN before IS NULL THEN status = 'Pending'
  ELSE (before IN ('Pending', 'Failed') AND status = 'Indexing') OR (before = 'Indexing' AND status IN ('Completed', 'Failed')) END AS allowed
FROM p""",
)
def status_transition_audit(spark, sf_dir):
    status = (
        F.when(F.col("event_type") == "signup", "Pending")
        .when(F.col("event_type").isin("click", "view"), "Indexing")
        .when(F.col("event_type") == "purchase", "Completed")
        .otherwise("Failed")
    )
    history = load(spark, sf_dir, "events").select(
        "event_id", "user_id", status.alias("status"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us")
    )
    rows = T.audit_transitions(history, "user_id", "us", "event_id", DAY_US)
    return rows.select("event_id", "status", F.col("prev_status").alias("before"), "allowed")


@query(
    "parse_totals",
    f"""WITH {FILES_SQL} SELECT library, count(*) AS files, sum(len(string_split(text, chr(10)))) AS snippets,
  count(*) FILTER (size > 5000) AS errors, min(CASE WHEN size > 5000 THEN path END) AS first_error FROM files GROUP BY library""",
)
def parse_totals(spark, sf_dir):
    parsed = files(spark, sf_dir).select(
        "library", "path", F.size(F.split("text", "\n")).alias("snippets"), F.when(F.col("size") > 5000, "too large").alias("error")
    )
    return N.parse_totals(parsed)


RUNS_SQL = f"""{FILES_SQL}, r AS (SELECT library, count(*) AS total, count(*) FILTER (size <= 5000) AS ok,
  count(*) FILTER (size > 5000) AS failed FROM files GROUP BY library)"""


@query(
    "index_run_result",
    f"""WITH {RUNS_SQL} SELECT library, total, ok, failed, failed = 0 AS success, round(ok / total, 6) AS rate,
  ok + failed > total AS broken, round(100.0 * ok / total, 6) AS completion FROM r""",
)
def index_run_result(spark, sf_dir):
    good = F.col("size") <= 5000
    counts = files(spark, sf_dir).groupBy("library").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(good).alias("ok"), F.count_if(~good).alias("failed")
    )
    return N.run_result(counts).select(
        "library", "total", "ok", "failed", "success", F.round("rate", 6).alias("rate"), "broken",
        F.round("completion", 6).alias("completion"),
    )


DURATION_SQL = """SELECT event_id, CASE WHEN event_type = 'click' THEN value WHEN event_type = 'view' THEN value / 1000 ELSE 0 END AS seconds
FROM events"""


@query("parse_duration", DURATION_SQL)
def parse_duration(spark, sf_dir):
    number = F.col("value").cast("string")
    text = (
        F.when(F.col("event_type") == "click", F.concat(number, F.lit("s")))
        .when(F.col("event_type") == "view", F.concat(number, F.lit("ms")))
        .when(F.col("event_type") == "error", F.lit("soon"))
    )
    return load(spark, sf_dir, "events").select("event_id", rules.parse_duration(text).alias("seconds"))


@query(
    "status_map",
    """SELECT event_id, CASE event_type WHEN 'click' THEN 'Completed' WHEN 'view' THEN 'Indexing' WHEN 'error' THEN 'Failed'
  ELSE 'Pending' END AS status FROM events""",
)
def status_map(spark, sf_dir):
    kind = F.col("event_type")
    text = F.when(kind == "click", "COMPLETED").when(kind == "view", "indexing").when(kind == "error", "Failed").when(kind == "signup", "new")
    return load(spark, sf_dir, "events").select("event_id", rules.legacy_status(text).alias("status"))


@query(
    "backoff_schedule",
    "SELECT event_id, least(1000.0 * power(2, user_id % 8), 30000.0) AS wait_ms FROM events",
)
def backoff_schedule(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", rules.backoff_ms(1000, F.col("user_id") % 8 + 1).alias("wait_ms"))


@query(
    "category_slug",
    """SELECT p_partkey, lower(regexp_replace(trim(p_name), ' +', '_', 'g')) || '_' || p_size AS slug,
  CASE p_partkey % 4 WHEN 0 THEN 'Backend' WHEN 1 THEN 'Frontend' WHEN 2 THEN 'System' ELSE 'Other' END AS category FROM part""",
)
def category_slug(spark, sf_dir):
    label = F.concat(F.lit(" "), F.initcap("p_name"), F.lit("! ("), F.col("p_size").cast("string"), F.lit(")  "))
    kind = F.get(F.array(F.lit("CSharp"), F.lit("typescript"), F.lit("rust"), F.lit("cobol")), (F.col("p_partkey") % 4).cast("int"))
    return load(spark, sf_dir, "part").select(
        "p_partkey", rules.preset_slug(label).alias("slug"), rules.project_category(kind).alias("category")
    )


@query(
    "task_lookup",
    f"""WITH {TASKS_SQL} SELECT 'running' AS by, task_id, status FROM tasks WHERE library_id % 10 = 3 AND status = 'Running' UNION ALL
SELECT 'id', task_id, status FROM tasks WHERE task_id IN (5, 77, 901)""",
)
def task_lookup(spark, sf_dir):
    rows = tasks(spark, sf_dir)
    running = T.running_of(rows.withColumn("library_id", F.col("library_id") % 10), 3)
    by_id = rows.filter(F.col("task_id").isin(5, 77, 901))
    parts = [r.select(F.lit(n).alias("by"), "task_id", "status") for n, r in (("running", running), ("id", by_id))]
    return parts[0].unionByName(parts[1])
