"""Background-task tables: queues, summaries, retention and status audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snipdex.functions.rules import older_than
from snipdex.operators.sessions import previous_in_group

# Fixed values
STATUSES = ["Pending", "Running", "Completed", "Failed", "Cancelled"]
QUEUE_LIMIT = 50
MISSING_LIBRARY = "library not found"

# A run may start from Pending or Failed and end only while Indexing
ALLOWED_TRANSITIONS = [
    ("Pending", "Indexing"),
    ("Failed", "Indexing"),
    ("Indexing", "Completed"),
    ("Indexing", "Failed"),
]


def summary(tasks: DataFrame) -> DataFrame:
    return tasks.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("status") == s).alias(s.lower()) for s in STATUSES],
    )


def work_queue(tasks: DataFrame, limit: int = QUEUE_LIMIT) -> DataFrame:
    """The next pending tasks: high priority first, then oldest."""
    pending = tasks.filter(F.col("status") == "Pending")
    return pending.orderBy(F.desc("priority"), "created_at", "task_id").limit(limit)


def newest_first(tasks: DataFrame) -> DataFrame:
    return tasks.orderBy(F.desc("created_at"), "task_id")


def by_status(tasks: DataFrame, status: str) -> DataFrame:
    return newest_first(tasks.filter(F.col("status") == status))


def running_of(tasks: DataFrame, library_id: int) -> DataFrame:
    return newest_first(tasks.filter((F.col("library_id") == library_id) & (F.col("status") == "Running")))


def requeue(tasks: DataFrame) -> DataFrame:
    """Interrupted and waiting tasks, each once, in queue order; all are pending again."""
    running = tasks.filter(F.col("status") == "Running").withColumn("status", F.lit("Pending"))
    running = running.withColumn("interrupted", F.lit(True))
    pending = tasks.filter(F.col("status") == "Pending").withColumn("interrupted", F.lit(False))
    both = running.unionByName(pending).dropDuplicates(["task_id"])
    return both.orderBy(F.desc("priority"), "created_at", "task_id")


def expired(tasks: DataFrame, as_of: str, max_age: str, states: list[str] | None = None) -> DataFrame:
    """Tasks in an end state that are older than `max_age`."""
    ended = F.col("status").isin(states or ["Completed"])
    return tasks.filter(ended & older_than(F.col("created_at"), as_of, max_age))


def retained(tasks: DataFrame, as_of: str, max_age: str, states: list[str] | None = None) -> DataFrame:
    ended = F.col("status").isin(states or ["Completed"])
    return tasks.filter(~(ended & older_than(F.col("created_at"), as_of, max_age)))


def with_library(tasks: DataFrame, libraries: DataFrame, key: str = "library_id") -> DataFrame:
    """Left join; a task whose library is missing fails with a message."""
    joined = tasks.join(libraries.withColumn("_found", F.lit(True)), key, "left")
    missing = F.col("_found").isNull()
    return joined.withColumns(
        {
            "status": F.when(missing, F.lit("Failed")).otherwise(F.col("status")),
            "error_message": F.when(missing, F.lit(MISSING_LIBRARY)),
        }
    ).drop("_found")


def illegal_transition(before: Column, after: Column) -> Column:
    legal = F.lit(False)
    for a, b in ALLOWED_TRANSITIONS:
        legal = legal | ((before == a) & (after == b))
    return ~legal


def audit_transitions(history: DataFrame, key: str, micros: str, tie: str, span_us: int) -> DataFrame:
    """Status changes with the status before them, and whether the step is allowed.

    The first row of a key has no predecessor and is allowed only as Pending.
    """
    rows = previous_in_group(history, key, micros, tie, ["status"], span_us)
    before = F.col("prev_status")
    allowed = F.when(before.isNull(), F.col("status") == "Pending").otherwise(
        ~illegal_transition(before, F.col("status"))
    )
    return rows.withColumn("allowed", allowed)
