"""Small constant rules: durations, status names, back-off, categories, slugs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from snipdex.functions.paths import literal_map

# Fixed values
STATUS_BY_LEGACY_NAME = {
    "completed": "Completed",
    "failed": "Failed",
    "indexing": "Indexing",
    "cancelled": "Cancelled",
}

# Fixed values
CATEGORY_BY_TYPE = {
    "csharp": "Backend",
    "typescript": "Frontend",
    "javascript": "Frontend",
    "python": "Data/Backend",
    "java": "Backend",
    "cpp": "System",
    "go": "Backend",
    "rust": "System",
    "mixed": "Mixed",
}

BACKOFF_CEILING_MS = 30000


def parse_duration(text: Column) -> Column:
    """Seconds of `12s` or `5ms`; anything else is 0."""
    number = "[+-]?[0-9]+(?:\\.[0-9]*)?"
    millis = F.regexp_extract(text, f"^({number})ms$", 1)
    seconds = F.regexp_extract(text, f"^({number})s$", 1)
    return (
        F.when(millis != "", millis.try_cast("double") / 1000)
        .when(seconds != "", seconds.try_cast("double"))
        .otherwise(F.lit(0.0))
    )


def legacy_status(text: Column) -> Column:
    known = F.element_at(literal_map(STATUS_BY_LEGACY_NAME), F.lower(text))
    return F.coalesce(known, F.lit("Pending"))


def backoff_ms(base_ms: Column | int, attempt: Column) -> Column:
    """Doubling delay from the first attempt on, capped at 30 seconds."""
    base = F.lit(base_ms) if isinstance(base_ms, int) else base_ms
    return F.least(base * F.pow(F.lit(2.0), attempt - 1), F.lit(float(BACKOFF_CEILING_MS)))


def project_category(project_type: Column) -> Column:
    known = F.element_at(literal_map(CATEGORY_BY_TYPE), F.lower(project_type))
    return F.coalesce(known, F.lit("Other"))


def preset_slug(name: Column) -> Column:
    """Letters and digits only, words joined by an underscore, lower case."""
    clean = F.regexp_replace(name, "[^\\p{L}\\p{Nd}\\s]", "")
    return F.lower(F.array_join(F.filter(F.split(clean, " "), lambda w: w != ""), "_"))


def older_than(ts: Column, as_of: str, max_age: str) -> Column:
    """True before `as_of` minus an interval such as `30 days`."""
    return ts < F.to_timestamp(F.lit(as_of)) - F.expr(f"INTERVAL {max_age}")
