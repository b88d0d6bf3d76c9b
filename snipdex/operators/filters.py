"""Row filters over file listings, snippets and query tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snipdex.functions import paths as P
from snipdex.functions import text as X

# Fixed values
DEFAULT_MAX_FILE_SIZE = 10 << 20
MAX_RESULTS = 100


def glob_filter(
    files: DataFrame,
    include: Sequence[str],
    exclude: Sequence[str] = (),
    recursive: bool = True,
    column: str = "rel_path",
    mode: str = "glob",
) -> DataFrame:
    """Files whose path below the library root passes the patterns."""
    rule = {"glob": P.glob_match, "watch": P.watch_match, "contains": P.contains_match}[mode]
    if mode == "glob":
        return files.filter(rule(F.col(column), include, exclude, recursive))
    return files.filter(rule(F.col(column), include, exclude))


def size_filter(files: DataFrame, max_size: int = DEFAULT_MAX_FILE_SIZE) -> DataFrame:
    return files.filter(F.col("size") <= max_size)


def custom_pattern_filter(files: DataFrame, patterns: Sequence[dict], column: str = "rel_path") -> DataFrame:
    """Drop files that match an enabled custom pattern."""
    enabled = [p["pattern"] for p in patterns if p.get("enabled", True)]
    if not enabled:
        return files
    rules = [p if "/" in p else "**/" + p for p in enabled]
    return files.filter(~F.col(column).rlike(P.glob_regex(rules)))


def supported_only(files: DataFrame, column: str = "path") -> DataFrame:
    """Files that have a snippet extractor, with their language."""
    return files.withColumn("language", P.detect_language(F.col(column))).filter(F.col("language") != "unknown")


def language_dimension(spark) -> DataFrame:
    return spark.createDataFrame(P.LANGUAGES, "language string, display_name string, main_extension string, mime_type string")


def clean_snippets(snippets: DataFrame, max_tokens: int, column: str = "code") -> DataFrame:
    """Drop snippets that are blank before or after truncation; adds `tokens` and `model_text`."""
    return (
        snippets.filter(~X.is_blank(F.col(column)))
        .withColumn("tokens", X.estimate_tokens(F.col(column)))
        .withColumn("model_text", X.truncate_lines(F.col(column), max_tokens))
        .filter(~X.is_blank(F.col("model_text")))
    )


def query_problem(text: Column, k: Column) -> Column:
    """Why a query is refused, NULL if it is fine."""
    return (
        F.when(X.is_blank(text), "blank query")
        .when(k.isNull() | (k < 1), "k below 1")
        .when(k > MAX_RESULTS, "k above 100")
    )
