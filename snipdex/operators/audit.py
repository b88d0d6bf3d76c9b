"""Quality jobs over configuration tables: audit, clean, suggest, compare, apply.

Each audit is one pass: a row builds the list of its own findings, and the lists are exploded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snipdex.functions import jsonx as J
from snipdex.functions.text import TRIM_END, bind

# Fixed values
ALLOWED_EXTENSIONS = [
    ".cs", ".csx", ".cshtml", ".razor", ".vb", ".fs",
    ".ts", ".tsx", ".js", ".jsx", ".mjs", ".vue", ".svelte",
    ".py", ".pyi", ".pyx", ".ipynb",
    ".java", ".kt", ".scala", ".groovy",
    ".cpp", ".c", ".h", ".hpp", ".cc", ".cxx", ".hh", ".hxx",
    ".go",
    ".rs",
    ".php", ".rb", ".swift", ".dart", ".lua",
    ".html", ".htm", ".css", ".scss", ".sass", ".less",
    ".xml", ".json", ".yaml", ".yml", ".toml", ".ini",
    ".sql", ".md", ".txt", ".log",
]
UNSAFE_PARTS = ["..", "~", "$", "//", "\\\\", "|", "&", ";", "`"]
PATTERN_RULE = "(?U)^[\\w*?./-]+$"
NAME_RULE = "(?U)^[\\w\\-\\s]+$"
TAG_RULE = "(?U)^[\\w\\-.]+$"
PROJECT_TYPES = ["unknown", "csharp", "typescript", "javascript", "python", "java", "cpp", "go", "rust", "mixed"]
PRIORITIES = ["low", "normal", "high", "critical"]
MAX_FILE_SIZE = 100 << 20
LARGE_FILE_SIZE = 50 << 20
USUAL_FILE_SIZE = 10 << 20
MANY_PATTERNS = 20
MAX_EXCLUDE = 500
MAX_FILTER_NAME = 50
MAX_FILTER_PATTERN = 200
MAX_TAG = 50
MAX_SETTINGS = 50
MAX_SETTING_KEY = 100
MAX_SETTING_VALUE = 10_000
MAX_JSON_CHARS = 1 << 20
MAX_JSON_DEPTH = 10

# Default patterns and common excludes per project type
DEFAULT_PATTERNS = {
    "csharp": ["*.cs", "*.csx"],
    "typescript": ["*.ts", "*.tsx"],
    "javascript": ["*.js", "*.jsx"],
    "python": ["*.py"],
    "java": ["*.java"],
}
OTHER_PATTERNS = ["*.cs"]
COMMON_EXCLUDES = [".git", "node_modules"]
TYPE_EXCLUDES = {
    "csharp": ["bin", "obj", ".vs"],
    "typescript": ["dist", "build"],
    "javascript": ["dist", "build"],
    "python": ["__pycache__", ".venv", "venv"],
    "java": ["target", "build"],
}

FINDINGS = "array<struct<rule:string,value:string>>"


def strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def _blank(text: Column) -> Column:
    return text.isNull() | (F.btrim(text, F.lit(TRIM_END)) == "")


def unsafe(pattern: Column) -> Column:
    found = F.lit(False)
    for part in UNSAFE_PARTS:
        found = found | pattern.contains(part)
    return found


def valid_file_pattern(pattern: Column) -> Column:
    by_extension = F.lower(F.substring(pattern, F.lit(2), F.length(pattern))).isin(ALLOWED_EXTENSIONS)
    return F.when(pattern.startswith("*."), by_extension).otherwise(pattern.rlike(PATTERN_RULE))


def valid_filter_name(name: Column) -> Column:
    return ~_blank(name) & (F.length(name) <= MAX_FILTER_NAME) & name.rlike(NAME_RULE)


def valid_filter_pattern(pattern: Column) -> Column:
    return ~_blank(pattern) & (F.length(pattern) <= MAX_FILTER_PATTERN) & ~unsafe(pattern)


def _finding(rule: str, value: Column) -> Column:
    return F.struct(F.lit(rule).alias("rule"), value.cast("string").alias("value"))


def _each(items: Column, rule: str, bad, value=lambda x: x) -> Column:
    return F.transform(F.filter(items, bad), lambda x: _finding(rule, value(x)))


def _once(condition: Column, rule: str, value: Column) -> Column:
    return F.when(condition, F.array(_finding(rule, value))).otherwise(F.array().cast(FINDINGS))


def _report(df: DataFrame, key: str, findings: list[Column]) -> DataFrame:
    listed = F.concat(*[f.cast(FINDINGS) for f in findings])
    return df.select(key, F.explode(listed).alias("f")).select(key, "f.rule", "f.value")


def _watch_findings() -> list[Column]:
    patterns, excludes, filters = F.col("file_patterns"), F.col("exclude_patterns"), F.col("custom_filters")
    filled = F.filter(patterns, lambda p: ~_blank(p))
    size = F.col("max_file_size")
    named = F.filter(filters, lambda f: ~_blank(f["name"]))
    covered = F.flatten(
        F.transform(
            F.filter(patterns, lambda p: p.startswith("*.")),
            lambda p: F.transform(
                F.filter(excludes, lambda e: F.lower(e).contains(F.lower(F.substring(p, F.lit(2), F.length(p))))),
                lambda e: _finding("covered by exclude", F.concat(p, F.lit(" by "), e)),
            ),
        )
    )
    none = F.lit("")
    return [
        _once(F.size(patterns) == 0, "no file pattern", none),
        _each(patterns, "blank file pattern", _blank),
        _each(filled, "invalid file pattern", lambda p: ~valid_file_pattern(p)),
        _each(filled, "unsafe file pattern", unsafe),
        _each(excludes, "unsafe exclude pattern", lambda p: ~_blank(p) & unsafe(p)),
        _each(excludes, "long exclude pattern", lambda p: ~_blank(p) & (F.length(p) > MAX_EXCLUDE)),
        _once(size <= 0, "size not positive", size),
        _once(size > MAX_FILE_SIZE, "size above limit", size),
        _each(filters, "blank filter name", lambda f: _blank(f["name"]), lambda f: f["name"]),
        _each(named, "invalid filter name", lambda f: ~valid_filter_name(f["name"]), lambda f: f["name"]),
        _each(named, "invalid filter pattern", lambda f: ~valid_filter_pattern(f["pattern"]), lambda f: f["pattern"]),
        covered,
    ]


def audit_watch(configs: DataFrame, key: str = "config_id") -> DataFrame:
    """(key, rule, value) per finding in a watch configuration."""
    return _report(configs, key, _watch_findings())


def watch_is_valid() -> Column:
    """True for a row without findings."""
    return F.size(F.concat(*[f.cast(FINDINGS) for f in _watch_findings()])) == 0


def _metadata_findings() -> list[Column]:
    kind, priority, tags, settings = (F.col(c) for c in ("project_type", "priority", "tags", "custom_settings"))
    filled = F.filter(tags, lambda t: ~_blank(t))
    pairs = F.map_entries(settings)
    keyed = F.filter(pairs, lambda s: ~_blank(s["key"]))
    none = F.lit("")
    return [
        _once(_blank(kind), "blank project type", none),
        _once(~_blank(kind) & ~F.lower(kind).isin(PROJECT_TYPES), "unknown project type", kind),
        _once((priority != "") & ~F.lower(priority).isin(PRIORITIES), "unknown priority", priority),
        _each(tags, "blank tag", _blank),
        _each(filled, "long tag", lambda t: F.length(t) > MAX_TAG),
        _each(filled, "invalid tag", lambda t: ~t.rlike(TAG_RULE)),
        _once(F.size(settings) > MAX_SETTINGS, "too many settings", F.size(settings)),
        _each(pairs, "blank setting key", lambda s: _blank(s["key"]), lambda s: s["key"]),
        _each(keyed, "long setting key", lambda s: F.length(s["key"]) > MAX_SETTING_KEY, lambda s: s["key"]),
        _each(keyed, "large setting value", lambda s: F.length(s["value"]) > MAX_SETTING_VALUE, lambda s: s["key"]),
    ]


def all_findings() -> Column:
    """The findings of a row that holds a watch configuration and metadata, as one array."""
    return F.concat(*[f.cast(FINDINGS) for f in _watch_findings() + _metadata_findings()])


def audit_metadata(rows: DataFrame, key: str = "config_id") -> DataFrame:
    return _report(rows, key, _metadata_findings())


def audit_json(rows: DataFrame, column: str, key: str = "config_id") -> DataFrame:
    """Text that is blank, no JSON, too long or nested too deep."""
    doc = F.col(column)
    judged = rows.withColumn("_ok", ~_blank(doc) & J.is_valid(doc)).withColumn("_depth", F.when(F.col("_ok"), J.depth(doc)))
    return _report(
        judged,
        key,
        [
            _once(_blank(doc), "blank JSON", F.lit("")),
            _once(~_blank(doc) & ~F.col("_ok"), "invalid JSON", F.lit("")),
            _once(F.col("_ok") & (F.length(doc) > MAX_JSON_CHARS), "JSON too long", F.length(doc)),
            _once(F.col("_depth") > MAX_JSON_DEPTH, "JSON too deep", F.col("_depth")),
        ],
    )


def audit_presets(presets: DataFrame, key: str = "config_id") -> DataFrame:
    size = F.col("max_file_size")
    no_watch = F.col("file_patterns").isNull()
    return _report(
        presets,
        key,
        [
            _once(_blank(F.col("name")), "blank name", F.lit("")),
            _once(no_watch, "no watch configuration", F.lit("")),
            _once(~no_watch & (F.size("file_patterns") == 0), "no file pattern", F.lit("")),
            _once(~no_watch & (size <= 0), "size not positive", size),
            _once(F.col("project_type").isNull(), "no metadata", F.lit("")),
        ],
    )


def clean_config(configs: DataFrame) -> DataFrame:
    """Trimmed, valid and distinct lists, a capped size, what was removed, and `changed`."""

    def trimmed(items: Column) -> Column:
        return F.transform(items, lambda p: F.btrim(p, F.lit(TRIM_END)))

    def good_pattern(p: Column) -> Column:
        return (p != "") & ~unsafe(p) & valid_file_pattern(p)

    def good_exclude(p: Column) -> Column:
        return (p != "") & ~unsafe(p)

    def good_filter(f: Column) -> Column:
        return valid_filter_name(f["name"]) & valid_filter_pattern(f["pattern"])

    patterns, excludes, filters = F.col("file_patterns"), F.col("exclude_patterns"), F.col("custom_filters")
    clean_patterns = F.array_distinct(F.filter(trimmed(patterns), good_pattern))
    clean_excludes = F.array_distinct(F.filter(trimmed(excludes), good_exclude))
    clean_filters = F.transform(
        F.filter(filters, good_filter),
        lambda f: F.struct(
            F.btrim(f["name"], F.lit(TRIM_END)).alias("name"),
            F.btrim(f["pattern"], F.lit(TRIM_END)).alias("pattern"),
            f["enabled"].alias("enabled"),
        ),
    )
    removed = F.concat(
        F.filter(patterns, lambda p: ~good_pattern(F.btrim(p, F.lit(TRIM_END)))),
        F.filter(excludes, lambda p: ~good_exclude(F.btrim(p, F.lit(TRIM_END)))),
        F.transform(F.filter(filters, lambda f: ~good_filter(f)), lambda f: f["name"]),
    )
    size = F.least(F.col("max_file_size"), F.lit(MAX_FILE_SIZE))
    changed = (
        ~clean_patterns.eqNullSafe(patterns)
        | ~clean_excludes.eqNullSafe(excludes)
        | ~size.eqNullSafe(F.col("max_file_size"))
    )
    return configs.withColumns(
        {
            "file_patterns": clean_patterns,
            "exclude_patterns": clean_excludes,
            "custom_filters": clean_filters,
            "max_file_size": size,
            "removed": removed,
            "changed": changed,
        }
    )


def _per_type(kind: Column, lists: dict[str, list[str]], other: list[str]) -> Column:
    chosen = strings(other)
    for name, values in lists.items():
        chosen = F.when(F.lower(kind) == name, strings(values)).otherwise(chosen)
    return chosen


def common_excludes(kind: Column) -> Column:
    lists = {name: COMMON_EXCLUDES + more for name, more in TYPE_EXCLUDES.items()}
    return _per_type(kind, lists, COMMON_EXCLUDES)


def missing_excludes(kind: Column, excludes: Column) -> Column:
    """Common excludes that are not listed, ignoring case."""
    lowered = F.transform(excludes, lambda e: F.lower(e))
    return bind(lowered, lambda present: F.filter(common_excludes(kind), lambda c: ~F.array_contains(present, F.lower(c))))


def suggestions(configs: DataFrame, key: str = "config_id") -> DataFrame:
    """(key, rule, value) per suggestion; needs `project_type`."""
    kind = F.col("project_type")
    missing = missing_excludes(kind, F.col("exclude_patterns"))
    defaults = _per_type(kind, DEFAULT_PATTERNS, OTHER_PATTERNS)
    count = F.size("file_patterns")
    return _report(
        configs,
        key,
        [
            _once(count == 0, "warning: add file patterns", F.array_join(defaults, ",")),
            _once(F.size(missing) > 0, "info: add excludes", F.array_join(missing, ",")),
            _once(F.col("max_file_size") > LARGE_FILE_SIZE, "warning: lower the size limit", F.lit(USUAL_FILE_SIZE)),
            _once(count > MANY_PATTERNS, "performance: merge patterns", F.lit("")),
        ],
    )


def list_difference(old: Column, new: Column) -> tuple[Column, Column]:
    """Added and removed items, each once."""
    return F.array_except(new, old), F.array_except(old, new)


def diff_configs(old: DataFrame, new: DataFrame, key: str = "config_id") -> DataFrame:
    """One row per changed property: key, property, old and new value, added and removed items."""
    lists = {"FilePatterns": "file_patterns", "ExcludePatterns": "exclude_patterns"}
    scalars = {"IsEnabled": "is_enabled", "MaxFileSize": "max_file_size", "IncludeSubdirectories": "include_subdirectories"}
    columns = list(lists.values()) + list(scalars.values())
    before = old.select(key, *[F.col(c).alias("_old_" + c) for c in columns])
    after = new.select(key, *[F.col(c).alias("_new_" + c) for c in columns])
    kind = "array<struct<property:string,old:string,new:string,added:array<string>,removed:array<string>>>"
    none = strings([])
    parts = []

    def part(name: str, a: Column, b: Column, added: Column, removed: Column) -> Column:
        return F.struct(F.lit(name).alias("property"), a.alias("old"), b.alias("new"), added.alias("added"), removed.alias("removed"))

    for name, c in lists.items():
        a, b = F.col("_old_" + c), F.col("_new_" + c)
        added, removed = list_difference(a, b)
        differs = (F.size(added) > 0) | (F.size(removed) > 0)
        row = part(name, F.array_join(a, ","), F.array_join(b, ","), added, removed)
        parts.append(F.when(differs, F.array(row)).otherwise(F.array().cast(kind)))
    for name, c in scalars.items():
        a, b = F.col("_old_" + c), F.col("_new_" + c)
        row = part(name, a.cast("string"), b.cast("string"), none, none)
        parts.append(F.when(~a.eqNullSafe(b), F.array(row)).otherwise(F.array().cast(kind)))
    joined = before.join(after, key)
    return joined.select(key, F.explode(F.concat(*[p.cast(kind) for p in parts])).alias("d")).select(key, "d.*")


def apply_configs(current: DataFrame, wanted: DataFrame, key: str = "config_id", validate_only: bool = False):
    """Validated update of watch configurations.

    Gives (applied table, backup of the rows that change, findings of refused rows).  A refused
    row changes nothing; with `validate_only` nothing changes at all.
    """
    from snipdex.operators.registry import patch

    findings = audit_watch(wanted, key)
    accepted = wanted.filter(watch_is_valid()).join(current.select(key), key, "left_semi")
    if validate_only:
        accepted = accepted.filter(F.lit(False))
    backup = current.join(accepted.select(key), key, "left_semi")
    return patch(current, accepted, key), backup, findings
