"""Path, extension, glob and language expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from snipdex.functions.text import bind

# Language id by file extension
LANGUAGE_BY_EXTENSION = {
    ".cs": "csharp",
    ".py": "python",
    ".js": "javascript",
    ".jsx": "javascript",
    ".mjs": "javascript",
    ".cjs": "javascript",
    ".ts": "typescript",
    ".tsx": "typescript",
    ".cshtml": "cshtml",
}

# Id, display name, main extension, MIME type
LANGUAGES = [
    ("csharp", "C#", ".cs", "text/x-csharp"),
    ("python", "Python", ".py", "text/x-python"),
    ("javascript", "JavaScript", ".js", "text/javascript"),
    ("typescript", "TypeScript", ".ts", "text/typescript"),
    ("cshtml", "CSHTML", ".cshtml", "application/x-cshtml"),
]

COLLECTION_PREFIX = "code_index_"


def literal_map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def forward_slashes(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def _without_dots(path: Column) -> Column:
    """Drop empty and `.` segments and let `..` remove the segment before it."""
    rooted = path.startswith("/")
    parts = F.aggregate(
        F.split(path, "/"),
        F.array().cast("array<string>"),
        lambda acc, s: F.when((s == "") | (s == "."), acc)
        .when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.concat(acc, F.array(s))),
    )
    return F.concat(F.when(rooted, F.lit("/")).otherwise(F.lit("")), F.array_join(parts, "/"))


def normalize_path(path: Column) -> Column:
    """Lower-cased, forward slashes, no dot segments, no trailing slash."""
    slashed = F.lower(forward_slashes(path))
    messy = slashed.rlike("(^|/)\\.{0,2}(/|$)") & (slashed != "/")
    return F.when(messy, _without_dots(slashed)).otherwise(slashed)


def collection_name(path: Column) -> Column:
    return F.concat(F.lit(COLLECTION_PREFIX), F.substring(F.sha2(normalize_path(path), 256), 1, 8))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(forward_slashes(path), "/"), -1)


def extension(path: Column) -> Column:
    """Last dot of the file name and what follows, lower-cased; empty without one."""
    return F.lower(F.regexp_extract(path, "(\\.[^./\\\\]+)$", 1))


def file_stem(path: Column) -> Column:
    name = file_name(path)
    return F.regexp_replace(name, "\\.[^.]*$", "")


def parent_path(path: Column) -> Column:
    """Directory of a path; the root's own directory is NULL."""
    cut = F.regexp_replace(path, "/[^/]*$", "")
    inner = F.when(cut == "", F.lit("/")).otherwise(cut)
    return F.when(path.isNull() | (path == "/") | ~path.contains("/"), None).otherwise(inner)


def ancestors(path: Column) -> Column:
    """The path itself and every directory above it, without the bare root."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    return bind(
        parts,
        lambda names: F.transform(
            names, lambda _, i: F.concat(F.lit("/"), F.array_join(F.slice(names, F.lit(1), i + 1), "/"))
        ),
    )


def is_subdirectory(child: Column, parent: Column) -> Column:
    base = F.rtrim(parent, F.lit("/"))
    return child.startswith(F.concat(base, F.lit("/")))


def relative_path(full: Column, base: Column) -> Column:
    root = F.rtrim(base, F.lit("/"))
    return F.when(
        is_subdirectory(full, base), F.substring(full, F.length(root) + 2, F.length(full))
    ).otherwise(full)


def directory_depth(child: Column, parent: Column) -> Column:
    """Segments below the parent, 0 for the parent itself, -1 elsewhere."""
    rest = F.rtrim(relative_path(child, parent), F.lit("/"))
    return (
        F.when(F.rtrim(child, F.lit("/")) == F.rtrim(parent, F.lit("/")), F.lit(0))
        .when(is_subdirectory(child, parent), F.size(F.split(rest, "/")))
        .otherwise(F.lit(-1))
    )


def detect_language(path: Column) -> Column:
    known = F.element_at(literal_map(LANGUAGE_BY_EXTENSION), extension(path))
    return F.coalesce(known, F.lit("unknown"))


def has_extension(path: Column, extensions: Sequence[str]) -> Column:
    return extension(path).isin([e.lower() for e in extensions])


def has_segment(path: Column, names: Sequence[str]) -> Column:
    """True when any path segment equals one of the names, ignoring case."""
    wanted = F.array(*[F.lit(n.lower()) for n in names]).cast("array<string>")
    return F.arrays_overlap(F.split(F.lower(path), "[/\\\\]"), wanted)


def _include_fixed(pattern: str, recursive: bool) -> str:
    flat = "/" not in pattern and "\\" not in pattern
    if recursive and flat and pattern.startswith("*."):
        return "**/" + pattern
    if pattern.startswith(".") and not set("*?") & set(pattern):
        return ("**/" if recursive else "") + "*" + pattern
    return pattern


def _exclude_fixed(pattern: str) -> str:
    return pattern if set("/\\*") & set(pattern) else f"**/{pattern}/**"


def glob_to_regex(pattern: str) -> str:
    """One glob as a regular expression without look-around, so any engine can run it."""
    out = []
    for token in re.findall(r"\*\*/|/\*\*$|\*\*|\*|\?|[^*?]+", pattern.replace("\\", "/").lstrip("/")):
        out.append(
            {"**/": "(?:[^/]+/)*", "/**": "/.+", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(token)
            or re.sub(r"([.+(){}\[\]^$|])", r"\\\1", token)
        )
    return "".join(out)


def glob_regex(patterns: Sequence[str]) -> str:
    return "(?i)^(?:" + "|".join(glob_to_regex(p) for p in patterns) + ")$"


def include_regex(include: Sequence[str], recursive: bool = True) -> str:
    return glob_regex([_include_fixed(p, recursive) for p in include])


def exclude_regex(exclude: Sequence[str]) -> str:
    return glob_regex([_exclude_fixed(p) for p in exclude])


def glob_match(
    rel_path: Column,
    include: Sequence[str],
    exclude: Sequence[str] = (),
    recursive: bool = True,
) -> Column:
    """Path below the library root matches an include and no exclude, ignoring case."""
    path = forward_slashes(rel_path)
    keep = path.rlike(include_regex(include, recursive)) if include else F.lit(False)
    return keep & ~path.rlike(exclude_regex(exclude)) if exclude else keep


def watch_match(path: Column, include: Sequence[str], exclude: Sequence[str] = ()) -> Column:
    """Looser rule: excludes match anywhere, includes match the end; no include keeps all."""
    low = F.lower(path)
    keep = F.lit(True)
    if include:
        tails = [p.lower().lstrip("*") for p in include]
        keep = low.endswith(tails[0])
        for tail in tails[1:]:
            keep = keep | low.endswith(tail)
    for part in exclude:
        keep = keep & ~low.contains(part.lower())
    return keep


def contains_match(path: Column, include: Sequence[str], exclude: Sequence[str] = ()) -> Column:
    """Loosest rule: the file name contains a pattern without its stars."""
    name = file_name(path)
    keep = F.lit(not include)
    for part in include:
        keep = keep | name.contains(part.replace("*", ""))
    for part in exclude:
        keep = keep & ~path.contains(part)
    return keep
