"""Profiles of file listings: types, structure, advice and project-type detection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snipdex.functions import paths as P
from snipdex.functions.text import bind

# Evidence weights. `any` looks at all files, `root` at top-level files,
# `share` adds a hundredth per file with one of the extensions up to its limit.
EVIDENCE = {
    "csharp": {"any": [(["*.csproj"], 0.8), (["*.sln"], 0.3)], "root": [], "share": ([".cs"], 0.5)},
    "typescript": {"any": [], "root": [(["tsconfig.json"], 0.8), (["package.json"], 0.3)], "share": ([".ts", ".tsx"], 0.6)},
    "javascript": {"any": [], "root": [(["package.json"], 0.6)], "share": ([".js"], 0.5)},
    "python": {
        "any": [],
        "root": [(["requirements.txt"], 0.4), (["setup.py"], 0.4), (["pyproject.toml"], 0.4), (["Pipfile"], 0.4)],
        "share": ([".py"], 0.6),
    },
    "java": {"any": [], "root": [(["pom.xml"], 0.6), (["build.gradle"], 0.6), (["build.xml"], 0.6)], "share": ([".java"], 0.5)},
    "cpp": {"any": [], "root": [(["CMakeLists.txt", "Makefile"], 0.6)], "share": ([".cpp", ".c", ".h"], 0.5)},
    "go": {"any": [], "root": [(["go.mod"], 0.8)], "share": ([".go"], 0.5)},
    "rust": {"any": [], "root": [(["Cargo.toml"], 0.8)], "share": ([".rs"], 0.5)},
}
MIXED_SHARE = 0.8

# Advice limits
MANY_FILES = 10_000
LARGE_BYTES = 1 << 30
MANY_LOGS = 100
SUGGESTED_EXCLUDES = ["node_modules", "bin", "obj"]


def file_type_profile(files: DataFrame, group: str = "library") -> DataFrame:
    """Files and bytes per extension."""
    return files.groupBy(group, P.extension(F.col("rel_path")).alias("extension")).agg(
        F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes")
    )


def _directories(folder: Column) -> Column:
    """A directory and every directory above it, relative to the library."""
    return bind(
        F.split(folder, "/"),
        lambda names: F.transform(names, lambda _, i: F.array_join(F.slice(names, F.lit(1), i + 1), "/")),
    )


def structure_profile(files: DataFrame, group: str = "library") -> DataFrame:
    """Totals, directory facts, suggested excludes and advice per library.

    Directories are made distinct per library before they are counted, so a library with very
    many files is reduced where its rows are.
    """
    totals = files.groupBy(group).agg(
        F.count(F.lit(1)).alias("total_files"),
        F.sum("size").alias("total_bytes"),
        F.count_if(P.extension(F.col("rel_path")) == ".log").alias("log_files"),
    )
    folders = files.select(group, P.parent_path(F.col("rel_path")).alias("_d")).distinct()
    folders = folders.select(group, F.explode(_directories(F.col("_d"))).alias("_d")).distinct()
    name = P.file_name(F.col("_d"))
    facts = folders.groupBy(group).agg(
        F.count(F.lit(1)).alias("directories"),
        F.bool_or(F.lower(name).contains("test")).alias("has_tests"),
        F.bool_or(F.lower(name).contains("doc")).alias("has_docs"),
        *[F.bool_or(name == d).alias(f"_has_{d}") for d in SUGGESTED_EXCLUDES],
    )
    joined = totals.join(facts, group, "left")
    suggested = F.array_compact(F.array(*[F.when(F.col(f"_has_{d}"), d) for d in SUGGESTED_EXCLUDES]))
    no_folders = {"directories": 0, "has_tests": False, "has_docs": False}
    return (
        joined.withColumn("suggested_excludes", suggested)
        .withColumn("advice", structure_advice())
        .fillna(no_folders)
        .drop(*[f"_has_{d}" for d in SUGGESTED_EXCLUDES])
    )


def structure_advice(many: int = MANY_FILES, large: int = LARGE_BYTES, logs: int = MANY_LOGS) -> Column:
    """Advice codes from total_files, total_bytes and log_files."""
    return F.array_compact(
        F.array(
            F.when(F.col("total_files") > many, "add_excludes"),
            F.when(F.col("total_bytes") > large, "lower_size_limit"),
            F.when(F.col("log_files") > logs, "exclude_logs"),
        )
    )


def evidence_scores(files: DataFrame, group: str = "library") -> DataFrame:
    """One row per library with `scores`: the types with a score above 0, best first, and what speaks for each.

    All measures come from one aggregation.  Equal scores keep the order of the evidence table.
    """
    path = F.col("rel_path")
    ext, name, at_root = P.extension(path), P.file_name(path), ~path.contains("/")
    measures = []
    for kind, rules in EVIDENCE.items():
        for n, (patterns, _) in enumerate(rules["any"]):
            measures.append(F.bool_or(path.rlike(P.glob_regex(["**/" + p for p in patterns]))).alias(f"{kind}_any{n}"))
        for n, (names, _) in enumerate(rules["root"]):
            measures.append(F.bool_or(at_root & name.isin(names)).alias(f"{kind}_root{n}"))
        measures.append(F.count_if(ext.isin(rules["share"][0])).alias(f"{kind}_n"))
    wide = files.groupBy(group).agg(*measures)
    listed = []
    for place, (kind, rules) in enumerate(EVIDENCE.items()):
        score = F.least(F.lit(rules["share"][1]), F.col(f"{kind}_n") * F.lit(0.01))
        for slot in ("any", "root"):
            for n, (_, weight) in enumerate(rules[slot]):
                score = score + F.when(F.col(f"{kind}_{slot}{n}"), weight).otherwise(0.0)
        score = F.round(F.least(F.lit(1.0), score), 6)
        seen = [F.when(F.col(f"{kind}_{slot}{n}"), " or ".join(names)) for slot in ("any", "root") for n, (names, _) in enumerate(rules[slot])]
        many = F.concat(F.col(f"{kind}_n").cast("string"), F.lit(" files " + " ".join(rules["share"][0])))
        evidence = F.array_compact(F.array(*seen, F.when(F.col(f"{kind}_n") > 0, many)))
        listed.append(
            F.struct((-score).alias("order"), F.lit(place).alias("place"), F.lit(kind).alias("project_type"), score.alias("score"), evidence.alias("evidence"))
        )
    scores = F.sort_array(F.filter(F.array(*listed), lambda s: s["score"] > 0))
    return wide.select(group, scores.alias("scores"))


def detect_project_type(files: DataFrame, group: str = "library") -> DataFrame:
    """Project type, confidence, up to three alternatives and the evidence of all types found, per library.

    All types within 0.8 of the best make a mixed project with their mean score.
    """
    ranked = evidence_scores(files, group)
    top = F.get("scores", F.lit(0))
    close = F.filter("scores", lambda s: s["score"] >= F.round(top["score"] * MIXED_SHARE, 6))
    total = F.aggregate(close, F.lit(0.0), lambda acc, s: acc + s["score"])
    judged = ranked.withColumns({"_close": F.size(close), "_mean": F.try_divide(total, F.size(close))})
    kind = (
        F.when(F.size("scores") == 0, "unknown").when(F.col("_close") > 1, "mixed").otherwise(top["project_type"])
    )
    others = F.transform(F.slice("scores", 2, 3), lambda s: s["project_type"])
    return judged.select(
        group,
        kind.alias("project_type"),
        F.round(F.coalesce("_mean", F.lit(0.0)), 6).alias("confidence"),
        others.alias("alternatives"),
        F.flatten(F.transform("scores", lambda s: F.transform(s["evidence"], lambda e: F.concat(s["project_type"], F.lit(": "), e)))).alias("evidence"),
    )


def detect_by_marker(files: DataFrame, group: str = "library") -> DataFrame:
    """The light form: the first marker file at the top level decides."""
    path = F.col("rel_path")
    top = ~path.contains("/")
    marks = files.groupBy(group).agg(
        F.bool_or(top & P.extension(path).isin(".csproj")).alias("cs"),
        F.bool_or(top & (path == "package.json")).alias("ts"),
        F.bool_or(top & (path == "requirements.txt")).alias("py"),
    )
    kind = F.when(F.col("cs"), "csharp").when(F.col("ts"), "typescript").when(F.col("py"), "python").otherwise("mixed")
    return marks.select(group, kind.alias("project_type"))
