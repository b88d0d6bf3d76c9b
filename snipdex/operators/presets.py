"""Configuration presets: the built-in table, lookup, recommendation and merging."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from snipdex.functions.rules import CATEGORY_BY_TYPE

# Id, name, framework, file patterns, exclude patterns
BUILT_IN = [
    ("csharp", "C# Project", "dotnet",
     ["*.cs", "*.csx", "*.cshtml", "*.razor"],
     ["bin", "obj", ".vs", ".git", "packages", "*.user"]),
    ("typescript", "TypeScript Project", "node",
     ["*.ts", "*.tsx", "*.js", "*.jsx"],
     ["node_modules", "dist", "build", ".git", "coverage", "*.d.ts"]),
    ("javascript", "JavaScript Project", "node",
     ["*.js", "*.jsx", "*.mjs", "*.vue"],
     ["node_modules", "dist", "build", ".git", "coverage"]),
    ("python", "Python Project", "python",
     ["*.py", "*.pyi", "*.pyx", "*.ipynb"],
     ["__pycache__", ".venv", "venv", ".git", "dist", "build", "*.pyc"]),
    ("java", "Java Project", "jvm",
     ["*.java", "*.kt", "*.scala"],
     ["target", "build", ".git", "*.class", ".gradle"]),
    ("cpp", "C++ Project", "native",
     ["*.cpp", "*.c", "*.h", "*.hpp", "*.cc", "*.cxx"],
     ["build", "Debug", "Release", ".git", "*.o", "*.obj"]),
    ("go", "Go Project", "go",
     ["*.go"],
     ["vendor", ".git", "bin"]),
    ("rust", "Rust Project", "rust",
     ["*.rs"],
     ["target", ".git", "Cargo.lock"]),
    ("mixed", "Mixed Project", "mixed",
     ["*.cs", "*.ts", "*.js", "*.py", "*.java", "*.cpp", "*.h", "*.go", "*.rs"],
     ["bin", "obj", "node_modules", "__pycache__", "target", "build", ".git"]),
]
DEFAULT_TEAM = "default"
DEFAULT_PRIORITY = "normal"
DEFAULT_MODEL = "text-embedding-3-small"
RECOMMENDED = 3

PRESET = (
    "preset_id string, name string, project_type string, category string, framework string, is_built_in boolean, "
    "tags array<string>, file_patterns array<string>, exclude_patterns array<string>, "
    "include_subdirectories boolean, is_enabled boolean, max_file_size bigint"
)


def built_in_presets(spark: SparkSession) -> DataFrame:
    rows = [
        (kind, name, kind, CATEGORY_BY_TYPE[kind], framework, True, ["built-in", kind], include, exclude, True, True, 10 << 20)
        for kind, name, framework, include, exclude in BUILT_IN
    ]
    return spark.createDataFrame(rows, PRESET)


def all_presets(spark: SparkSession, custom: DataFrame | None = None) -> DataFrame:
    base = built_in_presets(spark)
    return base if custom is None else base.unionByName(custom, allowMissingColumns=True)


def recommended_settings(types: DataFrame, spark: SparkSession, column: str = "project_type") -> DataFrame:
    """Watch configuration and metadata for detected types; an unknown type gets the mixed set."""
    known = [b[0] for b in BUILT_IN]
    table = built_in_presets(spark).select(
        F.col("preset_id").alias("_id"), "framework", "file_patterns", "exclude_patterns", "max_file_size"
    )
    keyed = types.withColumn("_id", F.when(F.col(column).isin(known), F.col(column)).otherwise("mixed"))
    return keyed.join(F.broadcast(table), "_id").drop("_id").withColumns(
        {
            "team": F.lit(DEFAULT_TEAM),
            "priority": F.lit(DEFAULT_PRIORITY),
            "tags": F.array(F.lit("auto-detected"), F.col(column)),
            "embedding_model": F.lit(DEFAULT_MODEL),
        }
    )


def lookup(requests: DataFrame, presets: DataFrame, column: str = "preset_id") -> DataFrame:
    """Presets by id, ignoring case; unknown ids give no row, and a built-in preset wins."""
    first = presets.withColumn("_key", F.lower("preset_id")).groupBy("_key").agg(
        F.max_by(F.struct(*presets.columns), F.struct("is_built_in", "name")).alias("_p")
    )
    asked = requests.withColumnRenamed(column, "_asked").withColumn("_key", F.lower("_asked"))
    return asked.join(first, "_key").drop("_key", "_asked").select("*", "_p.*").drop("_p")


def recommend(requests: DataFrame, presets: DataFrame, n: int = RECOMMENDED, column: str = "project_type") -> DataFrame:
    """The first n presets whose type or tag equals the asked type: built-in first, then by name."""
    asked = requests.select(F.lower(column).alias("asked")).distinct()
    kinds = F.array_distinct(F.transform(F.array_append(F.col("tags"), F.col("project_type")), lambda t: F.lower(t)))
    offered = presets.select("preset_id", "name", "is_built_in", F.explode(kinds).alias("asked"))
    order = Window.partitionBy("asked").orderBy(F.desc("is_built_in"), "name", "preset_id")
    matched = offered.join(asked, "asked", "left_semi")
    return matched.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n)


def merged_patterns(members: DataFrame, group: str, position: str) -> DataFrame:
    """Union of the pattern lists of a group: one row per list and pattern, in first-seen order.

    A pattern counts once per group before anything is gathered, so the result grows with the
    distinct patterns and not with the presets.
    """
    def listed(kind: str):
        return F.transform(
            F.coalesce(kind, F.array().cast("array<string>")),
            lambda p, i: F.struct(F.lit(kind).alias("kind"), i.alias("_i"), p.alias("pattern")),
        )

    both = F.concat(listed("file_patterns"), listed("exclude_patterns"))
    rows = members.select(group, F.col(position).alias("_pos"), F.explode(both).alias("p")).select(group, "_pos", "p.*")
    return rows.groupBy(group, "kind", "pattern").agg(F.min(F.struct("_pos", "_i")).alias("first_seen"))


def merge_presets(members: DataFrame, group: str, position: str) -> DataFrame:
    """One configuration per group: united lists, and flags of the last member."""
    united = merged_patterns(members, group, position)

    def listed(kind: str):
        rows = F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.struct("first_seen", "pattern"))))
        return F.transform(rows, lambda r: r["pattern"]).alias(kind)

    lists = united.groupBy(group).agg(listed("file_patterns"), listed("exclude_patterns"))
    flags = members.groupBy(group).agg(
        *[F.max_by(c, position).alias(c) for c in ("include_subdirectories", "is_enabled", "max_file_size")]
    )
    empty = F.array().cast("array<string>")
    joined = flags.join(lists, group, "left")
    return joined.withColumns({c: F.coalesce(c, empty) for c in ("file_patterns", "exclude_patterns")})
