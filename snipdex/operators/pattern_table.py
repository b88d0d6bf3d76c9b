"""File filters whose patterns are a table: every library has its own includes and excludes.

Patterns are indexed by what a matching path must have: an extension, a file name, or a folder name that stands in the
pattern as it is. Paths give out the keys they have, and only patterns that share a key with a path are tried on it. So
one query filters the files of all libraries, however many patterns there are.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snipdex.functions import globs
from snipdex.functions import paths as P


def pattern_key(pattern: str) -> str:
    """What every path has that the glob matches: 'e:' and an extension, 'n:' and a name, 'd:' and a folder, or '*'."""
    parts = pattern.replace("\\", "/").lower().strip("/").split("/")
    plain = [not set("*?") & set(p) for p in parts]
    if plain[-1] and parts[-1]:
        return f"n:{parts[-1]}"
    ending = re.search(r"(\.[^.*?]+)$", parts[-1])
    if ending:
        return f"e:{ending[1]}"
    named = [p for p, is_plain in zip(parts[:-1], plain[:-1]) if is_plain and p]
    return f"d:{max(named, key=len)}" if named else "*"


def compile_patterns(patterns: DataFrame, recursive: bool = True) -> DataFrame:
    """Rows (library, kind, pattern, key, regex) of (library, kind, pattern), kind being include or exclude."""

    @F.pandas_udf("struct<key:string,regex:string>")
    def compiled(kinds, texts):
        import pandas as pd

        fixed = [P._include_fixed(t, recursive) if k == "include" else P._exclude_fixed(t) for k, t in zip(kinds, texts)]
        return pd.DataFrame({"key": [pattern_key(t) for t in fixed], "regex": [P.glob_regex([t]) for t in fixed]})

    rows = patterns.filter(F.trim("pattern") != "").select("library", "kind", F.trim("pattern").alias("pattern")).distinct()
    return rows.select("*", compiled("kind", "pattern").alias("c")).select("library", "kind", "pattern", "c.key", "c.regex")


def path_keys(path: Column) -> Column:
    """The keys that a path below its library has."""
    low = F.lower(P.forward_slashes(path))
    parts = F.split(low, "/")
    name = F.element_at(parts, -1)
    ending = F.regexp_extract(name, r"(\.[^.]+)$", 1)
    folders = F.transform(F.array_distinct(F.slice(parts, F.lit(1), F.size(parts) - 1)), lambda d: F.concat(F.lit("d:"), d))
    own = F.array(F.lit("*"), F.concat(F.lit("n:"), name), F.concat(F.lit("e:"), ending))
    return F.filter(F.concat(own, folders), lambda k: k != "e:")


def filter_by_patterns(files: DataFrame, patterns: DataFrame, recursive: bool = True) -> DataFrame:
    """The files (library, rel_path, ...) that an include of their own library matches and no exclude does.

    `patterns` has (library, kind, pattern). A library without an include keeps nothing.
    """
    ready = compile_patterns(patterns, recursive)
    places = files.select("library", "rel_path").distinct()
    keyed = places.select("library", "rel_path", F.explode(path_keys(F.col("rel_path"))).alias("key"))
    met = keyed.join(ready, ["library", "key"]).filter(F.expr("replace(rel_path, '\\\\', '/') RLIKE regex"))
    judged = met.groupBy("library", "rel_path").agg(F.bool_or(F.col("kind") == "include").alias("wanted"), F.bool_or(F.col("kind") == "exclude").alias("unwanted"))
    return files.join(judged.filter("wanted AND NOT unwanted").select("library", "rel_path"), ["library", "rel_path"], "left_semi").select(*files.columns)


def covered_patterns(patterns: DataFrame, recursive: bool = True) -> DataFrame:
    """Rows (library, pattern, exclude) of includes that can match nothing, since an exclude of the library covers them."""
    fix_include = F.pandas_udf(lambda s: s.map(lambda t: P._include_fixed(t, recursive)), "string")
    fix_exclude = F.pandas_udf(lambda s: s.map(P._exclude_fixed), "string")
    named = patterns.filter(F.trim("pattern") != "").select("library", "kind", F.trim("pattern").alias("pattern")).distinct()
    includes = named.filter("kind = 'include'").select("library", "pattern", fix_include("pattern").alias("narrow"))
    excludes = named.filter("kind = 'exclude'").select("library", F.col("pattern").alias("exclude"), fix_exclude("pattern").alias("wide"))
    pairs = includes.join(excludes, "library")
    # Libraries share most of their patterns: each different pair is judged once.
    judged = pairs.select("narrow", "wide").distinct().withColumn("covered", globs.covered_by(F.col("narrow"), F.col("wide"))).filter("covered")
    return pairs.join(judged, ["narrow", "wide"]).select("library", "pattern", "exclude")
