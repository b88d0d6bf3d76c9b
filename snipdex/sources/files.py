"""Source trees as DataFrames."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from snipdex.sources import tree

SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:/*"


def _bare(path: str) -> str:
    return "/" + re.sub(SCHEME, "", path).strip("/")


def _text(content: Column) -> Column:
    """UTF-8 text; damaged bytes become replacement characters, a byte-order mark is dropped."""
    return F.regexp_replace(F.make_valid_utf8(content.cast("string")), "^﻿", "")


def _scan(spark: SparkSession, root: str, include: Sequence[str], exclude: Sequence[str], recursive: bool, max_size: int | None, library: str | None) -> DataFrame:
    """What `scan_files` gives, with the content and the reason why there is none."""
    tree.register(spark)
    reader = spark.read.format("source_tree").option("path", root).option("recursive", str(recursive).lower())
    reader = reader.option("include", json.dumps(list(include))).option("exclude", json.dumps(list(exclude)))
    if max_size is not None:
        reader = reader.option("max_size", str(max_size))
    listing = reader.load() if include else reader.load().limit(0)
    base = _bare(root)
    return listing.select(
        F.lit(library or base.rsplit("/", 1)[-1]).alias("library"),
        F.lit(base).alias("root"),
        F.concat(F.lit(base + "/"), "rel_path").alias("path"),
        "rel_path",
        "size",
        "modified",
        "content",
        "error",
    )


def scan_files(
    spark: SparkSession,
    root: str,
    include: Sequence[str],
    exclude: Sequence[str] = (),
    recursive: bool = True,
    max_size: int | None = None,
    library: str | None = None,
) -> DataFrame:
    """Files below a root that pass the patterns, read whole; `unread_files` tells what could not be read.

    Excluded folders are not entered, and patterns and size limits are applied to the listing, so other files are not
    opened.  Gives (library, root, path, rel_path, size, modified, text, content_hash).
    """
    rows = _scan(spark, root, include, exclude, recursive, max_size, library).filter("error IS NULL")
    return rows.withColumns({"text": _text(F.col("content")), "content_hash": F.sha2("content", 256)}).drop("content", "error")


def unread_files(
    spark: SparkSession, root: str, include: Sequence[str], exclude: Sequence[str] = (), recursive: bool = True, max_size: int | None = None, library: str | None = None
) -> DataFrame:
    """(library, root, path, rel_path, size, modified, error) of files that pass but cannot be read, or are too large for a row."""
    return _scan(spark, root, include, exclude, recursive, max_size, library).filter("error IS NOT NULL").drop("content")


def list_files(spark: SparkSession, root: str, exclude: Sequence[str] = (), recursive: bool = True) -> DataFrame:
    """(rel_path, name, size, modified) of all files outside of excluded folders; none is opened."""
    tree.register(spark)
    reader = spark.read.format("source_tree").option("path", root).option("recursive", str(recursive).lower()).option("exclude", json.dumps(list(exclude)))
    return reader.option("content", "false").load().select("rel_path", "name", "size", "modified")


def scan_patterns(spark: SparkSession, root: str, patterns: Sequence[str], recursive: bool = True) -> DataFrame:
    """Files that match any of the patterns, each once, from one scan."""
    return scan_files(spark, root, list(patterns), recursive=recursive)
