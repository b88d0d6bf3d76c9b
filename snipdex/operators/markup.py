"""Blocks of code embedded in markup, found inside the row without Python."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snipdex.functions import text as X


def embedded_blocks(pages: DataFrame, column: str, tags: Sequence[str]) -> DataFrame:
    """One row per non-blank block of the named elements, trimmed and numbered from 1."""
    names = "|".join(tags)
    pattern = F.lit(f"(?is)<({names})[^>]*>(.*?)</(?:{names})>")
    kinds = F.regexp_extract_all(column, pattern, F.lit(1))
    bodies = F.regexp_extract_all(column, pattern, F.lit(2))
    found = F.zip_with(
        kinds, bodies,
        lambda k, b: F.struct(F.lower(k).alias("kind"), F.btrim(b, F.lit(X.TRIM_END)).alias("code")),
    )
    kept = F.filter(found, lambda b: b["code"] != "")
    rows = pages.select(*pages.columns, F.posexplode(kept).alias("pos", "found"))
    return rows.select(*pages.columns, (F.col("pos") + 1).alias("block"), "found.kind", "found.code")
